"""The protected-span pattern of the social tokenizer, assembled from its classes.

All fragments are fixed values in ``patterns``; only their order is decided here.
"""

from __future__ import annotations

from collections.abc import Iterable

from moodmill.functions import patterns as P


def _any(parts: Iterable[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


def _face(name: str) -> str:
    """One-eyed symmetric face; the right eye repeats the left one (group ``name``)."""
    return f"(?:(?<{name}>{P.FACE_LEFT}){P.FACE_CENTER}\\k<{name}>)|{P.FACE_FLAT}"


def protected_pattern(tlds: Iterable[str] = P.COUNTRY_TLDS) -> str:
    """One Java pattern; the order of the alternatives decides between overlaps."""
    country = _any(tlds)
    domain = _any((_any(P.GENERIC_TLDS), country))
    host = f"{P.LINK_HOST}{domain}(?:\\.{country})?{P.LINK_HOST_END}"
    link = _any((P.LINK_SCHEME, host)) + P.LINK_PATH + P.LINK_END
    mouths = (P.FACE_TONGUE + P.FACE_END, P.FACE_OTHER + P.FACE_END, P.FACE_SAD, P.FACE_HAPPY)
    western = P.FACE_HAT + P.FACE_EYES + P.FACE_NOSE_OR_O + _any(mouths)
    turned = _any((P.FACE_SAD, P.FACE_HAPPY, P.FACE_OTHER))
    reversed_western = P.FACE_START + turned + P.FACE_NOSE + P.FACE_EYES + P.FACE_BEARD
    eastern = f"{P.FACE_EAST_LEFT}(?:{_face('east')}|{P.FACE_EAST_SYMBOL})+{P.FACE_EAST_RIGHT}"
    faces = _any((western, reversed_western, eastern, _face("plain"), P.FACE_TWO_O))
    return "(?U)" + _any(
        (
            P.HEARTS,
            link,
            P.EMAIL,
            P.CLOCK,
            P.THOUSANDS,
            P.DECIMAL,
            faces,
            P.ARROWS,
            P.ENTITY,
            P.MARK_RUNS,
            P.ABBREVIATION,
            P.SEPARATORS,
            P.DECORATIONS,
            P.APOSTROPHE_WORD,
            P.HASHTAG,
            P.MENTION,
        )
    )
