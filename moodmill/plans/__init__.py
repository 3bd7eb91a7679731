"""Registered queries over the given tables, each with its SQL counterpart where there is one."""

from moodmill.plans import (  # noqa: F401
    aligned,
    files,
    lexicon_set,
    lexicons,
    modeling,
    profiles,
    scoring,
    selection,
    texts,
)
from moodmill.plans.common import ORACLES, QUERIES  # noqa: F401
