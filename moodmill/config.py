"""Job settings as frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from moodmill.functions.patterns import SHORT_STOPS

ALL_STATS = ("avg", "sum", "min", "max", "amounts", "final")
#: What the lexicons of a kind can be asked for.
FAMILY_STATS = {
    "opinion": ALL_STATS,
    "emotion": ("avg", "sum", "min", "max", "amounts"),
    "tagged": ("avg", "sum", "min", "max", "amounts"),
    "synset": ("sum", "avg", "thresh", "decision"),
}


@dataclass(frozen=True)
class LexiconSpec:
    """How one lexicon is looked up and which statistics it yields."""

    name: str
    opinion: bool = True
    bigrams: bool = False
    trigrams: bool = False
    gapped: bool = False
    joiner: str = " "
    gap: str = "---"
    terms: bool = False
    stats: tuple[str, ...] = ALL_STATS
    dims: tuple[str, ...] = ()
    negated: bool = False
    keep_percent: float | None = None
    #: key of a tagged lexicon: ``dot`` for ``term.n``, ``hash`` for ``term#NOUN``
    tag_scheme: str | None = None
    #: a lexicon of senses: the ``first`` one of a word counts, or the ``mean`` of all
    senses: str | None = None
    #: objective score from which a sense is left out of the subjective averages
    thresh: float = 0.75

    @property
    def family(self) -> str:
        if self.senses:
            return "synset"
        if self.tag_scheme:
            return "tagged"
        return "opinion" if self.opinion else "emotion"

    def wanted(self) -> tuple[str, ...]:
        """The statistics it asks for; the default is all its family has."""
        served = FAMILY_STATS[self.family]
        if self.stats == ALL_STATS:
            return served
        unknown = [s for s in self.stats if s not in served]
        if unknown:
            raise ValueError(f"{self.name}: no statistic {', '.join(unknown)} for {self.family} lexicons")
        return self.stats

    def forms(self) -> tuple[str, ...]:
        out = ["tok"]
        out += [f"bi{self.joiner}"] if self.bigrams else []
        out += [f"tri{self.joiner}"] if self.trigrams else []
        out += [f"gap{self.gap}"] if self.gapped else []
        return tuple(out)

    def with_options(self, **changes) -> LexiconSpec:
        return replace(self, **changes)


_EMO = ("avg", "sum", "min", "max", "amounts")

# The lexicons in mask order, with the settings found best for each.
# The category sheet is the mask position after the last lexicon.
LEXICONS = (
    LexiconSpec("BING", negated=True),
    LexiconSpec("SWN", stats=("sum", "avg", "thresh", "decision"), negated=True, senses="first"),
    LexiconSpec(
        "MSOL", bigrams=True, trigrams=True, gapped=True, joiner="_", gap="-",
        terms=True, keep_percent=5,
    ),
    LexiconSpec("SSTREN", stats=("max",)),
    LexiconSpec("NRCHASH", gapped=True),
    LexiconSpec("SENT140", bigrams=True, trigrams=True, gapped=True),
    LexiconSpec("TSLEX", bigrams=True, trigrams=True),
    LexiconSpec("MPQA"),
    LexiconSpec("ANEW", terms=True, keep_percent=30),
    LexiconSpec(
        "WNA", opinion=False, bigrams=True, trigrams=True, joiner="_", terms=True,
        stats=_EMO, keep_percent=5,
    ),
    LexiconSpec(
        "DAL", opinion=False, bigrams=True, trigrams=True, stats=_EMO, dims=("pleasantness",)
    ),
    LexiconSpec(
        "SENTN", opinion=False, bigrams=True, trigrams=True, terms=True, stats=_EMO,
        keep_percent=15,
    ),
    LexiconSpec("EMOLX", opinion=False, stats=_EMO),
    LexiconSpec(
        "SENTS", opinion=False, joiner="_", stats=_EMO, dims=("sadness",), tag_scheme="dot"
    ),
    LexiconSpec(
        "LEW", opinion=False, bigrams=True, joiner="-", stats=_EMO, dims=("Evaluation",),
        tag_scheme="hash",
    ),
    LexiconSpec("EMOSNET", opinion=False, stats=_EMO, dims=("Disgust", "Joy")),
)
LEW_EMOTIONS = replace(next(s for s in LEXICONS if s.name == "LEW"), name="LEWEmo")
CATEGORY_SHEET = "LIWC"
MASK_ORDER = tuple(s.name for s in LEXICONS) + (CATEGORY_SHEET,)


@dataclass(frozen=True)
class CleanSpec:
    """Steps of a cleaning job; ``stops_first`` removes stop words before lowercasing."""

    tokenizer: str = "social"
    lower: bool = True
    negate: str | None = None
    stops: tuple[str, ...] | None = SHORT_STOPS
    stops_first: bool = False
    mentions: bool = True
    hashtags: bool = False
    urls: bool = True
    numbers: bool = True


@dataclass(frozen=True)
class BlockSpec:
    """Which feature blocks to build."""

    ngrams: bool = True
    char_ngrams: bool = True
    caps: bool = True
    mentions: bool = True
    hashtags: bool = True
    tags: bool = True
    punctuation: bool = True
    emoticons: bool = True
    elongated: bool = True
    clusters: bool = True
    scores: bool = True


@dataclass(frozen=True)
class ModelSpec:
    """A model of the registry by name, with its parameters."""

    name: str
    params: dict = field(default_factory=dict)
