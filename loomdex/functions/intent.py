"""Intents of a query: detection, signal weights, boosts and packing hints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLORE = "explore"
#: In order of precedence on ties; phrases are parted by commas.
KEYWORDS: dict[str, tuple[str, ...]] = {
    name: tuple(words.split(","))
    for name, words in {
        "debug": "bug,broken,crash,error,exception,fail,fix,issue,panic,wrong",
        "test": "assert,coverage,fixture,mock,spec,test,unit test,verify",
        "refactor": "extract,merge,move,refactor,rename,reorganize,restructure,split",
        "modify": "add,build,create,extend,feature,implement,integrate,new",
        "understand": "explain,how does,trace,understand,walk through,what is,why does",
    }.items()
}
SIGNALS = ("bm25", "tfidf", "centrality", "ngram", "semantic")


@dataclass(frozen=True)
class Intent:
    """Weights by signal without and with an encoder, and how a capsule is packed."""

    plain: tuple[float, ...]
    encoded: tuple[float, ...]
    depth: int = 2
    pivot_share: float = 0.85
    docs: bool = False

    def weights(self, encoder: bool) -> dict[str, float]:
        return dict(zip(SIGNALS, self.encoded if encoder else (*self.plain, 0.0), strict=True))



def _percent(plain: str, encoded: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    return tuple(int(x) / 100 for x in plain.split()), tuple(int(x) / 100 for x in encoded.split())


_COMMON = _percent("35 30 25 10", "30 25 20 10 15")
INTENTS = {
    "debug": Intent(*_COMMON, depth=3),
    "test": Intent(*_COMMON),
    "refactor": Intent(*_percent("25 25 35 15", "20 20 30 15 15"), depth=3, pivot_share=0.70),
    "modify": Intent(*_percent("30 30 30 10", "25 25 25 10 15")),
    "understand": Intent(*_percent("30 30 25 15", "25 25 20 10 20"), docs=True),
    EXPLORE: Intent(*_COMMON),
}


def detect(query: Column) -> Column:
    """The intent with most keywords in the query (as substrings); explore without any."""
    low = F.lower(F.coalesce(query, F.lit("")))
    counts = {name: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for name, words in KEYWORDS.items()}
    most = F.greatest(*counts.values())
    out = F.when(most == 0, EXPLORE)
    for name, n in counts.items():
        out = out.when(n == most, name)
    return out


def detect_one(query: str) -> str:
    """The same for one query on the driver."""
    low = query.lower()
    counts = {name: sum(w in low for w in words) for name, words in KEYWORDS.items()}
    best = max(counts.values())
    return next(name for name, n in counts.items() if n == best) if best else EXPLORE


def parse(name: str | None) -> str | None:
    """An intent's name in any case; None if there is no such intent."""
    return name.lower() if name and name.lower() in INTENTS else None


@dataclass(frozen=True)
class Traits:
    """What a boost may look at: columns of a symbol."""

    kind: Column
    path: Column
    exported: Column
    docstring: Column
    in_degree: Column

    def named(self, *words: str) -> Column:
        """Whether the kind has one of the words in it."""
        return sum((F.contains(F.lower(self.kind), F.lit(w)).cast("int") for w in words), F.lit(0)) > 0

    def called(self, least: int) -> Column:
        return self.in_degree >= least

    @property
    def documented(self) -> Column:
        return self.docstring.isNotNull() & (self.docstring != "")

    @property
    def entry(self) -> Column:
        return sum((self.path.endswith(n).cast("int") for n in ENTRY_FILES), F.lit(0)) > 0


ENTRY_FILES = ("mod.rs", "index.ts", "index.js", "__init__.py")
#: By intent: what is added to a score, and when.  More can be put in.
BOOSTS: dict[str, list[tuple[float, Callable[[Traits], Column]]]] = {
    "debug": [(0.20, lambda s: s.named("error", "exception", "panic")), (0.10, lambda s: s.called(3))],
    "modify": [(0.15, lambda s: s.entry), (0.10, lambda s: s.exported & s.called(5))],
    "refactor": [(0.25, lambda s: s.exported), (0.15, lambda s: s.called(5))],
    EXPLORE: [(0.10, lambda s: s.documented), (0.05, lambda s: s.called(3))],
    "understand": [(0.20, lambda s: s.documented), (0.15, lambda s: s.kind.isin("module", "class", "trait", "interface", "namespace")), (0.10, lambda s: s.in_degree == 0)],
    "test": [(0.20, lambda s: s.named("test", "spec")), (0.15, lambda s: s.called(2))],
}


def boost(intent: str, kind: Column, path: Column, exported: Column, docstring: Column, in_degree: Column) -> Column:
    """What an intent adds to a symbol's score."""
    traits = Traits(kind, path, exported, docstring, in_degree)
    return sum((F.when(F.coalesce(when(traits), F.lit(False)), value).otherwise(0.0) for value, when in BOOSTS[intent]), F.lit(0.0))
