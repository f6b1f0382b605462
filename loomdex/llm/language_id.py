"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies)
those of its letters, permuted (rotated) by their place in it; a document bundles
(adds) the vectors of all trigrams of its whole text; a language's prototype bundles
its documents, each scaled to length one, less the mean of all prototypes.
A document gets the language whose prototype has the largest cosine with it.

Text is lower-cased; a run of anything that is no letter counts as one blank.  Every
letter of any script has a vector of its own, whose signs are the bits of a hash of its
code point, so there is no table of letters to fill up and every machine has the same.

The largest cosine tells languages apart, but is at least 0 for any letters, so it can't
tell that a text is in none of them.  ``recognise`` judges that by the share of a text's
trigrams that are common in a language (``COMMON`` of its trigrams or more), against a
bound for each language calibrated on the labelled rows: ``SPREAD`` standard deviations
above what texts of the other languages get, but at most midway to what its own get.

Learning sums vectors per language in every task before they are shuffled: one vector
per language and Arrow batch, so a language that holds most rows is no hot group.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows without a
language are not learned from; with nothing learned every row is ``und``; equal
cosines go to the language that sorts first; repeated rows count as often as they
occur; an empty table gives an empty one; other columns are kept, but those that have the
name of a result give way to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm import common as C

DIMENSIONS = 512
#: Languages that may be learned (4 KB each on the driver and in every task); there are some 7,000, so more mean that the column holds something else.
LANGUAGES = 20_000
UNKNOWN = "und"
#: A trigram is common in a language if it is this share of its trigrams: 1 / COMMON of them at most.
COMMON = 1e-4
#: Standard deviations between what other languages' texts get and the bound.
SPREAD = 3.0
#: Trigrams and languages (8 and 4096 bytes each) that a task counts before it hands them on.
HELD, HELD_LANGUAGES = 1 << 20, 4_096


_U = np.uint64
_CODE = 21  # bits of a code point


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """A letter's code point in lower case, by code point; 0 (a blank) for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = ord(chr(c).lower()[0])
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    """Vectors of +1 and -1 of code points."""
    part = np.arange(DIMENSIONS // 64, dtype=_U) + _U(1)
    bits = C.mix(C.mix(codes.astype(_U) + _U(11))[:, None] + part * _U(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of a text, as three code points in a number, and how often each occurs; None without a letter."""
    s = _lowered()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return None
    keep = s > 0
    keep[1:] |= s[:-1] > 0  # one blank after a word stays
    s = s[keep]
    s = np.concatenate(([0], s[: len(s) - (s[-1] == 0)], [0])).astype(np.int64)
    return np.unique(s[:-2] << 2 * _CODE | s[1:-1] << _CODE | s[2:], return_counts=True)


def encode(text: str | None) -> np.ndarray | None:
    """A document's vector, of length one; None where there is no letter."""
    grams = _grams(text) if text else None
    if grams is None:
        return None
    g, n = grams
    mask = (1 << _CODE) - 1
    codes, at = np.unique(np.concatenate((g >> 2 * _CODE, g >> _CODE & mask, g & mask)), return_inverse=True)
    own = letters(codes)
    a, b, c = np.roll(own, 2, 1), np.roll(own, 1, 1), own
    at = at.reshape(3, -1)
    v = np.zeros(DIMENSIONS, np.float64)
    for i in range(0, len(g), 4096):
        x, y, z = at[:, i : i + 4096]
        v += n[i : i + 4096].astype(np.float32) @ (a[x] * b[y] * c[z]).astype(np.float32)
    size = np.sqrt(v @ v)
    return v / size if size else None


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[float]]:
    """Prototypes by language, from every row with a language: one vector each."""
    C.small_batches(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])
            held.clear()

        for b in batches:
            for t, name in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                v = encode(t.as_py())
                if v is not None:
                    if name not in held and len(held) == HELD_LANGUAGES:
                        yield from rows()
                    # whole numbers, so that the sum doesn't depend on its order
                    held[name] = held.get(name, 0) + np.round(v * 2**30).astype(np.int64)
        yield from rows()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    vectors = rows.mapInArrow(C.tidy(sums), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v"))
    # DIMENSIONS numbers for each of at most LANGUAGES languages reach the driver
    made = vectors.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).limit(LANGUAGES + 1).collect()
    if len(made) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct languages")
    if not made:
        return {}
    names = sorted(r["lang"] for r in made)
    by = {r["lang"]: np.array(r["v"]) for r in made}
    unit = np.array([by[n] / max(1e-12, np.sqrt(by[n] @ by[n])) for n in names])
    if len(names) > 1:
        unit = unit - unit.mean(0)  # what all languages share tells nothing
        unit /= np.maximum(1e-12, np.sqrt((unit**2).sum(1, keepdims=True)))
    return {n: [float(x) for x in u] for n, u in zip(names, unit, strict=True)}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, (1 + cosine) / 2 of the best prototype."""
    C.small_batches(docs.sparkSession)
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs]).reshape(len(langs), DIMENSIONS)
    body = C.set_aside(docs, F.col(text).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = [], []
            for t in b.column("text"):
                v = encode(t.as_py()) if langs else None
                if v is None:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cos = matrix @ v
                k = int(np.argmax(np.round(cos, 12)))
                best.append(langs[k])
                score.append(float(min(1.0, max(0.0, (1 + cos[k]) / 2))))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["_row", "lang_pred", "score"])

    out = T.StructType([body.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return C.put_back(body.mapInArrow(C.tidy(predict), out), ["lang_pred", "score"])


class Common:
    """The trigrams that are common in some language, ascending, and for each language which of them are in it."""

    def __init__(self, by_language: dict[str, np.ndarray]) -> None:
        self.langs = sorted(by_language)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *by_language.values()]))
        self.inside = np.array([np.isin(self.grams, by_language[x]) for x in self.langs]).reshape(len(self.langs), len(self.grams))

    def share(self, text: str | None) -> np.ndarray | None:
        """The share of a text's trigrams that are common, by language; None without a letter."""
        grams = _grams(text) if text else None
        if grams is None:
            return None
        g, n = grams
        if not len(self.grams):
            return np.zeros(len(self.langs))
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        known = self.grams[at] == g
        return self.inside[:, at[known]] @ n[known] / n.sum()


def common_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> Common:
    """The trigrams that are common in each language, from every row with a language."""
    C.small_batches(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "g", "n"])
            held.clear()

        for b in batches:
            for t, name in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                grams = _grams(t.as_py()) if t.is_valid else None
                if grams is not None:
                    held.setdefault(name, []).append(grams)
                    size += len(grams[0])
                    if size > HELD:
                        yield from rows()
                        size = 0
        yield from rows()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    sums = C.stored(rows.mapInArrow(C.tidy(counts), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")))
    total = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    found = sums.join(total, "lang").filter(F.col("n") >= F.col("total") * F.lit(COMMON))
    # at most 1 / COMMON numbers for each of at most LANGUAGES languages reach the driver
    made = found.groupBy("lang").agg(F.collect_list("g").alias("g")).limit(LANGUAGES + 1).collect()
    if len(made) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct languages")
    return Common({r["lang"]: np.array(r["g"], np.int64) for r in made})


def bounds(docs: DataFrame, common: Common, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """By language the least share of common trigrams with which a text counts as one of it."""
    C.small_batches(docs.sparkSession)
    langs = common.langs
    at = {x: k for k, x in enumerate(langs)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in ten-thousandths, so that the sums don't depend on their order: own rows and sum, others' rows, sum and squares
        held = np.zeros((5, len(langs)), np.int64)
        for b in batches:
            for t, name in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                share = common.share(t.as_py())
                if share is not None:
                    x, k = np.round(share * 1e4).astype(np.int64), at[name]
                    own = np.arange(len(langs)) == k
                    held += np.array([own, own * x, ~own, ~own * x, ~own * x * x])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *(pa.array(h) for h in held)], ["lang", "n", "s", "m", "o", "q"])

    if not langs:
        return {}
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    got = rows.mapInArrow(C.tidy(sums), "lang string, n long, s long, m long, o long, q long").groupBy("lang").agg(*[F.sum(c).alias(c) for c in "nsmoq"])
    out = {}
    for r in got.collect():
        own = r["s"] / max(1, r["n"]) / 1e4
        mean = r["o"] / max(1, r["m"]) / 1e4
        dev = max(0.0, r["q"] / max(1, r["m"]) / 1e8 - mean**2) ** 0.5
        half = (own + mean) / 2
        out[r["lang"]] = min(half, mean + SPREAD * dev) if r["m"] else half  # one language has no others
    return out


def recognise(docs: DataFrame, common: Common, least: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is in no language of ``common``."""
    C.small_batches(docs.sparkSession)
    line = np.array([least[x] for x in common.langs])
    body = C.set_aside(docs, F.col(text).alias("text"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = (common.share(t.as_py()) for t in b.column("text"))
            own = b.filter(pa.array([s is not None and bool((s >= line).any()) for s in shares], pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column("_row")], ["_row"])

    return C.put_back(body.mapInArrow(C.tidy(known), T.StructType([body.schema["_row"]])), [])


def held_out(ident: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(ident).cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out())
    model = learn(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
