"""Ranking: term statistics, BM25, TF-IDF cosine, scaling and the hybrid score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import intent as I
from loomdex.functions import stem as porter
from loomdex.functions import text as X
from loomdex.sources.store import stored

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SYMBOL_FIELDS = {"name": 10.0, "fqn": 5.0, "docstring": 1.0, "signature": 3.0}
MEMORY_FIELDS = {"content": 5.0, "headline": 1.0}
SYMBOL_CANDIDATES, MEMORY_CANDIDATES = 100, 50
_EPS = 2.220446049250313e-16


#: Rows whose tokens are counted at once.
_AT_ONCE = 256


def _terms_of_rows(rows: DataFrame, ident: str, *tokens: tuple[Column, float]) -> DataFrame:
    """(id, term, f, dl) of every row by itself: each distinct term with the sum of its weights, and how many tokens there are.

    A row's terms are counted where the row is, so nothing is shuffled and a task holds a few
    rows' tokens, however large the table is.
    """
    t = rows.select(ident, *[c.alias(f"_t{i}") for i, (c, _) in enumerate(tokens)])
    weights = [w for _, w in tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(k, _AT_ONCE) for batch in batches for k in range(0, batch.num_rows, _AT_ONCE)):
            held = [pc.fill_null(pc.list_value_length(b.column(1 + i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(weights))]
            words = pa.concat_arrays([b.column(1 + i).flatten() for i in range(len(weights))]).dictionary_encode()
            if not len(words):
                continue
            row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in held])
            key = row * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            f = np.add.reduceat(np.repeat(np.array(weights, float), [n.sum() for n in held])[order], starts)
            row, word = np.divmod(key[order][starts], len(words.dictionary))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(f), pa.array(sum(held)[row])], names=[ident, "term", "f", "dl"])

    return t.mapInArrow(run, f"`{ident}` {t.schema[ident].dataType.simpleString()}, term string, f double, dl long")


def term_frequencies(rows: DataFrame, ident: str, tokens: Column) -> DataFrame:
    """(id, term, n, tf): how often each term occurs in a row's tokens, absolutely and as a share; rows of one id count as one."""
    t = rows.select(ident, tokens.alias("tokens"))
    if not rows.groupBy(ident).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        t = t.groupBy(ident).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return _terms_of_rows(t, ident, (F.col("tokens"), 1.0)).select(ident, "term", F.col("f").cast("long").alias("n"), (F.col("f") / F.col("dl")).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df) from rows that are unique by term and id."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column | int, df: Column) -> Column:
    """ln(N / (1 + df)); may be negative."""
    return F.log(F.lit(n_docs) / (1 + df)) if isinstance(n_docs, int) else F.log(n_docs / (1 + df))


def bm25(rows: DataFrame, ident: str, fields: dict[str, float], query: str | list[str], k1: float = K1, b: float = B, stem: bool = False) -> DataFrame:
    """(id, bm25) of rows with a query term, over weighted fields.

    A term's frequency is the weighted sum over fields; a row's length is that of all
    fields unweighted.  The texts are split once: only the query's terms are counted
    (by comparing tokens, with no join), and the few numbers of each row are stored, from
    which statistics and scores come.  See ``postings`` for many queries over the same rows.
    """
    terms = X.query_terms(query) if isinstance(query, str) else list(query)
    if stem:
        terms = list(dict.fromkeys(porter.stem(t) for t in terms))
    if not terms:
        return rows.sparkSession.createDataFrame([], f"{ident} {rows.schema[ident].dataType.simpleString()}, bm25 double")
    t = rows.select(ident, *[(porter.stems if stem else lambda c: c)(X.fts_terms(F.col(f))).alias(f) for f in fields])
    length = sum((F.size(f) for f in fields), F.lit(0))
    count = lambda f, term: F.size(F.filter(F.col(f), lambda w: w == term))
    weighted = [sum((count(f, term) * F.lit(w) for f, w in fields.items()), F.lit(0.0)).alias(f"f{i}") for i, term in enumerate(terms)]
    t = stored(t.select(ident, length.cast("double").alias("dl"), *weighted))
    n = range(len(terms))
    stats = t.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in n]).first()
    t = t.filter(F.greatest(*[F.col(f"f{i}") for i in n], F.lit(0.0)) > 0)
    score = F.lit(0.0)
    for i in n:
        f, df = F.col(f"f{i}"), stats[f"df{i}"] or 0
        weight = max(math.log((stats["N"] - df + 0.5) / (df + 0.5)), IDF_FLOOR)
        score = score + F.lit(weight) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    return t.select(ident, score.alias("bm25"))


def postings(rows: DataFrame, ident: str, fields: dict[str, float], stem: bool = False) -> DataFrame:
    """A full-text index of rows unique by ident: (term, ident, f, dl), a term's weighted frequency in a row and the row's length."""
    split = (lambda c: porter.stems(X.fts_terms(c))) if stem else X.fts_terms
    t = _terms_of_rows(rows, ident, *[(split(F.col(f)), float(v)) for f, v in fields.items()])
    return t.select("term", ident, "f", F.col("dl").cast("double").alias("dl"))


def text_lengths(rows: DataFrame, ident: str, fields: dict[str, float], *more: Column) -> DataFrame:
    """(ident, dl): the length of every row, those without a term included; with it ``more`` columns."""
    return rows.select(ident, sum((F.size(X.fts_terms(F.col(f))) for f in fields), F.lit(0)).cast("double").alias("dl"), *more)


def bm25_indexed(index: DataFrame, lengths: DataFrame, ident: str, query: str | list[str], k1: float = K1, b: float = B, stem: bool = False) -> DataFrame:
    """``bm25`` from a stored index: only the postings of the query's terms are read, and no text."""
    terms = X.query_terms(query) if isinstance(query, str) else list(query)
    terms = list(dict.fromkeys(porter.stem(t) for t in terms)) if stem else terms
    if not terms:
        return index.select(ident).limit(0).withColumn("bm25", F.lit(0.0))
    hits = index.filter(F.col("term").isin(terms))
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per term asked for
    if not df:
        return index.select(ident).limit(0).withColumn("bm25", F.lit(0.0))
    n, mean = lengths.agg(F.count("*"), F.avg("dl")).first()
    weight = F.create_map(*[F.lit(x) for t in sorted(df) for x in (t, max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), IDF_FLOOR))])
    part = weight[F.col("term")] * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0)))
    return hits.groupBy(ident).agg(F.sum(part).alias("bm25"))


def top_k(scored: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    return scored.orderBy(F.col(score).desc(), *ties).limit(k)


def query_cosine(tf: DataFrame, ident: str, query_tf: dict[str, float], n_docs: int, df: DataFrame) -> DataFrame:
    """(id, tfidf): cosine of TF-IDF vectors over the query's terms; terms that no row has weigh 0."""
    if not query_tf:
        return tf.select(ident).limit(0).withColumn("tfidf", F.lit(0.0))
    # one row for each of the query's terms comes to the driver and goes out as a literal map
    found = df.filter(F.col("term").isin(*query_tf)).select("term", idf(n_docs, F.col("df")).alias("idf")).collect()
    weight = {r["term"]: r["idf"] for r in found}
    if not weight:
        return tf.select(ident).limit(0).withColumn("tfidf", F.lit(0.0))
    norm = sum((query_tf[t] * weight[t]) ** 2 for t in sorted(weight)) ** 0.5
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])[F.col("term")]
    own = F.col("tf") * as_map(weight)
    asked = as_map({t: float(query_tf[t] * weight[t]) for t in weight})
    out = tf.filter(F.col("term").isin(*weight)).groupBy(ident).agg(F.sum(own * asked).alias("dot"), F.sqrt(F.sum(own * own)).alias("n"))
    return out.select(ident, F.when((F.col("n") > 0) & F.lit(norm > 0), F.col("dot") / (F.col("n") * F.lit(norm or 1.0))).otherwise(0.0).alias("tfidf"))


def plain_cosine(tf: DataFrame, ident: str, query_tf: dict[str, float]) -> DataFrame:
    """(id, tfidf): cosine of bare term frequencies, as session memory uses."""
    norm = sum(v * v for v in query_tf.values()) ** 0.5
    hit = F.create_map(*[F.lit(x) for kv in sorted(query_tf.items()) for x in kv])[F.col("term")] if query_tf else F.lit(None).cast("double")
    out = tf.groupBy(ident).agg(F.sum(F.coalesce(hit, F.lit(0.0)) * F.col("tf")).alias("dot"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n"))
    return out.select(ident, F.when((F.col("n") > 0) & F.lit(norm > 0), F.col("dot") / (F.col("n") * F.lit(norm or 1.0))).otherwise(0.0).alias("tfidf"))


def text_tf(query: str) -> dict[str, float]:
    """Term frequencies of one text on the driver (the Python twin of ``text.tokenize_text``)."""
    import regex

    out: list[str] = []
    for word in regex.split(r"[\s,;:()\[\]{}<>\"'`!?#$%^&*+=|\\~@]+", query):
        for part in regex.split(r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z]{2}[a-z])", word, flags=regex.VERSION1):
            low = part.lower()
            if len(low.encode()) > 1 and low not in X.STOP_WORDS:
                out.append(low)
    return {t: out.count(t) / len(out) for t in dict.fromkeys(out)}


def min_max(value: Column, window=None) -> Column:
    """Values scaled to 0..1 over a (small) set; all 0 if they are equal."""
    w = window if window is not None else W.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < _EPS, 0.0).otherwise((value - low) / (high - low))


def hybrid(weights: dict[str, float], boost: Column, **signals: Column) -> Column:
    """The weighted sum of signals, in a fixed order, plus the boost."""
    out = F.lit(0.0)
    for name in I.SIGNALS:
        if name in signals:
            out = out + F.lit(weights[name]) * signals[name]
    return out + boost


def reason(intent: Column, centrality: Column, bm25_: Column, tfidf: Column, boost: Column, ngram: Column, semantic: Column, in_degree: Column, documented: Column) -> Column:
    """Why a symbol ranks where it does, as a comma-separated list."""
    said = F.concat_ws(
        ", ",
        F.when(centrality > 0.7, F.format_string("High centrality (called by %d symbols)", in_degree)),
        F.when(bm25_ > 0.7, "Strong term match"),
        F.when(tfidf > 0.7, "High TF-IDF similarity"),
        F.when(boost > 0, F.concat(intent, F.lit("-boosted"))),
        F.when(ngram > 0.3, "Partial name match"),
        F.when(semantic > 0.5, "Semantic match"),
        F.when(documented, "Has documentation"),
    )
    return F.when(said == "", "General relevance").otherwise(said)


def matched_terms(terms: list[str], *fields: Column) -> Column:
    """The query terms that occur in a field, as substrings."""
    low = F.lower(F.concat_ws("\n", *fields))
    return F.array_sort(F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(low, t)))


def search_symbols(symbols: DataFrame, files: DataFrame, edges: DataFrame, centrality: DataFrame, tf: DataFrame, query: str, limit: int = 10, intent: str | None = None, query_vector: list[float] | None = None, embeddings: DataFrame | None = None, encoder: bool = False, index: tuple[DataFrame, DataFrame] | None = None, stem: bool = True) -> DataFrame:
    """Hybrid search: the best candidates by BM25, rescored by five signals and an intent's boosts.

    ``index``: stored postings and lengths of the symbols, without which their texts are read.
    """
    name = intent or I.detect_one(query)
    weights = I.INTENTS[name].weights(encoder or query_vector is not None)
    query_tf = text_tf(query)
    scored = bm25_indexed(*index, "id", query, stem=stem) if index else bm25(symbols, "id", SYMBOL_FIELDS, query, stem=stem)
    found = stored(top_k(scored, SYMBOL_CANDIDATES, "bm25", "id"))
    own = found.join(symbols, "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    ids = F.broadcast(found.select("id"))  # at most SYMBOL_CANDIDATES: what is joined to them is cut down to them first
    own = own.join(centrality.join(ids, "id", "left_semi"), "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    degree = edges.withColumnRenamed("dst", "id").join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("in_degree"))
    own = own.join(degree, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    n_docs = index[1].filter("terms > 0").count() if index else tf.select("symbol_id").distinct().count()
    mine = tf.join(F.broadcast(found.select(F.col("id").alias("symbol_id"))), "symbol_id", "left_semi")
    cosine = query_cosine(mine, "symbol_id", query_tf, max(1, n_docs), document_frequencies(tf)).withColumnRenamed("symbol_id", "id")
    own = own.join(cosine, "id", "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    grams = X.identifier_trigrams(F.lit(query))
    short = F.substring_index("fqn", "::", -1)
    own = own.withColumn("ngram", F.greatest(X.jaccard(grams, X.identifier_trigrams(F.col("name"))), X.jaccard(grams, X.identifier_trigrams(short))))
    if query_vector is not None and embeddings is not None:
        vector = F.array(*[F.lit(float(v)) for v in query_vector])
        near = embeddings.filter(F.size("embedding") == len(query_vector)).select(F.col("symbol_id").alias("id"), F.greatest(X.dense_cosine(vector, F.col("embedding")), F.lit(0.0)).alias("semantic"))
        own = own.join(near, "id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    else:
        own = own.withColumn("semantic", F.lit(0.0))
    own = own.withColumn("raw_bm25", F.col("bm25"))
    for signal in ("bm25", "centrality", "ngram", "semantic"):  # over at most SYMBOL_CANDIDATES rows
        own = own.withColumn(signal, min_max(F.col(signal)))
    own = own.withColumn("boost", I.boost(name, F.col("kind"), F.col("path"), F.col("is_exported"), F.col("docstring"), F.col("in_degree")))
    documented = F.col("docstring").isNotNull() & (F.col("docstring") != "")
    own = own.withColumns({
        "intent": F.lit(name),
        "score": hybrid(weights, F.col("boost"), **{s: F.col(s) for s in I.SIGNALS}),
        "why": reason(F.lit(name), F.col("centrality"), F.col("bm25"), F.col("tfidf"), F.col("boost"), F.col("ngram"), F.col("semantic"), F.col("in_degree"), documented),
        "matched_terms": matched_terms(sorted(query_tf), F.col("name"), F.col("fqn"), F.col("docstring")),
    })
    return own.orderBy(F.col("score").desc(), F.col("raw_bm25").desc(), "id").limit(limit)


def embedding_coverage(symbols: DataFrame, vectors: DataFrame, *group: str) -> DataFrame:
    """Symbols and those with a vector, per group."""
    have = vectors.select(F.col("symbol_id").alias("id"), F.lit(1).alias("_have")).distinct()
    return symbols.join(have, "id", "left").groupBy(*group).agg(F.count("*").alias("symbols"), F.count("_have").alias("embedded"))


def search_lexical(symbols: DataFrame, files: DataFrame, query: str, limit: int = 10, stem: bool = True, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Symbols by BM25 alone, with the columns that a hybrid search's callers use; all signals but bm25 are 0."""
    scored = bm25_indexed(*index, "id", query, stem=stem) if index else bm25(symbols, "id", SYMBOL_FIELDS, query, stem=stem)
    found = top_k(scored, limit, "bm25", "id")
    own = found.join(symbols, "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    zero = F.lit(0.0)
    own = own.withColumns({
        "raw_bm25": F.col("bm25"), "score": F.col("bm25"), "intent": F.lit("fallback"), "why": F.lit("Full-text match alone (no hybrid scoring)"),
        "matched_terms": F.array().cast("array<string>"), "in_degree": F.lit(0).cast("long"), "boost": zero, **{s: zero for s in I.SIGNALS if s != "bm25"},
    })
    return own.orderBy(F.col("score").desc(), "id")


def search_relaxed(search, lexical, limit: int = 10) -> tuple[DataFrame, bool]:
    """``search(limit)``; if that is empty ``search`` for four times as many, then ``lexical(limit)``; whether it was relaxed.

    The candidates of a search don't depend on its limit, so relaxing tells that a first
    pass was empty rather than finding more.
    """
    first = search(limit)
    if not first.isEmpty():
        return first, False
    wider = search(limit * 4)
    return (wider.limit(limit) if not wider.isEmpty() else lexical(limit)), True
