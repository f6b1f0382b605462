"""The registered queries on the smallest tables, and the pipeline against its parts by brute force."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as P
    from loomdex.llm import common

    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    clean = [r["doc_id"] for r in rows.filter("doc_id % 9 = 2").collect()]
    shared = " ".join(f"passage{i}" for i in range(60))
    own = lambda x: " ".join(f"own{x}{i}" for i in range(50))
    more = [(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, f"{shared} and then some words of its own follow here, {own('a')}", "en", "s", 1), (9004, f"another start before it comes {own('b')} {shared}", "en", "s", 1), (9005, "Some lead in words. " + leak, "en", "s", 1)]
    docs = common.stored(rows.unionByName(spark.createDataFrame(more, rows.schema)))
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        out = common.stored(stage(spark, docs, DATA))
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        seen.append((name, docs.count(), len(ids)))
        if i < len(P.STAGES) - 1:
            assert out.columns == columns
        if i == 0:
            assert not ids & {9001, 9002} and set(clean) <= ids
        if i == 2:
            texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id >= 9000").collect()}
            assert "passage30" not in texts[9003] and "words of its own" in texts[9003] and "passage30" not in texts[9004]
        if i == 3:
            assert 9005 not in ids and 9003 in ids
        docs = out
    assert docs.filter("copies < 1").count() == 0 and [n for n, _, _ in seen] == [n for n, _ in P.STAGES]
    kept = docs.groupBy("source").sum("taken").count()
    assert kept > 0


def test_unrecognised_languages_go(spark):
    """Junk with letters and a language that wasn't learned go; documents in learned ones stay."""
    import random

    import corpus_pipeline as P

    rng = random.Random(5)
    junk = ["".join(rng.choices(letters, k=k)) for letters in ("abcdefghijklmnopqrstuvwxyz ", "0123456789abcdef ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for k in (200, 2000)]
    junk += ["Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах."]
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = rows.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))  # French is not learned
    more = spark.createDataFrame([(9000 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], rows.schema)
    kept = {r["doc_id"] for r in P.keep_languages(spark, rows.unionByName(more), DATA).select("doc_id").collect()}
    assert not [i for i in kept if i >= 9000]
    ids = lambda cond: {r["doc_id"] for r in rows.filter(cond).filter("text rlike '[a-z]'").collect()}
    french = ids("lang is null")  # some of it is words that are Spanish, too
    assert ids("lang is not null") <= kept and len(french & kept) < len(french) / 5


def test_identified_language_is_passed_on(spark):
    """What language ID says of a text is its lang in what follows, up to the pipeline's result, labelled or not."""
    import corpus_pipeline as P
    from loomdex.llm import common
    from loomdex.llm import language_id as L

    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit("en")).when(F.col("doc_id") % 3 > 0, F.col("lang")))
    want = {r["doc_id"]: r["lang_pred"] for r in L.identify(rows.select("doc_id", "text"), L.learn(rows)).collect()}
    kept = common.stored(P.keep_languages(spark, rows, DATA))
    got = {r["doc_id"]: r["lang"] for r in kept.select("doc_id", "lang").collect()}
    assert any(i % 3 == 0 for i in got) and len(set(got.values())) > 1 and got == {i: want[i] for i in got}
    mixed = {r["doc_id"]: r["lang"] for r in P.mix_sources(spark, kept, DATA).select("doc_id", "lang").collect()}
    assert mixed and mixed == {i: want[i] for i in mixed}


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_minhash_near_dedup", "op6_warc_bundles", "op7_source_mixing", "op8_suffix_array_dedup"])
def test_sql_twins(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_registry():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
