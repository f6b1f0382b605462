"""Columns of clashing names, hot keys, very long texts and empty tables, for every operator and pipeline stage."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import common as C
from loomdex.llm import decontamination as D
from loomdex.llm import language_id as L
from loomdex.llm import lossless_webp as P
from loomdex.llm import minhash_dedup as M
from loomdex.llm import repeats as R
from loomdex.llm import source_mixing as X
from loomdex.llm import substring_dedup as S
from loomdex.llm import suffix_dedup as B
from loomdex.llm import token_counts as K
from loomdex.llm import url_filters as U
from loomdex.llm import warc_bundles as Z

#: Every name that an operator returns, and those that it uses inside.
NAMES = """n_words n_removed kept_sha256 removed_spans n_bytes n_spans n_tokens over_limit payload payload_digest record_type refers_to media payload_bytes
    width height pixels error payload_sha256 tail_crc32 media_bytes media_sha256 feature lang_pred score host path rule verdict component_id kept n_shingles
    held_out size target copies taken source_size whole left stop b c h id key m first cls sig n tag s e kfp at runs sub ctx form pos places own w f ok said good line
    _row _k1 _k2 _spans _text _hot _key _salt _cold _bad _s _n _id _ok _said item_id windows item_windows verbatim slots bundle frame rows cid""".split()
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def crowded(df):
    """``df`` with a column of each of NAMES that it lacks."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("theirs").alias(c) for c in NAMES if c.lower() not in have])


def model():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = {"en": "the then there other with from about which would these".split(), "fr": "avec dans pour plus tous cette leurs entre aussi comme".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s"]) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(20, 90)), lang, f"s{i % 3}", 1) for i in range(24) for lang in ["en" if i % 2 else "fr"]]
    shared = text("en", 50)
    rows += [(100, rows[0][1], "fr", "s0", 1), (101, shared + " one more", "en", "s1", 1), (102, "and " + shared, "en", "s1", 1), (103, None, None, None, None), (104, "", "en", "s1", 0), (105, "12 34", "en", None, 1)]
    return C.stored(spark.createDataFrame(rows, SHAPE))


def items(spark):
    return spark.createDataFrame([(1, "so the other then would go with these there which about 12 would")], "item_id long, text string")


OPERATORS = {
    "substrings": (lambda d: S.dedup_substrings(d), ["n_words", "n_removed", "kept_sha256", "removed_spans", "text"]),
    "bytes": (lambda d: B.dedup_bytes(d, window=100, gram=16), ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]),
    "near": (lambda d: M.near_duplicates(d), ["n_shingles", "component_id", "kept"]),
    "keep one": (lambda d: M.keep_one(d), ["text"]),
    "tokens": (lambda d: K.count_tokens(d, model()), ["n_bytes", "n_tokens", "over_limit", "text"]),
    "store": (lambda d: P.store(d), ["n_bytes", "payload_bytes", "media"]),
    "features": (lambda d: P.features(P.store(d)), ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
    "pixels": (lambda d: P.pixels(P.store(d)), ["width", "height", "pixels", "error"]),
    "identify": (lambda d: L.identify(d, L.learn(d)), ["lang_pred", "score", "text"]),
    "leaks": (lambda d: D.drop_contaminated(d, items(d.sparkSession)), ["text"]),
    "mix": (lambda d: X.mix(d).withColumnRenamed("id", "doc_id"), ["size", "source_size", "target", "taken"]),
    "urls": (lambda d: U.judge(d.withColumn("url", F.concat(F.lit("http://a.net/"), F.substring("text", 1, 9))), "url"), ["host", "path", "rule", "verdict", "text"]),
    "roles": (lambda d: Z.roles(d, "doc_id", "text", 10), ["payload", "payload_digest", "record_type", "refers_to"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_may_clash(spark, docs, name):
    operator, own = OPERATORS[name]
    wide = crowded(docs)
    plain, full = operator(docs), operator(wide)
    rows = lambda df: sorted((repr((r["doc_id"], *(r[c] for c in own))) for r in df.select("doc_id", *own).collect()))
    assert rows(plain) == rows(full)
    if name not in ("near", "mix"):  # these return no other columns; elsewhere those of other names are as they were
        theirs = [c for c in NAMES if c not in plain.columns and (name, c) != ("features", "media")]
        assert set(theirs) <= set(full.columns) and full.select(*[f"`{c}`" for c in theirs]).distinct().collect()[0] == tuple(["theirs"] * len(theirs))


def test_archives_of_crowded_rows(spark, docs, tmp_path):
    pages = crowded(docs.withColumn("url", F.lit("http://a/b")))
    index = Z.write_bundles(Z.roles(pages, "doc_id", "text", 10), f"file://{tmp_path}", "doc_id")
    back = {r["page_id"]: bytes(r["block"]) for r in Z.read_bundles(index).collect()}
    want = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(back[i] in (want[i], b"") for i in want) and len(back) == len(want)


def test_stages_of_crowded_rows(spark, docs, tmp_path):
    import corpus_pipeline

    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    plain, wide = docs, C.stored(crowded(docs))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        one, two = C.stored(stage(spark, plain, str(tmp_path))), C.stored(stage(spark, wide, str(tmp_path)))
        assert one.columns == plain.columns and two.columns == wide.columns, name
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.select(one.columns).collect())), name
        assert two.filter("_row <> 'theirs' or score <> 'theirs'").count() == 0
        plain, wide = one, two
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(repr, last(spark, plain, "").collect())) == sorted(map(repr, last(spark, wide, "").collect()))


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], SHAPE)
    items(spark).limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_of_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    for name, (operator, _) in OPERATORS.items():
        assert operator(none).count() == 0, name


@pytest.mark.parametrize("share", [0.9])
def test_one_text_holds_most_rows(spark, share, monkeypatch):
    """A key with nine tenths of all rows goes apart from the others' shuffle, and results are those of brute force."""
    monkeypatch.setattr(C, "HOT_ROWS", 20)
    monkeypatch.setattr(C, "HOT_SHARE", 5)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(50)) for _ in range(n))
    hot = text(150)
    rows = [(i, hot if rng.random() < share else text(90)) for i in range(400)] + [(900 + i, None if i % 2 else "") for i in range(60)] + [(5000, hot + " and an end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.near_duplicates(df, shingle=3, percent=85).collect()}
    least = min(i for i, t in rows if t == hot)
    assert all(got[i]["component_id"] == (least if t in (hot, hot + " and an end") else i) for i, t in rows) and len(got) == len(rows)
    cut = {r["doc_id"]: r["n_removed"] for r in S.dedup_substrings(df).collect()}
    assert all(cut[i] == (150 if t and t.startswith(hot) else 0) for i, t in rows)
    cut = {r["doc_id"]: r["n_removed"] for r in B.dedup_bytes(df).collect()}
    assert all(cut[i] == (len(hot) if t and t.startswith(hot) else 0) for i, t in rows)
    roles = {r["doc_id"]: (r["record_type"], r["refers_to"]) for r in Z.roles(df, "doc_id", "text").select("doc_id", "record_type", "refers_to").collect()}
    last = max(i for i, t in rows if t == hot)
    assert all(roles[i] == (("revisit", last) if t == hot and i != last else ("response", None)) for i, t in rows)


def test_spread_join_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 5)
    rng = random.Random(1)
    left = [(i, rng.choice(["a"] * 20 + ["b", "c", None])) for i in range(200)]
    right = [(k, sum(x == k for _, x in left), v) for k, v in (("a", 1), ("b", 2), ("z", 3))]
    got = C.spread_join(spark.createDataFrame(left, "i long, k string"), spark.createDataFrame(right, "k string, m long, v long"), "k", "m")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, k, {"a": 1, "b": 2}.get(k)) for i, k in left), key=repr)
    assert got.columns == ["i", "k", "v"]


# ---- very long texts


def test_texts_of_megabytes(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    item = "If a train leaves at 9 and drives 120 km to the next town then how long does it take to be there at last"
    long = " ".join(rng.choices(words, k=350_000)) + " . " + item + " . " + " ".join(rng.choices(words, k=50_000))
    df = spark.createDataFrame([(1, long, "en"), (2, "something short " + item.replace("9", "7"), "en"), (3, "rien de tout cela", "fr")], "doc_id long, text string, lang string")
    assert len(long) > 2_000_000
    found = D.find_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2]
    assert {r["doc_id"]: r["lang_pred"] for r in L.identify(df, L.learn(df)).collect()}[3] == "fr"
    back = P.features(P.store(df)).filter("doc_id = 1").first()
    assert back["payload_sha256"] == hashlib.sha256(P.padded(long.encode())).hexdigest()
    near = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df.unionByName(df.filter("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))).collect()}
    assert near[9] == near[1] == 1 and near[2] == 2
    pages = spark.createDataFrame([(1, "http://a.eu/" + "x" * 20_000), (2, "http://b.net/x"), (3, "http://c.org/fr/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in U.judge(pages).collect()}[2] == "block"


def test_archives_of_long_pages(spark, tmp_path):
    html = ["<p>" + c * 3_000_000 for c in "ab"] + ["<p>" + "a" * 3_000_000]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u"))
    index = Z.write_bundles(Z.roles(df), f"file://{tmp_path}")
    back = {r["page_id"]: (r["headers"]["warc-type"], len(r["block"])) for r in Z.read_bundles(index).collect()}
    assert back == {0: ("revisit", 0), 1: ("response", 3_000_003), 2: ("response", 3_000_003)}


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_scan_of_a_long_text_in_pieces(unit, monkeypatch):
    """A text that is cut into overlapping pieces has the runs that it has as a whole, but for cuts where pieces meet."""
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(4000))
    batch = pa.RecordBatch.from_pydict({"text": [text], "_k1": [1], "_k2": [2]})

    def windows():
        """Of every window its k-gram; contexts agree with their windows by construction."""
        out = {}
        for b in R._scan(batch, unit, 40, 6):
            for kfp, at in zip(b.column("kfp").to_pylist(), b.column("at").to_pylist(), strict=True):
                for k in range((at & 511) + 1):
                    place = (at >> 9 & R._PLACE) + k
                    assert place not in out
                    out[place] = kfp
        return out

    whole = windows()
    n = len(text.split()) if unit == "word" else len(text)
    assert sorted(whole) == list(range(n - 39))
    monkeypatch.setattr(R, "_PIECE", 700)
    assert windows() == whole


@pytest.mark.parametrize("hot", [2, 10_000])
def test_nothing_is_removed_without_the_solvers(spark, hot):
    """What is removed comes from the suffix trees and arrays (but for k-grams that are hot) alone."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(1000)}" for _ in range(120))
    df = C.with_key(spark.createDataFrame([(i, text + f" end{i % 3}") for i in range(9)], "doc_id long, text string"), "text", "doc_id")
    blind = lambda symbols, first, last, window, number: np.zeros(0, np.int64)
    for unit, window, gram in (("word", 35, 6), ("byte", 400, 32)):
        assert R.repeated_spans(df, "text", "doc_id", unit, window, gram, blind, 10_000).count() == 0
        solve = S.deep_nodes if unit == "word" else B.tied_windows
        assert R.repeated_spans(df, "text", "doc_id", unit, window, gram, solve, hot).count() == 9
