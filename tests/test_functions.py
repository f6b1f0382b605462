"""Exact values of scalar and text functions."""

import pytest
from pyspark.sql import functions as F

from loomdex.functions import intent as I
from loomdex.functions import scalars as S
from loomdex.functions import text as X
from loomdex.operators import pack, rank


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "tokens"),
    [("MAX_RETRIES", ["max", "retries"]), ("AuthService", ["auth", "service"]), ("src/auth/middleware.ts", ["src", "auth", "middleware"]), ("x", []), ("HTTPSClient", ["http", "sclient"]), ("ABc", ["abc"]), ("a::fooBar-baz.py", ["foo", "bar", "baz"])],
)
def test_identifier_tokens(spark, name, tokens):
    assert value(spark, X.tokenize_identifier(F.lit(name))) == tokens


def test_text_tokens(spark):
    assert value(spark, X.tokenize_text(F.lit("Fix the (validateToken) bug, in src/auth.ts!"))) == ["fix", "validate", "token", "bug", "src/auth.ts"]
    assert value(spark, X.tokenize_text(F.lit(None).cast("string"))) == []
    assert rank.text_tf("Fix the fix validateToken") == {"fix": 0.5, "validate": 0.25, "token": 0.25}


def test_symbol_tokens(spark):
    got = value(spark, X.tokenize_symbol(F.lit("login"), F.lit("Signs in."), F.lit("src/auth.ts::AuthService::login")))
    assert got == ["login", "signs", "in.", "src", "auth", "auth", "service"]


@pytest.mark.parametrize(("n", "tokens"), [(35, 10), (7, 2), (0, 0), (8, 3)])
def test_estimate(spark, n, tokens):
    assert value(spark, X.estimate_tokens(F.lit("x" * n))) == tokens


@pytest.mark.parametrize(("query", "name"), [("fix the auth bug", "debug"), ("refactor the middleware", "refactor"), ("add rate limiting", "modify"), ("", "explore"), ("how does the latest thing", "test"), ("explain this", "understand")])
def test_intent(spark, query, name):
    assert value(spark, I.detect(F.lit(query))) == name == I.detect_one(query)


def test_weights_sum_to_one():
    for t in I.INTENTS.values():
        assert sum(t.weights(False).values()) == pytest.approx(1) and sum(t.weights(True).values()) == pytest.approx(1)


@pytest.mark.parametrize(("a", "b", "yes"), [("foo", "foos", True), ("validate", "validata", True), ("foo", "completely_different", False), ("", "", False)])
def test_rename(spark, a, b, yes):
    assert value(spark, S.is_rename(F.lit(a), F.lit(b))) is yes


@pytest.mark.parametrize(("age", "said"), [(30, "30s ago"), (59, "59s ago"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago"), (-5, "0s ago")])
def test_relative_time(spark, age, said):
    assert value(spark, S.relative_time(F.lit(1000000), F.lit(1000000 - age))) == said


def test_scaling(spark):
    rows = lambda xs: [r["v"] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", rank.min_max(F.col("x")).alias("v")).orderBy("x").collect()]
    assert rows([5]) == [0] and rows([0, 5, 10]) == [0, 0.5, 1]
    assert rows([-10, -5, -1])[0] == 0 and rows([-10, -5, -1])[-1] == 1


def test_strings(spark):
    assert value(spark, S.truncate_bytes(F.lit("aéb"), 2)) == "a" and value(spark, S.truncate_bytes(F.lit("aéb"), 3)) == "aé" and value(spark, S.truncate_bytes(F.lit("ab"), 9)) == "ab"
    assert value(spark, S.truncate_bytes(F.lit("x😀y"), 4)) == "x"
    assert value(spark, S.query_of(F.lit("Tool: x. Query: find it. Result: r"))) == "find it" and value(spark, S.query_of(F.lit("nothing"))) is None
    assert value(spark, S.human_bytes(F.lit(1536))) == "1.5 KiB" and value(spark, S.human_bytes(F.lit(12))) == "12 B"
    assert value(spark, X.match_expression(F.lit("foo-bar the"))) == '"foo" OR "bar" OR "the"' and value(spark, X.match_expression(F.lit("  "))) == ""
    assert value(spark, X.jaccard(X.trigrams(F.lit("abcd")), X.trigrams(F.lit("abce")))) == pytest.approx(1 / 3)
    assert value(spark, S.blast_radius(F.lit(5))) == "medium"


def test_budget():
    b = pack.Budget.split(8000, 0.85)
    assert (b.memory, b.pivots, b.rest) == (500, 6375, 1125)
    assert pack.resolve_budget(99999999) == 50000 and pack.resolve_budget(None) == 10000 and pack.resolve_budget(None, 7) == 7


def test_stems():
    from loomdex.functions.stem import stem

    words = "caresses ponies feed agreed plastered motoring hopping filing happy sky relational predication operator hopefulness electrical adoption cease controll authentication"
    assert [stem(w) for w in words.split()] == "caress poni feed agre plaster motor hop file happi sky relat predic oper hope electr adopt ceas control authent".split()


def test_local_encoder(tmp_path):
    """Cut, padded, averaged over real tokens and scaled; a missing model says so, and a copy for workers has only its path."""
    import pickle
    from types import SimpleNamespace

    import numpy as np

    from loomdex.functions import encoder

    class Words:
        def encode_batch(self, texts):
            return [SimpleNamespace(ids=[len(w) for w in t.split()]) for t in texts]

    class Session:
        def get_inputs(self):
            return [SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"} and given["input_ids"].shape[1] <= encoder.EMBEDDING_TOKENS
            x = given["input_ids"].astype(np.float32)
            return [np.stack([x, np.ones_like(x)], 2)]  # padding must not count, though its vector isn't zero

    e = encoder.LocalEncoder(str(tmp_path), Words(), Session())
    got = e(["aaa a", "aa", "", "b " * 400] + ["c"] * 40)
    assert len(got) == 44 and np.allclose(got[0], np.array([2, 1]) / 5**0.5) and np.allclose(got[1], got[0]) and got[2] == [0, 0]
    assert np.allclose(got[3], np.array([1, 1]) / 2**0.5)
    with pytest.raises(encoder.MissingModel):
        pickle.loads(pickle.dumps(e))(["x"])


def test_human_bytes_rounds_ties_to_even(spark):
    """Java's %.1f rounds ties up, C's and SQL's printf to the even digit."""
    sizes = {1280: "1.2 KiB", 1792: "1.8 KiB", 5 << 18: "1.2 MiB", 7 << 18: "1.8 MiB", 5 << 28: "1.2 GiB", 1279: "1.2 KiB", 1281: "1.3 KiB", (1 << 20) - 1: "1024.0 KiB", 1023: "1023 B"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", S.human_bytes(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == sizes
