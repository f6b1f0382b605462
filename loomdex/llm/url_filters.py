"""URL filters: rules first, then a ratio of two character models.

A url that a rule fits gets that rule's verdict.  The urls so accepted and rejected
train two smoothed variable-order Markov models of characters; every other url is
judged by the difference of its log-likelihoods under the two, divided by its length,
against a threshold calibrated on the labelled ones.

A model of order k gives a character after a context of k - 1 the probability
(n(context, c) + M * p of order k - 1) / (n(context) + M), down to an even
distribution.  A longer context therefore only counts as far as it was seen.  What a
gram of order k changes in the log ratio against order k - 1 is kept as one number;
a url's score is the sum over all its grams, since whenever a gram was seen its
suffixes were, too.  The model is a table with a row for every gram that was counted:
it grows with the urls and is joined by shuffle, never sent to every task.  All counts
are over all rows; all steps are DataFrame operations.

Cases: for a null url, or one without ``://``, host and path are empty, no rule fits
and the models judge the empty string; a path that is empty doesn't start with ``/``;
without accepted (rejected) urls to learn from all others are blocked (allowed), and
without either allowed; repeated rows count as often as they occur and are judged
alike; an empty table gives an empty one; ``judge`` keeps extra columns, but those that
have the name of a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm import common as C

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
#: Weight of the shorter context against counts, and the number of characters told apart at order 0.
M, EVEN = 4.0, 128.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one asked for wins
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, order: int) -> Column:
    """All grams of 1 to ``order`` characters, each as often as it occurs."""
    every = F.sequence(F.lit(1), F.length(text))
    return F.flatten(F.transform(every, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.length(text) - i + 1)), lambda k: F.substring(text, i, k))))


def _starts(text: Column, order: int) -> Column:
    """The longest gram at every character: ``order`` characters, fewer at the end."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, order))


def fit(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, delta), a row for every gram that occurs, from rows of (s, good, n): a string, whether accepted, and how often it occurs."""
    exploded = urls.select("good", "n", F.explode(_grams(F.col("s"), order)).alias("g"))
    counts = C.stored(exploded.groupBy("g").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("r")))
    size = F.length("g")
    below, levels = None, []
    for k in range(1, order + 1):
        own = counts.filter(size == k)
        if below is None:  # all single characters have the empty context: two numbers
            total = own.agg(F.sum("a"), F.sum("r")).first()
            own = own.withColumns({"ca": F.lit(total[0]), "cr": F.lit(total[1]), "pa0": F.lit(1 / EVEN), "pr0": F.lit(1 / EVEN)})
        else:
            context = F.substring("g", 1, k - 1)
            total = own.groupBy(context.alias("x")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            own = own.withColumn("x", context).join(total, "x")
            lower = below.select(F.col("g").alias("y"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
            own = own.withColumn("y", F.substring("g", 2, k - 1)).join(lower, "y").drop("y")
        p = lambda n, c, q: (F.col(n) + M * F.col(q)) / (F.col(c) + M)
        below = C.stored(own.select("g", p("a", "ca", "pa0").alias("pa"), p("r", "cr", "pr0").alias("pr"), "pa0", "pr0"))
        levels.append(below)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    delta = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("pa0") / F.col("pr0"))
    return out.select("g", delta.alias("delta"))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Stored in as many files as there are shuffle partitions: so few bytes would else be one task's, whatever is made of them."""
    return C.stored(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def score(strings: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(s, score) per distinct s: the log ratio per character, to nine places."""
    own = _spread(strings.select("s").filter("s <> ''").distinct(), "s")
    own = C.stored(own.withColumn("id", F.monotonically_increasing_id()))
    # all grams that begin at a character are prefixes of the longest one there: each distinct one is summed up once
    at = own.select("id", F.explode(_starts(F.col("s"), order)).alias("w"))
    prefixes = at.select("w").distinct().select("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring("w", 1, k))).alias("g"))
    # merge joins: they spill, and parts with many rows of one gram are split
    worth = prefixes.join(model.hint("merge"), "g").groupBy("w").agg(F.sum("delta").alias("delta"))
    sums = at.join(worth.hint("merge"), "w").groupBy("id").agg(F.sum("delta").alias("total"))
    return own.join(sums, "id").select("s", F.round(F.col("total") / F.length("s"), 9).alias("score"))


def threshold(labelled: DataFrame) -> float | None:
    """Where the two classes' scores part: the same number of standard deviations from either mean.

    None if there are no accepted and no rejected rows to tell apart; infinite if one kind is missing.
    """
    w = F.col("n")
    row = labelled.agg(*[f.alias(f"{name}{cls}") for cls, cond in (("a", F.col("good")), ("r", ~F.col("good"))) for name, f in (("n", F.sum(F.when(cond, w))), ("s", F.sum(F.when(cond, w * F.col("score")))), ("q", F.sum(F.when(cond, w * F.col("score") * F.col("score")))))]).first()
    if not row["na"] and not row["nr"]:
        return None
    if not row["nr"] or not row["na"]:
        return float("inf") if not row["na"] else float("-inf")
    mean = {c: row["s" + c] / row["n" + c] for c in "ar"}
    dev = {c: max(1e-9, row["q" + c] / row["n" + c] - mean[c] ** 2) ** 0.5 for c in "ar"}
    return round((mean["a"] * dev["r"] + mean["r"] * dev["a"]) / (dev["a"] + dev["r"]), 9)


def judge(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the models' score (null where a rule fits)."""
    host, path = host_and_path(F.col(url))
    own = ["host", "path", "rule", "verdict", "score"]
    seen = C.set_aside(pages, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "said": verdict, "s": F.concat(F.lit("\x02"), "host", "path", F.lit("\x03"))})
    # the models see each string once, with the number of its rows
    strings = _spread(seen.groupBy("s", (F.col("said") == "allow").alias("good")).agg(F.count("*").alias("n")), "s")
    labelled = strings.filter("good is not null")
    scores = C.stored(strings.join(score(strings, fit(labelled, order), order), "s", "left"))
    scores = scores.withColumn("score", F.coalesce("score", F.lit(0.0)))
    line = threshold(scores.filter("good is not null"))
    allow = F.lit(True) if line is None else F.col("score") >= F.lit(line)
    # a rule fits all urls of one host and path or none, so these strings are the other rows' alone
    other = scores.filter("good is null").select("s", "score", allow.alias("ok"), "n")
    out = C.spread_join(seen, C.stored(other), "s", "n")
    return C.put_back(out.withColumn("verdict", F.coalesce("said", F.when(F.col("ok"), "allow").otherwise("block"))), own)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0].partition('/')[0], '/' + r[0].partition('/')[2])} THEN '{r[k]}'" for r in by_length) + " END"
    level = lambda k: f"""l{k} AS MATERIALIZED (SELECT g.g, (a + {M} * pa0) / (ca + {M}) AS pa, (r + {M} * pr0) / (cr + {M}) AS pr, pa0, pr0
      FROM (SELECT g.g, a, r, ca, cr, {'y.pa' if k > 1 else f'1.0::DOUBLE / {EVEN}'} AS pa0, {'y.pr' if k > 1 else f'1.0::DOUBLE / {EVEN}'} AS pr0
        FROM g JOIN c ON c.k = {k} AND c.x = substr(g.g, 1, {k - 1}) {f'JOIN l{k - 1} y ON y.g = substr(g.g, 2)' if k > 1 else ''} WHERE g.k = {k}) g)"""  # noqa: E731
    grams = "SELECT *, substr(s, i, k) AS g FROM (SELECT *, unnest(range(1, length(s) - k + 2)) AS i FROM {t}, range(1, %d) AS o(k) WHERE length(s) >= k)" % (ORDER + 1)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS said, chr(2) || host || path || chr(3) AS s FROM p),
z AS MATERIALIZED (SELECT s, said = 'allow' AS good, count(*) AS n FROM v GROUP BY ALL),
lab AS (SELECT * FROM z WHERE good IS NOT NULL),
g AS MATERIALIZED (SELECT g, k, sum(CASE WHEN good THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN good THEN 0 ELSE n END)::DOUBLE AS r FROM ({grams.format(t='lab')}) GROUP BY g, k),
c AS MATERIALIZED (SELECT k, substr(g, 1, k - 1) AS x, sum(a) AS ca, sum(r) AS cr FROM g GROUP BY ALL),
{", ".join(level(k) for k in range(1, ORDER + 1))},
m AS MATERIALIZED (SELECT g, ln(pa / pr) - ln(pa0 / pr0) AS delta FROM ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, ORDER + 1))})),
d AS (SELECT s, round(sum(delta) / length(s), 9) AS score FROM (SELECT s, g FROM ({grams.format(t='(SELECT DISTINCT s FROM z)')})) JOIN m USING (g) GROUP BY s),
e AS MATERIALIZED (SELECT z.*, coalesce(score, 0) AS score FROM z LEFT JOIN d USING (s)),
q AS (SELECT good, sum(n * score) / sum(n) AS mean, sqrt(greatest(1e-9::DOUBLE, sum(n * score * score) / sum(n) - pow(sum(n * score) / sum(n), 2))) AS dev FROM e WHERE good IS NOT NULL GROUP BY good),
t AS (SELECT CASE WHEN x.mean IS NULL AND y.mean IS NULL THEN '-inf'::DOUBLE WHEN x.mean IS NULL THEN 'inf'::DOUBLE WHEN y.mean IS NULL THEN '-inf'::DOUBLE
  ELSE round((x.mean * y.dev + y.mean * x.dev) / (x.dev + y.dev), 9) END AS line FROM (SELECT 1) LEFT JOIN q x ON x.good LEFT JOIN q y ON NOT y.good)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= line THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN (SELECT s, score FROM e WHERE good IS NULL) f USING (s), t
"""


ORACLE_SQL = _oracle()
