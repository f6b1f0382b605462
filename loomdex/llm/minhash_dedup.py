"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every document becomes its set of word shingles; equal sets form a class at
   once, by a 128-bit hash of the set, so copies cost one comparison at most.
2. Class signatures are cut into bands.  In a band's bucket every member is paired
   with the bucket's least member only (a star, not all pairs).
3. A pair's signatures are compared batch by batch.  After n values with m matches
   the posterior of the similarity under a uniform prior is Beta(m+1, n-m+1); a
   pair whose chance of reaching the threshold falls below ``MISS`` is dropped.
4. Survivors are verified on their full shingle sets, and linked classes joined.
5. A bucket whose members now lie in several components may hide a link that its
   star missed: only there are members compared with each other, inside tasks, in
   blocks, and again just those pairs that survive step 3 leave the task for step 4.
6. Such a bucket of more than ``LARGE`` classes is first split: into the buckets that its
   members have in common with each other in any other band, and these go through steps 2
   to 5 in their turn (with ever longer keys, ``LEVELS`` times at most), which links most of
   what belongs together cheaply.
7. Members of such a bucket may share no second one.  So those buckets that still hold several
   components after that are compared within as in step 5, all members of different
   components whose numbers of shingles allow a link, and no bucket is left out.

There are as many bands of 5 values as it takes for two classes at the threshold to share
no bucket with a probability of ``APART`` at most: 26 at 0.85, 39 at 0.80.  Above the
threshold it is less.

Cases: a null or empty text has an empty set, n_shingles 0 and no link; fewer words
than a shingle form one shingle; repeated rows are copies; a null id takes part and
gets its component's least id (null if it has none), kept false; empty tables give
empty results; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import common as C
from loomdex.llm.components import components

SHINGLE = 5
SIMILAR = 80  # percent
ROWS = 5
#: Chance at which two classes at the threshold may share no bucket.
APART = 2.5e-7
BATCH = 26
#: Chance at which a batch comparison may drop a pair that reaches the threshold.
MISS = 1e-8
#: Pivot groups above this many members are split over tasks, the pivot going along.
SPLIT = 4_000
#: Members of an unsettled bucket that are compared with each other at a time.
BLOCK = 1_024
#: Classes in an unsettled bucket above which it is split by other bands, before its members are compared
#: with each other, as many at a time; and how often it is split.
LARGE, LEVELS = 8_192, 3

_U = np.uint64


def bands_for(percent: int, apart: float = APART) -> int:
    return max(1, ceil(log(apart) / log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's rows and each row's first index (n + 1 values)."""
    ws, we, first = C.find_words(data, off)
    w = C.word_hashes(data, ws, we, lower=True)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    head = np.concatenate(([0], np.cumsum(count)))
    if not len(w):
        return np.zeros(0, _U), head
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - head[row] + first[row]
    sums = C.prefix_sums(w)
    return C.range_hash(sums, at, np.minimum(at + k, first[row + 1])), head


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return np.unique(_shingles(data, np.array([0, len(data)]), k)[0])


def _sketch(batch: pa.RecordBatch, k: int, mult: np.ndarray) -> Iterator[pa.RecordBatch]:
    values_ = len(mult)
    data, off = C.text_buffers(batch.column("text"))
    for i, j in C.chunks(off):
        sh, head = _shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        n = np.zeros(j - i, np.int64)
        cls: list[bytes | None] = [None] * (j - i)
        sig: list[bytes | None] = [None] * (j - i)
        full = np.flatnonzero(np.diff(head))
        if len(full):
            starts = head[full]
            x = (sh >> _U(32)).astype(np.uint32)
            least = np.empty((values_, len(full)), np.uint32)
            for h in range(values_):
                least[h] = np.minimum.reduceat(x * mult[h], starts)
            values = (C.mix(least.T.astype(_U) + (np.arange(values_, dtype=_U) << _U(32))) & _U(0xFFFF)).astype(np.uint16)
            for at, row in enumerate(full):
                own = np.unique(sh[head[row] : head[row + 1]])
                n[row] = len(own)
                cls[row] = int(C.mix(own).sum(dtype=_U)).to_bytes(8, "little") + int(C.mix(own + _U(0x5851F42D4C957F2D)).sum(dtype=_U)).to_bytes(8, "little")
                sig[row] = values[at].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("_k1").slice(i, j - i), batch.column("_k2").slice(i, j - i), pa.array(n), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["id", "_k1", "_k2", "n", "cls", "sig"])


def least_matches(percent: int, miss: float = MISS, values: int | None = None) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after every batch."""
    t, out = percent / 100, []
    for n in range(BATCH, (values or bands_for(percent) * ROWS) + 1, BATCH):
        chance, m = 0.0, 0
        while True:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(one: np.ndarray, many: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of ``many`` survive all batches against ``one`` (or against their own row of it)."""
    alive = np.arange(len(many))
    have, got, before = len(many), np.zeros(len(many), np.int64), 0
    for n, m in rules:
        if not len(alive):
            break
        left = one[before:n] if one.ndim == 1 else one[alive, before:n]
        got = got + (left == many[alive, before:n]).sum(1)
        ok = got >= m
        alive, got, before = alive[ok], got[ok], n
    out = np.zeros(have, bool)
    out[alive] = True
    return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("a", "b", "body", "salt")), strict=True)


def _by_pivot(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, body, salt): per pivot a (split by salt if it has many members) first its own body, then its members'."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    heads = many.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    members = pairs.join(many.filter("parts > 1"), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))
    rows = heads.unionByName(members).join(bodies, "b")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b")).select("a", "b", "body", "salt")


def _laid(member: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members (key, cid, comp, parts, upper) so that every two blocks of a bucket meet in one task: a member goes wherever its block is needed."""
    member = member.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    meet = F.explode(F.expr("transform(sequence(0, parts - 1), j -> struct(least(part, j) as x, greatest(part, j) as y))"))
    member = member.withColumn("at", meet).join(sigs.withColumnRenamed("b", "cid"), "cid")
    laid = member.select("key", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "part", "cid", "comp", "body", "upper")
    return laid.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "cid")


def _graded(member: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Members (key, cid, comp) of large buckets as buckets of those with alike numbers of shingles, ready to be laid out.

    Sets that link have sizes within ``percent`` of each other, so they are of one grade or of
    two next to each other (a grade being a little wider than that).  There is a bucket for
    each grade and the next one, whose members, marked ``upper``, needn't meet each other there.
    """
    width = max(1e-9, log(100 / percent)) * 1.0001
    member = member.join(sizes, "cid").withColumn("grade", F.floor(F.log("n") / F.lit(width)))
    places = F.array(F.struct(F.col("grade").alias("low"), F.lit(False).alias("upper")), F.struct((F.col("grade") - 1).alias("low"), F.lit(True).alias("upper")))
    member = member.withColumn("at", F.explode(places)).select(F.xxhash64("key", "at.low").alias("key"), "cid", "comp", F.col("at.upper").alias("upper"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("upper").alias("alone"), F.count("*").alias("m")).filter("lo <> hi and not alone")
    return member.join(mixed.select("key", F.ceil(F.col("m") / LARGE).cast("int").alias("parts")), "key")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own, out = None, None, []
        for a, b, body, _ in _stream(batches):
            if a == b:
                pivot, own = a, shingle_set(body, k)
                continue
            assert pivot == a
            other = shingle_set(body, k)
            if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(other) - both):
                out.append((a, b))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})

    needed = pairs.select(F.col("a").alias("b")).unionByName(pairs.select("b")).distinct()
    where = classes.select(F.col("cid").alias("b"), "_k1", "_k2").join(needed, "b", "left_semi")
    # of repeated rows one text is enough: they share both keys, and so would be read twice
    texts = docs.join(where, ["_k1", "_k2"]).select("b", F.encode("text", "UTF-8").alias("body"))
    return _by_pivot(pairs, texts).mapInArrow(C.tidy(verify), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = SHINGLE, percent: int = SIMILAR, keys: bool = False) -> DataFrame:
    """(ident, n_shingles, component_id, kept) per row of ``docs``; see the module's text."""
    C.small_batches(docs.sparkSession)
    docs = C.with_key(docs.select(F.col(ident).alias("id"), F.col(text).alias("text")), "text", "id")
    kind = docs.schema["id"].dataType.simpleString()
    bands_n = bands_for(percent)
    values = bands_n * ROWS
    rules, mult = least_matches(percent), _multipliers(values)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _sketch(b, shingle, mult)

    base = C.stored(docs.mapInArrow(C.tidy(sketch), f"id {kind}, _k1 long, _k2 long, n long, cls binary, sig binary"))
    # one row per class; the number it is given is fixed by writing it
    classes = base.filter("n > 0").groupBy("cls").agg(F.min("id").alias("least_id"), F.count("*").alias("rows"), F.min("n").alias("n"), F.min(F.struct("_k1", "_k2", "sig")).alias("r"))
    classes = C.stored(classes.select(F.monotonically_increasing_id().alias("cid"), "cls", "rows", "n", "least_id", "r._k1", "r._k2", "r.sig"))

    bands = F.expr(f"transform(sequence(0, {bands_n - 1}), i -> xxhash64(i, substring(sig, i * {2 * ROWS} + 1, {2 * ROWS})))")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own, names, held = None, None, [], []

        def flush():
            if names:
                ok = plausible(own, np.frombuffer(b"".join(held), np.uint16).reshape(-1, values), rules)
                good = [x for x, y in zip(names, ok, strict=True) if y]
                if good:
                    yield pa.RecordBatch.from_pydict({"a": [pivot] * len(good), "b": good})

        for a, b, body, _ in _stream(batches):
            if a == b:
                yield from flush()
                pivot, own, names, held = a, np.frombuffer(body, np.uint16), [], []
            else:
                names.append(b)
                held.append(body)
        yield from flush()

    sigs = classes.select(F.col("cid").alias("b"), F.col("sig").alias("body"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            x, y = rows[0][1], rows[0][2]
            part, cid, comp = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
            sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, values)
            upper = np.array([r[7] for r in rows])
            left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
            # in large blocks the first batch, which decides on most pairs, goes value by value
            n, m = rules[0] if rules and len(right) > 256 else (0, 0)
            ahead = np.ascontiguousarray(sig[right, :n].T)
            for at, i in enumerate(left):
                after = at + 1 if x == y else 0
                other = right[after:]
                same = np.zeros(len(other), np.uint16)
                for v in range(n):
                    same += ahead[v, after:] == sig[i, v]
                other = other[(same >= m) & (comp[other] != comp[i]) & ~(upper[i] & upper[other])]
                good = other[plausible(sig[i], sig[other], rules)]
                if len(good):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(cid[i], cid[good]), "b": np.maximum(cid[i], cid[good])})

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "x", "y", "part", "cid", "comp", "body", "upper")), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    links, known, aside = None, None, None  # verified and screened pairs of all levels, members of large buckets
    # a bucket's members agree in the bands that it has used
    buckets = classes.select("cid", F.explode(bands).alias("key")).withColumn("used", F.array("key"))
    for level in range(LEVELS + 1):
        groups = buckets.groupBy("key").agg(F.min("cid").alias("pivot"), F.count("*").alias("m")).filter("m > 1")
        members = C.stored(buckets.join(groups, "key").select("key", "used", "pivot", "cid"))
        pairs = members.filter("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
        pairs = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        screened = C.stored(_by_pivot(pairs, sigs).mapInArrow(C.tidy(screen), "a long, b long"))
        known = screened if known is None else known.unionByName(screened)
        found = C.stored(_verified(screened, classes, docs, shingle, percent))
        links = found if links is None else links.unionByName(found)
        comp = components(links)
        # buckets that still hold several components
        member = members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "used", "cid", F.coalesce("component", "cid").alias("comp"))
        open_ = C.stored(member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("key", "m"))
        large = open_.filter(F.col("m") > LARGE) if level < LEVELS else open_.limit(0)
        small = open_.join(large, "key", "left_anti").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
        laid = _laid(member.join(small, "key").withColumn("upper", F.lit(False)), sigs)
        rest = C.stored(laid.mapInArrow(C.tidy(within), "a long, b long").distinct().join(known, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            known = known.unionByName(rest)
            links = links.unionByName(C.stored(_verified(rest, classes, docs, shingle, percent)))
            comp = components(links)
        if level == LEVELS or large.isEmpty():
            break
        if aside is None:  # later levels' buckets are parts of these
            aside = C.stored(member.join(large.select("key"), "key").select("key", "cid"))
        other = classes.select("cid", F.explode(bands).alias("other"))
        longer = member.join(large.select("key"), "key").join(other, "cid").filter(~F.array_contains("used", F.col("other")))
        longer = longer.select("cid", F.array_sort(F.array_append("used", F.col("other"))).alias("used")).distinct()
        buckets = longer.select("cid", F.xxhash64("used").alias("key"), "used")

    if aside is not None:
        member = aside.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
        laid = _laid(_graded(member, classes.select("cid", "n"), percent), sigs)
        rest = C.stored(laid.mapInArrow(C.tidy(within), "a long, b long").distinct().join(known, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.unionByName(C.stored(_verified(rest, classes, docs, shingle, percent)))
            comp = components(links)

    named = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cls", "rows", "least_id", F.coalesce("component", "cid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = C.stored(named.join(least, "comp").select("cls", "rows", "component_id"))
    # a class may hold a third of all rows, and so may texts without a word, whose class is null
    out = C.spread_join(base, named, "cls", "rows")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    extra = ["_k1", "_k2"] if keys else []
    out = out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), *extra)
    return C.stored(out) if keys else out


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """``docs`` less all but one document of each near-duplicate group: that of the least id.

    Of its repeated rows one stays; texts without a word all stay; of a group in which
    no row has an id the copies of one text stay as one row, different texts all.
    """
    verdict = near_duplicates(docs, text, ident, shingle, percent, keys=True)
    drop = verdict.filter((F.col("n_shingles") > 0) & ~F.col("kept") & F.col("component_id").isNotNull()).select("_k1", "_k2").distinct()
    own = C.with_key(C.set_aside(docs, F.col(text).alias("text"), F.col(ident).alias("id")), "text", "id").drop("text", "id")
    rest = own.join(drop, ["_k1", "_k2"], "left_anti")
    twice = verdict.filter("n_shingles > 0").groupBy("_k1", "_k2").agg(F.count("*").alias("n")).filter("n > 1").select("_k1", "_k2")
    if not twice.isEmpty():
        # repeated rows only; dropDuplicates over everything would shuffle every text for them
        same = rest.join(twice, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
        rest = rest.join(twice, ["_k1", "_k2"], "left_anti").unionByName(same)
    return C.put_back(rest, [])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)


#: The same by a join of all shingles, for tables of a size that bears it.
ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
j AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS MATERIALIZED (SELECT a, b FROM j JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
t AS (SELECT rid AS a, rid AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT t.a, min(doc_id) AS component_id FROM t JOIN d ON d.rid = t.b GROUP BY t.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM d JOIN c ON c.a = d.rid LEFT JOIN n ON n.rid = d.rid
"""
