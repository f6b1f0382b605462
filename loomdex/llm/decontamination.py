"""Benchmark decontamination by template canonicalisation.

Texts and items are brought to templates: numbers, units after numbers and names
(capitalised words within a sentence) become typed placeholders, letters lower case,
and punctuation at word ends goes.  Every window of ``WINDOW`` template words is
hashed and joined with the items' windows.  An item is found in a text when enough of
its windows are; its slots must then be filled consistently: the same value of the
item stands for one value in the text.  That is judged per occurrence: over the hits
that lie alike (a window's place in the text less that in the item), over those that lie
within ``SLACK`` words of each other (a word put in or left out) and over all of them;
one that passes is enough.  A re-parameterised question passes,
another question of the same wording whose values don't correspond does not, unless
enough windows are verbatim.

Only hashes travel: the items' distinct window hashes are sent to all tasks in blocks of at
most ``BLOCK`` (8 bytes each), whatever their number, and meet the texts' window hashes,
which carry the row's key and the place but no text.  The few texts with a hit are fetched
by key afterwards and split into words once.  All steps are DataFrame operations.

Windows with fewer than ``LITERAL`` words that aren't placeholders are passed over.  Items
without another, and those of fewer than ``WINDOW`` words, are found verbatim only: all
their words in a row, values kept, whatever the case and the punctuation at word ends.

Cases: null and empty texts match nothing; items without a letter (numbers in a row)
match nothing; repeated rows are found alike, and once per id; repeated items are each
reported; empty tables give empty results; ``drop_contaminated`` keeps other columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm import common as C

WINDOW = 8
LITERAL = 4
#: Share of an item's windows that must be found (at least two windows, if it has as many).
SHARE = 0.25
#: Hits of one occurrence lie at most so many words apart from the next ones.
SLACK = 8
#: Hashes (8 bytes, some 24 in a hash table) that are sent to every task at a time.
BLOCK = 4_000_000
#: Keys of texts with a hit (8 bytes) up to which they are sent to every task; more are joined by shuffle.
KEYS = 1_000_000

NUM, UNIT, NAME = "\x10", "\x11", "\x12"
UNITS = "%|km|m|cm|mm|mi|miles?|kg|g|mg|lbs?|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|l|ml|litres?|liters?|kb|mb|gb|tb|hz|khz|mhz|ghz|kmh|mph|degrees?"
_SPACE = "\\x20\\x09-\\x0D"
_PUNCT = ".,;:!?\"')\\]"


def words(text: Column) -> Column:
    """Words as they stand."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), f"[{_SPACE}]+")


def template(text: Column) -> Column:
    """The template as a text with as many words as ``text``.

    Every pattern begins with a character to look for and looks back only from there.
    """
    t = F.regexp_replace(text, f"([0-9][{_SPACE}])(?i:{UNITS})(?=[{_PUNCT}]*(?:[{_SPACE}]|$))", "$1" + UNIT)
    t = F.regexp_replace(t, f"\\p{{Lu}}(?<=[\\p{{Ll}},;][{_SPACE}]\\p{{Lu}})[\\p{{L}}'-]*", NAME)
    t = F.regexp_replace(t, "[0-9](?:[0-9.,:/]*[0-9])?", NUM)
    t = F.regexp_replace(t, f"[{_PUNCT}](?<=[^{_SPACE}].)[{_PUNCT}]*(?=[{_SPACE}]|$)", "")
    return F.lower(t)


def _windows(form: Column, window: int) -> Column:
    """Hashes of all windows of a template's words (empty if there are too few)."""

    def hashed(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        own = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(F.size(h) >= window, own).otherwise(F.array().cast("array<bigint>"))

    # the words are hashed once: as a lambda's variable they aren't computed again for each window
    return F.get(F.transform(F.array(F.transform(words(form), lambda w: F.xxhash64(w))), hashed), 0)


def _slots(own: Column, shape: Column, at: Column, window: int) -> Column:
    """Of a window at ``at`` in a text's and its template's words: (place, kind, value) of its placeholders, punctuation at the ends left out."""
    own, shape = F.slice(own, at + 1, window), F.slice(shape, at + 1, window)
    pair = F.transform(F.arrays_zip(own.alias("w"), shape.alias("t")), lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), F.regexp_replace(x["w"], f"[{_PUNCT}]+$", "").alias("v")))
    return F.filter(pair, lambda x: x["t"].rlike(f"[{NUM}{UNIT}{NAME}]"))


def _matching(rows: DataFrame, hashes: DataFrame, block: int) -> DataFrame:
    """``rows`` whose ``h`` is among distinct ``hashes``, which are sent to every task in blocks; stored."""
    hashes = C.stored(hashes.select("h").distinct())
    blocks = max(1, -(-hashes.count() // max(1, block // 2)))  # hashing spreads distinct ones evenly enough for half to be safe
    out = None
    for b in range(blocks):
        part = hashes if blocks == 1 else hashes.filter(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(blocks)) == b)
        hit = rows.join(F.broadcast(part), "h", "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return C.stored(out)


def _texts_of(base: DataFrame, hits: DataFrame) -> DataFrame:
    """(_k1, _k2, text) of the rows of ``base`` that ``hits`` names, each once."""
    keys = C.stored(hits.select("_k1").distinct())
    send = F.broadcast if keys.limit(KEYS + 1).count() <= KEYS else (lambda df: df)
    return base.join(send(keys), "_k1", "left_semi").groupBy("_k1", "_k2").agg(F.first("text").alias("text"))


def item_windows(items: DataFrame, text: str = "text", ident: str = "item_id", window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(item_id, h, at, slots, n): the windows of every item that may be matched, and how many there are."""
    base = items.filter(F.col(text).isNotNull()).select(F.col(ident).alias("item_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("t"), template(F.col(text)).alias("f"))
    names = words(F.col("f"))
    base = base.filter(F.size(names) >= window).withColumn("names", names)
    rows = base.select("item_id", "_row", words(F.col("t")).alias("t"), "f", "names", F.posexplode(_windows(F.col("f"), window)).alias("at", "h"))
    plain = F.size(F.filter(F.slice("names", F.col("at") + 1, window), lambda w: ~w.rlike(f"[{NUM}{UNIT}{NAME}]")))
    rows = rows.filter(plain >= literal).select("item_id", "_row", "h", "at", _slots(F.col("t"), F.col("names"), F.col("at"), window).alias("slots"))
    count = rows.groupBy("item_id", "_row").agg(F.countDistinct("at").alias("n"))
    return rows.join(count, ["item_id", "_row"])


def _plain(text: Column) -> Column:
    """Lower-case words without punctuation at their ends; words of nothing else go."""
    bare = F.regexp_replace(text, f"[(\\[{_PUNCT}]+(?=[{_SPACE}]|$)|(?<![^{_SPACE}])[(\\[{_PUNCT}]+", "")
    return F.filter(words(F.lower(bare)), lambda w: w != "")


def find_verbatim(base: DataFrame, items: DataFrame, wanted: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame | None:
    """The items (item_id, text) without a row in ``wanted`` that stand in ``base`` (doc_id, text, _k1, _k2) as a whole; None if all have one."""
    items = items.filter(F.col("text").rlike("\\p{L}")).withColumn("_row", F.xxhash64("text"))
    rest = items.join(wanted.select("_row").distinct(), "_row", "left_anti").select("item_id", "_row", _plain(F.col("text")).alias("all"))
    # found by their first words, at most a window of them; then all are compared
    hashed = lambda h, k: F.xxhash64(F.lit(k), *[F.get(h, i) for i in range(k)])
    anchor = F.coalesce(*[F.when(F.size("all") >= k, hashed(F.col("all"), k)) for k in range(window, 0, -1)])
    rest = C.stored(rest.filter(F.size("all") > 0).select("item_id", "_row", "all", F.least(F.size("all"), F.lit(window)).alias("k"), anchor.alias("h")))
    sizes = sorted(r["k"] for r in rest.select("k").distinct().collect())  # at most ``window`` numbers
    if not sizes:
        return None
    own = base.withColumn("words", _plain(F.col("text")))
    starts = F.sequence(F.lit(0), F.size("words") - 1)
    at = lambda k: lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get("words", i + j) for j in range(k)]).alias("h"))
    every = F.flatten(F.array(*[F.transform(starts, at(k)) for k in sizes]))
    key = ["doc_id", "_k1", "_k2"]
    rows = own.filter(F.size("words") > 0).select(*key, F.explode(every).alias("x")).select(*key, "x.*")
    hits = _matching(rows, rest, block).join(rest, "h")
    whole = hits.filter(F.size("all") <= F.col("k")).select("doc_id", "item_id", "_row")
    longer = hits.filter(F.size("all") > F.col("k")).groupBy(*key, "item_id", "_row", "all").agg(F.collect_set("pos").alias("places"))
    if not rest.filter(F.size("all") > F.col("k")).isEmpty():
        longer = longer.join(_texts_of(base, longer).withColumn("words", _plain(F.col("text"))), ["_k1", "_k2"])
        longer = longer.filter(F.exists("places", lambda p: F.slice("words", p + 1, F.size("all")) == F.col("all")))
        whole = whole.unionByName(longer.select("doc_id", "item_id", "_row"))
    one = F.lit(1).cast("long")
    return whole.distinct().select("doc_id", "item_id", one.alias("windows"), one.alias("item_windows"), F.lit(True).alias("verbatim"), F.lit(0).cast("long").alias("slots"))


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id", item_text: str = "text", item_ident: str = "item_id", window: int = WINDOW, share: float = SHARE, literal: int = LITERAL, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, verbatim, slots): the items found in each text.

    An item that is found verbatim only counts as one window.
    """
    stored = C.stored
    wanted = stored(item_windows(items, item_text, item_ident, window, literal))
    base = docs.filter(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    base = C.with_key(base, "text", "doc_id")
    key = ["doc_id", "_k1", "_k2"]
    form = template(F.col("text"))
    rows = base.select(*key, F.posexplode(_windows(form, window)).alias("pos", "h"))
    met = _matching(rows, wanted, block).distinct()
    # the texts with hits are split once, and the slots of all their places read off
    places = met.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("places")).join(_texts_of(base, met), ["_k1", "_k2"])
    split = F.array(F.struct(words(F.col("text")).alias("w"), words(form).alias("f")))
    read = F.transform(split, lambda x: F.transform("places", lambda p: F.struct(p.alias("pos"), _slots(x["w"], x["f"], p, window).alias("own"))))
    own = places.select("_k1", "_k2", F.explode(F.get(read, 0)).alias("x")).select("_k1", "_k2", "x.*")
    hits = met.join(own, ["_k1", "_k2", "pos"]).join(wanted, "h").select("doc_id", "item_id", "_row", "n", "at", (F.col("pos") - F.col("at")).alias("lies"), "slots", "own")
    value = lambda s: F.transform(s, lambda x: x["v"])
    hits = stored(hits.withColumn("same", value(F.col("slots")) == value(F.col("own"))))
    pair = ["doc_id", "item_id", "_row"]
    along = W.partitionBy(*pair).orderBy("lies")
    apart = F.when(F.col("lies") - F.lag("lies").over(along) > SLACK, 1).otherwise(0)
    runs = hits.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along.rangeBetween(W.unboundedPreceding, W.currentRow)))
    # each hit counts in its alignment, in its run and in the whole text
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("long").alias("at")) for k, x in enumerate((F.col("lies"), F.col("run"), F.lit(0)))])
    hits = stored(runs.withColumn("group", F.explode(groups)))
    key = [*pair, "group"]
    found = hits.groupBy(*key).agg(F.first("n").alias("n"), F.countDistinct("at").alias("windows"), F.countDistinct(F.when(F.col("same"), F.col("at"))).alias("exact"))
    need = F.least(F.col("n"), F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(float(share)))))
    # every value of the item must stand for one value of the text
    zipped = F.explode(F.arrays_zip(F.col("slots").alias("s"), F.col("own").alias("o")))
    filled = hits.select(*key, zipped.alias("z")).select(*key, F.col("z.s.t").alias("kind"), F.col("z.s.v").alias("v"), F.col("z.o.v").alias("u"))
    filled = filled.groupBy(*key, "kind", "v").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    filled = filled.groupBy(*key).agg(F.count("*").alias("slots"), F.max(F.col("lo") != F.col("hi")).alias("torn"))
    same = (found["doc_id"].eqNullSafe(filled["doc_id"])) & (found["item_id"].eqNullSafe(filled["item_id"])) & (found["_row"] == filled["_row"]) & (found["group"] == filled["group"])
    out = found.join(filled, same, "left").select(*[found[k] for k in pair], "n", "windows", "exact", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("torn", F.lit(False)).alias("torn"))
    out = out.filter((F.col("windows") >= need) & (~F.col("torn") | (F.col("exact") >= need)))
    out = out.groupBy(*pair).agg(F.max(F.struct("windows", "exact", "slots", "n")).alias("best")).select("doc_id", "item_id", "best.*")
    out = out.select("doc_id", "item_id", "windows", F.col("n").alias("item_windows"), (F.col("exact") == F.col("windows")).alias("verbatim"), F.col("slots").cast("long").alias("slots"))
    short = find_verbatim(base, items.select(F.col(item_ident).alias("item_id"), F.col(item_text).alias("text")), wanted, window, block)
    return out if short is None else out.unionByName(short)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    own = C.set_aside(docs, F.col(text).alias("text"), F.col(ident).alias("doc_id"))
    bad = find_items(own, items).select(F.col("doc_id").alias("_bad")).distinct()
    return C.put_back(own.join(bad, own["doc_id"].eqNullSafe(bad["_bad"]), "left_anti"), [])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_items(docs, items)
