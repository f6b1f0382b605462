"""The query registry of the engine's own operators, with the same results as DuckDB SQL.

Every query runs over whole tables.  Scores are compared as whole millionths, since two
engines add floating-point numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import intent as I
from loomdex.functions import scalars as S
from loomdex.functions import text as X
from loomdex.operators import detect, diff, graph, memory, pack, rank, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _micro(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5).cast("long")


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


# ---- SQL building blocks


def _terms(x: str) -> str:
    return f"[w FOR w IN regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']"


_STOP = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))


def _tokens(x: str) -> str:
    """Prose tokens: punctuation to blanks, humps parted, lower case, short and stop words out."""
    clean = f"regexp_replace(coalesce({x}, ''), '[\\s,;:()\\[\\]{{}}<>\"''`!?#$%^&*+=|\\\\~@]+', ' ', 'g')"
    humps = f"regexp_replace(regexp_replace({clean}, '([^A-Z ])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z]{{2}}[a-z])', '\\1 \\2', 'g')"
    return f"[w FOR w IN string_split(lower({humps}), ' ') IF strlen(w) > 1 AND w NOT IN ({_STOP})]"


def _m(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::BIGINT"


def _bm25_sql(table: str, ident: str, fields: dict[str, float], query: list[str]) -> str:
    """CTEs ending in ``scored`` (ident, bm25)."""
    cols = ", ".join(f"{_terms(f)} AS x_{i}" for i, f in enumerate(fields))
    dl = " + ".join(f"len(x_{i})" for i in range(len(fields)))
    freq = ", ".join("(" + " + ".join(f"len([w FOR w IN x_{i} IF w = '{t}']) * {w}::DOUBLE" for i, w in enumerate(fields.values())) + f") AS f{k}" for k, t in enumerate(query))
    dfs = ", ".join(f"sum((f{k} > 0)::INT) AS df{k}" for k in range(len(query)))
    any_ = " OR ".join(f"f{k} > 0" for k in range(len(query)))
    term = " + ".join(f"greatest(ln((N - df{k} + 0.5) / (df{k} + 0.5)), 1e-6::DOUBLE) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for k in range(len(query)))
    return f"""b0 AS (SELECT {ident}, {cols} FROM {table}), b1 AS (SELECT {ident}, ({dl})::DOUBLE AS dl, {freq} FROM b0),
      b2 AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS avgdl, {dfs} FROM b1),
      scored AS (SELECT {ident}, {term} AS bm25 FROM b1, b2 WHERE {any_})"""


_Q = ["then", "there", "src3"]
_DOC_FIELDS = {"text": 1.0, "source": 3.0}


@_query(f"WITH {_bm25_sql('documents', 'doc_id', _DOC_FIELDS, _Q)} SELECT doc_id, {_m('bm25')} AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_topk(spark, sf):
    scored = rank.bm25(_t(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", _DOC_FIELDS, _Q)
    return rank.top_k(scored.select("doc_id", _micro(F.col("bm25")).alias("score")), 10, "score", "doc_id")


@_query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term")
def term_doc_frequency(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.array_distinct(X.fts_terms(F.col("text"))).alias("t"))
    return rank.document_frequencies(docs.select("doc_id", F.explode("t").alias("term")))


@_query(f"SELECT doc_id, term, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY doc_id, term")
def term_frequency(spark, sf):
    return rank.term_frequencies(_t(spark, sf, "documents"), "doc_id", X.fts_terms(F.col("text"))).select("doc_id", "term", "n")


@_query(f"""WITH t AS (SELECT doc_id, {_terms('text')} AS x FROM documents), e AS (SELECT doc_id, len(x) AS total, unnest(x) AS term FROM t),
  tf AS (SELECT doc_id, term, count(*) / max(total)::DOUBLE AS tf FROM e GROUP BY doc_id, term),
  q AS (SELECT term, 0.5::DOUBLE AS q, ln((SELECT count(*) FROM documents)::DOUBLE / (1 + count(*))) AS idf FROM tf WHERE term IN ('ounder', 'heres', 'with') GROUP BY term),
  s AS (SELECT doc_id, sum(tf * idf * q * idf) AS dot, sqrt(sum(tf * idf * tf * idf)) AS n FROM tf JOIN q USING (term) GROUP BY doc_id)
  SELECT doc_id, {_m('CASE WHEN n > 0 AND qn > 0 THEN dot / (n * qn) ELSE 0 END')} AS cosine FROM s, (SELECT sqrt(sum(q * idf * q * idf)) AS qn FROM q)""")
def tfidf_query_cosine(spark, sf):
    docs = _t(spark, sf, "documents")
    tf = rank.term_frequencies(docs, "doc_id", X.fts_terms(F.col("text")))
    wanted = {"ounder": 0.5, "heres": 0.5, "with": 0.5}
    mine = tf.filter(F.col("term").isin(*wanted))
    out = rank.query_cosine(mine, "doc_id", wanted, docs.count(), rank.document_frequencies(mine))
    return out.select("doc_id", _micro(F.col("tfidf")).alias("cosine"))


@_query("""WITH g AS (SELECT p_partkey, list_distinct([substr(lower(p_name), i, 3) FOR i IN range(1, length(p_name) - 1)]) AS a,
    list_distinct([substr('part number 12', i, 3) FOR i IN range(1, 13)]) AS b FROM part)
  SELECT p_partkey, floor(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE * 1e6 + 0.5)::BIGINT AS similarity FROM g""")
def trigram_jaccard(spark, sf):
    sim = X.jaccard(X.trigrams(F.col("p_name")), X.trigrams(F.lit("Part number 12")))
    return _t(spark, sf, "part").select("p_partkey", _micro(sim).alias("similarity"))


@_query(f"""WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
  s AS (SELECT vec_id, list_sum([embedding[i]::DOUBLE * v[i]::DOUBLE FOR i IN range(1, 65)]) AS d, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN v])) AS n FROM embeddings, q)
  SELECT vec_id, {_m('greatest(d / n, 0)')} AS cosine FROM s ORDER BY 2 DESC, 1 LIMIT 10""")
def embedding_topk(spark, sf):
    rows = _t(spark, sf, "embeddings")
    first = rows.orderBy("vec_id").limit(1).select("embedding").first()
    vector = F.array(*[F.lit(float(v)) for v in first["embedding"]])
    near = rows.select("vec_id", _micro(F.greatest(X.dense_cosine(F.col("embedding"), vector), F.lit(0.0))).alias("cosine"))
    return rank.top_k(near, 10, "cosine", "vec_id")


@_query(f"""WITH {_bm25_sql('documents', 'doc_id', _DOC_FIELDS, _Q)},
  c AS (SELECT doc_id, bm25 FROM scored ORDER BY {_m('bm25')} DESC, doc_id LIMIT 100),
  j AS (SELECT c.doc_id, bm25, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0) AS toxic FROM c LEFT JOIN labels USING (doc_id)),
  r AS (SELECT *, min(bm25) OVER () AS b0, max(bm25) OVER () AS b1, min(quality) OVER () AS q0, max(quality) OVER () AS q1 FROM j)
  SELECT doc_id, {_m('0.35 * CASE WHEN b1 - b0 < 2.3e-16 THEN 0 ELSE (bm25 - b0) / (b1 - b0) END + 0.25 * CASE WHEN q1 - q0 < 2.3e-16 THEN 0 ELSE (quality - q0) / (q1 - q0) END + CASE WHEN toxic = 0 THEN 0.1 ELSE 0 END')} AS score FROM r""")
def minmax_hybrid(spark, sf):
    scored = rank.bm25(_t(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", _DOC_FIELDS, _Q)
    top = rank.top_k(scored.withColumn("_m", _micro(F.col("bm25"))), rank.SYMBOL_CANDIDATES, "_m", "doc_id")
    own = top.join(_t(spark, sf, "labels"), "doc_id", "left").withColumns({"centrality": F.coalesce("quality", F.lit(0)).cast("double"), "toxic": F.coalesce("toxic", F.lit(0))})
    own = own.withColumns({"b": rank.min_max(F.col("bm25")), "c": rank.min_max(F.col("centrality"))})
    score = rank.hybrid(I.INTENTS["debug"].weights(False), F.when(F.col("toxic") == 0, 0.1).otherwise(0.0), bm25=F.col("b"), centrality=F.col("c"))
    return own.select("doc_id", _micro(score).alias("score"))


def _intent_sql(x: str) -> str:
    count = {n: " + ".join(f"contains(lower(coalesce({x}, '')), '{w}')::INT" for w in words) for n, words in I.KEYWORDS.items()}
    cols = ", ".join(f"({c}) AS n_{n}" for n, c in count.items())
    most = "greatest(" + ", ".join(f"n_{n}" for n in count) + ")"
    return f"SELECT conv_id, turn, CASE WHEN {most} = 0 THEN 'explore' " + " ".join(f"WHEN n_{n} = {most} THEN '{n}'" for n in count) + f" END AS intent FROM (SELECT conv_id, turn, {cols} FROM conversations)"


@_query(_intent_sql("text"))
def intent_classify(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", I.detect(F.col("text")).alias("intent"))


@_query("SELECT doc_id, ceil(strlen(coalesce(text, '')) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@_query("""SELECT doc_id, CASE WHEN said = '' THEN 'General relevance' ELSE said END AS reason FROM (SELECT doc_id, concat_ws(', ',
    CASE WHEN doc_id % 10 > 7 THEN 'High centrality (called by ' || (doc_id % 7) || ' symbols)' END, CASE WHEN doc_id % 5 = 4 THEN 'Strong term match' END,
    CASE WHEN doc_id % 3 = 2 THEN 'High TF-IDF similarity' END, CASE WHEN doc_id % 4 = 1 THEN 'debug-boosted' END, CASE WHEN doc_id % 11 > 3 THEN 'Partial name match' END,
    CASE WHEN doc_id % 6 > 3 THEN 'Semantic match' END, CASE WHEN lang = 'en' THEN 'Has documentation' END) AS said FROM documents)""")
def score_reason(spark, sf):
    share = lambda n, k: F.when(F.col("doc_id") % n > k, 0.9).otherwise(0.1)
    i = F.col("doc_id")
    said = rank.reason(F.lit("debug"), share(10, 7), share(5, 3), share(3, 1), F.when(i % 4 == 1, 0.2).otherwise(0.0), share(11, 3), share(6, 3), i % 7, F.col("lang") == "en")
    return _t(spark, sf, "documents").select("doc_id", said.alias("reason"))


_TRANSITIONS = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


def _transitions(spark, sf):
    """Edges between the types of consecutive events of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.lit("next").alias("kind")).filter("dst is not null")


@_query(f"""WITH e AS (SELECT * FROM ({_TRANSITIONS}) WHERE dst IS NOT NULL)
  SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id""")
def event_graph_degree(spark, sf):
    return graph.degrees(_transitions(spark, sf))


_PART_SUPP = "SELECT DISTINCT l_partkey AS src, 1000000000 + l_suppkey AS dst FROM lineitem"


def _part_supp(spark, sf):
    return _part_supp_rows(spark, sf).distinct().withColumn("kind", F.lit("supplied"))


def _part_supp_rows(spark, sf):
    """The same edges as often as they occur, for searches, which don't count them."""
    return _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000000).alias("dst"))


_RANK = "SELECT i.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT sum(CASE WHEN out IS NULL THEN r ELSE 0 END) FROM r{p} LEFT JOIN o ON o.src = r{p}.id) / n) AS r FROM ids i CROSS JOIN c LEFT JOIN (SELECT dst, sum(r / out) AS g FROM e JOIN o USING (src) JOIN r{p} ON r{p}.id = e.src GROUP BY dst) x ON x.dst = i.id"


@_query(f"""WITH e AS MATERIALIZED ({_PART_SUPP} UNION ALL SELECT 1000000000 + l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 2 = 0)),
  ids AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT count(*)::DOUBLE AS n FROM ids), o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY src),
  r0 AS (SELECT id, 1 / n AS r FROM ids, c), r1 AS MATERIALIZED ({_RANK.format(p=0)}), r2 AS MATERIALIZED ({_RANK.format(p=1)}), r3 AS ({_RANK.format(p=2)})
  SELECT id, floor(r * 1e9 + 0.5)::BIGINT AS rank FROM r3""")
def pagerank_transitions(spark, sf):
    one = _part_supp(spark, sf)
    back = one.filter("src % 2 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    edges = graph.stored(one.unionByName(back))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    out = graph.pagerank(nodes, edges, rounds=3, tolerance=None, scale=False)
    return out.select("id", F.floor(F.col("centrality") * 1e9 + 0.5).cast("long").alias("rank"))


@_query(f"""WITH e AS ({_PART_SUPP}), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  one AS (SELECT b AS id FROM s WHERE a = 1), two AS (SELECT DISTINCT b AS id FROM s WHERE a IN (SELECT id FROM one))
  SELECT id, min(depth)::INT AS depth FROM (SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two) WHERE id <> 1 GROUP BY id""")
def bfs_depth2(spark, sf):
    return graph.bfs(_part_supp_rows(spark, sf), spark.createDataFrame([(1,)], "id long"), "both", 2).select("id", "depth")


@_query("""WITH RECURSIVE e AS (SELECT 2000 + s_suppkey AS src, s_nationkey::BIGINT AS dst FROM supplier UNION ALL SELECT n_nationkey, 1000 + n_regionkey FROM nation),
  c AS (SELECT dst AS id, src AS who FROM e UNION SELECT c.id, e.src FROM c JOIN e ON e.dst = c.who)
  SELECT id, count(*)::BIGINT AS callers, CASE WHEN count(*) <= 4 THEN 'low' WHEN count(*) <= 20 THEN 'medium' ELSE 'high' END AS radius FROM c GROUP BY id""")
def transitive_radius(spark, sf):
    a = _t(spark, sf, "supplier").select((F.col("s_suppkey") + 2000).alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    edges = a.unionByName(_t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst")))
    return graph.transitive_callers(edges, edges.select(F.col("dst").alias("id")))


_TYPES = ("signup", "purchase", "error", "view", "click")


@_query(f"""WITH RECURSIVE e AS (SELECT DISTINCT list_position({list(_TYPES)}, src)::BIGINT AS a, list_position({list(_TYPES)}, dst)::BIGINT AS b FROM ({_TRANSITIONS}) WHERE dst IS NOT NULL),
  p AS (SELECT [1::BIGINT] AS path UNION ALL SELECT list_append(path, b) FROM p JOIN e ON e.a = path[-1] WHERE NOT list_contains(path, b) AND path[-1] <> 2)
  SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM p WHERE path[-1] = 2 ORDER BY len(path), path LIMIT 3""")
def k_paths(spark, sf):
    number = F.create_map(*[F.lit(x) for i, t in enumerate(_TYPES) for x in (t, i + 1)])
    edges = _transitions(spark, sf).select(number[F.col("src")].cast("long").alias("src"), number[F.col("dst")].cast("long").alias("dst")).distinct()
    return graph.k_paths(edges, 1, 2, 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "hops")


@_query("SELECT l_partkey AS id, 'calls both' AS how FROM (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2) ORDER BY 1 LIMIT 5")
def bridge_parts(spark, sf):
    return graph.bridges(_part_supp(spark, sf), 1000000001, 1000000002)


@_query("""WITH s AS (SELECT s_suppkey AS id, n_regionkey AS f, 'n' || s_nationkey AS name, s_acctbal > 0 AS ex FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  c AS (SELECT 1000000 + c_custkey AS src, n_regionkey AS f, 'n' || (c_nationkey * 7 % 25) AS to_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT src, dst FROM (SELECT src, s.id AS dst, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN s.f = c.f THEN 0 WHEN ex THEN 1 ELSE 2 END, s.id) AS k FROM c JOIN s ON s.name = c.to_name) WHERE k = 1""")
def edge_resolve_cascade(spark, sf):
    nation = _t(spark, sf, "nation")
    files = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("path"))
    at = lambda k: F.col(k) == F.col("n_nationkey")
    who = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    supp = _t(spark, sf, "supplier").join(nation, at("s_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").cast("long").alias("file_id"), F.concat(F.lit("n"), "s_nationkey").alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("fqn"), F.lit(1).alias("start_line"), (F.col("s_acctbal") > 0).alias("is_exported"))
    cust = _t(spark, sf, "customer").join(nation, at("c_nationkey"))
    own = cust.select((F.col("c_custkey") + 1000000).alias("id"), F.col("n_regionkey").cast("long").alias("file_id"), who.alias("name"), who.alias("fqn"), F.lit(1).alias("start_line"), F.lit(True).alias("is_exported"))
    raw = cust.join(files, F.col("n_regionkey") == F.col("id")).select("path", who.alias("from_fqn"), F.concat(F.lit("n"), F.col("c_nationkey") * 7 % 25).alias("to_name"), F.lit("calls").alias("kind"))
    return resolve.resolve_edges(raw, supp.unionByName(own), files).select("src", "dst")


@_query("""WITH a AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS path, md5(text || CASE WHEN doc_id % 5 = 1 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 0)
  SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def manifest_diff(spark, sf):
    docs = _t(spark, sf, "documents")
    old = docs.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    new = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.concat("text", F.when(F.col("doc_id") % 5 == 1, "x").otherwise(""))).alias("content_hash"))
    return diff.manifest(old, new)


_A = "SELECT 'p' || p_partkey AS fqn, p_brand AS path, p_name AS sig, p_size > 25 AS ex, md5(p_type) AS body FROM part WHERE p_partkey % 17 <> 0"
_B = "SELECT 'p' || p_partkey AS fqn, p_brand AS path, CASE WHEN p_partkey % 11 = 0 THEN p_name || '!' ELSE p_name END AS sig, (p_size > 25) <> (p_partkey % 13 = 0) AS ex, md5(CASE WHEN p_partkey % 5 = 0 THEN p_type || '.' ELSE p_type END) AS body FROM part WHERE p_partkey % 19 <> 0"


@_query(f"""SELECT coalesce(a.fqn, b.fqn) AS symbol_fqn, CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'removed' WHEN a.sig <> b.sig THEN 'signature_changed' WHEN a.ex <> b.ex THEN 'visibility_changed' ELSE 'body_changed' END AS change_kind,
  CASE WHEN a.fqn IS NULL THEN NULL WHEN b.fqn IS NULL THEN a.sig WHEN a.sig <> b.sig THEN a.sig WHEN a.ex <> b.ex THEN CASE WHEN a.ex THEN 'exported' ELSE 'private' END ELSE a.body END AS old_value
  FROM ({_A}) a FULL JOIN ({_B}) b ON a.fqn = b.fqn WHERE a.fqn IS NULL OR b.fqn IS NULL OR a.sig <> b.sig OR a.ex <> b.ex OR a.body <> b.body""")
def symbol_diff_priority(spark, sf):
    part, k = _t(spark, sf, "part"), F.col("p_partkey")

    def side(gone, sig, ex, body):
        return part.filter(k % gone != 0).select(F.concat(F.lit("p"), k.cast("string")).alias("fqn"), F.col("p_brand").alias("path"), sig.alias("signature"), ex.alias("is_exported"), F.md5(body).alias("body_hash"))

    old = side(17, F.col("p_name"), F.col("p_size") > 25, F.col("p_type"))
    new = side(19, F.when(k % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), (F.col("p_size") > 25) != (k % 13 == 0), F.when(k % 5 == 0, F.concat("p_type", F.lit("."))).otherwise(F.col("p_type")))
    return diff.symbol_changes(old, new).select("symbol_fqn", "change_kind", "old_value")


@_query("""WITH p AS (SELECT p_partkey AS k, p_brand || '/' || (p_partkey // 40) AS f, p_name AS n FROM part), j AS (SELECT a.f, a.n AS x, b.n AS y FROM p a JOIN p b ON a.f = b.f WHERE a.k % 2 = 0 AND b.k % 2 = 1)
  SELECT f AS file_path, f || '::' || x AS old_fqn, f || '::' || y AS new_fqn FROM j
  WHERE greatest(strlen(x), strlen(y)) > 0 AND abs(strlen(x) - strlen(y)) <= ceil(greatest(strlen(x), strlen(y)) * 0.2::DOUBLE) AND levenshtein(x, y) <= 3""")
def rename_pairs(spark, sf):
    k = F.col("p_partkey")
    where = F.concat("p_brand", F.lit("/"), F.floor(k / 40).cast("string"))
    changes = _t(spark, sf, "part").select(where.alias("file_path"), F.concat(where, F.lit("::"), "p_name").alias("symbol_fqn"), F.when(k % 2 == 0, "removed").otherwise("added").alias("change_kind"))
    return diff.rename_candidates(changes)


@_query("SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id % 50 = 0 AS is_stale FROM documents")
def stale_semijoin(spark, sf):
    obs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50 == 0).alias("is_stale"))
    links = _t(spark, sf, "labels").select(F.col("doc_id").alias("observation_id"), F.concat(F.lit("toxic"), F.col("toxic").cast("string")).alias("symbol_fqn"))
    changes = spark.createDataFrame([("toxic1", "signature_changed", None)], "symbol_fqn string, change_kind string, old_value string")
    return diff.mark_stale(obs, links, changes)


_EV = "SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events"


def _events(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", _seconds(F.col("ts")).alias("t"))


@_query(f"WITH e AS ({_EV}) SELECT a.user_id, a.t AS t0, b.t AS t1 FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = 'signup' AND b.event_type = 'error' AND b.t > a.t AND b.t - a.t < 300")
def dead_end_selfjoin(spark, sf):
    return detect.dead_end_pairs(_events(spark, sf), 300, "signup", "error", "user_id", "t", "event_type")


@_query(f"WITH e AS ({_EV}) SELECT 'u' || user_id AS session_id, 'File ''' || event_type || ''' has ' || count(*) || ' structural changes within the detection window' AS summary FROM e WHERE t > (SELECT max(t) FROM e) - 604800 GROUP BY user_id, event_type HAVING count(*) >= 4")
def thrash_having(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max("t")).first()[0]
    changes = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("file_path"), F.col("t").alias("detected_at"))
    return detect.thrashing(changes, changes, now, 604800).select("session_id", "summary")


@_query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT user_id, event_type, sum(apart) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e), n AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run)
  SELECT user_id, max(n)::BIGINT AS longest FROM n GROUP BY user_id""")
def circular_runs(spark, sf):
    items = _t(spark, sf, "events").select("user_id", "event_id", "ts", F.array("event_type").alias("tokens"))
    runs = detect.similar_runs(items, "user_id", ["ts", "event_id"], "tokens")
    return runs.groupBy("user_id", "run").count().groupBy("user_id").agg(F.max("count").alias("longest"))


@_query(f"WITH e AS ({_EV}) SELECT event_id, {_m('pow(0.5::DOUBLE, ((SELECT max(t) FROM e) - t) / 86400.0::DOUBLE / 7.0::DOUBLE)')} AS recency FROM e")
def recency_score(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max("t")).first()[0]
    return e.select("event_id", _micro(memory.recency(F.lit(now), F.col("t"))).alias("recency"))


_MQ = ["the", "then", "with"]


@_query(f"""WITH o AS (SELECT conv_id * 1000 + turn AS id, text AS content, role AS headline, turn * 86400 AS created_at, turn % 4 = 3 AS is_stale FROM conversations),
  {_bm25_sql('o', 'id', {'content': 5.0, 'headline': 1.0}, _MQ)},
  c AS (SELECT id, bm25 FROM scored ORDER BY bm25 DESC, id LIMIT 50),
  n AS (SELECT id, CASE WHEN max(bm25) OVER () - min(bm25) OVER () < 2.3e-16 THEN 0 ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS b FROM c),
  k AS (SELECT id, unnest(x) AS term, len(x) AS total FROM (SELECT id, {_tokens('content')} AS x FROM o WHERE id IN (SELECT id FROM c))),
  tf AS (SELECT id, term, count(*) / max(total)::DOUBLE AS tf FROM k GROUP BY id, term),
  v AS (SELECT id, sum(CASE WHEN term = 'then' THEN tf ELSE 0 END) / sqrt(sum(tf * tf)) AS cosine FROM tf GROUP BY id)
  SELECT o.id, {_m('greatest(0.35::DOUBLE * b + 0.25::DOUBLE * coalesce(cosine, 0) + 0.2::DOUBLE * pow(0.5::DOUBLE, greatest(1000000 - created_at, 0) / 86400.0::DOUBLE / 7.0::DOUBLE) - CASE WHEN is_stale THEN 0.3::DOUBLE ELSE 0 END, 0)')} AS score
  FROM n JOIN o ON o.id = n.id LEFT JOIN v ON v.id = n.id""")
def memory_score(spark, sf):
    c = _t(spark, sf, "conversations")
    obs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("s").alias("session_id"), F.lit("manual").alias("kind"), F.col("text").alias("content"), F.col("role").alias("headline"), (F.col("turn") * 86400).alias("created_at"), (F.col("turn") % 4 == 3).alias("is_stale"))
    links = spark.createDataFrame([], "observation_id long, symbol_fqn string")
    out = memory.search(obs, links, " ".join(_MQ), 1000000, limit=50, include_stale=True, stem=False)
    return out.select("id", _micro(F.col("memory_score")).alias("score"))


@_query(f"""WITH k AS (SELECT conv_id, unnest({_tokens('text')}) AS term FROM conversations), n AS (SELECT conv_id, term, count(*) AS n FROM k GROUP BY conv_id, term),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS r FROM n) SELECT conv_id, string_agg(term, ',' ORDER BY r) AS key_terms FROM r WHERE r <= 20 GROUP BY conv_id""")
def session_compress(spark, sf):
    return memory.key_terms(_t(spark, sf, "conversations"), "conv_id", X.tokenize_text(F.col("text")))


@_query(f"WITH e AS ({_EV}) SELECT user_id::VARCHAR AS id, max(t)::BIGINT AS last_active FROM e GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 10")
def recent_sessions(spark, sf):
    s = _events(spark, sf).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("t").alias("last_active")).withColumn("is_compressed", F.lit(False))
    return memory.recent_sessions(s, 10).select("id", "last_active")


@_query("""WITH d AS (SELECT source, doc_id, sum(ceil(strlen(text) / 3.5::DOUBLE)::BIGINT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) SELECT source, doc_id, used FROM d WHERE used <= 5000""")
def prefix_pack(spark, sf):
    rows = _t(spark, sf, "documents").select("source", "doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    return pack.prefix_pack(rows, 5000, "tokens", ["doc_id"], ["source"]).select("source", "doc_id", "used")


@_query("""WITH RECURSIVE d AS (SELECT source, doc_id, ceil(strlen(text) / 3.5::DOUBLE)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
  f AS (SELECT source, doc_id, pos, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END AS used, tokens <= 3000 AS kept FROM d WHERE pos = 1
    UNION ALL SELECT d.source, d.doc_id, d.pos, CASE WHEN f.used + d.tokens <= 3000 THEN f.used + d.tokens ELSE f.used END, f.used + d.tokens <= 3000 FROM f JOIN d ON d.source = f.source AND d.pos = f.pos + 1)
  SELECT source, doc_id FROM f WHERE kept""")
def first_fit_pack(spark, sf):
    rows = _t(spark, sf, "documents").select("source", "doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    return pack.stream_first_fit(rows, 3000, "tokens", ["doc_id", "tokens"], ["source"]).select("source", "doc_id")


@_query("""WITH s AS (SELECT l_orderkey AS f, l_orderkey * 10 + l_linenumber AS id, l_quantity::BIGINT AS a, l_quantity::BIGINT + l_linenumber * 5 AS b, l_linenumber % 2 = 1 AS c FROM lineitem)
  SELECT DISTINCT x.id FROM s x JOIN s o ON x.f = o.f WHERE o.c AND o.a <= x.a AND x.b <= o.b AND o.id <> x.id""")
def skeleton_containment(spark, sf):
    li = _t(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long")
    return pack.contained(li.select(F.col("l_orderkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("start_line"), (q + F.col("l_linenumber") * 5).alias("end_line"), F.when(F.col("l_linenumber") % 2 == 1, "class").otherwise("method").alias("kind")))


_ALL = ("customer", "documents", "embeddings", "events", "lineitem", "orders", "pages", "part", "supplier")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in _ALL))
def index_status(spark, sf):
    out = None
    for t in _ALL:
        one = _t(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"WITH e AS ({_EV}) SELECT event_id, t FROM e WHERE t > (SELECT min(t) + 3600 FROM e) OR (t = (SELECT min(t) + 3600 FROM e) AND event_id > 5) ORDER BY t, event_id LIMIT 20")
def keyset_page(spark, sf):
    from loomdex.streaming.watch import keyset_page as page

    e = _events(spark, sf).select("event_id", "t")
    return page(e, "t", "event_id", e.agg(F.min("t")).first()[0] + 3600, 5, 20)


@_query("""WITH w AS (SELECT DISTINCT user_id AS session_id, event_type AS rule FROM events), o AS (SELECT user_id AS session_id, '[' || event_type || '] seen' AS content FROM events WHERE event_id % 3 = 0)
  SELECT session_id, rule FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = w.session_id AND starts_with(o.content, '[' || w.rule || ']'))""")
def warning_dedup(spark, sf):
    e = _t(spark, sf, "events")
    noted = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("session_id"), F.lit("warning").alias("kind"), F.concat(F.lit("["), "event_type", F.lit("] seen")).alias("content"))
    return detect.unseen(e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("rule")).distinct(), noted)


@_query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS apart FROM events),
  r AS (SELECT user_id, ts, sum(apart) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*)::BIGINT AS n FROM r GROUP BY user_id, run""")
def session_debounce(spark, sf):
    from loomdex.streaming.watch import debounce

    return debounce(_t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id").select("user_id", _seconds(F.col("window.start")).alias("start"), "n")


@_query(f"""WITH e AS ({_EV}), a AS (SELECT event_id, (SELECT max(t) FROM e) - t AS s FROM e)
  SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM a""")
def relative_time(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max("t")).first()[0]
    return e.select("event_id", S.relative_time(F.lit(now), F.col("t")).alias("age"))


@_query(f"SELECT conv_id, turn, array_to_string({_tokens('text')}, ' ') AS tokens FROM conversations")
def tokenize_text(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.tokenize_text(F.col("text")), " ").alias("tokens"))


@_query("SELECT doc_id, to_json({'id': doc_id, 'source': source, 'chars': n_chars})::VARCHAR AS json FROM documents")
def json_sink(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("chars"))).alias("json"))
