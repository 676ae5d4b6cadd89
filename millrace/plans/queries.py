"""The reference's operators by name, over whole tables, and their SQL."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import access, search
from millrace.plans.relational import SQL
from millrace.sources import store
from millrace.sources.tables import sql, table
from millrace.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _text(which: str | tuple[str, str], engine: int) -> str:
    return which if isinstance(which, str) else which[engine]


for _name, _which in SQL.items():
    QUERIES[_name] = lambda spark, sf_dir, q=_text(_which, 0): sql(spark, sf_dir, q)
    ORACLE_SQL[_name] = re.sub(r"\{(\w+)\}", r"\1", _text(_which, 1)).replace("AS string)", "AS VARCHAR)")


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


# ---- relational queries whose SQL, planned as it is, doesn't do for large tables


@_query("agg_approx", ORACLE_SQL["agg_approx"])
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are counted apart: in one aggregation with a DISTINCT each key would get a sketch, a digest and a table of quantities of its own, to be merged one by one."""
    t = table(spark, sf_dir, "lineitem")
    keys = t.agg(F.count_distinct("l_partkey").alias("n"))
    a = t.agg(F.approx_count_distinct("l_partkey").alias("near"), F.percentile_approx("l_quantity", 0.5).alias("mid_near"), F.percentile("l_quantity", 0.5).alias("mid"))
    near = F.abs(F.col("near") / F.col("n") - 1) < 0.15
    return a.crossJoin(F.broadcast(keys)).select(near.alias("distinct_near"), (F.abs(F.col("mid_near") - F.col("mid")) <= 1).alias("median_near"))  # one row each


@_query("join_range", ORACLE_SQL["join_range"])
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are counted, not paired: of a nation's suppliers and customers the pairs grow as the square."""
    s, c, mid = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), F.col("s_acctbal")
    return access.count_in_ranges(s, c, "s_suppkey", ("s_nationkey", "c_nationkey"), mid - 500, mid + 500, "c_acctbal")


# ---- full text


def _sql_tokens(stop: str, blend: str = "") -> str:
    cut = f"[{blend}]"
    found = f"regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}{blend}]+')"
    if blend:
        found = f"flatten(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '{cut}') THEN list_concat([t], list_filter(regexp_split_to_array(t, '{cut}'), lambda x: x <> '')) ELSE [t] END))"
    return f"list_filter(list_transform(list_filter({found}, lambda t: length(t) BETWEEN {search.LEAST} AND {search.MOST}), lambda t: lower(t)), lambda t: t NOT IN ({stop}))"


_STOP = ", ".join(repr(x) for x in search.STOP)


def _sql_postings(stop: str = _STOP, blend: str = "") -> str:
    return f"""d AS (SELECT doc_id, {_sql_tokens(stop, blend)} AS ts FROM documents),
  l AS (SELECT doc_id, len(ts) AS dl FROM d), c AS (SELECT count(*) AS n, sum(dl) / count(*) AS av FROM l),
  e AS (SELECT doc_id, unnest(ts) AS term FROM d), p AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY doc_id, term)"""


_POSTINGS = _sql_postings()


def _bm25(terms: list[str], where: str = "true", head: str = _POSTINGS) -> str:
    want = " UNION ALL ".join(f"SELECT {i} AS i, '{t.rstrip('*')}' AS q, {str(t.endswith('*')).lower()} AS pre" for i, t in enumerate(terms))
    return f"""WITH {head}, w AS ({want}),
  h AS (SELECT i, doc_id, sum(tf) AS tf FROM p JOIN w ON term = q OR (pre AND starts_with(term, q)) GROUP BY i, doc_id),
  f AS (SELECT i, count(*) AS df FROM h GROUP BY i)
  SELECT doc_id, round(sum(tf * ln((n - df + 0.5) / (df + 0.5) + 1) * {search.K1 + 1} / (tf + {search.K1 * (1 - search.B)} + {search.K1 * search.B} * dl / av)), 6) AS score
  FROM h JOIN f USING (i) JOIN l USING (doc_id), c WHERE {where} GROUP BY doc_id"""


def _fts(query: str, mode: str = "natural", **how):
    return lambda spark, sf_dir: search.fts_search(table(spark, sf_dir, "documents"), "doc_id", ["text"], query, mode, **how).select("doc_id", F.round("score", 6).alias("score"))


_has = "doc_id IN (SELECT doc_id FROM p WHERE term = '{}')".format
_not = "doc_id NOT IN (SELECT doc_id FROM p WHERE term = '{}')".format
_order = "doc_id IN (SELECT doc_id FROM d, (SELECT unnest(generate_series(1, 100000)) AS i) g WHERE i < len(ts) AND ts[i] = '{}' AND ts[i + 1] = '{}')".format
_query("fts_natural", _bm25(["license", "tion"]))(_fts("the license of Tion"))
_query("fts_repeated_term", _bm25(["license", "license"]))(_fts("license license"))
_query("fts_boolean", _bm25(["then", "tion"], _has("then") + " AND " + _has("tion")))(_fts("+then + tion", "boolean"))
_query("fts_boolean_exclude", _bm25(["tion", "license"], _not("ther") + " AND " + _not("thon")))(_fts("-ther tion license -thon", "boolean"))
_query("fts_boolean_hyphen", _bm25(["tion"], _has("tion") + " AND " + _not("ther")))(_fts("+tion-ther", "boolean"))
_query("fts_prefix", _bm25(["licen*"]))(_fts("licen*", "boolean"))
_query("fts_phrase", _bm25(["all", "rights"], _order("all", "rights")))(_fts('"all rights"', "boolean"))
_query("fts_phrase_exclude", _bm25(["rights", "license"], "NOT " + _order("all", "rights")))(_fts('rights -"all rights" license', "boolean"))
_query("fts_blend", _bm25(["by-nc", "555-5433", "555", "5433"], head=_sql_postings(blend="\\x2d")))(_fts("by-nc 555-5433", blend="-"))
_query("fts_empty", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")(_fts("the of"))
_query("fts_stopwords", "SELECT unnest([" + _STOP + "]) AS word")(lambda spark, sf_dir: spark.createDataFrame([(w,) for w in search.STOP], "word string"))


@_query("fts_custom_stopwords", _bm25(["with", "that"], head=_sql_postings("'tion', 'ther'")))
def fts_custom_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("TION",), ("ther",), (None,)], "w string")
    return _fts("with that tion", stop=search.stop_words(own, "w"))(spark, sf_dir)


@_query("fts_tokens", f"WITH {_POSTINGS} SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM p GROUP BY term")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@_query("fts_postings", f"WITH {_POSTINGS} SELECT doc_id, term, tf, dl::INTEGER AS doc_len FROM p JOIN l USING (doc_id)")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"])


@_query("fts_corpus_stats", f"WITH {_POSTINGS} SELECT n, (SELECT sum(dl)::BIGINT FROM l) AS words, round(av, 6) AS avgdl FROM c")
def fts_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.size(search.tokens(F.col("text"))).cast("long").alias("n"))
    return d.agg(F.count(F.lit(1)).alias("n2"), F.sum("n").alias("words")).select(F.col("n2").alias("n"), "words", F.round(F.col("words") / F.col("n2"), 6).alias("avgdl"))


@_query("fts_topk", _bm25(["license", "tion"]) + " ORDER BY score DESC, doc_id LIMIT 10")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts("license tion")(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(10)


# ---- boxes and vectors

_BOX = (10.0, 920.0, 40.0, 1060.0)
_ROW = (11.0, 900.0, 16.0, 1000.0)


def _geo(kind: str, box=_BOX):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = F.col("p_size"), F.col("p_retailprice")
        return table(spark, sf_dir, "part").filter(access.mbr_predicate(kind, box, x, y, x + 5, y + 100)).select("p_partkey")

    return run


_meets = "p_size <= 40 AND p_size + 5 >= 10 AND p_retailprice <= 1060 AND p_retailprice + 100 >= 920"
_inside = "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size + 5 <= 40 AND p_retailprice >= 920 AND p_retailprice + 100 <= 1060"
_query("geo_intersects", f"SELECT p_partkey FROM part WHERE {_meets}")(_geo("intersects"))
_query("geo_disjoint", f"SELECT p_partkey FROM part WHERE NOT ({_meets})")(_geo("disjoint"))
_query("geo_within", _inside)(_geo("within"))
_query("geo_contains", _inside)(_geo("contains"))
_query("geo_equals", "SELECT p_partkey FROM part WHERE p_size = 11 AND p_retailprice = 900 AND p_retailprice + 100 = 1000")(_geo("equals", _ROW))


@_query("geo_mbr", "SELECT p_partkey, p_size::DOUBLE AS xmin, p_retailprice AS ymin, p_size::DOUBLE + 5 AS xmax, p_retailprice + 7 AS ymax FROM part")
def geo_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in well-known binary, made of the columns of each part, as rectangles."""

    def lines(batches):
        for b in batches:
            xy = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            raw = [struct.pack("<IBII4d", 0, 1, 2, 2, x + 5, y, x, y + 7) for x, y in xy]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["p_partkey", "g"])

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice").mapInArrow(lines, "p_partkey long, g binary")
    return access.mbr(rows, "g", ["p_partkey"])


@_query("geo_wkt", "SELECT p_partkey, p_size::DOUBLE AS xmin, p_size::DOUBLE + 3 AS xmax FROM part")
def geo_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size")
    box = access.wkt_box(F.format_string("POLYGON((%d 1, %d 1.5, %d -2e1, %d 1))", x, x + 3, x, x))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.xmin", "b.xmax")


@_query("geo_hilbert_sort", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 910 AND 950")
def geo_hilbert_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points laid out along a Hilbert curve, so that a box touches few row groups; the predicate is exact."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    key = access.hilbert(F.col("p_size").cast("double"), F.col("p_retailprice"), (0.0, 900.0, 51.0, 1000.0))
    laid = store.create(p.repartitionByRange(8, key).sortWithinPartitions(key), store.passing_path(spark, "hilbert"))
    return laid.filter("p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 910 AND 950").select("p_partkey")


_Q = [1.0] + [0.0] * 63
_QD = f"{_Q}::DOUBLE[64]"


def _vec(metric: str):
    return lambda spark, sf_dir: access.vector_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _Q, 10, metric).select("vec_id", F.round("dist", 5).alias("dist"))


_L2 = f"SELECT vec_id, round(d, 5) AS dist FROM (SELECT vec_id, array_distance(embedding::DOUBLE[64], {_QD}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10"
_query("vec_l2_topk", _L2)(_vec("l2"))
_query("vec_cos_topk", f"SELECT vec_id, round(d, 5) AS dist FROM (SELECT vec_id, 1 - array_cosine_similarity(embedding::DOUBLE[64], {_QD}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")(_vec("cosine"))


@_query("vec_from_text", "SELECT vec_id, round(array_distance((embedding[1:3])::DOUBLE[3], [0.5, 0, 0]::DOUBLE[3]), 4) AS dist FROM embeddings")
def vec_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three dimensions out of their text."""
    text = F.to_json(F.slice("embedding", 1, 3))
    v = table(spark, sf_dir, "embeddings").select("vec_id", access.vec_from_text(text).alias("v"))
    return v.select("vec_id", F.round(access.distance(F.col("v"), [0.5, 0.0, 0.0]), 4).alias("dist"))


# ---- JSON


@_query("json_contains", "SELECT event_id, (event_id % 3 = 0)::BOOLEAN AS admin FROM events")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("event_id") % 3 == 0, F.lit('{"tags": ["user", "admin"]}')).otherwise(F.lit('{"tags": ["administrator"]}'))
    return table(spark, sf_dir, "events").select("event_id", access.json_contains(tags, "admin", "$.tags").alias("admin"))


@_query("json_set", "SELECT event_id, '{\"k\":' || (json_extract_string(props, '$.k')::BIGINT + 1) || ',\"seen\":true}' AS props FROM events")
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") + 1
    doc = access.json_set(F.col("props"), "k bigint", "k", k)
    return table(spark, sf_dir, "events").select("event_id", access.json_set(doc, "k bigint, seen boolean", "seen", F.lit(True)).alias("props"))


# ---- expiry


@_query("ttl_visible", "SELECT event_id FROM events, (SELECT max(epoch(ts)) AS now FROM events) WHERE CASE WHEN value > 0 THEN epoch(ts) + round(value * 1000) > now ELSE true END")
def ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.round(F.col("value") * 1000) * 1_000_000).cast("long").alias("ttl"))
    now = e.agg(F.max("at").alias("now"))
    rows = e.withColumn("expiry", access.expires_at(F.col("at"), F.col("ttl"))).crossJoin(F.broadcast(now))  # one row
    return access.ttl_visible(rows, "expiry", F.col("now")).select("event_id")


@_query("ttl_precedence", "SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 600 END AS BIGINT) AS ttl FROM events")
def ttl_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttl = access.expires_at(F.lit(0).cast("long"), F.col("event_id") % 3, F.lit(0), F.lit(600))
    return table(spark, sf_dir, "events").select("event_id", ttl.alias("ttl"))


@_query("ttl_session", "SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 30 END AS BIGINT) AS ttl FROM events")
def ttl_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's seconds stand before the table's, and a row's before both."""
    ttl = access.expires_at(F.lit(0).cast("long"), F.col("event_id") % 3, F.lit(30), F.lit(600))
    return table(spark, sf_dir, "events").select("event_id", ttl.alias("ttl"))


@_query("ttl_restart", "SELECT event_id FROM events WHERE CASE WHEN event_id % 2 = 0 THEN 90 ELSE 0 END + 20 > 100")
def ttl_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written at 0 with 20 seconds to live, every other one updated at 90: what is left at 100."""
    e = table(spark, sf_dir, "events").select("event_id", access.expires_at(F.lit(0), F.lit(20)).alias("expiry"))
    e = access.update(e, F.col("event_id") % 2 == 0, {"expiry": access.expires_at(F.lit(90), F.lit(20))})
    return access.ttl_visible(e, "expiry", F.lit(100)).select("event_id")


# ---- changes of rows


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each key, every other one of a customer, numbered in the order of writing; the later one has 5."""
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    return c.select(key.alias("c_custkey"), F.explode(F.array(*(F.struct(F.lit(v).alias("c_acctbal"), F.lit(i).alias("seq")) for i, v in enumerate((9.0, 5.0))))).alias("x")).select("c_custkey", "x.*")


_NEW = "n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS k, 5.0::DOUBLE AS v FROM customer)"


def _upserted(spark: SparkSession, sf_dir: str, update=None) -> DataFrame:
    return access.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), _batch(spark, sf_dir), "c_custkey", update, "seq")


_query("upsert_replace", f"WITH {_NEW} SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN v ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k")(_upserted)
_query("upsert_iodku", f"WITH {_NEW} SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN v ELSE round(c_acctbal + v, 2) END AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k")(
    lambda spark, sf_dir: _upserted(spark, sf_dir, {"c_acctbal": F.round(F.col("t.c_acctbal") + F.col("b.c_acctbal"), 2)})
)


@_query("upsert_composite", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) UNION ALL SELECT -l_orderkey, 1, 0.0 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey > 0)")
def upsert_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a key of two columns: the first line of each order is written over, and one of another order added."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    first = t.select("l_orderkey").distinct()
    known = t.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("l_quantity"))
    more = first.filter("l_orderkey > 0").select((-F.col("l_orderkey")).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return access.upsert(t, known.unionByName(more), ["l_orderkey", "l_linenumber"])


@_query("replace_unique", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 NOT IN (0, 1) UNION ALL SELECT s_suppkey - s_suppkey % 4 + 1000000, s_name FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, 'x' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0")
def replace_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that clash by the key, and others that clash by a second unique column, take the old ones' place."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    by_key = s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("s_name"))
    by_name = s.filter("s_suppkey % 4 = 1").select((F.col("s_suppkey") - F.col("s_suppkey") % 4 + 1_000_000).alias("s_suppkey"), "s_name")
    batch = by_key.unionByName(by_name).withColumn("seq", F.col("s_suppkey"))
    return access.replace_into(s, batch, ["s_suppkey", "s_name"], "seq")


@_query("insert_unique_check", f"WITH {_NEW} SELECT k AS c_custkey FROM n")
def insert_unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.unique_violations(table(spark, sf_dir, "customer"), _batch(spark, sf_dir), "c_custkey")


@_query("update_rows", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN round(s_acctbal * 1.1, 2) ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return access.update(s, F.col("s_nationkey") == 3, {"s_acctbal": F.round(F.col("s_acctbal") * 1.1, 2)}, ["s_suppkey"])


@_query("delete_rows", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) < 10, false)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for which the condition is null stays."""
    return access.delete(table(spark, sf_dir, "supplier"), F.nullif("s_nationkey", F.lit(3)) < 10).select("s_suppkey")


@_query("auto_increment", "SELECT c_custkey, CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id FROM customer")
def auto_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0] or 0
    return access.numbered(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "id", top)


# ---- tables


def _path(spark: SparkSession, name: str) -> str:
    return store.passing_path(spark, name)


@_query("ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.create(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), _path(spark, "ctas"))


@_query("insert_select", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "insert")
    store.create(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), path)
    store.append(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), path)
    return spark.read.parquet(path)


@_query("engine_convert", "SELECT * FROM supplier")
def engine_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "orc")
    store.create(table(spark, sf_dir, "supplier"), path, engine="orc")
    return store.convert(spark, path, "orc", _path(spark, "parquet"), "parquet")


@_query("cross_engine_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def cross_engine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = store.create(table(spark, sf_dir, "nation"), _path(spark, "nation"), engine="json")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@_query("compression", "SELECT unnest(['none', 'snappy', 'lz4', 'lz4_fast', 'zstd']) AS codec, (SELECT count(*) FROM part) AS n, (SELECT sum(p_size)::BIGINT FROM part) AS sizes")
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for codec in ("none", "snappy", "lz4", "lz4_fast", "zstd"):
        t = store.create(table(spark, sf_dir, "part"), _path(spark, codec), codec=codec).agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))
        out = t if out is None else out.unionByName(t)
    return out


@_query("backup", "SELECT o_orderkey, o_custkey FROM orders")
def backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, to = _path(spark, "live"), _path(spark, "backup")
    store.create(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path)
    store.backup(spark, path, to)
    store.truncate(spark, path)
    return spark.read.parquet(to)


@_query("truncate", "SELECT 0::BIGINT AS n, (SELECT count(*) FROM nation) AS before")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "truncate")
    before = store.create(table(spark, sf_dir, "nation"), path).count()
    return store.truncate(spark, path).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.lit(before).cast("long"))


@_query("discovery", "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in store.discover(spark, sf_dir)], "name string")


@_query("schema_evolution", "SELECT n_nationkey AS id, n_name AS label, 'new' AS added FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), 'late' FROM nation")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from before and after a column was added and another renamed, read as one table."""
    path, n = _path(spark, "evolved"), table(spark, sf_dir, "nation")
    store.create(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    store.append(n.select((F.col("n_nationkey") + 100).alias("id"), F.upper("n_name").alias("label"), F.lit("late").alias("added")), path)
    return store.evolved(spark, path, {"added": F.lit("new")}, {"name": "label"}).select("id", "label", "added")


_BOUNDS = [("p0", 1000), ("p1", 5000), ("p2", 9000)]


def partitioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    label = store.range_label(F.col("o_orderkey"), _BOUNDS, "pmax")
    return store.create(o.withColumn("part", label), _path(spark, "orders"), partition_by=["part"])


@_query("part_range_pruned", "SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 'p0' WHEN o_orderkey < 5000 THEN 'p1' ELSE 'p2' END AS part FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 5100")
def part_range_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pruned_range(partitioned_orders(spark, sf_dir), "part", "o_orderkey", _BOUNDS, "pmax", 500, 5100).select("o_orderkey", "part")


@_query("part_hash_pruned", "SELECT o_orderkey FROM orders WHERE o_custkey = 42")
def part_hash_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("part", F.pmod("o_custkey", F.lit(4)).cast("int"))
    t = store.create(o, _path(spark, "hash"), partition_by=["part"])
    return t.filter((F.col("o_custkey") == 42) & (F.col("part") == 42 % 4)).select("o_orderkey")


@_query("part_list_dropped", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (0, 1)")
def part_list_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition by a list of regions is dropped: the others' files stay as they are."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey").isin(0, 1), "west").otherwise("rest").alias("part"))
    return store.create(n, _path(spark, "list"), partition_by=["part"]).filter("part <> 'west'").drop("part")


# ---- streams: an extension, the engine this follows has none


@_query("stream_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.hourly(spark, f"{sf_dir}/events.parquet", _path(spark, "stream"))
