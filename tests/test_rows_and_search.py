"""Operators on fixtures of a few rows, with nulls, ties, repeats and clashing names, and the plans that large tables need."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from millrace.operators import access, search
from millrace.plans import queries
from millrace.plans.queries import QUERIES
from millrace.plans.relational import SQL
from millrace.sources import store
from millrace.sources.tables import sql

SF = "/root/testdata/sf0.001"

ARTICLES = [
    (1, "MySQL Tutorial", "DBMS stands for DataBase Management System"),
    (2, "How To Use MySQL", "After you went through a tutorial you can start"),
    (3, "Optimizing MySQL", "In this tutorial we show optimization techniques"),
    (4, "TidesDB Guide", None),
    (5, "Database Systems", "A database management system manages data efficiently"),
]
DOCS = ["the quick brown fox jumps over the lazy dog", "quick fox and lazy dog play together", "the brown dog is not lazy at all", "completely unrelated content here", "the fox is quick and the dog is lazy"]
BLENDED = ["L'aria fresca della montagna", "Dell'aria pura si respira bene", "Un'aria di festa pervadeva la piazza", "O'Malley went to the store", "The cat sat on the mat"]


def _found(df, cols, query, mode="natural", **how):
    rows = search.fts_search(df, "id", cols, query, mode, **how).orderBy(F.desc("score"), "id").collect()
    return [r["id"] for r in rows]


def test_articles_are_ranked(spark):
    df = spark.createDataFrame(ARTICLES, "id int, title string, body string")
    find = lambda q, mode="natural": _found(df, ["title", "body"], q, mode)
    assert find("tutorial") == [3, 1, 2]
    assert find("database management") == [5, 1]
    assert sorted(find("+mysql +tutorial", "boolean")) == [1, 2, 3]
    assert find("+mysql -tutorial", "boolean") == [] and find("-tutorial +mysql", "boolean") == []
    assert find("optim*", "boolean") == [3] and find("+the", "boolean") == [] and find("the of") == []


def test_phrases(spark):
    df = spark.createDataFrame(list(enumerate(DOCS, 1)), "id int, body string")
    find = lambda q: sorted(_found(df, ["body"], q, "boolean"))
    assert find('"quick brown fox"') == [1] and find('"lazy dog"') == [1, 2] and find('"fox quick"') == [5]
    assert find('+"lazy dog" -quick') == [] and find('lazy -"lazy dog"') == [3, 5] and find('""') == []


def test_blended_signs(spark):
    df = spark.createDataFrame(list(enumerate(BLENDED, 1)), "id int, body string")
    find = lambda q, mode="natural": sorted(_found(df, ["body"], q, mode, blend="'"))
    assert find("aria") == [1, 2, 3] and find("l'aria") == [1, 2, 3] and find("malley") == [4] and find("o'malley") == [4]
    assert find("dell'aria") == [1, 2, 3] and find("cat") == [5] and find("the") == [] and find("+aria -malley", "boolean") == [1, 2, 3]
    assert _found(df, ["body"], "l'aria", blend="'")[0] == 1


def test_parser():
    t = search.Term
    assert search.parse("+multi-model") == [t("+", ("multi",)), t("-", ("model",))]
    assert search.parse("+ Word - other opt* *") == [t("+", ("word",)), t("-", ("other",)), t("", ("opt",), True)]
    assert search.parse('-"the lazy dog" "x') == [t("-", ("lazy", "dog"), phrase=True)]
    assert search.parse("") == [] and search.parse("+-") == []


def test_empty_corpus_and_own_stop_words(spark):
    none = spark.createDataFrame([], "id int, body string")
    assert _found(none, ["body"], "fox") == []
    df = spark.createDataFrame(list(enumerate(DOCS, 1)), "id int, body string")
    stop = search.stop_words(spark.createDataFrame([("Fox",), (None,)], "w string"), "w")
    assert stop == ["fox"] and _found(df, ["body"], "fox", stop=stop) == [] and sorted(_found(df, ["body"], "the", stop=stop)) == [1, 3, 5]


def test_vectors_without_distance_are_left_out(spark):
    rows = [(1, [1e-7, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [3.0, 4.0]), (7, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    top = lambda q, m: [r["id"] for r in access.vector_topk(df, "id", "v", q, 9, m).collect()]
    assert top([0.0, 0.0], "l2") == [2, 1, 6, 7] and top([1.0, 0.0], "cosine") == [1, 6, 7]
    assert [r[0] for r in spark.createDataFrame([("[1, 2.5]",), ("no",), (None,)], "t string").select(access.vec_from_text(F.col("t"))).collect()] == [[1.0, 2.5], None, None]


def test_rectangles_of_geometries(spark):
    point = lambda x, y, e="<": struct.pack(e + "BI2d", e == "<", 1, x, y)
    ring = struct.pack("<I", 3) + struct.pack("<6d", 0, 0, 5, -1, 2, 7)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    several = struct.pack("<BII", 1, 7, 2) + point(9, 9, ">") + polygon
    nested = several
    for _ in range(40):
        nested = struct.pack("<BII", 1, 7, 1) + nested
    assert access.wkb_box(point(1, 2)) == (1, 2, 1, 2) and access.wkb_box(b"\0\0\0\0" + point(1, 2)) == (1, 2, 1, 2)
    assert access.wkb_box(polygon) == (0, -1, 5, 7) and access.wkb_box(several) == (0, -1, 9, 9)
    assert [access.wkb_box(x) for x in (None, b"", b"junk", point(1, 2)[:-1], point(math.nan, math.nan), nested)] == [None] * 6
    df = spark.createDataFrame([(1, bytearray(polygon)), (2, None)], "xmin_id int, g binary")
    assert [tuple(r) for r in access.mbr(df, "g", ["xmin_id"]).collect()] == [(1, 0, -1, 5, 7), (2, None, None, None, None)]
    box = spark.createDataFrame([("LINESTRING(1 2, -3.5 4e1)",), ("POINT EMPTY",), (None,)], "t string").select(access.wkt_box(F.col("t"))).collect()
    assert [None if r[0] is None else tuple(r[0]) for r in box] == [(-3.5, 2, 1, 40), None, None]


def test_upserts_last_writer_and_null_keys(spark):
    t = spark.createDataFrame([(1, 1, 1.0), (None, 1, 2.0)], "k long, j long, v double")
    b = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, None, 2), (3, 1, 6.0, 1), (None, 1, 7.0, 1), (None, 1, 8.0, 2)], "k long, j long, v double, seq int")
    got = sorted(map(tuple, access.upsert(t, b, ["k", "j"], order="seq").collect()), key=str)
    assert got == sorted([(1, 1, None), (None, 1, 2.0), (3, 1, 6.0), (None, 1, 7.0), (None, 1, 8.0)], key=str)
    with pytest.raises(access.DuplicateKey):
        access.upsert(t, b, "k")


def test_replace_by_any_unique_key_is_as_one_by_one(spark):
    t = [(1, "a"), (2, "b"), (3, None), (4, "d")]
    batch = [(5, "a", 1), (5, "c", 2), (6, "c", 3), (2, None, 4), (7, "d", 5), (4, "z", 6)]
    want = list(t)
    for k, e, _ in batch:
        want = [r for r in want if r[0] != k and (e is None or r[1] != e)] + [(k, e)]
    got = access.replace_into(spark.createDataFrame(t, "id int, e string"), spark.createDataFrame(batch, "id int, e string, seq int"), ["id", "e"], "seq")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_changes_check_their_keys(spark):
    t = spark.createDataFrame([(1, None), (2, None), (3, 7)], "id int, u int")
    with pytest.raises(access.DuplicateKey):
        access.insert(t, spark.createDataFrame([(4, 7)], "id int, u int"), ["id", "u"])
    assert access.insert(t, spark.createDataFrame([(4, None)], "id int, u int"), ["id", "u"]).count() == 4  # nulls never clash
    with pytest.raises(access.DuplicateKey):
        access.update(t, F.col("id") < 3, {"u": F.lit(7)}, ["u"])
    assert sorted(map(tuple, access.update(t, F.col("u") > 0, {"id": F.col("id") + 9, "u": F.col("id")}, ["id"]).collect()), key=str) == sorted([(1, None), (2, None), (12, 3)], key=str)
    assert access.delete(t, F.col("u") == 7).count() == 2
    assert sorted(r["n"] for r in access.numbered(t, "id", "n", 10).collect()) == [11, 12, 13]


def test_expiry_falls_through_values_that_are_not_positive(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "id long, ttl long")
    got = df.select("id", access.expires_at(F.lit(100), F.col("ttl"), F.lit(-1), F.lit(7)).alias("e")).collect()
    assert {r[0]: r[1] for r in got} == {1: 105, 2: 107, 3: 107}


def test_tables_are_made_refused_and_found(spark, tmp_path):
    root = "file://" + str(tmp_path)
    t = spark.createDataFrame([(1, "x")], "id int, v string")
    store.create(t, root + "/t.parquet")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.create(t, root + "/t.parquet")
    store.backup(spark, root + "/t.parquet", root + "/copy")
    with pytest.raises(ValueError, match="isn't empty"):
        store.backup(spark, root + "/t.parquet", root + "/copy")
    assert spark.read.parquet(root + "/copy").collect() == t.collect() and store.discover(spark, root) == ["t"]
    assert store.truncate(spark, root + "/t.parquet").schema == t.schema


@pytest.mark.parametrize("name", ["quant_all", "quant_any", "anti_not_in", "delete_subquery", "semi_in", "join_multi"])
def test_plans_have_no_nested_loop(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_numbering_has_all_rows_in_no_task(spark):
    plan = QUERIES["auto_increment"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "row_number() windowspecdefinition(_mr_p" in plan


def test_filters_reach_files_and_partitions(spark):
    scan = QUERIES["point_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,77)" in scan and "o_orderdate" not in scan.split("ReadSchema")[1]
    plan = QUERIES["part_range_pruned"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "pmax" not in plan.split("PartitionFilters")[1].split("]")[0]
    parts = queries.partitioned_orders(spark, SF)
    assert {r[0] for r in parts.select("part").distinct().collect()} <= {"p0", "p1", "p2", "pmax"}


def test_no_key_has_a_sketch_of_its_own(spark, tmp_path):
    plan = QUERIES["agg_approx"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[l_partkey" in plan and not [x for x in plan.splitlines() if "keys=[l_partkey" in x and ("percentile" in x or "approx" in x)]
    rows = [(i % 7 or None, float(i % 5) if i % 11 else None) for i in range(1000)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got, want = QUERIES["agg_approx"](spark, f"file://{tmp_path}"), sql(spark, f"file://{tmp_path}", SQL["agg_approx"][0])
    assert got.dtypes == want.dtypes and got.collect() == want.collect()


def test_range_join_counts_without_pairs(spark, tmp_path):
    plan = QUERIES["join_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "acctbal" in x] and "windowspecdefinition(_mr_s" in plan
    at, root = [0.0, -0.0, 500.0, 500.01, -500.0, 999.99, 1000.0, 7.5, 7.5, math.nan, math.inf, -math.inf, 1e300, None], f"file://{tmp_path}"
    rows = [(k, v) for k in (1, 2, None) for v in at]
    customers = [(i, 3 if k == 2 else k, v) for i, (k, v) in enumerate(rows * 2)]  # nations of one side only, repeated rows
    spark.createDataFrame([(i % 9 or None, k, v) for i, (k, v) in enumerate(rows)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{root}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{root}/customer.parquet")
    got, want = QUERIES["join_range"](spark, root), sql(spark, root, SQL["join_range"])
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []
    for name in ("supplier", "customer"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{root}/none/{name}.parquet")
    assert QUERIES["join_range"](spark, f"{root}/none").collect() == []


def test_range_join_of_one_nation_is_cut(spark):
    """20,000 spans and points of one nation, each pair within reach; and spans that end before they begin."""
    t = spark.range(20_000).select("id", F.lit(1).alias("k"), (F.col("id") % 1000 / 10).alias("v"))
    got = access.count_in_ranges(t, t, "id", ("k", "k"), F.col("v") - 500, F.col("v") + 500, "v")
    assert [tuple(r) for r in got.agg(F.count("id"), F.min("n"), F.max("n")).collect()] == [(20_000, 20_000, 20_000)]
    near = access.count_in_ranges(t, t, "id", ("k", "k"), F.col("v"), F.col("v"), "v", parts=5)
    assert [tuple(r) for r in near.agg(F.count("id"), F.min("n"), F.max("n")).collect()] == [(20_000, 20, 20)]
    assert access.count_in_ranges(t, t, "id", ("k", "k"), F.col("v") + 1, F.col("v"), "v").isEmpty()
