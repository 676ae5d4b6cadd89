"""Boxes, vectors, expiry, JSON, joins by ranges and changes of rows as Column and DataFrame functions."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]  # xmin, ymin, xmax, ymax


class DuplicateKey(ValueError):
    """A row whose key, or unique column, is there already."""


# ---- boxes


def mbr_predicate(kind: str, box: Box, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The relation of a row's rectangle to ``box``: intersects (borders touch), within (as is contains, said of the box), equals or disjoint."""
    a, b, c, d = map(F.lit, box)
    meets = (xmin <= c) & (xmax >= a) & (ymin <= d) & (ymax >= b)
    inside = (xmin >= a) & (xmax <= c) & (ymin >= b) & (ymax <= d)
    return {"intersects": meets, "disjoint": ~meets, "within": inside, "contains": inside, "equals": (xmin == a) & (xmax == c) & (ymin == b) & (ymax == d)}[kind]


_DEEPEST = 32


def wkb_box(raw: bytes | None) -> Box | None:
    """The rectangle of a geometry in well-known binary, with or without four bytes of a reference system before it; None if it is malformed or empty.

    Points, lines, polygons and collections of them; coordinates that aren't finite are left out.
    """
    if raw is None:
        return None
    for skip in (0, 4):
        found: list[tuple[float, float]] = []
        try:
            if _walk(raw, skip, found, 0) == len(raw):
                xs, ys = zip(*found, strict=True) if found else ((), ())
                return (min(xs), min(ys), max(xs), max(ys)) if found else None
        except (struct.error, ValueError):
            pass
    return None


def _walk(raw: bytes, at: int, found: list[tuple[float, float]], depth: int) -> int:
    order, kind = struct.unpack_from("<B", raw, at)[0], 0
    if order > 1 or depth > _DEEPEST:
        raise ValueError("not a geometry")
    e = "<" if order else ">"
    (kind,) = struct.unpack_from(e + "I", raw, at + 1)
    at += 5

    def points(at: int, n: int) -> int:
        if n * 16 > len(raw) - at:
            raise ValueError("too short")
        for k in range(n):
            x, y = struct.unpack_from(e + "2d", raw, at + 16 * k)
            if math.isfinite(x) and math.isfinite(y):
                found.append((x, y))
        return at + 16 * n

    if kind == 1:
        return points(at, 1)
    (n,) = struct.unpack_from(e + "I", raw, at)
    at += 4
    if kind == 2:
        return points(at, n)
    if kind == 3:
        for _ in range(n):
            (m,) = struct.unpack_from(e + "I", raw, at)
            at = points(at + 4, m)
        return at
    if kind not in (4, 5, 6, 7) or n > len(raw):
        raise ValueError("unknown geometry")
    for _ in range(n):
        at = _walk(raw, at, found, depth + 1)
    return at


def mbr(df: DataFrame, wkb: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` with xmin, ymin, xmax, ymax of the binary column ``wkb``; null where it is no geometry."""
    names = [*keep, "xmin", "ymin", "xmax", "ymax"]
    rows = df.select(*keep, F.col(wkb).alias("_mr_wkb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [wkb_box(x) or (None,) * 4 for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([b[k] for b in boxes], pa.float64()) for k in range(4))], names=names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_mr_wkb").dtypes)
    return rows.mapInArrow(run, f"{kinds}, xmin double, ymin double, xmax double, ymax double")


def wkt_box(wkt: Column) -> Column:
    """The rectangle of a geometry in well-known text as a struct of xmin, ymin, xmax, ymax, by its pairs of numbers; null if it has none."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    pairs = F.regexp_extract_all(wkt, F.lit(rf"({number})\s+({number})"), F.lit(0))
    at = lambda k: F.transform(pairs, lambda p: F.split(p, r"\s+")[k].cast("double"))
    box = F.struct(*(f(at(k)).alias(n) for f, k, n in ((F.array_min, 0, "xmin"), (F.array_min, 1, "ymin"), (F.array_max, 0, "xmax"), (F.array_max, 1, "ymax"))))
    return F.when(F.size(pairs) > 0, box)


def hilbert(x: Column, y: Column, box: Box, order: int = 16) -> Column:
    """The place of a point on a Hilbert curve over ``box``, as a key to lay out files by; predicates stay exact."""
    side = 1 << order
    cell = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / (hi - lo) * side), F.lit(0)), F.lit(side - 1)).cast("long")
    start = F.struct(cell(x, box[0], box[2]).alias("x"), cell(y, box[1], box[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx, ry = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0), F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        a, b = F.when(flip, side - 1 - acc["x"]).otherwise(acc["x"]), F.when(flip, side - 1 - acc["y"]).otherwise(acc["y"])
        swap = ry == 0
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry)).cast("long")
        return F.struct(F.when(swap, b).otherwise(a).cast("long").alias("x"), F.when(swap, a).otherwise(b).cast("long").alias("y"), d.cast("long").alias("d"))

    return F.aggregate(F.array(*(F.lit(1 << k).cast("long") for k in range(order - 1, -1, -1))), start, step)["d"]


# ---- vectors


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(v: Column, query: Sequence[float], metric: str = "l2") -> Column:
    """Null for a null vector, one of another length or, by cosine, of no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        d = 1 - F.try_divide(_dot(v, q), F.sqrt(_dot(v, v)) * F.sqrt(_dot(q, q)))
    else:
        d = F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(v) == len(query), d)


def vector_topk(df: DataFrame, key: str, v: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """(key, dist) of the k nearest by the distance as it is, ties by key; vectors without a distance are left out. Each partition keeps its own k, no shuffle of vectors."""
    d = df.select(key, distance(F.col(v), query, metric).alias("dist"))
    return d.filter(F.col("dist").isNotNull() & ~F.isnan("dist")).orderBy("dist", key).limit(k)


def vec_from_text(text: Column) -> Column:
    """``[1, 2.5, ...]`` as a vector; null if it is none."""
    return F.from_json(text, "array<float>")


# ---- JSON


def json_contains(doc: Column, value: str, path: str) -> Column:
    """Whether the array of strings at ``path`` has ``value``; null if nothing is there."""
    return F.array_contains(F.from_json(F.get_json_object(doc, path), "array<string>"), value)


def json_set(doc: Column, schema: str, field: str, value: Column) -> Column:
    """The document, of the given schema, with ``field`` set; other fields keep their types. A document that isn't of the schema gives null."""
    row = F.from_json(doc, schema)
    return F.when(row.isNotNull(), F.to_json(row.withField(field, value)))


# ---- expiry


def expires_at(written: Column, *seconds: Column) -> Column:
    """When a row ends: the first of ``seconds`` (row, session, table) that is above 0; null for never. An update calls it again with the time of the update."""
    ttl = F.coalesce(*[F.when(s > 0, s) for s in seconds])
    return written + ttl


def ttl_visible(df: DataFrame, expiry: str, as_of: Column) -> DataFrame:
    return df.filter(F.col(expiry).isNull() | (F.col(expiry) > as_of))


# ---- joins


def _part(v: Column, cuts: Sequence[float]) -> Column:
    """How many of ``cuts`` are below ``v``."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < v)) if cuts else F.lit(0)


def count_in_ranges(spans: DataFrame, points: DataFrame, group: str, on: tuple[str, str], low: Column, high: Column, at: str, parts: int = 64) -> DataFrame:
    """(``group``, n): by the group of a span, how many pairs of a span and a point agree in ``on`` (the spans' column, the points') and have low <= at <= high.

    No pair is made: a running sum counts the points up to each end of a span, and a
    span has those up to its high end less those before its low one. Rows are cut at
    quantiles of all ends and points, and the sums of parts give each its start, so
    that no task has all rows of one ``on``. Groups without a pair are left out.
    """
    s, p = F.col(on[0]), F.col(on[1])
    end = lambda v, sign: F.struct(v.alias("_mr_v"), F.lit(sign).alias("_mr_k"))
    ends = spans.filter(s.isNotNull() & (low <= high)).select(s.alias("_mr_s"), F.col(group), F.explode(F.array(end(low, -1), end(high, 1))).alias("_mr_e"))
    ends = ends.select("_mr_s", "_mr_e.*", group, F.lit(0).cast("long").alias("_mr_n"))
    known = points.filter(p.isNotNull() & F.col(at).isNotNull()).groupBy(p.alias("_mr_s"), F.col(at).alias("_mr_v")).agg(F.count(F.lit(1)).alias("_mr_n"))
    rows = ends.unionByName(known.withColumn("_mr_k", F.lit(0)), allowMissingColumns=True)  # of one value: low ends, points, high ends
    cuts = rows.select("_mr_v").distinct().agg(F.percentile_approx("_mr_v", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    rows = rows.withColumn("_mr_p", _part(F.col("_mr_v"), sorted(set(cuts or []))))
    sums = rows.groupBy("_mr_s", "_mr_p").agg(F.sum("_mr_n").alias("_mr_m"))
    before = F.sum("_mr_m").over(Window.partitionBy("_mr_s").orderBy("_mr_p")) - F.col("_mr_m")  # parts rows
    starts = sums.select(F.col("_mr_s").alias("_mr_t"), F.col("_mr_p").alias("_mr_q"), before.alias("_mr_o"))
    upto = F.sum("_mr_n").over(Window.partitionBy("_mr_s", "_mr_p").orderBy("_mr_v", "_mr_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("_mr_r", upto).filter("_mr_k <> 0").join(starts, (F.col("_mr_s") == F.col("_mr_t")) & (F.col("_mr_p") == F.col("_mr_q")))
    return found.groupBy(group).agg(F.sum(F.col("_mr_k") * (F.col("_mr_r") + F.col("_mr_o"))).alias("n")).filter("n > 0")


# ---- changes of rows


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def last_of_each(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; rows whose key has a null all stay."""
    keys, some = _keys(key), F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    row = F.max_by(F.struct(*df.columns), F.col(order)).alias("_mr_x")
    return df.filter(some).groupBy(*keys).agg(row).select("_mr_x.*").select(*df.columns).unionByName(df.filter(~some))


def upsert(target: DataFrame, batch: DataFrame, key: str | Sequence[str], update: Mapping[str, Column] | None = None, order: str | None = None) -> DataFrame:
    """``target`` with ``batch`` written over it: rows of a known key are replaced, or changed by ``update``, others added.

    In ``update`` the old columns are named t.x and the new ones b.x. A key with a
    null matches nothing. Of several batch rows of one key the last by ``order`` wins,
    a column of ``batch`` that isn't stored unless ``target`` has it; without ``order``
    they are an error.
    """
    keys = _keys(key)
    if order is not None:
        batch = last_of_each(batch, keys, order)
    elif not unique_violations(batch.limit(0), batch, keys).isEmpty():
        raise DuplicateKey("several rows of one key, and no order to tell the last")
    t, b = target.withColumn("_mr_t", F.lit(True)).alias("t"), batch.withColumn("_mr_b", F.lit(True)).alias("b")
    on = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys]
    old, new, out = F.col("t._mr_t").isNotNull(), F.col("b._mr_b").isNotNull(), []
    for c in target.columns:
        hit = (update or {}).get(c, F.col(f"t.{c}") if update else F.col(f"b.{c}"))
        out.append(F.when(old & new, hit).when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return t.join(b, on, "full").select(*out)


def replace_into(target: DataFrame, batch: DataFrame, uniques: Sequence[str | Sequence[str]], order: str) -> DataFrame:
    """REPLACE one batch row after the other, in ``order``: each takes away all rows that agree with it in any of the unique keys.

    So a row stays if no later one agrees with it in any key, whether that one stays
    or not. Keys with a null agree with none. ``order`` must tell all rows apart.
    """
    kept, rows = target, batch
    for key in uniques:
        keys = _keys(key)
        last = batch.dropna(subset=keys).groupBy(*keys).agg(F.max(order).alias("_mr_o"))
        kept = kept.join(last.select(*keys), keys, "left_anti")
        alias = last.select(*(F.col(k).alias(f"_mr_k{i}") for i, k in enumerate(keys)), "_mr_o")
        on = [F.col(k) == F.col(f"_mr_k{i}") for i, k in enumerate(keys)]
        rows = rows.join(alias, [*on, F.col(order) < F.col("_mr_o")], "left_anti")
    return kept.select(*target.columns).unionByName(rows.select(*target.columns))


def unique_violations(target: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys of ``batch`` that it holds twice or ``target`` holds already. Keys with a null never clash."""
    keys = _keys(key)
    n = batch.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_mr_n"))
    known = target.select(*keys, F.lit(1).alias("_mr_k")).distinct()
    return n.join(known, keys, "left").filter("_mr_n > 1 or _mr_k is not null").select(*keys)


def insert(target: DataFrame, batch: DataFrame, uniques: Sequence[str | Sequence[str]], check: bool = True) -> DataFrame:
    """``target`` and the rows of ``batch``; a clash in any unique key is an error, and then nothing is added."""
    for key in uniques if check else []:
        bad = unique_violations(target, batch, key).take(1)
        if bad:
            raise DuplicateKey(f"{key}: {tuple(bad[0])}")
    return target.unionByName(batch.select(*target.columns))


def update(table: DataFrame, where: Column, assign: Mapping[str, Column], uniques: Sequence[str | Sequence[str]] = ()) -> DataFrame:
    """``table`` with the assigned columns of the rows where ``where`` is true, all from the old values; a key that is then there twice is an error."""
    out = table.select(*(F.when(where, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns))
    for key in uniques:
        bad = unique_violations(out.limit(0), out, key).take(1)
        if bad:
            raise DuplicateKey(f"{key}: {tuple(bad[0])}")
    return out


def delete(table: DataFrame, where: Column) -> DataFrame:
    """``table`` without the rows where ``where`` is true; where it is null they stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def numbered(df: DataFrame, order: str, name: str, after: int = 0, parts: int = 256) -> DataFrame:
    """``df`` with successive numbers from ``after`` + 1 in the order of a numeric column without repeats.

    Rows are cut at quantiles and numbered within each part, and the few sums of parts
    give each its first number, so no task has all rows. Nulls come first.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))  # parts numbers
    rows = df.withColumn("_mr_p", F.when(F.col(order).isNull(), -1).otherwise(_part(F.col(order), cuts)))
    counts = rows.groupBy("_mr_p").agg(F.count(F.lit(1)).alias("_mr_n"))
    offsets = counts.select(F.col("_mr_p").alias("_mr_q"), (F.sum("_mr_n").over(Window.orderBy("_mr_p")) - F.col("_mr_n")).alias("_mr_o"))  # parts rows
    own = F.row_number().over(Window.partitionBy("_mr_p").orderBy(F.col(order).asc_nulls_first()))
    out = rows.withColumn("_mr_r", own).join(F.broadcast(offsets), F.col("_mr_p") == F.col("_mr_q"))
    return out.select(*df.columns, (F.col("_mr_r") + F.col("_mr_o") + after).cast("long").alias(name))


