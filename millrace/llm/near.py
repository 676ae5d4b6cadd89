"""Near-duplicate documents by bottom-k MinHash sketches from one hash function.

A document is the set of hashes of its runs of five words; its sketch is the k
least of them. Inverted lists of the retained values generate the pairs whose
sketches overlap. The union sketch (the k least of both sets) estimates the
Jaccard index and filters, and the exact index of the full sets verifies.

Which values are listed: two sketches whose estimate reaches the floor share at
least ``floor * size`` values, so in any common order of values they share one of
the first ``size - floor * size + 1`` of each. The order is by rarity, so a
passage that very many documents quote makes no list unless most of a sketch is
made of such values. That loses no pair, at any threshold.

Groups are connected components of verified pairs, so pairs inside a component
need no look. First each list compares its members with a hub, the member whose
values are the most widespread; then only pairs of different components are
compared, which leaves the work on thousands of copies of one text linear.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import TMP, U1, U2, Words, key_columns, lean, lists, mix, named_back, ngrams, one_each, pieces, renamed, row_order, settled, text_of, words, written
from millrace.llm.components import components

K = 64
SHINGLE = 5
THRESHOLD = 0.4
#: How far the estimate may fall short of the threshold: 2.4 standard deviations at K.
SLACK = 0.15
#: Bits of the largest Bloom filter that is sent along with tasks (32 MB); beyond it keys are joined instead.
FILTER_BITS = 28


def shingle_sets(k: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted 63-bit hashes of its runs of n words; of fewer words one hash of all; of none, none."""
    hashed = ngrams(k.hash, n) >> np.uint64(1)
    out = []
    for a, b in zip(k.first[:-1].tolist(), k.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(hashed[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(k.hash[a:b], b - a) >> np.uint64(1))
        else:
            out.append(hashed[:0])
    return out


def _prints(k: Words, sets: list[np.ndarray], n: int) -> tuple[list[int], list[int]]:
    """Two 63-bit fingerprints of each set: a sum and an exclusive or; of a single hash the second is of the words themselves."""
    one, two = [], []
    for i, s in enumerate(sets):
        one.append(int(s.sum(dtype=np.uint64) >> np.uint64(1)))
        if len(s) == 1:
            at = slice(k.first[i], min(k.first[i] + n, k.first[i + 1]))  # its only run of n words, or all of fewer
            seen = b" ".join(k.data[a:b].tobytes().lower() for a, b in zip(k.start[at].tolist(), k.end[at].tolist(), strict=True))
            two.append(int.from_bytes(hashlib.blake2b(seen, digest_size=8).digest(), "little") >> 1)
        else:
            two.append(int(np.bitwise_xor.reduce(mix(s)) >> np.uint64(1)) if len(s) else 0)
    return one, two


def _sketcher(k: int, n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(3)):
                part = batch.slice(a, b - a)
                w = words(part.column(3))
                sets = shingle_sets(w, n)
                f1, f2 = _prints(w, sets, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists([s[:k].astype(np.int64) for s in sets], pa.int64())],
                    names=["doc_id", U1, U2, "n", "f1", "f2", "sketch"],
                )

    return sketch


def _setter(n: int, held=None):
    """Shingle sets of the rows (key, text) whose key may be in the filter ``held``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                bitmap, u = held.value, batch.column(0).to_numpy().view(np.uint64)
                low, six, one = np.uint64(64 * len(bitmap) - 1), np.uint64(6), np.uint64(1)
                hit = np.full(len(u), one)
                for p in (u & low, u >> np.uint64(32) & low):
                    hit &= bitmap[p >> six] >> (p & np.uint64(63))
                batch = batch.filter(pa.array(hit == one))
            for a, b in pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                found = shingle_sets(words(part.column(2)), n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists([s.astype(np.int64) for s in found], pa.int64())], names=[U1, U2, "s"])

    return sets


def _filter_of(ends: DataFrame):
    """A Bloom filter of the first key, of 16 bits a key and two places each, to send along with tasks; None if it would be too large."""
    bits = max(16, (16 * ends.count()).bit_length())
    if bits > FILTER_BITS:
        return None
    place = F.explode(F.array(F.col(U1).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(U1, 32).bitwiseAND(F.lit((1 << bits) - 1)))).alias("p")
    words_ = ends.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words_["w"].to_numpy()] = words_["m"].to_numpy().view(np.uint64)
    return ends.sparkSession.sparkContext.broadcast(bitmap)


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column(2), batch.column(3)
        oa, ob = (x.offsets.to_numpy() for x in (sa, sb))
        va, vb = (x.values.to_numpy() for x in (sa, sb))
        out = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum()) if len(y) else 0
            out[i] = both / max(1, len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "jaccard"])


def sketches(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n, f1, f2, sketch, id) of each row with words; id is a number of its own, given once when the table is written."""
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), *key_columns(), text_of().alias("text"))
    made = rows.mapInArrow(lean(_sketcher(k, n)), f"doc_id long, {U1} long, {U2} long, n long, f1 long, f2 long, sketch array<long>").filter("n > 0")
    return written(made.withColumn("id", F.monotonically_increasing_id()), "sketches")


def inverted_lists(sets: DataFrame, floor: float) -> DataFrame:
    """(v, u, n, spread): the sketches that hold each retained value, of each sketch the rarest values, as the module says; values that one sketch alone has are left out.

    Values are counted before they meet their sketches, so a value that everything
    has is a skewed join, split by the engine, and no group in one task.
    """
    flat = sets.select("u", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    counted = flat.join(flat.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "v")
    by = counted.groupBy("u", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))  # no more than a sketch has
    need = F.greatest(F.lit(1), F.ceil(F.round(F.col("s") * F.lit(floor), 6)).cast("int"))
    spread = F.aggregate("vs", F.lit(0.0), lambda t, x: t + F.log2(x["df"].cast("double")))
    kept = by.withColumn("left", F.size("vs") - need + 1).filter("left > 0")  # values of its own come first and are listed for nobody
    return kept.select("u", "n", F.round(spread, 6).alias("spread"), F.explode(F.slice("vs", F.lit(1), F.col("left"))).alias("x")).select(F.col("x.v").alias("v"), "u", "n", "spread")


def _alike(x: str, y: str, threshold: float) -> Column:
    """Sets of these sizes can have an index of ``threshold``."""
    return F.least(x, y) >= F.round(F.greatest(x, y) * F.lit(threshold), 6)


def estimated(pairs: DataFrame, sets: DataFrame, k: int, floor: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose union sketch has a share of at least ``floor`` in common."""
    # 31 leading bits keep the order and tell values apart well enough for an estimate
    short = F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int"))
    side = lambda x: sets.select(F.col("u").alias(x), short.alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("t", union).filter(F.size(F.array_intersect("t", F.array_intersect("sa", "sb"))) >= F.round(F.size("t") * F.lit(floor), 6))
    return both.select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, keys: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, jaccard) of ``pairs`` with an exact index of at least ``threshold``. Only the sets of documents that are involved, or pass a Bloom filter of them, are shuffled."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = written(keys.select("id", U1, U2).join(ids, "id"), "ends")
    texts = docs.filter(F.col("text").isNotNull()).select(*key_columns(), text_of().alias("text"))
    held = _filter_of(ends)
    if held is None:
        texts = texts.join(ends.select(U1, U2), [U1, U2], "left_semi")
    sets = texts.mapInArrow(lean(_setter(n, held)), f"{U1} long, {U2} long, s array<long>").join(ends, [U1, U2]).select("id", "s")
    sets = one_each(written(sets, "whole-sets"), "id")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(_jaccard), "a long, b long, jaccard double").filter(F.col("jaccard") >= threshold)


def groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, n: int = SHINGLE, slack: float = SLACK) -> DataFrame:
    """(doc_id, key, root) of every row with words; rows of one root are near duplicates."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    floor = max(0.0, threshold - slack)
    every = sketches(docs, k, n)
    same = ["n", "f1", "f2"]
    sets = written(every.groupBy(*same).agg(F.min("id").alias("u"), F.first("sketch").alias("sketch")), "sets")
    listed = written(inverted_lists(sets, floor), "lists")
    hubs = listed.groupBy("v").agg(F.max(F.struct("spread", "u", "n")).alias("h"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    stars = listed.join(hubs, "v").filter(F.col("u") != F.col("h.u")).filter(_alike("n", "h.n", threshold))
    stars = written(stars.select(F.least("u", "h.u").alias("a"), F.greatest("u", "h.u").alias("b")).distinct(), "stars")
    near = settled(lambda: verified(written(estimated(stars, sets, k, floor), "likely"), docs, every, threshold, n).select("a", "b"), "near")
    found = components(near)
    # what is left: in each list, pairs of different components. All but the largest component of a list are compared with all of it.
    rest = settled(lambda: _left(listed, found, threshold).join(stars, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = settled(lambda: verified(written(estimated(rest, sets, k, floor), "passed"), docs, every, threshold, n).select("a", "b"), "more")
        found = components(near.unionByName(more))
    roots = sets.join(found.withColumnRenamed("node", "u"), "u", "left").select(*same, F.coalesce("root", "u").alias("root"))
    return every.select("doc_id", U1, U2, *same).join(roots, same).select("doc_id", U1, U2, "root")


def _left(listed: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one list but of different components."""
    placed = written(listed.join(found.withColumnRenamed("node", "u"), "u", "left").select("v", "u", "n", F.coalesce("root", "u").alias("c")), "placed")
    parts = placed.groupBy("v", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("v").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts"))
    marked = written(placed.join(parts.filter("parts > 1"), "v").select("v", "u", "n", "c", (F.col("c") == F.col("top")).alias("main")), "open")
    few = marked.filter("not main").select("v", F.col("u").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    all_ = marked.select("v", F.col("u").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), "main")
    rest = few.join(all_, "v").filter("cx <> cy and (main or x < y)").filter(_alike("nx", "ny", threshold))
    return rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, group_doc_id, group_size, keep) of the rows that are in a group of at least two.

    ``group_doc_id`` is the least doc_id of the group, and that row is kept; a null
    doc_id is greater than all others. Texts that are null or have no words are near
    to nothing and not listed. A text of fewer words than a run is near only to ones
    of the same words. Texts are whole, however long. Equal texts are near; rows that
    agree in doc_id and text are one row. Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    found = settled(lambda: groups(docs, **how).distinct(), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", U1, U2)).alias("l")
    by = found.groupBy("root").agg(least, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    out = found.join(by, "root")
    return out.select("doc_id", F.col("l.doc_id").alias("group_doc_id"), "group_size", (F.struct(U1, U2) == F.struct(f"l.{U1}", f"l.{U2}")).alias("keep"))


def drop_near(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group, all its columns with it; rows without words, or with a null text, all stay, repeated rows only once.

    The row that stays has the least doc_id, null being greater than all. An empty
    table stays empty; columns keep their names, whatever they are.
    """
    found = settled(lambda: groups(docs, **how).groupBy(U1, U2).agg(F.min("root").alias("root"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias(TMP + "m")), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", U1, U2)).alias("l")
    by = found.groupBy("root").agg(least, F.count(F.lit(1)).alias("size")).filter("size > 1")
    dropped = found.join(by, "root").filter(F.struct(U1, U2) != F.struct(f"l.{U1}", f"l.{U2}")).select(U1, U2)
    again = written(found.filter(F.col(TMP + "m") > 1).select(U1, U2, TMP + "m"), "again")
    out = docs.select(*renamed(docs), *key_columns()).join(written(dropped, "dropped"), [U1, U2], "left_anti")
    if not again.isEmpty():  # rows that agree in doc_id and text
        out = out.join(again, [U1, U2], "left")
        more = out.filter(F.col(TMP + "m").isNotNull()).groupBy(U1, U2).agg(F.min_by(F.struct(*(F.col(f"{TMP}c{i}") for i in range(len(docs.columns)))), F.struct(*row_order(docs))).alias("x"))
        out = out.filter(F.col(TMP + "m").isNull()).drop(TMP + "m", U1, U2).unionByName(more.select("x.*"))
    return out.select(*named_back(docs))
