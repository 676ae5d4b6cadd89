"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All blocks of all
documents are partitioned and sorted, and a block's integer name is its
partition's number and its dense rank there: equal blocks get equal names and
different blocks different ones, as whole blocks are compared; a hash only says
which partition sorts them. Then adjacent names are
paired, pairs are sorted and named in the same way, and so on until a document
is down to one name. (level, name) identifies its text without collisions.

The text is shuffled once. From then on rows are a few integers, half as many at
each level, and only of documents not yet named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import TMP, U1, U2, keep_rows, key_columns, lean, settled, text_of, written

BLOCK_BYTES = 4096
_KEYS = f"doc_id long, {U1} long, {U2} long, m long, i long, n long"


def _ranker(columns: list[str], carried: list[str]):
    """A mapInArrow function that names the sorted tuples of ``columns``: partition number, then dense rank in it."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last = TaskContext.get().partitionId() << 40, None
        at = -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            new = np.zeros(n, bool)
            for c in cols:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head = tuple(c[0].as_py() for c in cols)
            new[0] = head != last
            last = tuple(c[n - 1].as_py() for c in cols)
            local = at + np.cumsum(new)
            at = int(local[-1])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(base + local, pa.int64())], names=[*carried, "name"])

    return rank


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, m, level, name): one row for each distinct (doc_id, text) with a non-null text; m counts its rows.

    Equal (level, name) means equal texts, byte for byte, and the other way round.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    carried = ["doc_id", U1, U2, "m", "i", "n"]
    base = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), *key_columns(), text_of().cast("binary").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("b").substr(i * F.lit(block_bytes) + 1, F.lit(block_bytes)))
    blocks = base.select("doc_id", U1, U2, F.lit(1).cast("long").alias("m"), n.cast("long").alias("n"), cut.alias("cut")).select(
        "doc_id", U1, U2, "m", "n", F.posexplode("cut").alias("i", "block")
    )
    blocks = blocks.select("doc_id", U1, U2, "m", F.col("i").cast("long"), "n", "block").repartition("block").sortWithinPartitions("block")
    level, done = 0, []
    now = written(blocks.mapInArrow(lean(_ranker(["block"], carried)), f"{_KEYS}, name long"), "names")
    while True:
        done.append(now.filter("n = 1").select("doc_id", U1, U2, "m", F.lit(level).alias("level"), "name"))
        rest = now.filter("n > 1")
        if rest.isEmpty():
            break
        half = F.floor(F.col("i") / 2)
        left, right = F.when(F.col("i") % 2 == 0, F.col("name")), F.when(F.col("i") % 2 == 1, F.col("name"))
        # repeated rows fall together here; m keeps their number
        pairs = rest.groupBy("doc_id", U1, U2, half.alias("i"), F.ceil(F.col("n") / 2).alias("n")).agg(
            F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(-1)).alias("b"), F.sum(F.when(F.col("i") % 2 == 0, F.col("m"))).alias("m")
        )
        pairs = pairs.select("doc_id", U1, U2, "m", "i", "n", "a", "b").repartition("a", "b").sortWithinPartitions("a", "b")
        now = written(pairs.mapInArrow(lean(_ranker(["a", "b"], carried)), f"{_KEYS}, name long"), "names")
        level += 1
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.groupBy("level", "name", "doc_id", U1, U2).agg(F.sum("m").alias("m"))


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, group_doc_id, copies, keep): the group of documents with the same text, its least doc_id, its rows.

    Empty texts equal each other. A null text is compared with nothing: it is its
    own group and kept. Rows that agree in doc_id and text are one row here and
    counted in ``copies``. A null doc_id is greater than all others. Extra columns
    are ignored; an empty table gives an empty result.
    """
    same = Window.partitionBy("level", "name")
    named = identities(docs, block_bytes).select(
        "doc_id", F.min("doc_id").over(same).alias("group_doc_id"), F.sum("m").over(same).alias("copies")
    )
    nulls = docs.filter(F.col("text").isNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.lit(1).cast("long").alias("copies"))
    out = named.unionByName(nulls.select("doc_id", F.col("doc_id").alias("group_doc_id"), "copies"))
    return out.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("group_doc_id")))


def drop_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each text: the one with the least doc_id, null being greater than all. Rows with a null text all stay.

    Of rows that agree in doc_id and text one stays, with all its columns, whatever
    their names. Empty texts are one text. An empty table stays empty.
    """

    def kept() -> DataFrame:
        first = Window.partitionBy("level", "name").orderBy(F.col("doc_id").asc_nulls_last(), U1, U2)
        named = identities(docs, block_bytes).withColumn(TMP + "k", F.row_number().over(first)).filter(F.col(TMP + "k") == 1)
        nulls = docs.filter(F.col("text").isNull()).select(*key_columns()).groupBy(U1, U2).agg(F.count(F.lit(1)).alias(TMP + "m"))
        return named.select(U1, U2, F.lit(1).cast("long").alias(TMP + "n1"), F.col("m").alias(TMP + "m")).unionByName(nulls.select(U1, U2, F.col(TMP + "m").alias(TMP + "n1"), TMP + "m"))

    return keep_rows(docs, settled(kept, "kept"), TMP + "n1")
