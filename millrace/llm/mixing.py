"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their doc_id. A document's
virtual finish time is the number of tokens its source has sent up to and with
it, divided by the source's target weight. Sorting all documents by that time
and cutting at a token budget gives each source its share for as long as it has
documents.

No running sum is made in one task: documents are bucketed by their hash (within
a source) or by their time (over all), buckets are summed apart, and the small
table of bucket totals gives each bucket its offset. A hot source is spread over
as many buckets as any other, and buckets of time are cut at quantiles, so that
they hold about as many documents however unlike the weights are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import TMP, U1, U2, keep_rows, key_columns, settled, text_of, written

#: Target weights for production: the hot source is held at its own share, curated ones get more.
WEIGHTS: dict[str, float] = {"src0": 2.0, "src1": 3.0, "src2": 3.0, "src3": 1.5, "src4": 0.5}
DEFAULT_WEIGHT = 1.0
#: The budget as a share of all tokens, in thousandths, so that every size behaves alike.
BUDGET_PERMILLE = 800
SEED = "mix-1"
_HEX = 3  # characters of the hash that name a bucket of a source: 4096 buckets
_TIMES = 1024  # buckets of virtual time


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("long")


def _weight(weights: Mapping[str, float], default: float) -> Column:
    for s, w in [*weights.items(), ("default", default)]:
        if not w > 0:
            raise ValueError(f"the weight of {s} must be positive")
    out = F.lit(float(default))
    for s, w in weights.items():
        out = F.when(F.col("source") == s, F.lit(float(w))).otherwise(out)
    return out


def _queued(docs: DataFrame, weights: Mapping[str, float], default: float, seed: str) -> DataFrame:
    """key, doc_id, source, n_tokens, h, vft for each row, written once."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *key_columns(), token_count(text_of()).alias("n_tokens"), h.alias("h"))
    rows = written(rows.withColumn("b", F.substring("h", 1, _HEX)), "tokens")
    totals = rows.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s2"), F.col("b").alias("b2"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o"))
    within = Window.partitionBy("source", "b").orderBy("h", "n_tokens", U1, U2).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("c", F.sum("n_tokens").over(within))
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    return joined.select(U1, U2, "doc_id", "source", "n_tokens", "h", ((F.col("c") + F.col("o")) / _weight(weights, default)).alias("vft"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_permille: int = BUDGET_PERMILLE,
    budget_tokens: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """The chosen documents: key, doc_id, source, n_tokens, vft, and ``running``, the tokens up to and with each.

    Rows are ordered by (vft, source, h, n_tokens, key) and kept while ``running``
    is within the budget: ``budget_tokens``, or else that share of all tokens. A
    null source is a source of its own with the default weight. A null or empty
    text has 0 tokens and takes none of the budget. Equal rows follow each other
    and each counts. Sources beyond ``weights`` get ``default_weight``. An empty
    table gives an empty result. Texts are counted whole, however long; extra
    columns are ignored, whatever their names.
    """
    queued = settled(lambda: _queued(docs, WEIGHTS if weights is None else weights, default_weight, seed), "queued")
    cuts = F.percentile_approx("vft", [i / _TIMES for i in range(1, _TIMES)], 20 * _TIMES)
    span = queued.agg(cuts.alias("cuts"), (F.sum("n_tokens") * budget_permille).alias("all")).first()  # _TIMES numbers
    budget = budget_tokens if budget_tokens is not None else (span["all"] or 0) // 1000
    splits = [-math.inf, *sorted(set(span["cuts"] or [])), math.inf]
    queued = Bucketizer(splits=splits, inputCol="vft", outputCol="slot").transform(queued) if len(splits) > 2 else queued.withColumn("slot", F.lit(0.0))
    before = Window.orderBy("slot2").rowsBetween(Window.unboundedPreceding, -1)  # at most _TIMES rows
    totals = queued.groupBy(F.col("slot").alias("slot2")).agg(F.sum("n_tokens").alias("t"))
    offsets = totals.withColumn("o", F.coalesce(F.sum("t").over(before), F.lit(0))).filter(F.col("o") <= budget)
    within = Window.partitionBy("slot").orderBy("vft", F.col("source").asc_nulls_first(), "h", "n_tokens", U1, U2).rowsBetween(Window.unboundedPreceding, 0)
    # slots that begin beyond the budget leave before the sort
    joined = queued.join(offsets, F.col("slot") == F.col("slot2")).withColumn("running", F.sum("n_tokens").over(within) + F.col("o"))
    return joined.filter(F.col("running") <= budget).select(U1, U2, "doc_id", "source", "n_tokens", "h", "vft", "running")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, n_tokens, virtual_finish, running_tokens), globally sorted in the order of sending."""
    out = mix(docs, **how)
    order = ["vft", F.col("source").asc_nulls_first(), "h", "n_tokens", U1, U2]
    return out.orderBy(*order).select("doc_id", "source", "n_tokens", F.col("vft").alias("virtual_finish"), F.col("running").alias("running_tokens"))


def shares(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, **how) -> DataFrame:
    """(source, tokens, target, achieved): the tokens chosen of each source, its share by weight among all sources, and its share of what was chosen.

    They agree while no favoured source runs dry before the budget is spent; the
    default budget of four fifths is more than small sources of a high weight have.
    """
    weights = WEIGHTS if weights is None else weights
    have = docs.select(F.col("source").cast("string").alias("source")).distinct().withColumn("w", _weight(weights, default_weight))
    got = mix(docs, weights, default_weight, **how).groupBy("source").agg(F.sum("n_tokens").alias("t"))
    both = have.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("t", F.coalesce("t", F.lit(0)))
    total = both.agg(F.sum("w").alias("ws"), F.sum("t").alias("ts"))
    return both.crossJoin(F.broadcast(total)).select("source", F.col("t").alias("tokens"), (F.col("w") / F.col("ws")).alias("target"), F.try_divide("t", "ts").alias("achieved"))  # one row


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, as :func:`mix` chooses them, sorted by virtual finish time."""
    have = docs.select(*key_columns()).groupBy(U1, U2).agg(F.count(F.lit(1)).alias(TMP + "m"))
    chosen = settled(lambda: mix(docs, **how).groupBy(U1, U2).agg(F.count(F.lit(1)).alias(TMP + "n1"), F.min("vft").alias(TMP + "o")).join(have, [U1, U2]), "chosen")
    return keep_rows(docs, chosen, TMP + "n1", TMP + "o")
