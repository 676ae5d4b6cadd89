"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Two machines share the features: one for quality, one for toxicity. A score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so that all pairwise interactions cost as much as one pass over the features.
Training takes a bounded number of labelled rows; scoring is one pass over the
documents with no shuffle, and the model goes along with the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SIGNS, TMP, Words, lean, pieces, text_of, words, written

BITS = 17  # hashed words
RANK = 6
#: Bounds of the training set: labelled rows with the least hashes of doc_id and text, so many and of so many bytes together.
TRAIN_ROWS = 8_000
TRAIN_BYTES = 64 << 20
EPOCHS = 6
#: A document is kept if P(good) is at least this and P(toxic) at most that.
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.5
_STATS = 12
_NAMES = 4096  # hashed names of sources, and as many of languages
_META = 2 * _NAMES
_DENSE = 1 << BITS  # first dense feature
SIZE = _DENSE + _STATS + _META


class Model(NamedTuple):
    w0: np.ndarray  # (heads,)
    w: np.ndarray  # (SIZE, heads)
    v: np.ndarray  # (SIZE, heads * RANK)


def _class_table() -> np.ndarray:
    """By byte, three integers that each hold two 0/1 classes, 32 bits apart, so that one running sum counts both."""
    out = np.zeros((6, 256), np.uint64)
    out[0, 65:91] = out[1, 97:123] = out[2, 48:58] = 1  # upper, lower, digits
    out[3, [33, 35, 36, 37, 38, 42, 64, 94, 124, 126]] = 1  # signs rare in prose
    out[4, 10] = 1
    out[5, 128:] = 1
    return out[::2] | out[1::2] << np.uint64(32)


_CLASSES = _class_table()


def _shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 6): the share of each class of bytes."""
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out = np.empty((len(offsets) - 1, 6))
    total = np.zeros(len(data) + 1, np.uint64)
    for k in range(3):
        np.cumsum(_CLASSES[k][data], out=total[1:])
        both = total[offsets[1:]] - total[offsets[:-1]]
        out[:, 2 * k], out[:, 2 * k + 1] = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    return out / size


def _meta(col: pa.Array, block: int) -> np.ndarray:
    """The feature of each name, hashed whole; null is a name of its own."""
    names = col.to_pylist()
    known = {x: _DENSE + _STATS + _NAMES * block + int.from_bytes(hashlib.blake2b(b"0" if x is None else b"1" + x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % _NAMES for x in set(names)}
    return np.array([known[x] for x in names], np.int64)


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between offsets; of empty ranges 0."""
    total = np.zeros((len(x) + 1, *x.shape[1:]), np.float64)
    np.cumsum(x, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), ordered by row. Each distinct word, and each distinct run of signs between words, counts once; its value is 1."""
    k: Words = words(texts, separators=SIGNS)
    signs: Words = words(texts, separators=~SIGNS)
    n = len(texts)
    key = np.concatenate([(x.doc.astype(np.int64) << BITS) | (x.hash >> np.uint64(64 - BITS)).astype(np.int64) for x in (k, signs)])
    key = np.unique(key)
    rows, feats = key >> BITS, key & (_DENSE - 1)
    count = np.diff(k.first).astype(np.float64)
    distinct = np.bincount(rows, minlength=n)
    per = _shares(k.data, k.offsets)
    length = np.bincount(k.doc, k.end - k.start, minlength=n) / np.maximum(count, 1)
    odd = k.hash >> np.uint64(1)
    repeat = np.zeros(n)
    if len(odd) > 1:  # a word that follows itself
        same = (odd[1:] == odd[:-1]) & (k.doc[1:] == k.doc[:-1])
        repeat = np.bincount(k.doc[1:][same], minlength=n) / np.maximum(count, 1)
    stats = np.stack(
        [np.ones(n), *(4 * per[:, :4].T), 40 * per[:, 4], per[:, 5], length / 10, distinct / np.maximum(count, 1), np.log1p(count) / 5, 4 * repeat, count == 0], 1
    )
    dense_rows = np.repeat(np.arange(n), _STATS + 2)
    dense_feats = np.concatenate([np.broadcast_to(np.arange(_DENSE, _DENSE + _STATS), (n, _STATS)), _meta(source, 0)[:, None], _meta(lang, 1)[:, None]], 1).ravel()
    dense_vals = np.concatenate([stats, np.ones((n, 2))], 1).ravel()
    rows, feats = np.append(rows, dense_rows), np.append(feats, dense_feats)
    vals = np.append(np.ones(len(key)), dense_vals)
    order = np.argsort(rows, kind="stable")
    return rows[order], feats[order], vals[order].astype(np.float32)


def raw_scores(model: Model, rows: np.ndarray, feats: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """(n, heads), by the identity of the sum's square and the squares' sum."""
    offsets = np.searchsorted(rows, np.arange(n + 1))
    linear = _sums(model.w[feats] * vals[:, None], offsets)
    vx = model.v[feats] * vals[:, None]
    s, q = _sums(vx, offsets), _sums(vx * vx, offsets)
    heads = model.w.shape[1]
    return model.w0 + linear + 0.5 * (s * s - q).reshape(n, heads, RANK).sum(2)


def train(rows: np.ndarray, feats: np.ndarray, vals: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss. y: (n, heads) of 0 and 1; rows ordered from 0 to n - 1."""
    n, heads = y.shape
    rng = np.random.default_rng(seed)
    base = np.clip(y.mean(0) if n else np.full(heads, 0.5), 1e-3, 1 - 1e-3)
    w0 = np.log(base / (1 - base))
    w, v = np.zeros((SIZE, heads), np.float32), rng.normal(0, 0.01, (SIZE, heads * RANK)).astype(np.float32)
    gw, gv = np.full((SIZE, heads), 0.05, np.float32), np.full((SIZE, heads * RANK), 1.0, np.float32)
    often = np.bincount(feats, minlength=SIZE) > 1  # a word of one document can teach nothing about others
    rows, feats, vals = (x[often[feats]] for x in (rows, feats, vals))
    offsets = np.searchsorted(rows, np.arange(n + 1))
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for chunk in np.array_split(order, max(1, n // 64)):
            size = offsets[chunk + 1] - offsets[chunk]
            to = np.cumsum(size)
            pick = np.repeat(offsets[chunk] - (to - size), size) + np.arange(to[-1])
            f, x, r = feats[pick], vals[pick][:, None], np.repeat(np.arange(len(chunk)), size)
            off = np.append(0, to)
            vx = v[f] * x
            s = _sums(vx, off)
            out = w0 + _sums(w[f] * x, off) + 0.5 * (s * s - _sums(vx * vx, off)).reshape(len(chunk), heads, RANK).sum(2)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[chunk]).astype(np.float32)
            uniq, inv = np.unique(f, return_inverse=True)
            gr = g[r]
            dw, dv = np.zeros((len(uniq), heads), np.float32), np.zeros((len(uniq), heads * RANK), np.float32)
            one = gr * x
            two = np.repeat(gr, RANK, 1) * x * (s[r] - vx)
            for c in range(heads):
                dw[:, c] = np.bincount(inv, one[:, c], minlength=len(uniq))
            for c in range(heads * RANK):
                dv[:, c] = np.bincount(inv, two[:, c], minlength=len(uniq))
            m = len(chunk)
            dw, dv = dw / m + 1e-5 * w[uniq], dv / m + 1e-3 * v[uniq]
            gw[uniq] += (dw * m) ** 2
            gv[uniq] += (dv * m) ** 2
            w[uniq] -= 0.3 * (dw * m) / np.sqrt(gw[uniq])
            v[uniq] -= 0.02 * (dv * m) / np.sqrt(gv[uniq])
    return Model(w0, w, v)


# -------- on Spark


def _inputs(docs: DataFrame) -> DataFrame:
    """Only these columns go on, so that no other can clash."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as 32-bit integers and the values of the last, dense ones; all others are 1."""
    tail = _STATS + 2
    for batch in batches:
        for a, b in pieces(batch.column(0)):
            part = batch.slice(a, b - a)
            rows, feats, vals = features(part.column(0), part.column(1), part.column(2))
            off = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
            f = [feats[x:y].astype(np.int32).tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
            x = [vals[y - tail : y].tobytes() for y in off[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(x, pa.binary()), *part.columns[3:]], names=["f", "x", *part.schema.names[3:]])


def _training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """The labelled documents that are trained on: distinct rows of (doc_id, text, source, lang), in the order of a hash, within both bounds."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _inputs(docs).filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # max_rows ids; a document may have several rows
    rows = written(rows.select("*", *(F.xxhash64(F.lit(k), "doc_id", "text", "source", "lang", F.col("source").isNull(), F.col("lang").isNull()).alias(f"h{k}") for k in (1, 2))), "labelled")
    keys = rows.groupBy("h1", "h2").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h1", "h2").limit(max_rows).collect()  # max_rows of three numbers
    held, chosen = 0, []
    for r in keys:
        held += r["size"]
        if chosen and held > max_bytes:
            break
        chosen.append((r["h1"], r["h2"]))
    few = docs.sparkSession.createDataFrame(chosen, "h1 long, h2 long")
    return rows.join(F.broadcast(few), ["h1", "h2"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Train on at most ``max_rows`` labelled documents of at most ``max_bytes`` together (one at least), those with the least hashes.

    Labels without a doc_id, quality or document are left out, as are documents
    without a text. Of several labels of one document the least quality and the
    greatest toxicity count; several texts of one doc_id are as many documents, and
    equal rows are one. With no labels left, the model keeps everything.
    """
    rows = _training_rows(docs, labels, max_rows, max_bytes)
    made = rows.select("text", "source", "lang", "good", "toxic", "h1", "h2").mapInArrow(lean(_featurise), "f binary, x binary, good int, toxic int, h1 long, h2 long")
    made = made.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("f", "x", "good", "toxic")))
    table = made.toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])  # bounded by max_rows and max_bytes; one order whatever the partitions
    n = table.num_rows
    if not n:
        return Model(np.array([9.0, -9.0]), np.zeros((SIZE, 2), np.float32), np.zeros((SIZE, 2 * RANK), np.float32))
    feats = [np.frombuffer(x.as_py(), np.int32) for x in table["f"]]
    size = np.array([len(x) for x in feats])
    vals = np.ones(size.sum(), np.float32)
    ends = np.cumsum(size)
    for end, x in zip(ends.tolist(), table["x"], strict=True):
        dense = np.frombuffer(x.as_py(), np.float32)
        vals[end - len(dense) : end] = dense
    y = np.stack([table[c].to_numpy() for c in ("good", "toxic")], 1).astype(np.float32)
    return train(np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(feats), vals, y, epochs)


def _scorer(model, at: tuple[int, int, int]):
    """Adds p_quality and p_toxic to batches; at: where text, source and lang are."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            for a, b in pieces(batch.column(at[0])):
                part = batch.slice(a, b - a)
                rows, feats, vals = features(*(part.column(i) for i in at))
                p = 1 / (1 + np.exp(-np.clip(raw_scores(m, rows, feats, vals, b - a), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*part.schema.names, "p_quality", "p_toxic"])

    return score


def _scored(rows: DataFrame, model: Model, at: tuple[int, int, int]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(tuple(model))  # of fixed size: SIZE x (1 + RANK) x 2 floats
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(lean(_scorer(held, at)), f"{kinds}, p_quality double, p_toxic double")


def _good():
    return (F.col("p_quality") >= KEEP_QUALITY) & (F.col("p_toxic") <= KEEP_TOXIC)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) for each row.

    A null or empty text has no words and is scored by its metadata and the
    feature for emptiness; a null source or language is a value of its own. A text
    is read whole, however long; its length counts by the logarithm. Equal
    rows get equal scores, whatever the partitions. Extra columns are ignored; an
    empty table gives an empty result. Conflicting labels: see :func:`fit`.
    """
    out = _scored(_inputs(docs), fit(docs, labels, max_rows), (1, 2, 3))
    return out.select("doc_id", "p_quality", "p_toxic", _good().alias("keep"))


def drop_rejected(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns, whatever their names, in one pass; repeated rows stay repeated."""
    model = fit(docs, labels, max_rows)
    names = [f"{TMP}c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select("*", *(F.col(names[docs.columns.index(c)]).cast("string").alias(TMP + c) for c in ("text", "source", "lang")))
    n = len(names)
    kept = _scored(rows, model, (n, n + 1, n + 2)).filter(_good())
    return kept.select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))
