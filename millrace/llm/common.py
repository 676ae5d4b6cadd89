"""What the training-data operators share: shared storage, row keys, and numpy word hashing.

Word hashing works on slices of an Arrow string column. The bytes of a slice get
one running sum of (table[byte] * odd power); the hash of any byte range is a
difference of two sums times an inverse power, so hashing all words of a slice
costs a few vector operations and no Python loop.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of working columns, so that a caller's extra columns never clash.
TMP = "_mr_"
U1, U2 = TMP + "u1", TMP + "u2"


# -------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found, True)
        found = "file://" + found
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def passing_path(spark: SparkSession, label: str) -> str:
    """A place in this application's own part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/millrace-{sc.applicationId}"
    if own not in _owned:
        at = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _owned.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex[:12]}"


_owned: set[str] = set()


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again. A lost executor costs no recomputation."""
    spark, schema = df.sparkSession, df.schema
    path = passing_path(spark, label)
    if (held := _held.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Paths of the tables written so far within the innermost :func:`settled`.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()``, written. The tables that were written for it on the way go then: the result is read from files of its own.

    ``make`` must not hand out a table it writes by other ways than its result.
    """
    inner: list[str] = []
    outer, token = _held.get(), _held.set(inner)
    kept: list[str] = []
    try:
        out = written(make(), label)
        kept.append(inner.pop())
    finally:
        _held.reset(token)
        sc = SparkSession.active().sparkContext
        for path in inner:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    if outer is not None:
        outer += kept
    return out


def files(uri: str):
    """(file system, path) for what workers read and write themselves; s3a and s3n name the same store as s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


# -------- memory


def _trim() -> None:
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, in a worker that gives freed arrays back to the system: workers wait for later stages, and what they keep counts with what those take."""

    def kept(batches: Iterator) -> Iterator:
        _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return kept


# -------- row keys


def text_of(name: str = "text") -> Column:
    return F.col(name).cast("string")


def key_columns() -> list[Column]:
    """A 128-bit key of (doc_id, text). Rows that agree in both are the same row to every operator here."""
    null = F.col("doc_id").isNull().cast("int") + 2 * F.col("text").isNull().cast("int")
    return [
        F.xxhash64(F.col("doc_id"), null, text_of()).alias(U1),
        F.xxhash64(text_of(), F.lit(0x5EED), null, F.col("doc_id")).alias(U2),
    ]


def renamed(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` under names of ours, so that none clashes with a working column."""
    return [F.col(f"`{c}`").alias(f"{TMP}c{i}") for i, c in enumerate(docs.columns)]


def named_back(docs: DataFrame) -> list[Column]:
    return [F.col(f"{TMP}c{i}").alias(c) for i, c in enumerate(docs.columns)]


def row_order(docs: DataFrame) -> list[Column]:
    """An order of renamed rows by all columns that have one."""
    return [F.col(f"{TMP}c{i}") for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind]


def keep_rows(docs: DataFrame, chosen: DataFrame, count: str, order: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose key is in ``chosen``; of rows with one key, only the first ``count``.

    The numbering of equal keys is added only if some key really has more rows
    than it may keep. With ``order``, a column of ``chosen``, the rows are sorted by it.
    """
    on, extra = [U1, U2], [order] if order else []
    picked = chosen.select(*on, F.col(count).alias(TMP + "n"), F.col(TMP + "m"), *extra)
    out = docs.select(*renamed(docs), *key_columns())
    if picked.filter(F.col(TMP + "n") < F.col(TMP + "m")).isEmpty():
        out = out.join(picked.select(*on, *extra), on) if order else out.join(picked.select(*on), on, "left_semi")
    else:
        out = out.join(picked, on).withColumn(TMP + "r", F.row_number().over(Window.partitionBy(*on).orderBy(*row_order(docs))))
        out = out.filter(F.col(TMP + "r") <= F.col(TMP + "n"))
    if order:
        out = out.orderBy(order, *on)
    return out.select(*named_back(docs))


def one_each(df: DataFrame, key: str) -> DataFrame:
    """``df``, a written table whose rows of one key are equal, with one row of each. Without repeated keys no row moves."""
    return df if df.groupBy(key).count().filter("count > 1").isEmpty() else df.dropDuplicates([key])


# -------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64, for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                row = np.multiply.accumulate(row)
                _powers[k : k + 1] = [row]
    return _powers[0], _powers[1]


def _table(fold: bool) -> np.ndarray:
    codes = np.arange(256)
    if fold:
        codes[65:91] += 32
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


FOLDED, EXACT = _table(True), _table(False)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE = np.zeros(256, bool)  # first bytes that _other_scripts looks at
_WIDE[[0xC2, 0xF0, *range(0xE0, 0xEA)]] = True
#: White space and all ASCII signs but letters and digits.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class Words(NamedTuple):
    """Words of a slice of texts: 64-bit hash, number of the text, first byte, byte after the last; bytes; text offsets; first word of each text."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with about ``limit`` bytes each; one long text is a range of its own, never cut."""
    _, offsets = utf8(col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _other_scripts(data: np.ndarray, space: np.ndarray, edge: np.ndarray) -> None:
    """Marks white space beyond ASCII, and the characters of scripts without spaces, each of which is a word."""
    wide = np.flatnonzero(_WIDE[data])
    if not len(wide):
        return
    a, b, c = data[wide], *(data[np.minimum(wide + k, len(data) - 1)] for k in (1, 2))
    two = wide[(a == 0xC2) & ((b == 0xA0) | (b == 0x85))]
    three = (a == 0xE3) & (b == 0x80) & (c == 0x80)
    three |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    for at, size in ((two, 2), (wide[three], 3)):
        for k in range(size):
            space[at + k] = True
    alone = ((a >= 0xE4) & (a <= 0xE9)) | (a == 0xE3) & ~three | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    alone |= (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))
    four = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    for mask, size in ((alone, 3), (four, 4)):
        edge[wide[mask]] = True
        edge[np.minimum(wide[mask] + size, len(data))] = True


def words(col: pa.Array, table: np.ndarray = FOLDED, separators: np.ndarray = SPACE) -> Words:
    """Words are maximal runs of bytes other than ``separators``; with FOLDED, ASCII letters count without case.

    By default they are parted by white space, and a character of a script that
    has none (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word.
    """
    data, offsets = utf8(col)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, data, offsets, np.zeros(len(offsets), np.int64))
    space = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if separators is SPACE:
        _other_scripts(data, space, edge)
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= space[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, inverse = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * p[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(h, doc, start, end, data, offsets, first)


_MULT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _MULT[0]
    for k in range(1, n):
        out += h[k : k + m] * _MULT[k]
    return mix(out)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """As ngrams, by running sums: the cost doesn't grow with n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[:m])


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array, one list for each numpy array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
