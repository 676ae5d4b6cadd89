"""Tables in a folder that all executors see: created, appended to, partitioned, converted, backed up, found again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The codecs of tables by name.
CODECS = {"none": "uncompressed", "snappy": "snappy", "lz4": "lz4", "lz4_fast": "lz4_raw", "zstd": "zstd", "gzip": "gzip"}
_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found, True)
        found = "file://" + found
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def passing_path(spark: SparkSession, label: str) -> str:
    """A new place in this application's own part of the shared folder, which goes when the application ends."""
    own = f"{shared_dir(spark).rstrip('/')}/millrace-plans-{spark.sparkContext.applicationId}"
    if own not in _owned:
        at, files = _hadoop(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _owned.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex[:12]}"


def create(df: DataFrame, path: str, codec: str = "snappy", partition_by: Sequence[str] = (), engine: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as a new table and read it back; an existing one is an error unless ``mode`` says otherwise."""
    out = df.write.mode(mode).format(engine)
    if engine == "parquet":
        out = out.option("compression", CODECS[codec])
    (out.partitionBy(*partition_by) if partition_by else out).save(path)
    return df.sparkSession.read.format(engine).schema(df.schema).load(path)


def append(df: DataFrame, path: str, engine: str = "parquet") -> None:
    """Add the rows of ``df``, all or none."""
    df.write.mode("append").format(engine).save(path)


def truncate(spark: SparkSession, path: str, engine: str = "parquet") -> DataFrame:
    """The table without rows, its columns as they were."""
    schema = spark.read.format(engine).load(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").format(engine).save(path)
    return spark.read.format(engine).schema(schema).load(path)


def convert(spark: SparkSession, path: str, source: str, to: str, target: str) -> DataFrame:
    """A table of one format as one of another, rows and types as they are."""
    return create(spark.read.format(source).load(path), to, engine=target)


def backup(spark: SparkSession, path: str, to: str) -> None:
    """Copy the files of a table to an empty or new folder; one that holds anything is refused."""
    (src, files), (dst, there) = _hadoop(spark, path), _hadoop(spark, to)
    if there.exists(dst) and len(there.listStatus(dst)):
        raise ValueError(f"{to} isn't empty")
    there.delete(dst, True)
    sc = spark.sparkContext
    sc._jvm.org.apache.hadoop.fs.FileUtil.copy(files, src, there, dst, False, sc._jsc.hadoopConfiguration())


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder, in order."""
    at, files = _hadoop(spark, folder)
    return sorted(x.getPath().getName().removesuffix(".parquet") for x in files.listStatus(at) if x.getPath().getName().endswith(".parquet"))


def evolved(spark: SparkSession, path: str, defaults: Mapping[str, Column], renamed: Mapping[str, str] | None = None) -> DataFrame:
    """A table whose files have older and newer columns: a column that a file lacks has its default, a renamed one its values under either name.

    Files that were written with the column keep their nulls only where no default is given.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for old, new in (renamed or {}).items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df.select(*(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in df.columns))


def range_label(value: Column, bounds: Sequence[tuple[str, object]], rest: str) -> Column:
    """The name of the partition by upper bounds, which aren't included, in rising order; ``rest`` has null and all beyond."""
    out = F.lit(rest)
    for name, bound in reversed(bounds):
        out = F.when(value < F.lit(bound), F.lit(name)).otherwise(out)
    return out


def pruned_range(df: DataFrame, label: str, column: str, bounds: Sequence[tuple[str, object]], rest: str, low, high) -> DataFrame:
    """Rows with low <= column < high of a table partitioned by :func:`range_label`: only partitions that can have some are read."""
    names, before = [], None
    for name, bound in bounds:
        if (before is None or before < high) and bound > low:
            names.append(name)
        before = bound
    if before is None or before < high:
        names.append(rest)
    return df.filter(F.col(label).isin(names) & (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
