"""The inner loops of the language model in Java (``Kernel.java``), run by the executors' JVM.

They need a fraction of numpy's CPU time, as no step has to wait for arrays. Spark brings a compiler (Janino) with it: the driver compiles the source once for each application and
gives it to the executors as a jar. Messages are those of ``lm``: pickled and compressed
tuples, each with the number of the partition it goes to.
"""

from __future__ import annotations

import atexit
import pkgutil
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark import RDD, SparkContext
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import _BASE, _MULT, EXACT

_classes: dict[str, object] = {}


def _class(sc: SparkContext):
    """Kernel's Java class, compiled and known to the executors."""
    if sc.applicationId not in _classes:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook("Kernel.java", pkgutil.get_data(__package__, "Kernel.java").decode())
        folder = tempfile.mkdtemp(prefix="millrace-kernel-")  # executors may come for it as long as the application runs
        atexit.register(shutil.rmtree, folder, True)
        place = Path(folder, f"millrace-kernel-{sc.applicationId}.jar")
        with zipfile.ZipFile(place, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.sc().addJar(str(place))
        _classes.clear()
        _classes[sc.applicationId] = compiler.getClassLoader().loadClass("millrace.Kernel")
    return _classes[sc.applicationId]


def _routed(raw: bytes) -> tuple[int, bytes]:
    return int.from_bytes(raw[:4], "big", signed=True), bytes(raw[4:])


class Kernel:
    """Kernel.java with what it is told. ints: partitions, occurrences that make a word hot, CAP, sweeps dropped and kept."""

    def __init__(self, spark: SparkSession, **told):
        self.spark, self.has = spark, {"common": (), "hot": (), "hot_count": (), "hot_total": 1.0, "total": 1.0, "d": (0.0,) * 3, "s": (0.0,) * 3} | told

    def told(self, **more) -> Kernel:
        return Kernel(self.spark, **self.has | more)

    def _java(self, what: str):
        x, sc = self.has, self.spark.sparkContext
        real = (x["hot_total"], x["total"], *x["d"], *x["s"])
        base = np.array([_BASE], np.uint64).view(np.int64)
        args = (what, np.append(np.array(x["ints"], np.int64), base), np.array(real, np.float64), np.array(x["logs"], np.float64), EXACT, *(np.array(x[k], kind) for k, kind in (("common", np.uint64), ("hot", np.uint64), ("hot_count", np.int64))), _MULT[:3])
        held = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
        for i, v in enumerate(args):
            held[i] = v.tobytes() if isinstance(v, np.ndarray) else v
        return _class(sc).getConstructors()[0].newInstance(held)

    def _out(self, jrdd, what: str) -> RDD:
        return RDD(jrdd.mapPartitions(self._java(what)), self.spark.sparkContext, NoOpSerializer()).map(_routed)

    def of_rows(self, what: str, rows: DataFrame) -> RDD:
        """(partition, message) made of rows."""
        return self._out(rows._jdf.javaRDD(), what)

    def of_messages(self, what: str, messages: RDD) -> RDD:
        """(partition, message) made of the messages of each partition, as partitionBy leaves them."""
        return self._out(self.spark.sparkContext._jvm.SerDeUtil.pythonToJava(messages._jrdd, True), what)
