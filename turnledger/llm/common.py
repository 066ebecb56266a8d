"""Shared folder, written tables, size-checked broadcasts and small helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids is broadcast only when it was counted and has no more rows than
#: this (8 bytes a row); beyond it the same join is shuffled.
BROADCAST_IDS = 1_000_000

#: Rows and bytes of a batch between the JVM and Python.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session (tests) names none a folder is made and set; on a cluster
    a folder of one machine would lose its tables to the others, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to reuse work."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the driver to drop what it no longer refers to, so that the shuffle files of written tables go.

    The first collection finds the plans, the second what they held.  What the driver's
    threads and its compiler have freed then goes back to the system.
    """
    gc.collect()
    for wait in (0.3, 0.2):
        spark._jvm.System.gc()
        time.sleep(wait)
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """The driver's ``jcmd System.trim_native_heap``, as a management call; JVMs without it keep their memory."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds = array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    call = array(jvm.java.lang.Object, 4)  # without arguments and their types
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, call)
    except Py4JJavaError as e:
        if "ReflectionException" not in str(e.java_exception.getCause()) and "InstanceNotFound" not in str(e.java_exception.getCause()):
            raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **casts: str) -> DataFrame:
    """The named columns, cast; other columns cannot clash with an operator's own.

    Also bounds the rows of a batch that goes to Python, where the session has
    a larger bound, since texts are long: a setting of the session, as a plan has
    none of its own.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in casts.items()))


def keep_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """Semi or anti join with a set of ids that is broadcast only if it is small."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)
