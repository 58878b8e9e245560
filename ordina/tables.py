"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Least seconds between two collections of the driver's garbage.
COLLECT_SECONDS = 10
_collected = time.monotonic()


def give_back(spark: SparkSession) -> None:
    """Let the driver drop what the plans of written tables held, broadcasts and shuffles included, and return the memory.

    Else its heap grows by that before it collects of its own accord, and what its compilers freed stays with the C
    library. Not more often than :data:`COLLECT_SECONDS` tells.
    """
    global _collected
    if time.monotonic() - _collected < COLLECT_SECONDS:
        return
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # a JVM may lack this command
        _trim(spark)
    _collected = time.monotonic()


def _trim(spark: SparkSession) -> None:
    """What ``jcmd System.trim_native_heap`` does, in the driver's JVM."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    name = jvm.java.lang.Class.forName
    kinds = [name(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    values = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
    types, args = array(jvm.java.lang.Class, len(kinds)), array(jvm.java.lang.Object, len(kinds))
    for i, (kind, value) in enumerate(zip(kinds, values, strict=True)):
        types[i], args[i] = kind, value
    # By the interface: the server's own class is not open to callers.
    run = name("javax.management.MBeanServer").getMethod("invoke", types)
    run.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local mode)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ordina-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
