"""Scratch tables on the storage all executors share, and small helpers."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rankloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.scratch = path
    return held


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``table`` or ``chunks.store`` that nothing reads any more, and lets Spark drop the shuffle files of finished steps.

    Spark's cleaner drops a shuffle once the JVM has collected its plan, which a driver with memory to spare puts off.
    What the driver's JVM has allocated outside its heap and freed goes back to the system too.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        if name := getattr(df, "scratch_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    gc.collect()
    context = SparkSession.getActiveSession().sparkContext
    context._jvm.System.gc()
    _trim(context)


def _trim(context: SparkContext) -> None:
    """Gives the freed native memory of the driver's JVM back to the system, where the JVM has a command for it (HotSpot on glibc).

    Planning and compiling many steps allocates in many threads, and the C library keeps what each of them frees.
    """
    lang = context._jvm.java.lang

    def array(kind: object, *values: object) -> object:
        made = context._gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            made[k] = v
        return made

    try:
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(lang.Class.forName, names)))
        commands = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JError:  # another JVM: it keeps that memory
        pass


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows in an Arrow batch. Texts are long, so batches hold few rows; Spark also cuts batches by bytes where it can."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
