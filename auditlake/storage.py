"""Tables written to the cluster's shared folder, and bitmaps of their keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one if the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For each scratch() that is open, the tables written so far.
_scratch: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df written as a Parquet table in the shared folder, and read again.

    A lost executor costs a re-read of the files and no recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._auditlake_path = path
    if _scratch:
        _scratch[-1].append(back)
    return back


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of written() frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_auditlake_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more, which it does when the driver collects garbage.

    What compilers and codecs of the driver's JVM have freed goes back to the system too: the C library keeps it, in an
    arena a thread, and a driver has hundreds of threads.
    """
    # Spark's listeners hold the event that came last, and with it the last query's plan: until another query has run.
    spark.sql("select 1").collect()
    with suppress(Exception):  # events come late on a busy driver; then the next call deletes the files
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2000)
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Returns the free native memory of the driver's JVM to the system; whether that JVM can (JDK 17.0.9 on, with glibc)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    try:
        # by the interface's method: the server's own class is closed to reflection
        kinds = array(lang.Class, 4)
        kinds[0], kinds[1] = lang.Class.forName("javax.management.ObjectName"), lang.Class.forName("java.lang.String")
        kinds[2], kinds[3] = array(lang.Object, 0).getClass(), array(lang.String, 0).getClass()
        call = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        values = array(lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = array(lang.Object, 0), array(lang.String, 0)
        call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # a JVM without that command
        return False
    return True


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside at the end, but for those taken off the list."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        discard(spark, *_scratch.pop())
        released(spark)


def bucket_values(found: DataFrame, n: int, kind: str = "bigint") -> F.Column:
    """The summed values v of (b, v) as an array over b = 0..n-1, as a scalar subquery; n is fixed or bounded, whatever the input."""
    every = found.sparkSession.range(n).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("v"))
    total = found.select("b", "v").unionByName(every).groupBy("b").agg(F.sum("v").cast(kind).alias("v"))
    return total.agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("p")).select(F.expr("p.v")).scalar()


def marked(ids: DataFrame, key: str = "doc_id", least: int = 1 << 16, most: int = 1 << 26) -> F.Column:
    """A test of a whole-number column `key` in DataFrame expressions: holds for every key of `ids` and for few others.

    The keys set bits of a bitmap, about 16 bits for each key of `ids` (which should be a written table, since it is
    counted first), between `least` and `most`. The bitmap is one value of at most 8 MB; beyond some 20 million keys it
    lets through more of the others, so that an exact join has to follow. Keys of any integer type hash alike.
    """
    bits = least
    wanted = 16 * ids.count()
    while bits < min(wanted, most):
        bits *= 2
    slot = f"pmod(xxhash64(try_cast({key} as bigint)), {bits}L)"
    word, bit = f"cast(shiftright({slot}, 6) as int)", f"shiftleft(1L, cast({slot} & 63 as int))"
    found = ids.groupBy(F.expr(word).alias("b")).agg(F.expr(f"bit_or({bit})").alias("v"))
    return F.get(bucket_values(found, bits // 64), F.expr(word)).bitwiseAND(F.expr(bit)) != 0
