"""The driver's own memory."""

import time

from pyspark.sql import functions as F

from auditlake import storage


def test_released_returns_native_memory(spark, monkeypatch):
    """Freed native memory of the driver's JVM goes back to the system, wherever shuffle files are let go."""
    asked = []
    trim = storage.trimmed
    monkeypatch.setattr(storage, "trimmed", lambda s: asked.append(trim(s)))
    storage.released(spark)
    assert asked == [True]


def test_released_deletes_the_last_querys_shuffle_files(spark):
    """Those of a query that nothing holds any more, even if no other query has run since."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {x for x in manager.getAllFiles().mkString("|").split("|") if "shuffle_" in x}
    storage.released(spark)
    before = kept()
    storage.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert kept() - before
    storage.released(spark)
    end = time.time() + 5
    while kept() - before and time.time() < end:
        time.sleep(0.1)
    assert not kept() - before
