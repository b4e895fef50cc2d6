"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # instants are compared as UTC microseconds
    "spark.sql.session.timeZone": "UTC",
    # window stages cost much CPU per byte: keep small shuffles in several tasks
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}
# Only for the session builder: call-site capture costs several round trips per column
# expression while plans are built.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
