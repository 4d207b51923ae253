"""Session settings the operators are written for. All are runtime settings of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Long regular-expression pipelines make generated methods the JVM refuses to compile; above this
    # size Spark runs the operators one by one, each of which is compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables bucketed by some of the keys they are joined on meet where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # What was sorted when it was dealt to buckets, a file each, is not sorted again when it is read.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def builder(app_name: str = "tracemill") -> SparkSession.Builder:
    """A session builder with these settings, for programs that start their own session."""
    made = SparkSession.builder.appName(app_name)
    for name, value in SETTINGS.items():
        made = made.config(name, value)
    # Recording the Python line of every expression costs more than building the plan.
    return made.config("spark.python.sql.dataFrameDebugging.enabled", "false")
