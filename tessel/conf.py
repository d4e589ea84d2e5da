"""Settings of the Spark session that the dialect's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.cteRecursionLevelLimit": "200000",
    "spark.sql.cteRecursionRowLimit": "5000000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        try:
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        except Exception as e:  # a setting that this Spark fixes at start or does not know keeps its value
            if "CANNOT_MODIFY" not in str(e) and "SQL_CONF_NOT_FOUND" not in str(e):
                raise
    return spark
