"""The session and its settings."""

from pyspark.sql import SparkSession

#: Map keys repeat in annotation attributes, where the last one counts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("celltide").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
