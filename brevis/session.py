"""A session for local work; on a cluster the cluster's own settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "16g") -> SparkSession:
    conf = {
        "spark.master": f"local[{cores}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
