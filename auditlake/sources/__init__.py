"""Tables that the queries read."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder, read by Spark whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
