"""Reading and writing the shapes of the schema module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.schema import PROFILE, REGISTRY, TABLE


SPREAD_CONF = "canvass.scan.partitions"


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over as many partitions as the session asks for.

    A caller whose input is a few large row groups sets ``canvass.scan.partitions``;
    unset, the scan stays as it is.
    """
    wanted = scan.sparkSession.conf.get(SPREAD_CONF, None)
    return scan.repartition(int(wanted)) if wanted else scan


def spread_by(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows out by their key, so that every core has a share of the costly expressions after them.

    A scan is cut by bytes and row groups, and adaptive execution joins partitions by bytes
    as well; both leave a few tasks to rows that are small and dear.  A number of partitions
    that is asked for stays, and a join on the key takes it over.
    """
    spark = rows.sparkSession
    wanted = spark.conf.get(SPREAD_CONF, None) or max(
        rows.rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(int(wanted), key)


def read_records(spark: SparkSession, path: str, fmt: str = "json", schema=None) -> DataFrame:
    """Published or ingested records; the schema is never guessed when given."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A keyed table."""
    return spark.read.format(fmt).schema(TABLE).load(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path)


def read_shards(spark: SparkSession, root: str, source_ids=None) -> DataFrame:
    """Published shards; only the folders of the wanted sources are read."""
    shards = spark.read.parquet(root).where(F.col("delivery") == "shard")
    return shards if source_ids is None else shards.where(F.col("source_id").isin(list(source_ids)))


def read_core(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("delivery") == "core")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
