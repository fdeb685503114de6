"""Relations in a database, read and written over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, split_by: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table, or a query in brackets with a name. split_by: a whole-number column, over whose range `parts` connections read side by
    side (its ends are asked for first); without it one connection reads everything. Options go to the driver."""
    options = {"url": url, **options}
    if split_by:
        ends = spark.read.format("jdbc").options(dbtable=table, **options).load().agg(F.min(split_by), F.max(split_by)).first()
        if ends[0] is not None:
            options |= {"partitionColumn": split_by, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
