"""Small tables from the driver's memory."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def frame(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """Rows as a local relation: no Python worker and no job to read them."""
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
