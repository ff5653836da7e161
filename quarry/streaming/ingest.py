"""Incremental load of arriving product and contract files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quarry.operators import catalog
from quarry.session import materialize
from quarry.sources import files

KEYS = {"products": "ste_id", "contracts": "contract_key"}
FIRST = {"products": [], "contracts": ["customer_inn"]}


def ingest_stream(spark: SparkSession, folder: str, kind: str, landing: str) -> DataStreamWriter:
    """Writer that validates and standardises new files of a folder into ``landing``.

    Files are read by lines and put together to records, as by the batch reader. Every batch has its own subfolders, so repeating a
    batch after a failure replaces it.
    """
    lines = files.stream_lines(spark, folder)
    standardize = (
        catalog.standardize_products if kind == "products" else catalog.standardize_contracts
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(batch.withColumn("id", F.monotonically_increasing_id()), "arrived-lines")
        good, quarantine = files.validate_rows(files.parse_lines(arrived, kind), kind)
        standardize(good).write.mode("overwrite").parquet(f"{landing}/{kind}/batch={batch_id}")
        quarantine.write.mode("overwrite").parquet(f"{landing}/quarantine_{kind}/batch={batch_id}")

    return lines.writeStream.foreachBatch(put).option(
        "checkpointLocation", f"{landing}/_progress_{kind}"
    )


def current_rows(spark: SparkSession, landing: str, kind: str) -> DataFrame:
    """Rows in force: of all that arrived with one key the last, by batch, file and place in the file."""
    arrived = spark.read.parquet(f"{landing}/{kind}")
    order = F.struct("batch", files.PLACE)
    latest = catalog.latest_per_key(arrived, KEYS[kind], order, FIRST[kind])
    return latest.drop("batch", files.PLACE)
