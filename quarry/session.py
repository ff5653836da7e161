"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes of rows in memory for a byte of Parquet: 8 to 12 measured for the catalogue's tables, ids above all.
BYTES_OF_ROWS = 10.0


def size_tables(spark: SparkSession) -> None:
    """Let Spark judge tables by their rows rather than by their compressed files when it chooses what to broadcast.

    A table of 10 MB of Parquet is 100 MB as rows, and the driver holds a broadcast several times while it is made.
    A factor that the session has set itself is left alone.
    """
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, str(BYTES_OF_ROWS))


def scratch_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="quarry-")
    return _LOCAL_FOLDERS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several later steps read the same result: it cuts the lineage, survives
    lost executors, and gives the optimizer real sizes to choose join strategies by.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
