"""Resumable collection: arriving batches of records are upserted into a table by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from stacklore.operators.cleaning import upsert


def collect_into(stream: DataFrame, table: str, checkpoint: str, key: str = "name", order: str = "row_id") -> StreamingQuery:
    """Upsert each batch of ``stream`` into versions of the parquet table ``table``.

    A batch writes the folder <table>/v<batch>, so one that is repeated after a failure
    writes the same version again. The last version is the table (``current``).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, table, number)
        merged = batch if before is None else upsert(before, batch, key, order)
        if before is None:
            merged = upsert(batch.limit(0), batch, key, order)
        merged.write.mode("overwrite").parquet(f"{table}/v{number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str, before: int | None = None) -> DataFrame | None:
    """The table's last complete version (before a batch number); None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [s.getPath().getName() for s in files.listStatus(path)]
    done = [n for n in names if n.startswith("v") and (before is None or int(n[1:]) < before) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{table}/{max(done)}") if done else None
