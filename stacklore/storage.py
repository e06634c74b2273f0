"""Where intermediate tables go, and how lineage is cut.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir``, which
all executors and the driver must share. Only a session on a local master that names none
(unit tests) gets a temporary folder; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_shared: set[str] = set()
_tables: dict[str, SparkSession] = {}


def _on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; an error if a cluster's session names none or one that is not shared."""
    context = spark.sparkContext
    folder = spark.conf.get(_KEY, None) or context.getConf().get(_KEY, None)
    if folder is None:
        if not _on_one_machine(context.master):
            raise ValueError(f"set {_KEY} to a folder that all executors and the driver share")
        folder = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="stacklore-"))
    folder = folder.rstrip("/")
    if folder not in _shared:
        if not _on_one_machine(context.master):
            _probe(spark, folder)
        _shared.add(folder)
    return folder


def _probe(spark: SparkSession, folder: str, parts: int = 64) -> None:
    """Writes a row per task and reads them back, so that a folder of each machine's own is noticed before it loses rows."""
    path = f"{folder}/stacklore-{uuid.uuid4().hex}"
    spark.range(0, parts, 1, parts).write.parquet(path)
    seen = spark.read.schema("id bigint").parquet(path).count()
    _delete(spark, path)
    if seen != parts:
        raise ValueError(f"{folder} is not shared: {seen} of {parts} rows came back")


def _delete(spark: SparkSession, path: str) -> None:
    _tables.pop(path, None)
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone by then
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return that table.

    The result survives the loss of any executor and has no lineage. The files are
    removed by ``drop``, at the end of ``tables``, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stacklore-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stacklore_table = path
    return out


def drop(df: DataFrame | None) -> None:
    """Removes the files of a table that ``cut`` returned and nothing reads any more; others are left alone."""
    path = getattr(df, "_stacklore_table", None)
    if path in _tables:
        _delete(_tables[path], path)


@contextmanager
def tables() -> Iterator[None]:
    """Removes at its end the tables cut inside; what is to be kept must have been written elsewhere by then."""
    before = set(_tables)
    try:
        yield
    finally:
        for path in set(_tables) - before:
            _delete(_tables[path], path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_tables.items()):
        _delete(spark, path)
