"""Tables written to the folder that the driver and all executors share.

Long plans are cut by writing a table there and reading it again: it survives the loss of
executors, unlike cached blocks or local checkpoints.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Folders made by this process and not discarded yet, the oldest first.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may run without that setting: it gets a temporary folder,
    removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="affinia-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has been given."""
    _made.append(f"{shared_dir(spark)}/affinia-{uuid.uuid4().hex}")
    return f"{_made[-1]}/{name}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder, at a new path or the one given, and returns the written table."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table written by this module with its folder, on whatever file system it lies."""
    folder = next((f for f in _made if path == f or path.startswith(f + "/")), path)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if folder in _made:
        _made.remove(folder)


def mark() -> int:
    """How many folders there are: see discard_since."""
    return len(_made)


def discard_since(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes what was written after mark() gave ``since``, but for paths under ``keep``.

    For tables whose readers are done: a result that was written itself no longer needs what it came from.
    """
    for folder in _made[since:]:
        if not any(k == folder or k.startswith(folder + "/") for k in keep):
            discard(spark, folder)


#: Parquet options for rows of megabytes: pages and row groups are checked at every row, so a task
#: holds a few rows at a time and not the hundred after which Parquet looks first.
LARGE_ROWS = {
    "parquet.block.size": 8 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false",
}
