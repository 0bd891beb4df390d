"""Where intermediate tables go, and how plans are cut.

Results that later steps read more than once, or whose physical layout must
not change (partition numbers), are written as Parquet to the shared folder
named by ``spark.checkpoint.dir``. A written table survives the loss of any
executor, keeps column pruning, and costs no executor memory.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared scratch folder; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="fieldglass-")
    return _local_folders[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/fieldglass/{label}-{uuid.uuid4().hex}"


def stored_bytes(table: DataFrame) -> int:
    """The optimizer's size of a stored table: the bytes of its files. No job runs."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: a table that the optimizer sizes at no more than this may be sent to every executor
SMALL_BYTES = 8 << 20


def small_enough(table: DataFrame) -> bool:
    """Whether a table's known size allows a broadcast; a size that nobody knows does not."""
    return stored_bytes(table) <= SMALL_BYTES


def clear_scratch(spark: SparkSession) -> None:
    """Delete this library's folder of intermediate tables; tables that still read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fieldglass")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str = "table", group_bytes: int | None = None) -> DataFrame:
    """Write once to the shared folder and continue from the written table.

    ``group_bytes`` bounds its row groups, so that a table written by few tasks is read by many, without a shuffle.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
