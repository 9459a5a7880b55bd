"""Tables that outlive executors, and settings that the operators share."""

import atexit
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handed to Python at a time. Texts may be long, so few.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Rows of a Parquet file that are decoded at a time, and bytes of a row group that a task gathers before it writes.
DECODED_ROWS, ROW_GROUP = 256, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names. Only a local session, whose executors are the driver, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


class Scratch:
    """Written tables of one run of an operator. They go with drop() or at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.schemas: dict[str, object] = {}
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and reads it again, which cuts its lineage."""
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


_REMEMBERED: dict = {}


def remembered(kind: str, key, make):
    """What a Python worker keeps from task to task: one thing at a time, so that operators do not add up."""
    if _REMEMBERED.get(kind, (None,))[0] != key:
        _REMEMBERED.clear()
        _REMEMBERED[kind] = key, make()
    return _REMEMBERED[kind][1]


def task(run, kind: str | None = None):
    """run, for mapInArrow; a worker first forgets what operators of another kind remember."""

    def begin(batches):
        if any(other != kind for other in _REMEMBERED):
            _REMEMBERED.clear()
        yield from run(batches)

    return begin


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts are decoded and go to Python in small batches, which bounds a task's memory; workers find this package as the driver did.

    Lazy results are read with these settings of the session too, so they stay.
    """
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # with the next, what a worker frees goes back at once
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_ARENA_MAX", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(DECODED_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Another number of rows in a batch, for the actions inside."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
