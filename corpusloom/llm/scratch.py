"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and Spark is local,
    one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing lazy still reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends
    here, every executor can read it, and a lost one takes nothing with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def column(name: str) -> Column:
    """The column of exactly this name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *taken: str) -> Column:
    """All columns of ``df`` but the ``taken`` ones as one struct, so that their names
    can't meet those an operator works with; fields that nobody reads are pruned."""
    return F.struct(*[column(c) for c in df.columns if c not in taken] or [F.lit(0).alias("nothing")])


def unpacked(df: DataFrame, struct: str, *taken: str) -> list[Column]:
    """The columns that ``packed`` has put into the column ``struct`` of another frame."""
    return [F.col(struct)[c].alias(c) for c in df.columns if c not in taken]


#: Bytes of rows that go to a Python worker at once; texts are several times that in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a worker's memory doesn't follow the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not (now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))
