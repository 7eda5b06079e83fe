"""Tables of the corpus and the folder that all executors share."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightloom.llm._text import trim

#: Rows in a batch for Python. With texts and token sets in the rows this bounds a worker's memory.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that nothing refers to any more, and gives the driver's free memory back."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """release(), and the executors' JVMs give their free heap back, so that Python workers beside it find room.

    A heap that has grown in one step else stays as large in the next ones, which may need little of it. The job has a
    task for each core, and all begin at once where no others run, so each executor gets one.
    """
    release(spark)
    if not spark.sparkContext._jsc.sc().isLocal():  # there the driver's JVM is the only one
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where none is set and all tasks run here."""
    held = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or held
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='flightloom-')}"
    if held is None:
        spark.sparkContext.setCheckpointDir(named)  # also remembers a folder of our own
    return named


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: lineage ends there."""
    _small_batches(frame.sparkSession)
    path = new_folder(frame.sparkSession, what)
    frame.write.parquet(path)
    held = frame.sparkSession.read.schema(frame.schema).parquet(path)
    held.written_to = path
    return held


def discard(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def low_hash(id_column: str, by: str, counts: dict, most: int) -> Column:
    """Whether a row may be among the least hashes of its value of by, most of them; false for other values.

    counts: rows by value. Of values with many rows those pass whose hash is under a bound under which some more than
    wanted are expected, by eight standard deviations, so few rows are dealt out to be ordered, however many there are.
    """
    if not counts:
        return F.lit(False)
    wanted = most + 8 * math.isqrt(most) + 64
    bounds = {v: (1 << 63) - 1 if n <= wanted else -(1 << 63) + (wanted << 64) // n for v, n in counts.items()}
    known = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
    return F.coalesce(F.xxhash64(id_column) <= F.try_element_at(known, F.col(by)), F.lit(False))


def sample(rows: DataFrame, by: str, order: list, most: int, most_bytes: int, longest: int) -> DataFrame:
    """Of each value of by the first rows in an order: at most so many, with at most so many bytes of text in all.

    Texts longer than longest bytes are left out. Spark limits the groups within each task before it deals them out.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    w = Window.partitionBy(by).orderBy(*order)
    first = rows.where(size <= longest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return first.withColumn("bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("bytes") <= most_bytes)


def veiled(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """docs under column names that no operator uses, the new name of each column, and the old names in order.

    Joins can then bring columns of any name beside those of docs.
    """
    made = [f"docs_column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*made), dict(zip(docs.columns, made)), list(docs.columns)
