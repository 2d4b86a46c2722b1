"""Datasets as parquet folders and text files; any file system Spark can reach by URI."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordwood.sources.replace import folder, replace, restore
from wordwood.sources.sizing import files_and_rows, split_bytes, stored_bytes, stored_sizes

FEATURE_COLS = ["f0", "f1", "f2", "f3"]

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(c, T.FloatType()) for c in FEATURE_COLS],
        T.StructField("label", T.IntegerType()),
    ]
)

# The size ladders of the experiments, in rows, MB and factors.
TABLE_SIZES = [100_000, 200_000, 500_000, 1_000_000, 2_000_000, 3_000_000, 4_000_000]
TEXT_SIZES_MB = [50, 200, 500, 1024, 1536]
FACTORS = [10, 20, 50, 100, 200, 500, 1000, 2000, 5000]
CORE_LEVELS = [16, 20, 24, 30]

# Of many small files a task writes several, so that tasks do not become as many as files: at most
# ``FILES_PER_TASK``, of ``MANY_FILES``, of so many rows each that the tasks' shares are even enough.
FILES_PER_TASK = 16
MANY_FILES = 400
ROWS_OF_EVEN_FILES = 2048

# What a finished write leaves next to its files.
DONE = "_SUCCESS"


def dataset_path(root: str, size: int, suffix: str = "") -> str:
    """``root/data_100000``; with ``suffix=".parquet"`` the other spelling in use."""
    return f"{root.rstrip('/')}/data_{size}{suffix}"


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a parquet folder or file. A schema saves reading the footers first."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_lines(
    spark: SparkSession, path: str, partitions: int | None = None, splits: int | None = None
) -> DataFrame:
    """Scan text files by lines, ``value string``.

    Files are split by size; ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum`` say how.
    With ``splits`` this read alone is split into about that many tasks, by the bytes of its files and
    without a shuffle: a soft bound, as files are cut evenly and small ones are put together. The frame then
    belongs to a session of its own with the same settings. Only a caller who asks for a number of
    ``partitions`` gets exactly these, at the price of a shuffle.
    """
    if splits:
        spark = _split_session(spark, split_bytes(stored_sizes(spark, path), splits))
    df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


def _split_session(spark: SparkSession, size: int) -> SparkSession:
    """A session with the settings of ``spark``, in which scans are split by bytes alone."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    # No bytes are added for opening a file, and nothing but the bytes decides.
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def lines_df(spark: SparkSession, lines: Iterable[str], slices: int = 24) -> DataFrame:
    """Hand a short list of lines over from the driver; larger input belongs in files."""
    rows = [(line,) for line in lines]
    return spark.createDataFrame(rows, "value string").repartition(slices)


def from_pandas(
    spark: SparkSession, pdf, schema: T.StructType = FEATURE_SCHEMA, arrow: bool | None = None
) -> DataFrame:
    """Hand a small pandas frame over. The types follow the schema, with Arrow on or off.

    ``arrow`` says which; else the session does.
    """
    if arrow is None:
        return spark.createDataFrame(pdf[schema.names], schema)
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(arrow).lower())
    try:
        return spark.createDataFrame(pdf[schema.names], schema)
    finally:
        spark.conf.set(setting, before)


def write_dataset(
    df: DataFrame, path: str, files: int | None = None, file_bytes: int | None = None
) -> None:
    """Replace the dataset at ``path``; it stays as it was if the write fails.

    In exactly ``files`` even files if that is asked for, or in files of about ``file_bytes``, whether rows
    have 40 bytes or 100,000. Without either every partition writes its own file and nothing is shuffled.
    """
    most = 0
    if file_bytes:
        files, rows = files_and_rows(df, file_bytes)
        if files >= MANY_FILES and rows >= files * ROWS_OF_EVEN_FILES:
            files, most = _shared_out(files, rows)
    out = df.repartition(files) if files else df
    # 0 is no limit.
    replace(
        df.sparkSession, path, lambda at: out.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(at)
    )


def _shared_out(files: int, rows: int) -> tuple[int, int]:
    """Tasks that write so many files together, and the most rows of a file.

    Shares of a round robin differ by some rows, so files may have a little more than theirs, and
    the last one of a task has less by an eighth.
    """
    tasks = -(-files // FILES_PER_TASK)
    each = -(-files // tasks)
    return tasks, math.ceil(rows / tasks / each * (1 + 1 / (8 * each)))


def write_lines(
    df: DataFrame, path: str, files: int | None = None, file_bytes: int | None = None
) -> None:
    """Replace the text files at ``path``, as :func:`write_dataset` does; ``df`` has one string column."""
    if file_bytes:
        size = df.agg(F.sum(F.octet_length(df[df.columns[0]]) + 1)).first()[0] or 0
        files = max(1, -(-size // file_bytes))
    out = df.repartition(files) if files else df
    replace(df.sparkSession, path, lambda at: out.write.mode("overwrite").text(at))


# The column, and folder, that says which size of a table of many sizes a row is of.
SIZE = "size"


def write_size(df: DataFrame, root: str, size: int) -> None:
    """Replace one size in the table of many sizes at ``root``; the files of others are not touched."""
    if SIZE in (c.lower() for c in df.columns):
        raise ValueError(f"the dataset has a column {SIZE} already")
    sized = df.withColumn(SIZE, F.lit(size).cast("bigint"))
    _write_sizes(sized, root)


def write_sizes(df: DataFrame, root: str) -> None:
    """Replace all sizes that ``df`` has rows of, by its column ``size``.

    Rows of one size come together, but a size of many rows is split over several tasks and files.
    """
    _write_sizes(df.withColumn(SIZE, F.col(SIZE).cast("bigint")).hint("rebalance", SIZE), root)


def _write_sizes(df: DataFrame, root: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(SIZE).parquet(root)


def read_sizes(spark: SparkSession, root: str, *sizes: int) -> DataFrame:
    """The rows of these sizes, or of all, with their ``size``; only their folders are listed and read."""
    df = read_dataset(spark, root)
    df = df.withColumn(SIZE, F.col(SIZE).cast("bigint"))
    return df.where(F.col(SIZE).isin(list(sizes))) if sizes else df


def dataset_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished dataset is there, by the marker of the write.

    Nothing, or a folder with markers only, is no dataset. Files without the marker are neither:
    they may be half of a dataset or something else, so that is an error.
    """
    restore(spark, path)
    fs, at = folder(spark, path)
    if not fs.exists(at):
        return False
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    if DONE in names:
        return any(not n.startswith(("_", ".")) for n in names)
    if any(not n.startswith(("_", ".")) for n in names):
        raise ValueError(f"{path} holds files but no {DONE}: an unfinished or foreign dataset")
    return False


def ensure_dataset(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    files: int | None = None,
    rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Read the dataset at ``path``; build and write it first if it is not there.

    With ``rows`` a dataset of another number of rows, which the footers tell, is an error.
    """
    created = not dataset_exists(spark, path)
    if created:
        write_dataset(build(), path, files)
    df = read_dataset(spark, path)
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{path} has {found} rows, not {rows}")
    return df, created


def copy_dataset(
    spark: SparkSession, src: str, dst: str, files: int | None = None, file_bytes: int | None = None
) -> DataFrame:
    """Copy a dataset to another place or store; with ``files``, to that number of files.

    With ``file_bytes`` to files of about that size: as many as the bytes of the old files make.
    """
    if file_bytes:
        files = max(1, -(-stored_bytes(spark, src) // file_bytes))
    write_dataset(read_dataset(spark, src), dst, files)
    return read_dataset(spark, dst)
