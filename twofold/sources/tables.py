"""Table input and output: delimited files, folders of files, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("trial_id", T.LongType()),
        T.StructField("host_site", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("source_site", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("cnt", T.LongType()),
        T.StructField("infected_flag", T.StringType()),
    ]
)

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine
    session may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="run-")
    return _local_roots[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/twofold/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the staging folder and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer the
    real size of the table, so later joins broadcast it only if it is small.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stages: dict[tuple, tuple[str, T.StructType]] = {}


def stage_once(spark: SparkSession, key: tuple, name: str, build) -> DataFrame:
    """Staged table of a stage that several analyses of a session share.

    ``key`` names the input and every parameter the stage depends on. The table
    is written on first use and read from the staging folder after that, like
    the stage files of a batch pipeline; it is built anew if the folder lost it.
    """
    full = (spark.sparkContext.applicationId, staging_root(spark), name, *key)
    if full in _stages:
        path, schema = _stages[full]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _stages[full]
    df = build()
    path = stage_path(spark, name)
    df.write.parquet(path)
    _stages[full] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def forget_stages() -> None:
    """Build all shared stages anew; call it after the input has changed."""
    _stages.clear()


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = TRIAL_SCHEMA) -> DataFrame:
    """Read delimited text with a declared schema; the text ``NA`` is null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, nullValue="NA")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file below ``path`` as one table, with its file of origin."""
    return spark.read.parquet(path).withColumn("file_path", F.col("_metadata.file_path"))


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+)\.\w+$", 1)


def write_by_model(scores: DataFrame, path: str) -> None:
    """Score table with one folder and file per model, for reads that need few models."""
    scores.repartition("model_name").write.partitionBy("model_name").parquet(path)


def write_chunks(table: DataFrame, path: str) -> None:
    """One folder per chunk."""
    table.repartition("chunk").write.partitionBy("chunk").parquet(path)
