"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.session import spread

_BUILT: dict[tuple[str, str, str], object] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """Documents in enough partitions for work on their texts."""
        return spread(self.documents)

    @property
    def sections(self) -> DataFrame:
        """Documents in the column layout of filing sections."""
        return self.texts.select(
            F.col("doc_id").cast("string").alias("accession_number"),
            F.col("lang").alias("section"),
            F.col("source").alias("company"),
            F.col("source").alias("ticker"),
            F.lit(2024).alias("fiscal_year"),
            F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("source_url"),
            "text",
        )

    @property
    def questions(self) -> DataFrame:
        return self.benchmark.select(
            F.col("item_id").alias("question_id"), F.col("text").alias("question")
        )


def _files(table: DataFrame) -> int:
    """A number that changes when a file of the table does."""
    spark = table.sparkSession
    found = []
    for name in sorted(table.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return hash(tuple(found))


def built_once(name: str, t: Tables, build: Callable[[], object]):
    """An index over the documents, built at first use and kept for the session, as long as their files stay as they are."""
    key = (t.spark.sparkContext.applicationId, t.folder, f"{name} {_files(t.documents)}")
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its own name, with the SQL
    that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
