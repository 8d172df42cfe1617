"""The chunk store: chunks with embeddings in bucketed parquet folders, of which one pointer names the current ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.filters import among
from citemill.schemas import STORED_CHUNK
from citemill.session import stage
from citemill.sources.pointer import delete_folder, folders, pointer_version, read_pointer, write_pointer

NO_INDEX = "no-index"


def merge_upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Existing rows with those of ``new`` inserted, or put in their place."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def merge_replace(existing: DataFrame, new: DataFrame, owner: str = "accession_number") -> DataFrame:
    """Existing rows with every owner in ``new`` replaced as a whole, so that no
    chunk of an older chunking is left behind."""
    kept = existing.join(new.select(owner).distinct(), owner, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def repeated(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def stale_ids(stored: DataFrame, produced: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored keys that the latest run did not produce."""
    return stored.select(key).join(produced.select(key), key, "left_anti")


def id_difference(left: DataFrame, right: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys on one side only, with the side they are on."""
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    return both.where(F.col("l").isNull() | F.col("r").isNull()).select(
        key, F.when(F.col("l"), "left").otherwise("right").alias("side")
    )


def _digests(key: str) -> list:
    """Count and sums of digests of the keys, which add up over parts of a table."""
    digest = F.md5(F.encode(F.col(key).cast("string"), "UTF-8"))
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)"))
    return [F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b")]


def snapshot_hash(store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Twelve hex digits that identify the set of stored keys.

    Digests of the keys are added up, which needs no order and no gathering of
    keys in one place.
    """
    sums = store.agg(*_digests(key))
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", "a", "b")])
    whole = F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12)
    return sums.select(
        F.when(F.col("n") == 0, NO_INDEX).otherwise(whole).alias("corpus_snapshot_hash")
    )


class ChunkStore:
    """Chunks below one path, in a fixed number of buckets by filing.

    All chunks of a filing share a bucket. A write puts the buckets of the filings
    it brings into new folders, ``version=v/bucket=b``, and then replaces the
    pointer, which names the version of each bucket and the digest of its ids. A
    write that fails midway leaves the old rows and the old hash, and buckets it
    does not touch are neither read nor written. Choose ``store_buckets`` so that
    one bucket stays in the tens of gigabytes.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path, self.settings = spark, path, settings

    def _pointer(self, version: int | None = None) -> dict:
        start = {"version": 0, "buckets": self.settings.store_buckets, "parts": {}, "digests": {}}
        return read_pointer(self.spark, self.path, version) or start

    def buckets(self) -> int:
        """The number of buckets the store was first written with; later settings do not move its chunks."""
        return self._pointer()["buckets"]

    def exists(self) -> bool:
        return pointer_version(self.spark, self.path) > 0

    def version(self) -> int:
        """Number of the last write, 0 before the first."""
        return pointer_version(self.spark, self.path)

    def versions(self) -> list[int]:
        """Versions that can be read, the current one last."""
        current = pointer_version(self.spark, self.path)
        return [v for v in range(1, current + 1) if self._whole(v)]

    def _whole(self, version: int) -> bool:
        held = {int(name.partition("=")[2]) for name in folders(self.spark, self.path) if name.startswith("version=")}
        return set(self._pointer(version)["parts"].values()) <= held

    def _read(self, parts: dict) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(parts.items())]
        if not paths:
            return self.spark.createDataFrame([], STORED_CHUNK)
        return self.spark.read.schema(STORED_CHUNK).parquet(*paths)

    def scan(self, version: int | None = None) -> DataFrame:
        """All stored chunks, now or as of an earlier version. Select few columns; the rest is not read."""
        return self._read(self._pointer(version)["parts"])

    def get(self, ids: list[str]) -> DataFrame:
        """Chunks by id. Bloom filters on the id let row groups be skipped."""
        return self.scan().where(among(F.col("chunk_id"), ids))

    def ids(self) -> DataFrame:
        return self.scan().select("chunk_id")

    def snapshot(self, version: int | None = None) -> str:
        """The hash of the stored ids, from the digests of the buckets; no row is read."""
        sums = [sum(int(d[i]) for d in self._pointer(version)["digests"].values()) for i in range(3)]
        return hashlib.md5("-".join(map(str, sums)).encode()).hexdigest()[:12] if sums[0] else NO_INDEX

    def count(self) -> int:
        return sum(int(d[0]) for d in self._pointer()["digests"].values())

    def upsert(self, chunks: DataFrame) -> None:
        """Insert chunks, replacing those with the same id."""
        self._merge(chunks, merge_upsert)

    def replace_filings(self, chunks: DataFrame) -> None:
        """Store chunks as the only ones of their filings."""
        self._merge(chunks, merge_replace)

    def _merge(self, chunks: DataFrame, merge) -> None:
        new = stage(chunks.select(*STORED_CHUNK.names), "new-chunks")
        double = repeated(new).take(1)
        if double:
            raise ValueError(f"chunk id {double[0]['chunk_id']} occurs more than once in one write")
        old = self._pointer()
        # A failed write may have left a folder: its number is not used again.
        taken = [int(name.partition("=")[2]) for name in folders(self.spark, self.path) if name.startswith("version=")]
        version, folder = old["version"] + 1, max([old["version"], *taken]) + 1
        bucket = F.pmod(F.xxhash64("accession_number"), F.lit(old["buckets"])).cast("int")
        touched = [str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()]
        existing = self._read({b: v for b, v in old["parts"].items() if b in touched})
        merged = merge(existing, new).withColumn("bucket", bucket)
        # Rebalancing writes few files per bucket and splits a bucket that is large.
        merged.hint("rebalance", "bucket").write.mode("overwrite").option("parquet.bloom.filter.enabled#chunk_id", "true").partitionBy(
            "bucket"
        ).parquet(f"{self.path}/version={folder}")
        self._commit(old, version, folder)

    def _commit(self, old: dict, version: int, folder: int) -> None:
        """Makes the buckets in a folder the current ones."""
        written = self.spark.read.schema("chunk_id string, bucket int").parquet(f"{self.path}/version={folder}")
        found = written.groupBy("bucket").agg(*_digests("chunk_id")).collect()  # a row for each bucket
        write_pointer(self.spark, self.path, version, {
            "buckets": old["buckets"],
            "parts": {**old["parts"], **{str(r.bucket): folder for r in found}},
            "digests": {**old["digests"], **{str(r.bucket): [r.n, str(r.a), str(r.b)] for r in found}},
        })

    def clean(self) -> None:
        """Deletes the folders that the current pointer does not name. Readers of earlier versions lose them."""
        parts = {str(v): set() for v in self._pointer()["parts"].values()}
        for b, v in self._pointer()["parts"].items():
            parts[str(v)].add(f"bucket={b}")
        for name in folders(self.spark, self.path):
            kept = parts.get(name.partition("=")[2], set()) if name.startswith("version=") else None
            for inner in folders(self.spark, f"{self.path}/{name}") if kept is not None else []:
                if inner not in kept:
                    delete_folder(self.spark, f"{self.path}/{name}/{inner}")
            if kept == set():
                delete_folder(self.spark, f"{self.path}/{name}")
