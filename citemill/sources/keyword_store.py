"""A keyword index on disk that follows the writes of its store.

Each write adds a segment: the terms of its documents (``forward``), which it numbers, and their postings in runs of a term
and level, each with its size and largest weight (``postings``). A task writes the runs of its own documents, by term and
falling weight, so neither texts nor postings are shuffled. Documents that a write replaces or removes stay in their old
segment and are listed in ``gone``, the uses of their terms in ``away``. Document frequencies, the number of documents and
their lengths are sums over segments less what is gone, so they equal those of an index built anew. ``compact`` makes one
segment of what is there. All is written to new folders, and one pointer names the current ones.

Weights of blocks hold for the mean length of documents when they were written. A larger mean raises the weight of a
posting by the ratio of the two means at most, a smaller one lowers it, so bounds stay bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.filters import among
from citemill.operators.keyword import DOC, LISTED_KEYS, KeywordIndex, doc_bits, marked, posting_runs, run_postings, term_counts
from citemill.session import fits, held
from citemill.sources.pointer import delete_folder, folders, read_pointer, write_pointer

# Folders of segments, and of versions. An index of another layout counts as none and is written anew.
_SEGMENTS, _VERSIONS, _LAYOUT = ("forward", "postings"), ("gone", "away", "terms"), 2


class KeywordStore:
    def __init__(self, spark: SparkSession, path: str, settings: Settings, key: str = "chunk_id"):
        self.spark, self.path, self.settings, self.key = spark, path.rstrip("/"), settings, key

    def _pointer(self) -> dict:
        none = {"version": 0, "segments": [], "gone": [], "terms": 0, "source": None}
        pointer = read_pointer(self.spark, self.path) or none
        return pointer if pointer.get("layout") == _LAYOUT else {**none, "version": pointer["version"]}

    def exists(self) -> bool:
        return bool(self._pointer()["segments"])

    @property
    def source(self):
        """What the last write said it indexes, such as the version of a store."""
        return self._pointer()["source"]

    def keys(self) -> DataFrame:
        """Keys of the documents that are indexed."""
        return self._live_forward(self._pointer()).select(self.key)

    def _read(self, table: str, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{table}/{n}" for n in names]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _segments(self, table: str, pointer: dict) -> DataFrame:
        return self._read(table, [f"segment={s['id']}" for s in pointer["segments"]])

    def _versions(self, table: str, numbers: list[int]) -> DataFrame:
        return self._read(table, [f"version={v}" for v in numbers]).drop("version")

    def _small(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed once, and marked for broadcast if it is small."""
        df, rows = held(df, name)
        return F.broadcast(df) if rows is not None or fits(df, self.settings.broadcast_rows) else df

    def _gone(self, pointer: dict) -> DataFrame | None:
        """The documents that are gone, as bits."""
        return self._small(doc_bits(self._versions("gone", pointer["gone"])), "gone") if pointer["gone"] else None

    def _live_forward(self, pointer: dict) -> DataFrame:
        forward, gone = self._segments("forward", pointer), self._gone(pointer)
        return forward if gone is None else marked(forward, gone, there=False)

    def _write(self, df: DataFrame, path: str, filtered: str | None = None) -> DataFrame:
        """Writes a table, with bloom filters of a column, and reads it again."""
        filters = {f"parquet.bloom.filter.enabled#{filtered}": "true", "parquet.bloom.filter.adaptive.enabled": "true"} if filtered else {}
        # Numbers and terms in order are written as differences.
        df.write.options(compression="zstd", **{"parquet.writer.version": "v2"}, **filters).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _next(self, pointer: dict) -> int:
        """A number that no folder has, one of a failed write included."""
        taken = [
            int(name.rpartition("=")[2]) for table in (*_SEGMENTS, *_VERSIONS) for name in folders(self.spark, f"{self.path}/{table}")
        ]
        return max([pointer["version"], *taken]) + 1

    def upsert(self, docs: DataFrame, text: str = "text", gone: DataFrame | None = None, source=None) -> None:
        """Index ``docs`` in place of what is indexed under their keys, and forget the keys in ``gone``.

        A null text has no terms and counts as a document. A key that repeats in one write is an error.
        """
        pointer = self._pointer()
        number = self._next(pointer)
        counted = docs.select(self.key, term_counts(F.col(text)).alias("c"))
        rows = self._write_forward(counted.select(self.key, "c.dl", "c.terms"), number)
        sums = rows.agg(F.count("*").alias("n"), F.count_distinct(self.key).alias("keys"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        if sums.n != sums["keys"]:
            raise ValueError(f"{self.key} repeats or is null in one write")
        keys = rows.select(self.key)
        left = self._leave(pointer, keys if gone is None else keys.unionByName(gone.select(self.key)).distinct(), number)
        segments = [
            {**s, "n": s["n"] - left.get(s["id"], (0, 0))[0], "dl": s["dl"] - left.get(s["id"], (0, 0))[1]} for s in pointer["segments"]
        ]
        n, dl = (sum(s[k] for s in segments) + sums[k] for k in ("n", "dl"))
        average = dl / n if dl else 1.0
        self._write_postings(rows, number, average)
        self._commit(pointer, number, {
            "segments": [*segments, {"id": number, "n": sums.n, "dl": sums.dl, "average": average}],
            "gone": [*pointer["gone"], *([number] if left else [])], "source": source,
        })

    def _leave(self, pointer: dict, keys: DataFrame, number: int) -> dict[int, tuple[int, int]]:
        """Lists the indexed documents of ``keys`` as gone; (documents, terms) of each segment that lost some."""
        if not pointer["segments"]:
            return {}
        live = self._live_forward(pointer)
        listed = [r[0] for r in keys.limit(LISTED_KEYS + 1).collect()]
        some = among(F.col(self.key), listed) if len(listed) <= LISTED_KEYS else F.lit(True)
        old = live.select("segment", "doc", self.key, "dl").where(some)
        if len(listed) > LISTED_KEYS:
            old = old.join(keys, self.key, "left_semi")
        gone = self._write(old, f"{self.path}/gone/version={number}")
        # Terms are read only where they are: the documents go to them as bits.
        terms = marked(self._segments("forward", pointer).where(some), self._small(doc_bits(gone), "leaving"))
        each = terms.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term"))
        self._write(each.agg(F.count("*").alias("n")), f"{self.path}/away/version={number}")
        left = gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()
        return {r.segment: (r.n, r.dl) for r in left}

    def _write_forward(self, rows: DataFrame, number: int) -> DataFrame:
        """Writes (key, dl, terms) of the documents of a segment with a number for each."""
        numbered = rows.select(F.monotonically_increasing_id().alias("doc"), self.key, "dl", "terms")
        return self._write(numbered, f"{self.path}/forward/segment={number}", self.key)

    def _write_postings(self, forward: DataFrame, number: int, average: float) -> None:
        self._write(posting_runs(forward, average, self.settings), f"{self.path}/postings/segment={number}", "term")

    def _commit(self, old: dict, number: int, content: dict) -> None:
        """Weighs the terms over all segments less what is gone, and makes the new state the current one."""
        counts = self._segments("postings", content).select("term", "n")
        if content["gone"]:
            counts = counts.unionByName(self._versions("away", content["gone"]).select("term", (-F.col("n")).alias("n")))
        df = counts.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0").sortWithinPartitions("term")
        terms = self._write(df, f"{self.path}/terms/version={number}", "term")
        mean = terms.agg(F.avg(self._raw_idf(content))).first()[0]
        floor = None if mean is None else self.settings.bm25_epsilon * mean
        write_pointer(self.spark, self.path, old["version"] + 1, {**content, "terms": number, "floor": floor, "layout": _LAYOUT})

    @staticmethod
    def _raw_idf(pointer: dict) -> Column:
        n_docs = F.lit(sum(s["n"] for s in pointer["segments"]))
        return F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    def remove(self, keys: DataFrame, source=None) -> None:
        """Forget the documents of some keys."""
        pointer = self._pointer()
        if pointer["segments"]:
            number = self._next(pointer)
            left = self._leave(pointer, keys.select(self.key).distinct(), number)
            segments = [
                {**s, "n": s["n"] - left.get(s["id"], (0, 0))[0], "dl": s["dl"] - left.get(s["id"], (0, 0))[1]}
                for s in pointer["segments"]
            ]
            self._commit(pointer, number, {
                "segments": segments, "gone": [*pointer["gone"], *([number] if left else [])], "source": source,
            })

    def compact(self) -> None:
        """One segment of all documents that are there, and nothing gone."""
        pointer = self._pointer()
        if not pointer["segments"]:
            return
        number = self._next(pointer)
        forward = self._write_forward(self._live_forward(pointer).select(self.key, "dl", "terms"), number)
        n, dl = (sum(s[k] for s in pointer["segments"]) for k in ("n", "dl"))
        average = dl / n if dl else 1.0
        self._write_postings(forward, number, average)
        self._commit(pointer, number, {
            "segments": [{"id": number, "n": n, "dl": dl, "average": average}], "gone": [], "source": pointer["source"],
        })

    def clean(self) -> None:
        """Deletes what the current pointer does not name."""
        pointer = self._pointer()
        kept = {t: {f"segment={s['id']}" for s in pointer["segments"]} for t in _SEGMENTS}
        kept |= {t: {f"version={v}" for v in pointer["gone"]} for t in ("gone", "away")} | {"terms": {f"version={pointer['terms']}"}}
        for table, names in kept.items():
            for name in folders(self.spark, f"{self.path}/{table}"):
                if name not in names:
                    delete_folder(self.spark, f"{self.path}/{table}/{name}")

    def index(self) -> KeywordIndex:
        """The index as it is now, for ``keyword_search``."""
        pointer = self._pointer()
        if not pointer["segments"]:
            raise ValueError(f"nothing is indexed at {self.path}")
        n, dl = (sum(s[k] for s in pointer["segments"]) for k in ("n", "dl"))
        average = dl / n if n else 0.0
        # By how much the weights of a segment can have grown since it was written.
        grown = F.lit(1.0)
        for s in pointer["segments"]:
            grown = F.when(F.col("segment") == s["id"], max(1.0, average / s["average"])).otherwise(grown)
        runs, forward = self._segments("postings", pointer), self._segments("forward", pointer)
        postings = run_postings(runs, "term", "level").join(forward.select(*DOC, self.key), [*DOC])
        blocks = runs.select("term", "level", "n", (F.col("top") * grown).alias("top"))
        idf = F.when(self._raw_idf(pointer) < 0, F.lit(pointer["floor"])).otherwise(self._raw_idf(pointer)).cast("double")
        terms = self._versions("terms", [pointer["terms"]]).select("term", "df", idf.alias("idf"))
        stats = self.spark.createDataFrame([(n, average)], "n_docs long, avg_dl double")
        return KeywordIndex(postings, terms, stats, self.key, blocks, forward, self._gone(pointer), runs)
