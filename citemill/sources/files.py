"""Reading and writing filings, raw texts, golden sets and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.config import SECTION_LABELS
from citemill.functions.hashing import path_safe
from citemill.schemas import FILING, FILING_JSON, GOLDEN
from citemill.session import fits, path_exists, stage

# Lists of tickers up to this length are broadcast.
MAX_TICKERS = 100_000
_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_SECTIONS = FILING["parsed_sections"].dataType


# Spark's writer names its files so; they hold a document on each line. All other
# JSON files hold one document, on as many lines as it likes.
_LINES = "part-*.json"
_DOCUMENTS = "{[^p]*,p[^a]*,pa[^r]*,par[^t]*,part[^-]*,p,pa,par,part}.json"


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Processed filings below ``path``: what :func:`write_filings` wrote and
    files of one JSON document each. A file that does not fit the schema fails
    the read."""
    return _read_lines(spark, path).unionByName(_read_json(spark, path, _DOCUMENTS, True))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, _LINES, False)


def _read_json(spark: SparkSession, path: str, names: str, multi_line: bool) -> DataFrame:
    raw = (
        spark.read.schema(FILING_JSON)
        .option("multiLine", multi_line).option("recursiveFileLookup", True)
        .option("pathGlobFilter", names).option("mode", "FAILFAST").json(path)
    )
    return raw.withColumn("parsed_sections", _ordered(F.col("parsed_sections")))


def _ordered(sections: Column) -> Column:
    """A map of sections as an array in filing order, unknown labels last."""
    place = lambda label: F.array_position(F.lit(list(SECTION_LABELS)), label)
    entries = F.transform(
        F.map_entries(sections),
        lambda e: F.struct(
            F.when(place(e.key) > 0, place(e.key) - 1).otherwise(len(SECTION_LABELS)).alias("ord"),
            e.key.alias("section"), e.value.alias("text"),
        ),
    )
    return F.array_sort(entries).cast(_SECTIONS)


def write_filings(filings: DataFrame, path: str) -> None:
    """Processed filings as JSON lines in a folder per ticker. A filing written
    before is replaced; other filings and tickers stay. Files of other writers
    are left alone, so keep those in another folder."""
    merged = _merged(filings, path, _read_lines)
    as_map = F.map_from_entries(
        F.transform("parsed_sections", lambda s: F.struct(s.section, s.text))
    )
    merged.withColumn("parsed_sections", as_map).withColumn("_ticker", F.col("ticker")).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy(
        "_ticker"
    ).json(path)


def _merged(new: DataFrame, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """New rows with the present rows of the same tickers that they do not replace."""
    spark, key = new.sparkSession, ["ticker", "accession_number"]
    if not path_exists(spark, path):
        return new
    staged = stage(new, "new-filings")
    # There are few tickers, so the present texts meet their list where they lie.
    tickers = staged.select("ticker").distinct()
    present = read(spark, path).join(F.broadcast(tickers) if fits(tickers, MAX_TICKERS) else tickers, "ticker", "left_semi")
    return staged.unionByName(present.join(staged.select(*key), key, "left_anti").select(*new.columns))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_raw(filings: DataFrame, path: str) -> None:
    """Raw filing texts as UTF-8 bytes with their checksum, in a folder per
    ticker. A filing already there is replaced; others stay."""
    rows = filings.select(
        "ticker", "accession_number", path_safe(F.col("accession_number")).alias("file_key"),
        F.encode("raw_text", "UTF-8").alias("content"),
    )
    _merged(rows, path, _read_content).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("ticker").parquet(path)


def _read_content(spark: SparkSession, path: str) -> DataFrame:
    schema = "accession_number string, file_key string, content binary, ticker string"
    return spark.read.schema(schema).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Cached raw filings with the checksum of their bytes as they are now."""
    return _read_content(spark, path).select(
        "ticker", "accession_number", F.sha2("content", 256).alias("file_sha256")
    )


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """The same for a tree of ``{ticker}/{accession}.txt`` files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt").load(path)
    )
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.txt$", i)
    return files.select(
        part(1).alias("ticker"), part(2).alias("file_key"), F.sha2("content", 256).alias("file_sha256")
    )


def checksum_mismatch(filings: DataFrame, cached: DataFrame) -> DataFrame:
    """Filings whose raw text is not cached or no longer has its checksum."""
    key = ["ticker", "accession_number", "file_sha256"]
    return filings.join(cached.select(*key), key, "left_anti")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions. A missing file raises ``FileNotFoundError``."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"golden set not found at {path}")
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


_LISTED = (
    "question_id", "question", "answer", "abstained", "error", "hit_5", "hit_10", "hit_20", "retrieved_5", "retrieved_10",
    "retrieved_20", "judge", "refuse", "refused", "source_ids",
)


class _TextNodes(HTMLParser):
    """Text nodes of a page: what a reader could see, in document order."""

    HIDDEN = ("script", "style", "template")
    AS_TYPED = ("pre", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self._open: list[str] = []
        self._hidden = self._typed = 0

    def _close_node(self) -> None:
        text, self._open = "".join(self._open), []
        if text and not text.strip(" \n\t\f\r") and not self._typed:
            text = "\n" if "\n" in text else " "
        if text and not self._hidden:
            self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self._close_node()
        self._hidden += tag in self.HIDDEN
        self._typed += tag in self.AS_TYPED

    def handle_startendtag(self, tag, attrs):
        self._close_node()

    def handle_endtag(self, tag):
        self._close_node()
        if tag in self.HIDDEN:
            self._hidden = max(self._hidden - 1, 0)
        if tag in self.AS_TYPED:
            self._typed = max(self._typed - 1, 0)

    def handle_data(self, data):
        self._open.append(data)

    def handle_comment(self, data):
        self._close_node()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def close(self):
        super().close()
        self._close_node()


@F.pandas_udf(_PARSED)
def parsed_html(pages: pd.Series) -> pd.DataFrame:
    """Text of HTML pages, one text node per line. A page the parser fails on
    has no text but an error, and does not stop the others."""

    def text(page: str | None) -> tuple[str | None, str | None]:
        parser = _TextNodes()
        try:
            parser.feed(page or "")
            parser.close()
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"
        return "\n".join(parser.nodes), None

    return pd.DataFrame([text(p) for p in pages], columns=["text", "error"])


def html_text(page: Column) -> Column:
    """The text of :func:`parsed_html`, null where the page could not be parsed."""
    return parsed_html(page)["text"]


def write_scorecard(scorecard: DataFrame, folder: str, stamp: str, scored: DataFrame | None = None) -> Path:
    """One-row scorecard as JSON and Markdown; ``latest.md`` is a copy. With
    ``scored``, the JSON also lists the scores of every question; a golden set
    is written by hand, so its list is short."""
    row = {"timestamp": stamp, **scorecard.first().asDict(recursive=True)}
    if scored is not None:
        listed = scored.select(*[c for c in _LISTED if c in scored.columns]).orderBy("question_id")
        row["per_question"] = [r.asDict(recursive=True) for r in listed.toLocalIterator()]
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / f"report_{stamp}.json").write_text(json.dumps(row, indent=2, default=str), encoding="utf-8")
    verdict = lambda ok: "PASS" if ok else "FAIL"
    lines = [
        f"# Evaluation {stamp}", "",
        f"Questions: {row['n_questions']}  Seed: {row['seed']}  Model: {row['model_version']}", "",
        *[f"- recall@{k}: {row[f'recall_{k}']}" for k in (5, 10, 20)],
        f"- groundedness: {row['groundedness']}",
        f"- relevance: {row['relevance']}",
        f"- abstention: {row['abstain_accuracy']} ({row['abstain_correct']}/{row['abstain_total']})",
        *([f"- latency: p50 {row['p50_ms']} ms, p95 {row['p95_ms']} ms"] if row.get("p95_ms") is not None else []),
        "", f"Acceptance: {verdict(row['phase1_pass'])}", "",
    ]
    report = "\n".join(lines)
    (out / f"report_{stamp}.md").write_text(report, encoding="utf-8")
    fresh = out / ".latest.md.new"
    fresh.write_text(report, encoding="utf-8")
    os.replace(fresh, out / "latest.md")
    return out / f"report_{stamp}.json"
