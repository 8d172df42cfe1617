"""Command line: check the environment, build an index, ask, evaluate."""

from __future__ import annotations

import argparse
import importlib.util
import os
import shutil
import sys
import time
from dataclasses import replace
from datetime import datetime, timezone

from citemill.config import load_env, load_settings
from citemill.functions.filters import request_filter
from citemill.logs import get_logger, setup_logging

log = get_logger(__name__)


def environment_problems(folder: str = ".", min_disk_gb: int = 50) -> dict[str, str]:
    """What is missing here, by name. Network access is left to the backends."""
    found = {}
    if sys.version_info < (3, 11):
        found["python"] = "3.11 or newer is needed"
    free = shutil.disk_usage(folder).free / 1e9
    if free < min_disk_gb:
        found["disk"] = f"{free:.1f} GB free"
    for key in ("ANTHROPIC_API_KEY", "OPENAI_API_KEY"):
        if not os.environ.get(key):
            found[key] = "not set; needed for that backend only"
    for package in ("pyspark", "pyarrow", "numpy", "pandas", "yaml"):
        if importlib.util.find_spec(package) is None:
            found[package] = "not installed"
    return found


def answer_text(response: dict) -> str:
    """A response for the terminal."""
    lines = [response["answer"]]
    if response["error"]:
        lines.append(f"[error: {response['error']}]")
    elif response["abstained"]:
        lines.append("[abstained: no grounded answer in the corpus]")
    else:
        lines.append("Sources:")
        lines += [
            f"  [{c['n']}] {c['company']} {c['fiscal_year']} 10-K, {c['section']}, chunk {c['chunk_id']}"
            for c in response["citations"]
        ]
    if response["truncated"]:
        lines.append("[the answer was cut off at the token limit]")
    lines.append(f"{response['total_ms']} ms, {response['model_version']}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citemill")
    parser.add_argument("--config")
    parser.add_argument("--store", default="store")
    parser.add_argument("--shared", help="folder that the driver and all executors share, for staged tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("check")
    ingest_args = commands.add_parser("ingest")
    ingest_args.add_argument("raw", help="parquet table of raw filings")
    ingest_args.add_argument("--processed", default="processed")
    ingest_args.add_argument("--cache", default="raw")
    ingest_args.add_argument("--verify", action="store_true")
    ingest_args.add_argument("--as-of", type=int, help="fiscal year where a period names none")
    index = commands.add_parser("index")
    index.add_argument("filings")
    index.add_argument("--verify", action="store_true")
    ask_args = commands.add_parser("ask")
    ask_args.add_argument("question")
    ask_args.add_argument("--company")
    ask_args.add_argument("--year", type=int)
    ask_args.add_argument("--local", action="store_true")
    evaluate_args = commands.add_parser("evaluate")
    evaluate_args.add_argument("golden", nargs="?", help="default: eval.golden_set_path of the settings")
    evaluate_args.add_argument("--reports", default="reports")
    args = parser.parse_args(argv)
    setup_logging()
    load_env()
    if args.command == "check":
        problems = environment_problems()
        print("\n".join(f"{name}: {detail}" for name, detail in problems.items()) or "ready")
        return 1 if problems else 0

    from pyspark.sql import functions as F

    from citemill.plans.ask import ask
    from citemill.plans.evaluate import evaluate
    from citemill.operators.ingest import ingest_counts
    from citemill.plans.ingest import ingest
    from citemill.plans.index import build_index, verify_index
    from citemill.session import build_session
    from citemill.operators.checks import check_ingest
    from citemill.operators.evaluation import judge_for
    from citemill.sources.files import read_filings, read_golden, read_raw, write_scorecard
    from citemill.sources.keyword_store import KeywordStore
    from citemill.sources.store import ChunkStore

    settings = load_settings(args.config)
    spark = build_session(**{"spark.checkpoint.dir": args.shared} if args.shared else {})
    store = ChunkStore(spark, args.store, settings)
    keywords = KeywordStore(spark, f"{args.store.rstrip('/')}-keywords", settings)

    def index_for_search():
        """The written keyword index where it is one of the present store."""
        if not settings.hybrid_enabled:
            return None
        if keywords.source == store.version():
            return keywords.index()
        log.warning("the keyword index is not of this version of the store; run index again", extra={"store": args.store})
        return None

    if args.command == "ingest":
        raw = spark.read.parquet(args.raw)
        results = ingest(raw, args.processed, args.cache, settings, args.as_of)
        counts = ingest_counts(results).first()
        print(f"{counts['ok']} ok, {counts['failed']} failed")
        if args.verify:
            expected = spark.createDataFrame([(t,) for t in settings.tickers], "ticker string")
            bad = check_ingest(read_filings(spark, args.processed), expected, read_raw(spark, args.cache)).collect()
            print("\n".join(str(r.asDict()) for r in bad) or "verified")
            return 1 if bad else 0
    elif args.command == "index":
        filings = read_filings(spark, args.filings)
        build_index(filings, store, settings, keywords=keywords)
        print(f"{store.count()} chunks stored")
        if args.verify:
            report = verify_index(filings, store, settings)
            print(report)
            return 0 if report.passed else 1
    elif args.command == "ask":
        if args.local:
            settings = replace(settings, backend="ollama", model=settings.local_model or settings.model)
        where = request_filter(args.company, args.year)
        print(answer_text(ask(store.scan(), args.question, settings, where, store.snapshot(), index=index_for_search())))
    else:
        golden = read_golden(spark, args.golden or settings.golden_set_path).withColumn("question_id", F.col("id"))
        scored, card = evaluate(
            store.scan(), golden, settings, judge_for(settings), snapshot=store.snapshot(), index=index_for_search(),
            clock=time.monotonic,
        )
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        print(write_scorecard(card.cache(), args.reports, stamp, scored))
    return 0


if __name__ == "__main__":
    sys.exit(main())
