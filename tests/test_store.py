import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from citemill.config import Settings, from_tree, load_settings, lookup
from citemill.operators import checks, ingest
from citemill.operators.evaluation import exact_overlap
from citemill.plans.index import build_index, verify_index
from citemill.schemas import FILING
from citemill.sources import files
from citemill.sources.store import ChunkStore, snapshot_hash

SETTINGS = replace(Settings(), store_buckets=4)


def filings(spark, *names, words=900):
    rows = [
        (
            n, n.upper(), "1", "10-K", 2024, "2024-12-31", "2025-02-01", f"{n}/1", None, "https://sec.gov/x", "0" * 64, "now",
            [(0, "Item 1", f"{n} " * words), (1, "Item 1A", f"{n} risk. " * 200), (2, "Item 7", f"{n} " * 300)],
        )
        for n in names
    ]
    return spark.createDataFrame(rows, FILING)


def test_index_round(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), SETTINGS)
    assert store.scan().count() == 0 and snapshot_hash(store.scan()).first()[0] == "no-index"
    build_index(filings(spark, "aa", "bb"), store, SETTINGS)
    first = store.count()
    assert first == 8
    report = verify_index(filings(spark, "aa", "bb"), store, SETTINGS)
    assert report.passed and report.stored == first and len(report.sample) == 3
    # Another filing, and fewer chunks for a known one: nothing old is left.
    build_index(filings(spark, "aa", "cc", words=10), store, SETTINGS)
    held = {r.accession_number: r.n for r in store.scan().groupBy("accession_number").agg(F.count("*").alias("n")).collect()}
    assert held == {"aa/1": 3, "bb/1": 4, "cc/1": 3}
    # By id only, the same write would have kept the stale chunk.
    build_index(filings(spark, "bb", words=10), store, SETTINGS, replace=False)
    assert store.scan().where("accession_number = 'bb/1'").count() == 5
    assert not verify_index(filings(spark, "aa", "bb", "cc", words=10), store, SETTINGS).passed
    some = [r.chunk_id for r in store.ids().limit(2).collect()]
    assert {r.chunk_id for r in store.get(some).collect()} == set(some)


def test_duplicate_ids_are_refused(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), SETTINGS)
    twice = filings(spark, "aa").unionByName(filings(spark, "aa"))
    with pytest.raises(ValueError, match="more than once"):
        build_index(twice, store, SETTINGS)


def test_filing_files(spark, tmp_path):
    path = str(tmp_path / "processed")
    files.write_filings(filings(spark, "aa", "bb"), path)
    back = files.read_filings(spark, path)
    assert back.schema == FILING or [f.name for f in back.schema] == [f.name for f in FILING]
    assert sorted(r.ticker for r in back.collect()) == ["AA", "BB"]
    assert [s.section for s in back.first().parsed_sections] == ["Item 1", "Item 1A", "Item 7"]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.json").write_text('{"fiscal_year": "soon"}')
    with pytest.raises(Exception):
        files.read_filings(spark, str(bad)).collect()


def test_raw_cache(spark, tmp_path):
    raw = spark.createDataFrame([("A", "a/1", "été"), ("B", "b/1", "x")], "ticker string, accession_number string, raw_text string")
    path = str(tmp_path / "raw")
    files.write_raw(raw, path)
    cached = files.read_raw(spark, path)
    import hashlib

    sha = {r.ticker: r.file_sha256 for r in cached.collect()}
    assert sha["A"] == hashlib.sha256("été".encode()).hexdigest()
    known = spark.createDataFrame([("A", "a/1", sha["A"]), ("B", "b/1", "0" * 64), ("C", "c/1", "1")],
                                  "ticker string, accession_number string, file_sha256 string")
    assert {r.ticker for r in files.checksum_mismatch(known, cached).collect()} == {"B", "C"}
    planned = known.drop("file_sha256")
    assert {r.ticker for r in ingest.to_fetch(planned, known, cached).collect()} == {"B", "C"}
    tree = tmp_path / "tree" / "A"
    tree.mkdir(parents=True)
    (tree / "a_1.txt").write_bytes("été".encode())
    assert files.read_raw_files(spark, str(tmp_path / "tree")).first().asDict() == {
        "ticker": "A", "file_key": "a_1", "file_sha256": sha["A"],
    }


def test_golden_and_lines(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_golden(spark, str(tmp_path / "none.json"))
    golden = tmp_path / "g.json"
    golden.write_text(json.dumps([{"id": "g1", "question": "q?", "expected_sources": [{"company": "P", "year": 2024, "section": "s"}]}]))
    row = files.read_golden(spark, str(golden)).first()
    assert row.expected_sources[0].year == 2024 and row.should_abstain is None
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"question": "a"}\n\n{"question": "b"}\n')
    test = files.read_json_lines(spark, str(lines), "question string")
    assert test.count() == 2 and exact_overlap(test, test.limit(1)).count() == 1


def test_scorecard_files(spark, tmp_path):
    card = spark.createDataFrame(
        [("m", 42, 2, 0.5, 0.5, 0.5, 0.9, 0.8, 1, 2, 0.5, False)],
        "model_version string, seed int, n_questions int, recall_5 double, recall_10 double, recall_20 double, groundedness double, "
        "relevance double, abstain_correct int, abstain_total int, abstain_accuracy double, phase1_pass boolean",
    )
    for stamp in ("1", "2"):
        path = files.write_scorecard(card, str(tmp_path), stamp)
        assert json.loads(path.read_text())["recall_10"] == 0.5
    assert "Evaluation 2" in (tmp_path / "latest.md").read_text()


def test_choose_filings(spark):
    rows = [
        ("A", "10-K", "2024-12-31", "2025-02-01", "a1"), ("A", "10-K", "2023-12-31", "2024-02-01", "a0"),
        ("A", "10-K/A", "2024-12-31", "2025-03-01", "a2"), ("B", "10-K", "2024-12-31", "2025-02-01", "b1"),
        ("B", "10-K/A", "2023-12-31", "2025-03-01", "b0"),
    ]
    df = spark.createDataFrame(rows, "ticker string, form_type string, fiscal_year_end_date string, filing_date string, accession_number string")
    pick = lambda s: {r.accession_number for r in ingest.choose_filings(df, s).collect()}
    assert pick(SETTINGS) == {"a2", "b1"}
    assert pick(replace(SETTINGS, prefer_amended=False)) == {"a1", "b1"}
    assert ingest.check_plan(SETTINGS) == 12
    with pytest.raises(ValueError):
        ingest.check_plan(replace(SETTINGS, num_fiscal_years=3))


def test_describe_filings(spark):
    rows = [("A", "10-Q", "", "acc-2", "FY24", None, "", "h", "u", "text", 7)]
    df = spark.createDataFrame(
        rows, "ticker string, form string, accession_number string, accession_no string, period_of_report string, filing_date string, "
        "filing_url string, homepage_url string, url string, raw_text string, cik int",
    ).withColumns({"company": F.lit(None).cast("string"), "parsed_sections": F.lit(None).cast(FILING["parsed_sections"].dataType)})
    row = ingest.describe_filings(df, 2026).first()
    assert (row.company_name, row.form_type, row.accession_number, row.source_url, row.cik) == ("A", "10-K", "acc-2", "h", "7")
    assert row.fiscal_year == 2026 and row.fiscal_year_end_date == "FY24" and len(row.file_sha256) == 64
    assert ingest.describe_filings(df).first().fiscal_year is None


def test_checks_pass_on_sound_filings(spark):
    sound = filings(spark, "aa").withColumn("ticker", F.lit("PFE")).withColumn("company_name", F.lit("Pfizer Inc"))
    assert checks.check_filing_metadata(sound).count() == 0
    assert checks.check_sections(sound).count() == 0
    assert checks.check_urls(sound, ["ticker"]).count() == 0
    cached = sound.select("ticker", "accession_number", "file_sha256")
    assert checks.check_ingest(sound, sound, cached).count() == 0
    missing = spark.createDataFrame([("ZZZ",)], "ticker string")
    assert checks.check_ingest(sound, missing, cached).first().problem == "no processed filing"


def test_settings(tmp_path):
    tree = {"chunking": {"chunk_size_tokens": 100}, "corpus": {"tickers": ["A"]}}
    s = from_tree(tree, {"EMBED_DEVICE": "cpu", "GENERATOR_BACKEND_OVERRIDE": "ollama", "OFFLINE_MODE": "1"})
    assert (s.chunk_size_tokens, s.tickers, s.device, s.backend, s.offline) == (100, ("A",), "cpu", "ollama", True)
    assert lookup(tree, "chunking.chunk_size_tokens") == 100 and lookup(tree, "a.b", 3) == 3
    assert Settings().safe_max_tokens == 840 and Settings().split_stride == 680
    assert Settings().chunk_size_tokens < Settings().max_seq_length
    assert Settings().query_instruction != Settings().document_instruction
    path = tmp_path / "c.yaml"
    path.write_text("retrieval:\n  rrf_k: 5\n")
    assert load_settings(str(path), {}).rrf_k == 5 and load_settings(None, {}) == Settings()


RAW = (
    "ticker string, company string, cik string, form string, accession_number string, accession_no string, period_of_report string, "
    "filing_date string, filing_url string, homepage_url string, url string, raw_text string, html string, items map<string,string>"
)


def raw_filing(ticker, acc, items, html="", form="10-K", filed="2025-02-01", text="raw"):
    return (ticker, ticker + " Inc", "1", form, acc, "", "2024-12-31", filed, "https://sec.gov/" + acc, "", "", text, html, items)


def test_ingest_run(spark, tmp_path):
    from citemill.plans.ingest import ingest

    full = {"Item 1": "business " * 100, "Item 1A": "risk " * 150, "Item 7": "results " * 100}
    page = "<p>Item 1. Business " + "b " * 300 + "<p>Item 1A. Risk Factors " + "r " * 300 + "<p>Item 7. Management " + "m " * 300
    rows = [
        raw_filing("PFE", "p/1", full), raw_filing("PFE", "p/0", full, filed="2024-02-01"),
        raw_filing("MRK", "m/1", None, page), raw_filing("JNJ", "j/1", {**full, "Item 7": "short " * 20}),
        raw_filing("LLY", "l/1", full), raw_filing("LLY", "l/2", full, form="10-K/A", filed="2025-03-01"),
        raw_filing("XXX", "x/1", full),
    ]
    paths = str(tmp_path / "processed"), str(tmp_path / "raw")
    run = lambda r: {(x.ticker, x.accession_number): x for x in ingest(spark.createDataFrame(r, RAW), *paths, SETTINGS, 2026).collect()}
    first = run(rows)
    assert {k: r.status for k, r in first.items()} == {
        ("PFE", "p/1"): "ok", ("MRK", "m/1"): "ok", ("JNJ", "j/1"): "failed", ("LLY", "l/2"): "ok",
    }
    assert first["JNJ", "j/1"].truncated == ["Item 7"]
    held = {r.accession_number: r for r in files.read_filings(spark, paths[0]).collect()}
    assert set(held) == {"p/1", "m/1", "l/2"} and held["m/1"].fiscal_year == 2024 and held["l/2"].form_type == "10-K/A"
    assert files.checksum_mismatch(files.read_filings(spark, paths[0]), files.read_raw(spark, paths[1])).count() == 0
    # Again: what is there and intact is skipped; a newer filing joins the older.
    second = run(rows + [raw_filing("PFE", "p/2", full, filed="2025-04-01")])
    assert set(second) == {("JNJ", "j/1"), ("PFE", "p/2")}
    assert {r.accession_number for r in files.read_filings(spark, paths[0]).collect()} == {"p/1", "p/2", "m/1", "l/2"}


def test_command_line(spark, tmp_path, capsys):
    from citemill.cli import answer_text, environment_problems, main

    files.write_filings(filings(spark, "aa"), str(tmp_path / "f"))
    base = ["--store", str(tmp_path / "s")]
    assert main(base + ["index", str(tmp_path / "f"), "--verify"]) == 0
    assert main(base + ["ask", "aa risk there?", "--company", "aa"]) == 0
    out = capsys.readouterr().out
    assert "4 chunks stored" in out and "Sources:" in out and "aa 2024 10-K" in out
    assert "pyspark" not in environment_problems()
    failed = {"answer": "x", "error": "boom", "abstained": False, "citations": [], "truncated": True, "total_ms": 1, "model_version": "m"}
    assert "[error: boom]" in answer_text(failed) and "cut off" in answer_text(failed)


def test_json_logs(capsys):
    from citemill.logs import get_logger, setup_logging

    setup_logging()
    get_logger("t").info("stored", extra={"count": 3})
    entry = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert entry["event"] == "stored" and entry["count"] == 3 and entry["level"] == "info"


def test_filings_of_other_writers(spark, tmp_path):
    """A document over several lines beside lines of documents, whatever its name begins with."""
    import json

    path = tmp_path / "f"
    files.write_filings(filings(spark, "aa"), str(path))
    row = {"ticker": "zz", "accession_number": "", "parsed_sections": {"Item 1": "text"}}
    for name in ("0001", "p", "par", "partly", "part"):
        (path / f"{name}.json").write_text(json.dumps(row | {"accession_number": name}, indent=2))
    back = [r.accession_number for r in files.read_filings(spark, str(path)).where("ticker = 'zz'").collect()]
    assert sorted(back) == ["0001", "p", "par", "part", "partly"]
    files.write_filings(filings(spark, "aa"), str(path))
    assert files.read_filings(spark, str(path)).count() == 5 + filings(spark, "aa").count()


def test_every_nth_with_other_columns(spark):
    from citemill.operators.checks import every_nth

    df = spark.range(1000).repartition(7).selectExpr("id", "id % 3 AS a", "cast(id AS string) AS b")
    got = sorted(tuple(r) for r in every_nth(df, 20, "id").collect())
    assert got == [(i, i % 3, str(i)) for i in range(0, 1000, 20)]


def test_changed_texts_are_found(spark):
    from citemill.operators.checks import check_store

    stored = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    produced = spark.createDataFrame([("a", "x"), ("b", "other"), ("d", "z"), ("d", "z")], "chunk_id string, text string")
    assert sorted(tuple(r) for r in check_store(stored, produced).collect()) == [
        ("b", "changed"), ("c", "stale"), ("d", "lost"), ("d", "repeated")]


def test_staging_needs_a_shared_folder():
    """Executors in other processes cannot read the driver's temporary folder."""
    from types import SimpleNamespace

    from citemill.session import checkpoint_folder

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        held = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError):
            checkpoint_folder(held)


def test_headings_with_odd_spaces(spark):
    from citemill.operators.sections import headed_sections

    text = "Item\u00a01.\u00a0Business body Item 1A.\u2009Risk\u00a0Factors risks"
    found = spark.createDataFrame([(text,)], "t string").select(headed_sections(F.col("t")).alias("s")).first().s
    assert [s.section for s in found] == ["Item 1", "Item 1A"]


def test_rerank_fails_for_one_question_only(spark):
    import time

    from citemill.operators.rerank import model_scorer, rerank

    def load():
        def predict(pairs):
            if pairs[0][0] == "late":
                time.sleep(3)
            return [float(len(t)) for _, t in pairs]

        return predict

    rows = [(i, q, f"{i}{j}", "x" * (j + 1), j + 1) for i, q in enumerate(("late", "one", "two")) for j in range(4)]
    df = spark.createDataFrame(rows, "question_id int, question string, chunk_id string, text string, rank int").coalesce(1)
    got = rerank(df, replace(SETTINGS, rerank_score_threshold=2.0), model_scorer(load, 1.0)).collect()
    assert sorted(r.rerank_score for r in got if r.question_id == 1) == [2.0, 3.0, 4.0]
    assert sorted(r.rerank_score for r in got if r.question_id == 2) == [2.0, 3.0, 4.0]
    assert [r.rerank_score for r in got if r.question_id == 0] == [None] * 4


def test_a_failed_write_leaves_rows_and_hash(spark, tmp_path, monkeypatch):
    import citemill.sources.store as module
    from citemill.sources.pointer import folders

    held = ChunkStore(spark, str(tmp_path / "s"), replace(SETTINGS, store_buckets=16))
    build_index(filings(spark, "aa", "bb"), held, SETTINGS)
    rows, kept = {str(r) for r in held.scan().collect()}, held.snapshot()
    for broken in ("write_pointer", "_digests"):
        monkeypatch.setattr(module, broken, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            build_index(filings(spark, "aa", "cc"), held, SETTINGS)
        monkeypatch.undo()
        assert {str(r) for r in held.scan().collect()} == rows and held.snapshot() == kept and held.version() == 1
    build_index(filings(spark, "cc"), held, SETTINGS)
    assert held.versions() == [1, 2] and {str(r) for r in held.scan(1).collect()} == rows and held.snapshot(1) == kept
    assert held.snapshot() == snapshot_hash(held.scan()).first()[0] != kept and held.count() == held.scan().count() > len(rows)
    # Buckets that the write did not touch are where they were; the folders of failed writes go.
    parts = held._pointer()["parts"]
    assert 1 in parts.values() and len(set(parts.values())) == 2
    before = held.snapshot()
    held.clean()
    assert held.scan().count() == held.count() and held.snapshot() == before
    assert {int(n.partition("=")[2]) for n in folders(spark, held.path)} == set(parts.values())


def test_env_file(tmp_path):
    from citemill.config import load_env

    path = tmp_path / ".env"
    path.write_text("# keys\nA=1\nexport B = 'two # 2' # note\nC=three # note\nD=\n\nbad line\n1X=no\nE=\"x=y\"\nF=#none\n")
    env = {"A": "kept"}
    assert load_env(str(path), env) == ["B", "C", "D", "E", "F"]
    assert env == {"A": "kept", "B": "two # 2", "C": "three", "D": "", "E": "x=y", "F": ""}
    assert from_tree({}, {**env, "EMBED_DEVICE": "cuda"}).device == "cuda"
    assert load_env(str(tmp_path / "none"), env) == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    from citemill.sources.pointer import read_pointer, write_pointer

    path = str(tmp_path / "p")
    assert read_pointer(spark, path) is None
    write_pointer(spark, path, 1, {"a": 1})
    with pytest.raises(RuntimeError):
        write_pointer(spark, path, 1, {"a": 2})
    write_pointer(spark, path, 2, {"a": 3})
    assert read_pointer(spark, path) == {"a": 3, "version": 2} and read_pointer(spark, path, 1)["a"] == 1


def test_keyword_index_follows_the_store(spark, tmp_path):
    from citemill.plans.index import index_keywords
    from citemill.sources.keyword_store import KeywordStore

    held = ChunkStore(spark, str(tmp_path / "s"), replace(SETTINGS, store_buckets=4))
    keywords = KeywordStore(spark, str(tmp_path / "k"), SETTINGS)
    ids = lambda df: {r.chunk_id for r in df.select("chunk_id").collect()}
    build_index(filings(spark, "aa", "bb"), held, SETTINGS, keywords=keywords)
    build_index(filings(spark, "bb"), held, SETTINGS, keywords=keywords)
    assert ids(keywords.keys()) == ids(held.scan()) and keywords.source == held.version() == 2
    build_index(filings(spark, "cc"), held, SETTINGS)
    assert keywords.source != held.version()
    index_keywords(held, keywords)
    assert ids(keywords.keys()) == ids(held.scan()) and keywords.source == held.version()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_are_pruned(spark, tmp_path):
    """Ids and terms reach the scans, and a filtered hybrid search scores the corpus once."""
    from citemill.operators.keyword import KeywordIndex, keyword_search
    from citemill.operators.retrieval import retrieve
    from citemill.plans.ask import embedder_for, with_payload

    held = ChunkStore(spark, str(tmp_path / "s"), SETTINGS)
    rows = filings(spark, "aa", "bb")
    build_index(rows, held, SETTINGS)
    ids = [r.chunk_id for r in held.ids().limit(2).collect()]
    assert "PushedFilters: [In(chunk_id" in _plan(held.get(ids))
    asked = spark.createDataFrame([(1, "alpha beta")], "question_id int, question string")
    found = spark.createDataFrame([(1, ids[0], 1, 0.5)], "question_id int, chunk_id string, rank int, score double")
    assert ids[0] in _plan(with_payload(found, held.scan(), asked, SETTINGS)).split("PushedFilters")[1][:200]
    index = KeywordIndex.write(held.scan(), str(tmp_path / "k"), SETTINGS)
    assert "PushedFilters: [In(term, [alpha,beta])" in _plan(keyword_search(index, asked, SETTINGS)).replace("beta,alpha", "alpha,beta")
    hybrid = replace(SETTINGS, hybrid_enabled=True)
    got = retrieve(held.scan(), asked, hybrid, embedder_for(hybrid), {"ticker": "AA"}, index)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert held.snapshot() == snapshot_hash(held.scan()).first()[0]


def test_models_from_settings(spark):
    import sys
    import types

    from citemill.config import from_tree
    from citemill.operators.evaluation import judge_for, lexical_judge
    from citemill.plans.ask import embedder_for, scorer_for

    module = types.ModuleType("own_models")
    module.embed = lambda device: lambda texts: [[float(len(t)), 1.0] for t in texts]
    sys.modules["own_models"] = module
    settings = from_tree({
        "embeddings": {"loader": "own_models:embed", "dim": 2, "normalize": False, "query_instruction": ""},
        "serving": {"ollama_model_name": "small"}, "chunking": {"sentence_splitter": "pysbd"},
    }, {})
    assert settings.local_model == "small" and type(embedder_for(settings)).__name__ == "ModelEmbedder"
    assert scorer_for(settings).__name__ == "lexical_scorer" and judge_for(settings) is lexical_judge
    with pytest.raises(ValueError):
        from_tree({"chunking": {"sentence_splitter": "other"}}, {})
    with pytest.raises(ValueError):
        judge_for(from_tree({"eval": {"judge_backend": "openai"}}, {}))
