import json
from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from citemill.config import ABSTENTION, GENERATION_ERROR_ANSWER, Settings
from citemill.functions.citations import is_abstention, marker_ranges, numbers_within, ranges_beyond
from citemill.operators.citing import conclude
from citemill.operators.generation import (
    OfflineError, chat_answer, chat_generator, choose_generator, extractive_generator, with_retry,
)
from citemill.operators.prompting import SYSTEM_PROMPT, prompt
from citemill.plans.ask import BAD_QUESTION, ask, ask_many, embedder_for

SETTINGS = Settings()
SOURCE = "array<struct<rank:int,text:string,company:string,fiscal_year:int,section:string,chunk_id:string,source_url:string>>"
GENERATION = "struct<text:string,truncated:boolean,input_tokens:bigint,output_tokens:bigint,cost_usd:double,error:string>"


@pytest.mark.parametrize("answer, numbers", [
    ("a [1][2] b [3]", [1, 2, 3]), ("a [1, 2] b [3,4]", [1, 2, 3, 4]), ("see [1-3] and [5]", [1, 2, 3, 5]),
    ("x [12] y [1]", [12, 1]), ("[3-1]", []), ("[1-2-3]", []), ("[0]", [0]), ("[2 - 3 , 2]", [2, 3]),
    ("[3][1-3]", [3, 1, 2]), ("none [a] [1.5] []", []), ("[99999999999999999999]", []), ("[007]", [7]),
    ("[1-99999999999999999999999999999999999999999]", list(range(1, 21))),
])
def test_markers(spark, answer, numbers):
    df = spark.createDataFrame([(answer,)], "a string")
    found = df.select(numbers_within(marker_ranges(F.col("a")), F.lit(20)).alias("n")).first().n
    assert found == [n for n in numbers if n >= 1]


@pytest.mark.parametrize("answer, beyond", [
    ("[0]", [(0, 0)]), ("[0-7]", [(0, 0), (6, 7)]), ("[2-200000]", [(6, 200000)]), ("[6][7-9][6]", [(6, 6), (7, 9)]), ("[5]", []),
    ("[9223372036854775800-9223372036854775807]", [(9223372036854775800, 9223372036854775807)]),
    ("[12345678901234567890]", [(12345678901234567890, 12345678901234567890)]), ("[" + "8" * 50 + "]", [(10**38 - 1, 10**38 - 1)]),
])
def test_stray_markers(spark, answer, beyond):
    df = spark.createDataFrame([(answer,)], "a string")
    found = df.select(ranges_beyond(marker_ranges(F.col("a")), F.lit(5)).alias("r")).first().r
    assert [(int(r["first"]), int(r["last"])) for r in found] == beyond


@pytest.mark.parametrize("answer, abstains", [
    (ABSTENTION, True), (ABSTENTION + " The filings say nothing.", True), (f'> "{ABSTENTION}"', True),
    (f"\n“{ABSTENTION}”", True), (ABSTENTION.upper(), True), ("Sales rose [1].", False), ("", False),
    ("Note: " + ABSTENTION, False),
])
def test_abstention(spark, answer, abstains):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(is_abstention(F.col("a")).alias("x")).first().x is abstains


def outcome(spark, text, n=5, error=None, truncated=False):
    sources = [(i, f"chunk {i} text", "Co", 2024, "Item 1", f"id{i}", "u") for i in range(1, n + 1)]
    row = [(sources, (text, truncated, 1, 1, 0.0, error))]
    return conclude(spark.createDataFrame(row, f"sources {SOURCE}, generation {GENERATION}")).first()


def test_conclude(spark):
    r = outcome(spark, "claim [1, 2] and [3]")
    assert [c.n for c in r.citations] == [1, 2, 3] and r.out_of_range == [] and not r.abstained
    r = outcome(spark, "grounded [2] but hallucinated [10]", truncated=True)
    assert [c.chunk_id for c in r.citations] == ["id2"] and [(r["first"], r["last"]) for r in r.out_of_range] == [(10, 10)] and r.truncated
    assert outcome(spark, "see [3]").citations[0].chunk_id == "id3"
    r = outcome(spark, "no markers at all")
    assert r.abstained and r.ungrounded and r.answer == ABSTENTION and r.citations == []
    r = outcome(spark, ABSTENTION + " See [1].")
    assert r.abstained and not r.ungrounded and r.citations == [] and r.answer.endswith("[1].")
    r = outcome(spark, ABSTENTION, error="RateLimitError: " + "x" * 400)
    assert not r.abstained and r.answer == GENERATION_ERROR_ANSWER and len(r.error) == 416


def test_prompt(spark):
    rows = [("Why?", [(1, "One", "Acme", 2024, "Item 1", "id1", "u"), (2, "Two", None, None, None, "id2", None)])]
    df = spark.createDataFrame(rows, f"q string, s {SOURCE}")
    assert df.select(prompt(F.col("q"), F.col("s")).alias("p")).first().p == (
        "QUESTION:\nWhy?\n\nCONTEXT:\n[1] One\n    (Source: Acme 2024 10-K, Item 1, chunk id1)\n\n"
        "[2] Two\n    (Source: Unknown  10-K, , chunk id2)\n\nANSWER:"
    )


class RateLimitError(Exception):
    pass


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimitError("busy")
        return {"text": "ok"}

    assert with_retry(flaky, waits.append) == {"text": "ok"} and waits == [1.0, 2.0]

    def always():
        calls.append(1)
        raise RateLimitError("busy")

    calls.clear(), waits.clear()
    failed = with_retry(always, waits.append)
    assert failed["error"] == "RateLimitError: busy" and failed["text"] == ABSTENTION
    assert len(calls) == 4 and waits == [1.0, 2.0, 4.0]

    def wrong():
        calls.append(1)
        raise KeyError("x")

    calls.clear()
    assert with_retry(wrong, waits.append)["error"].startswith("KeyError") and len(calls) == 1


def test_backends():
    sent = []

    def service(reply):
        def post(url, headers, body):
            sent.append(body)
            return reply
        return post

    a = replace(SETTINGS, backend="anthropic", model="claude-sonnet-4-6")
    reply = {"content": [{"type": "text", "text": " hi [1] "}], "stop_reason": "max_tokens",
             "usage": {"input_tokens": 1_000_000, "output_tokens": 100_000}}
    got = chat_answer("p", a, service(reply))
    assert got["text"] == "hi [1]" and got["truncated"] and got["cost_usd"] == pytest.approx(4.5)
    assert "top_p" not in sent[-1] and sent[-1]["system"] == SYSTEM_PROMPT and sent[-1]["stop_sequences"] == ["\n\nQUESTION:"]
    o = replace(SETTINGS, backend="openai", model="gpt-4o")
    reply = {"choices": [{"message": {"content": None}, "finish_reason": "stop"}],
             "usage": {"prompt_tokens": 1, "completion_tokens": 0}}
    got = chat_answer("p", o, service(reply))
    assert got["error"] == "empty_response" and got["text"] == ABSTENTION and sent[-1]["top_p"] == 0.95
    local = replace(SETTINGS, backend="ollama", model="m")
    got = chat_answer("p", local, service({"message": {"content": "x"}, "done_reason": "length"}))
    assert got["truncated"] and got["cost_usd"] == 0.0 and sent[-1]["stream"] is False


def test_choose_generator():
    assert choose_generator(SETTINGS) is extractive_generator
    with pytest.raises(ValueError):
        choose_generator(replace(SETTINGS, backend="other"))
    with pytest.raises(OfflineError):
        choose_generator(replace(SETTINGS, backend="openai", offline=True))
    assert SETTINGS.model_version == "extractive/lexical"


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        ("a", "Pricing risk is high. Sales rose.", "Acme", 2024, "Item 1A", "u1", "ACM"),
        ("b", "Factories burn. Supply chain risk grows.", "Beta", 2023, "Item 1", "u2", "BET"),
    ]
    df = spark.createDataFrame(
        rows, "chunk_id string, text string, company string, fiscal_year int, section string, source_url string, ticker string"
    )
    return df.withColumn("embedding", embedder_for(SETTINGS).documents(F.col("text"))).cache()


def test_proximity_scorer(spark):
    from citemill.operators.rerank import proximity_scorer
    from citemill.plans.ask import scorer_for

    far = "alpha " + "filler " * 20 + "beta"
    rows = [
        ("alpha beta", "alpha beta"), ("alpha beta", "beta one two alpha"), ("alpha beta", far), ("alpha beta", "gamma"), ("alpha", "alpha"),
        ("the", "alpha"), ("alpha beta gamma", "alpha beta one gamma"), (None, "x"), ("alpha", None),
    ]
    df = spark.createDataFrame(rows, "q string, t string")
    got = [round(r.s, 6) for r in df.select(proximity_scorer(F.col("q"), F.col("t")).alias("s")).collect()]
    scaled = lambda u, o, w: round((0.85 * u + 0.10 * o + 0.05 * w) * 8 - 4, 6)
    assert got == [
        scaled(1, 1, 1), scaled(1, 0, 1), scaled(1, 0, 0), scaled(0, 0, 0), scaled(1, 0, 0), scaled(0, 0, 0), scaled(1, 0.5, 1),
        scaled(0, 0, 0), scaled(0, 0, 0),
    ]
    assert scorer_for(replace(SETTINGS, rerank_scorer="proximity")) is proximity_scorer
    with pytest.raises(ValueError):
        scorer_for(replace(SETTINGS, rerank_scorer="other"))


def test_stage_times(spark, store, tmp_path):
    """With a clock that a stage moves on by a second, then two, then three."""
    from citemill.plans.evaluate import evaluate
    from citemill.sources.files import write_scorecard
    from citemill.timing import latency

    ticks = iter([0.0, 1.0, 3.0, 6.0])
    asked = spark.createDataFrame([(1, "What pricing risk exists?"), (2, "Quantum zebra?"), (3, "x")], "question_id int, question string")
    got = ask_many(store, asked, SETTINGS, clock=lambda: next(ticks))
    times = {r.question_id: tuple(r.timing) for r in got.collect()}
    assert times == {1: (1000, 2000, 3000, 6000), 2: (1000, 2000, 0, 3000), 3: (1000, 2000, 0, 3000)}
    assert [r.timing for r in ask_many(store, asked, SETTINGS).collect()] == [None] * 3
    of = {r.stage: (r.n, r.p50_ms, r.p95_ms) for r in latency(got).collect()}
    assert of == {"retrieval": (3, 1000, 1000), "rerank": (3, 2000, 2000), "generation": (3, 0, 3000), "total": (3, 3000, 6000)}
    plain = {r.question_id: r.asDict() for r in ask_many(store, asked, SETTINGS).drop("timing").collect()}
    assert {r.question_id: r.asDict() for r in got.drop("timing").collect()} == plain
    golden = asked.where("question_id < 3").withColumns({
        "id": F.col("question_id").cast("string"), "reference_answer": F.lit(""), "question_type": F.lit("x"), "should_abstain": F.lit(False),
        "expected_sources": F.array().cast("array<struct<company:string,year:int,section:string,chunk_id:string>>"),
    })
    again = iter([0.0, 0.5, 0.5, 0.75])
    scored, card = evaluate(store, golden, SETTINGS, clock=lambda: next(again))
    assert (card.first().p50_ms, card.first().p95_ms) == (500, 750)
    write_scorecard(card, str(tmp_path), "t", scored)
    assert "latency: p50 500 ms, p95 750 ms" in (tmp_path / "latest.md").read_text()


def test_ask(spark, store):
    got = ask(store, "What pricing risk exists?", SETTINGS)
    assert set(got["timing"]) == {"retrieval_ms", "rerank_ms", "generation_ms", "total_ms"} and got["total_ms"] >= got["timing"]["total_ms"] > 0
    assert got["answer"] == "Pricing risk is high. [1] Supply chain risk grows. [2]"
    assert [c["chunk_id"] for c in got["citations"]] == ["a", "b"] and not got["abstained"] and got["error"] is None
    assert len(got["corpus_snapshot_hash"]) == 12
    got = ask(store, "What pricing risk exists?", replace(SETTINGS, hybrid_enabled=True), {"ticker": "BET"})
    assert [c["company"] for c in got["citations"]] == ["Beta"]
    got = ask(store, "Quantum zebra?", SETTINGS)
    assert got["abstained"] and got["answer"] == ABSTENTION and got["citations"] == []
    assert ask(store, "What pricing risk?", SETTINGS, {"ticker": "NONE"})["abstained"]
    for bad in ("", "ab", "x" * 2001):
        with pytest.raises(ValueError):
            ask(store, bad, SETTINGS)


def test_ask_many_with_service(spark, store):
    def post(url, headers, body):
        if "pricing" in body["messages"][1]["content"].split("CONTEXT")[0]:
            return {"message": {"content": "It is high [1]. See [9]."}}
        raise RuntimeError("down")

    settings = replace(SETTINGS, backend="ollama", model="m", rerank_enabled=False)
    asked = spark.createDataFrame([(1, "pricing?"), (2, "supply?"), (3, "no")], "question_id int, question string")
    rows = {r.question_id: r for r in ask_many(store, asked, settings, generator=chat_generator(settings, post)).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3].error == BAD_QUESTION and not rows[3].abstained and rows[3].citations == [] and rows[3].answer == GENERATION_ERROR_ANSWER
    assert [c.n for c in rows[1].citations] == [1] and rows[1].out_of_range[0]["last"] == 9 and rows[1].model_version == "ollama/m"
    assert rows[2].error == "RuntimeError: down" and not rows[2].abstained and rows[2].answer == GENERATION_ERROR_ANSWER


def test_evaluation(spark, store):
    from citemill.operators.evaluation import chat_judge, scorecard
    from citemill.plans.evaluate import evaluate
    from citemill.schemas import GOLDEN

    source = lambda **k: Row(company=k.get("company"), year=k.get("year"), section=k.get("section"), chunk_id=k.get("id"))
    rows = [
        ("1", "What pricing risk exists?", "Pricing risk is high.", [source(company="acme", year=2024, section="Item 1A")], "factual", False),
        ("2", "What supply risk exists?", "", [source(id="nope")], "factual", False),
        ("3", "Quantum zebra?", "", [], "negative", True),
        ("4", "Pricing risk?", "", [], "negative", True),
    ]
    golden = spark.createDataFrame(rows, GOLDEN).withColumn("question_id", F.col("id"))
    scored, card = evaluate(store, golden, SETTINGS)
    row = card.first()
    assert (row.n_questions, row.recall_5, row.recall_20, row.abstain_correct, row.abstain_total) == (4, 0.5, 0.5, 1, 2)
    assert row.abstain_accuracy == 0.5 and row.phase1_pass is False and row.groundedness == 1.0
    none = scorecard(scored.where("question_id = '2'"), SETTINGS).first()
    assert none.groundedness == 0.0 and none.abstain_accuracy is None
    reply = {"choices": [{"message": {"content": json.dumps({"groundedness": 1, "relevance": 0.5})}}]}
    _, judged = evaluate(store, golden, SETTINGS, judge=chat_judge(SETTINGS, lambda *a: reply))
    assert judged.first().relevance == 0.5

    def down(*args):
        raise OSError("down")

    _, judged = evaluate(store, golden, SETTINGS, judge=chat_judge(SETTINGS, down))
    assert judged.first().groundedness == 0.0
