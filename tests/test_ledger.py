import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.generation import chat_generator, prompt_key
from citemill.operators.ledger import Ledger, kept_answers


class Lost(BaseException):
    """Ends a task as a lost worker does: no retry of a call sees it."""


def service(folder):
    """A chat service that notes each prompt in a file, and takes its worker along at one of them, once."""

    def post(url, headers, body):
        prompt = body["messages"][-1]["content"]
        if prompt == "prompt 13" and not os.path.exists(f"{folder}/lost"):
            open(f"{folder}/lost", "w").close()
            raise Lost("worker")
        with open(f"{folder}/log", "a") as log:
            log.write(prompt + "\n")
        return {"message": {"content": "" if prompt.endswith("7") else f"answer to {prompt}"}}

    return post


def asked(spark, folder, settings):
    prompts = spark.range(20, numPartitions=1).select(F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("p"))
    rows = prompts.select("p", chat_generator(settings, service(folder))(None, None, F.col("p")).alias("g")).collect()
    return {r.p: (r.g.text, r.g.error) for r in rows}


def test_a_task_that_is_lost_asks_nothing_twice(spark, tmp_path):
    settings = replace(Settings(), backend="ollama", model="m", ledger_path=str(tmp_path / "ledger"))
    with pytest.raises(Exception):
        asked(spark, tmp_path, settings)
    before = (tmp_path / "log").read_text().split("\n")[:-1]
    assert before == [f"prompt {i}" for i in range(13)]
    answers = asked(spark, tmp_path, settings)
    assert answers["prompt 2"] == ("answer to prompt 2", None) and answers["prompt 17"][1] == "empty_response" and len(answers) == 20
    assert asked(spark, tmp_path, settings) == answers
    log = (tmp_path / "log").read_text().split("\n")[:-1]
    assert sorted(log) == sorted(f"prompt {i}" for i in range(20)), "each prompt once, over three runs"
    assert kept_answers(spark, settings.ledger_path).count() == 20
    # Another model is another question.
    asked(spark, tmp_path, replace(settings, model="n"))
    assert len((tmp_path / "log").read_text().split("\n")) == 41


def test_errors_are_asked_again(tmp_path):
    ledger, calls = Ledger(f"file://{tmp_path}/l"), []

    def ask(error):
        calls.append(error)
        return {"text": "t", "error": error}

    assert ledger.once("ab1", lambda: ask("TimeoutError: x"))["error"] and ledger.get("ab1") is None
    assert ledger.once("ab1", lambda: ask(None)) == {"text": "t", "error": None} == ledger.once("ab1", lambda: ask("never"))
    assert calls == ["TimeoutError: x", None]
    assert [f for f in os.listdir(tmp_path / "l" / "ab")] == ["ab1.json"] and json.loads((tmp_path / "l" / "ab" / "ab1.json").read_text())


def test_key_tells_requests_apart():
    base = Settings()
    keys = {prompt_key("p", s) for s in (base, replace(base, model="x"), replace(base, temperature=0.7), replace(base, max_output_tokens=5))}
    assert len(keys | {prompt_key("q", base)}) == 5 and prompt_key("p", base) == prompt_key("p", Settings())
