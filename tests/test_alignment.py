"""Alignment of sentences against a plain table of subsequences."""

import random

import pytest
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.alignment import aligned_judge, common_length, mean_support, sentence_support, unsupported
from citemill.operators.evaluation import judge_for


def plain_length(a, b):
    line = [0] * (len(a) + 1)
    for y in b:
        line, above = [0], line
        for i, x in enumerate(a):
            line.append(above[i] + 1 if x == y else max(above[i + 1], line[i]))
    return line[-1]


def test_common_length(spark):
    draw = random.Random(5)
    rows = [([draw.choice("abcd") for _ in range(draw.randrange(12))], [draw.choice("abcde") for _ in range(draw.randrange(14))]) for _ in range(400)]
    rows += [([], []), (["a"], []), ([], ["a"]), (["a"] * 30, ["a"] * 20), (list("abc") * 9, list("cba") * 9)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == len(rows) and all(r.n == plain_length(r.a, r.b) for r in got)


def test_support_needs_the_order(spark):
    df = spark.createDataFrame([
        ("Revenue rose above costs.", "Nothing here. Costs rose above revenue. Revenue slowly rose above costs."),
        ("Revenue rose above costs. The of and.", "Costs rose above revenue."),
        ("Revenue rose.", ""), ("Revenue rose.", None), ("", "Revenue rose."), (None, "Revenue rose."),
    ], "said string, given string")
    rows = df.select(sentence_support(F.col("said"), F.col("given")).alias("s"), mean_support(F.col("said"), F.col("given")).alias("m")).collect()
    assert [[(s.support, s.place) for s in r.s] for r in rows] == [[(1.0, 3)], [(1 / 3, 1)], [(0.0, 0)], [(0.0, 0)], [], []]
    assert [r.m for r in rows] == [1.0, 1 / 3, 0.0, 0.0, 0.0, 0.0]


def test_judge_and_what_is_unsupported(spark):
    df = spark.createDataFrame([(
        "What grew?", "Sales grew in spring. Rents fell.", "Sales grew.", "Sales grew in spring [1]. Profits doubled every year [1].",
    )], "question string, context string, reference string, answer string")
    judge = judge_for(Settings(judge_backend="aligned"))
    assert judge is aligned_judge
    row = df.select(judge(*map(F.col, df.columns)).alias("j"), unsupported(F.col("answer"), F.col("context")).alias("u")).first()
    assert row.j.groundedness == pytest.approx(0.5) and row.j.correctness == 1.0 and row.u == ["Profits doubled every year  ."]
