from dataclasses import replace

import numpy as np
import pytest

from citemill.config import Settings
from citemill.operators.dense import dense_topk_batch
from citemill.sources.cells import CellStore

SETTINGS = replace(Settings(), top_k_dense=10)


def clustered(n, centres, seed, spread=0.15, dim=24):
    draw = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dim))
    return [(i, (middle[i % centres] + draw.normal(size=dim) * spread * 3).tolist()) for i in range(n)]


def listed(df):
    return sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    nan = float("nan")
    rows = [(f"c{i:05d}", v) for i, v in clustered(3000, 40, 1)]
    # Copies tie, zero vectors score zero, and what is no vector is left out.
    rows += [(f"a{i:05d}", rows[0][1]) for i in range(60)] + [("z", [0.0] * 24), ("n", None), ("x", [nan] * 24), ("s", [1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(4)
    held = CellStore(spark, str(tmp_path_factory.mktemp("cells")), SETTINGS)
    held.write(df, source=7)
    asked = [(i, v) for i, v in clustered(12, 40, 2)] + [(90, rows[0][1]), (91, [0.0] * 24), (92, None), (93, [-x for x in rows[5][1]])]
    return held, df, spark.createDataFrame(asked, "question_id int, embedding array<float>")


def test_cells_are_exact_and_few_are_read(indexed):
    held, df, asked = indexed
    assert listed(held.search(asked)) == listed(dense_topk_batch(df, asked, SETTINGS)) and held.source == 7
    near = asked.where("question_id < 12")
    assert listed(held.search(near)) == listed(dense_topk_batch(df, near, SETTINGS))
    assert held.cells_read[0] < 0.35


def test_cells_in_blocks_of_questions(indexed, spark):
    held, df, asked = indexed
    small = CellStore(spark, held.path, replace(SETTINGS, broadcast_questions=6))
    assert listed(small.search(asked)) == listed(dense_topk_batch(df, asked, SETTINGS)) and len(small.cells_read) > 1


def test_few_cells_miss_few_rows(indexed):
    held, df, asked = indexed
    near = asked.where("question_id < 12")
    exact = {(q, c) for q, _, c, _ in listed(dense_topk_batch(df, near, SETTINGS))}
    some = {(q, c) for q, _, c, _ in listed(held.search(near, most_cells=6))}
    assert len(exact & some) / len(exact) >= 0.9 and held.cells_read[0] <= 6 / 50


def test_other_sizes_and_no_rows(indexed, spark, tmp_path):
    held, df, _ = indexed
    other = spark.createDataFrame([(1, [1.0, 2.0])], "question_id int, embedding array<float>")
    assert held.search(other).collect() == []
    empty = CellStore(spark, str(tmp_path / "e"), SETTINGS)
    with pytest.raises(ValueError):
        empty.search(other)
    empty.write(df.limit(0))
    assert empty.search(other).collect() == []


def test_scan_reads_the_partitions_of_its_cells(indexed):
    from pyspark.sql import functions as F

    held, _, _ = indexed
    plan = held.spark.read.parquet(f"{held.path}/version=1").where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
