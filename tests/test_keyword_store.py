import random
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.keyword import _inverted, _parts, BlockSearch, KeywordIndex, keyword_search, term_counts
from citemill.sources import pointer
from citemill.sources.keyword_store import KeywordStore

SETTINGS = Settings(bm25_top_k=7)


def corpus(n, seed, start=0):
    """Texts with words of very different frequency."""
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 400}"
    return [(f"d{start + i:05d}", " ".join(word() for _ in range(draw.randrange(60)))) for i in range(n)]


def asked(spark, n=25, seed=9):
    draw = random.Random(seed)
    rows = [(i, " ".join(f"w{draw.choice((1, 2, 3, 5, 8, 40, 77, 150, 390))}" for _ in range(draw.randrange(1, 8)))) for i in range(n)]
    return spark.createDataFrame(rows + [(90, "w1 w1 w1 w2"), (91, "nothing"), (92, ""), (93, None)], "question_id int, question string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def found(index, questions, allowed=None, settings=SETTINGS):
    return sorted((r.question_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in keyword_search(index, questions, settings, allowed).collect())


def test_term_counts(spark):
    df = spark.createDataFrame([("b a, b the B",), ("",), ("the",), (None,)], "t string").select(term_counts(F.col("t")).alias("c"))
    got = [(r.c.dl, [tuple(t) for t in r.c.terms]) for r in df.collect()]
    assert got[1:] == [(0, [])] * 3 and got[0][0] == sum(n for _, n in got[0][1]) and ("b", 3) in got[0][1]


@pytest.mark.parametrize("rows", [20_000, 0], ids=["local", "staged"])
def test_blocks_find_what_all_postings_find(spark, tmp_path, monkeypatch, rows):
    import citemill.session as session

    monkeypatch.setattr(session.held, "__defaults__", (rows,))
    docs, questions = frame(spark, corpus(900, 1) + [("none", None), ("blank", "")]), asked(spark)
    held = KeywordStore(spark, str(tmp_path / "k"), SETTINGS)
    held.upsert(docs)
    index, plain = held.index(), KeywordIndex.build(docs, SETTINGS)
    expected = found(plain, questions)
    assert found(index, questions) == expected and len(expected) > 150
    few = docs.where("chunk_id < 'd00300'")
    assert found(index, questions, few) == found(plain, questions, few)
    read, every = BlockSearch(index, questions, SETTINGS).postings_read()
    assert 0 < read < 0.7 * every


def test_few_postings_are_read_for_a_rare_word_beside_frequent_ones(spark, tmp_path):
    rows = [(f"d{i:05d}", "common usual " * (1 + i % 5) + ("rare " * 3 if i % 100 == 0 else "") + f"filler{i} " * (i % 17)) for i in range(3000)]
    held = KeywordStore(spark, str(tmp_path / "k"), SETTINGS)
    held.upsert(frame(spark, rows))
    one = spark.createDataFrame([(1, "common usual rare")], "question_id int, question string")
    search = BlockSearch(held.index(), one, SETTINGS)
    read, every = search.postings_read()
    assert read < 0.05 * every
    plain = KeywordIndex.build(frame(spark, rows), SETTINGS)
    assert found(held.index(), one) == found(plain, one)


def test_index_follows_writes(spark, tmp_path):
    held, questions = KeywordStore(spark, str(tmp_path / "k"), SETTINGS), asked(spark)
    state = dict(corpus(300, 2))
    held.upsert(frame(spark, list(state.items())), source=1)
    # Longer documents change the mean length, so the bounds of the first segment grow.
    second = [(k, v + " w1 w8" * 40) for k, v in corpus(120, 3, start=250)]
    held.upsert(frame(spark, second), gone=frame(spark, [("d00000", ""), ("d00007", ""), ("unknown", "")]), source=2)
    state.update(second)
    state.pop("d00000"), state.pop("d00007")
    held.upsert(frame(spark, [("d00001", "w390 w390"), ("d00260", None)]), source=3)
    state.update({"d00001": "w390 w390", "d00260": None})
    held.remove(frame(spark, [("d00002", ""), ("d00369", "")]), source=4)
    state.pop("d00002"), state.pop("d00369")

    def same(index):
        plain = KeywordIndex.build(frame(spark, list(state.items())), SETTINGS)
        terms = lambda i: sorted((r.term, r.df, round(r.idf, 9)) for r in i.terms.collect())
        assert terms(index) == terms(plain)
        assert index.stats.first()["n_docs"] == plain.stats.first()["n_docs"]
        assert index.stats.first()["avg_dl"] == pytest.approx(plain.stats.first()["avg_dl"])
        assert found(index, questions) == found(plain, questions)

    same(held.index())
    assert held.source == 4 and {r[0] for r in held.keys().collect()} == set(state)
    held.compact()
    held.clean()
    same(held.index())
    assert pointer.folders(spark, f"{held.path}/gone") == [] and len(pointer.folders(spark, f"{held.path}/postings")) == 1


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    import citemill.sources.keyword_store as module

    held, questions = KeywordStore(spark, str(tmp_path / "k"), SETTINGS), asked(spark, 5)
    held.upsert(frame(spark, corpus(80, 4)), source="a")
    before = found(held.index(), questions)
    monkeypatch.setattr(module, "write_pointer", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        held.upsert(frame(spark, corpus(80, 5)), source="b")
    monkeypatch.undo()
    assert found(held.index(), questions) == before and held.source == "a"
    held.upsert(frame(spark, corpus(80, 5)), source="b")
    assert found(held.index(), questions) == found(KeywordIndex.build(frame(spark, corpus(80, 5)), SETTINGS), questions)
    with pytest.raises(ValueError):
        held.upsert(frame(spark, [("x", "w1"), ("x", "w2")]))


def test_negative_weights(spark, tmp_path):
    """In a tiny corpus the mean weight is negative, and so is that of frequent words."""
    docs = frame(spark, [("a", "x y"), ("b", "x y z"), ("c", "x y"), ("d", "y")])
    held = KeywordStore(spark, str(tmp_path / "k"), SETTINGS)
    held.upsert(docs)
    questions = spark.createDataFrame([(1, "x y z"), (2, "y"), (3, "z z x")], "question_id int, question string")
    settings = replace(SETTINGS, bm25_top_k=1)
    assert found(held.index(), questions, settings=settings) == found(KeywordIndex.build(docs, settings), questions, settings=settings)


def test_terms_are_counted_once_in_a_write(spark, tmp_path, monkeypatch):
    import citemill.sources.keyword_store as module

    counted = spark.sparkContext.accumulator(0)

    def spy(text):
        @F.arrow_udf("string")
        def seen(texts):
            counted.add(len(texts))
            return texts

        return term_counts(seen(text))

    monkeypatch.setattr(module, "term_counts", spy)
    KeywordStore(spark, str(tmp_path / "k"), SETTINGS).upsert(frame(spark, corpus(200, 6)))
    assert counted.value == 200


@pytest.fixture
def plans(monkeypatch):
    """(path, plan) of all that is written."""
    kept, write = [], DataFrameWriter.parquet

    def spy(self, path, *args, **options):
        kept.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return kept


def shuffled(plans, *tables):
    """Tables of a written index with a shuffle before them."""
    return {t for t in tables for path, plan in plans if f"/{t}/" in path and re.search("(?<!Broadcast)Exchange", plan)}


def changed(spark, path):
    """A store that follows three writes, and the documents in it."""
    held, state = KeywordStore(spark, path, SETTINGS), dict(corpus(500, 7))
    held.upsert(frame(spark, list(state.items())))
    second = corpus(400, 8, start=200)
    held.upsert(frame(spark, second), gone=frame(spark, [(f"d{i:05d}", "") for i in range(50)]))
    held.remove(frame(spark, [(f"d{i:05d}", "") for i in range(400, 450)]))
    state.update(second)
    return held, frame(spark, [(k, v) for k, v in state.items() if not ("d00000" <= k < "d00050" or "d00400" <= k < "d00450")])


def test_writes_shuffle_no_texts_terms_or_postings(spark, tmp_path, plans):
    held, docs = changed(spark, str(tmp_path / "k"))
    assert len([path for path, _ in plans if "/forward/" in path]) == 2
    assert shuffled(plans, "forward", "postings", "blocks") == set()
    assert {r[0] for r in held.keys().collect()} == {r[0] for r in docs.collect()}


def test_compaction_shuffles_no_terms_or_postings(spark, tmp_path, plans):
    held, docs = changed(spark, str(tmp_path / "k"))
    plans.clear()
    held.compact()
    assert [path for path, _ in plans if "/forward/" in path] and shuffled(plans, "forward", "postings", "blocks") == set()
    held.clean()
    index, plain = held.index(), KeywordIndex.build(docs, SETTINGS)
    terms = lambda i: sorted((r.term, r.df, round(r.idf, 9)) for r in i.terms.collect())
    assert terms(index) == terms(plain)


@pytest.mark.parametrize("rows", [20_000, 0], ids=["few terms", "many terms"])
def test_many_documents_in_reach(spark, tmp_path, monkeypatch, rows):
    """Documents are dealt out by their number, and none that is gone or not allowed comes back."""
    import citemill.operators.keyword as keyword
    import citemill.session as session

    held, docs = changed(spark, str(tmp_path / "k"))
    monkeypatch.setattr(keyword, "HELD_ROWS", 0)
    monkeypatch.setattr(session.held, "__defaults__", (rows,))
    few, questions = replace(SETTINGS, broadcast_rows=0), asked(spark)
    index, plain = held.index(), KeywordIndex.build(docs, SETTINGS)
    expected = found(plain, questions)
    assert found(index, questions, settings=few) == expected and len(expected) > 100
    some = docs.where("chunk_id < 'd00300'")
    assert found(index, questions, some, few) == found(plain, questions, some)
    assert keyword_search(index, questions, few).columns == keyword_search(plain, questions, few).columns


def test_runs_of_parts():
    texts = [["a"], [], ["b", "a", "c", "d", "e"], ["a", "b"], [], ["c"]]
    rows = pa.RecordBatch.from_pylist(
        [{"doc": i, "dl": len(t), "terms": [{"term": w, "tf": 1 + i} for w in t]} for i, t in enumerate(texts)],
        pa.schema([("doc", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))]),
    )
    parts = list(_parts(iter([rows.slice(0, 2), rows.slice(2), rows.slice(0, 0)]), 3))
    assert [p["doc"].to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([rows])
    runs = [r for p in parts for b in _inverted(p, 2.0, SETTINGS) for r in b.to_pylist()]
    got = sorted((r["term"], d, tf, dl) for r in runs for d, tf, dl in zip(r["docs"], r["tfs"], r["dls"], strict=True))
    assert got == sorted((w, i, 1 + i, len(t)) for i, t in enumerate(texts) for w in t)
    assert all(r["n"] == len(r["docs"]) and r["top"] * 16 / 2.5 >= r["level"] for r in runs)
    last = [(r["term"], -r["level"]) for b in _inverted(rows, 2.0, SETTINGS) for r in b.to_pylist()]
    assert last == sorted(last)
    assert list(_inverted(rows.slice(1, 1), 2.0, SETTINGS)) == []


def test_an_index_of_another_layout_counts_as_none(spark, tmp_path):
    path = str(tmp_path / "k")
    pointer.write_pointer(spark, path, 1, {"segments": [{"id": 1, "n": 1, "dl": 1, "average": 1.0}], "gone": [], "terms": 1, "source": "a"})
    held = KeywordStore(spark, path, SETTINGS)
    assert not held.exists() and held.source is None
    held.upsert(frame(spark, [("x", "w1 w2")]), source="b")
    assert held.exists() and held.source == "b" and [r[0] for r in held.keys().collect()] == ["x"]
