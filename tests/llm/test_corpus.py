"""Operators across documents against brute force, and the pipeline."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from compare import duck, rows_of
from helpers import by_id, documents, odd

from citemill.llm import decontaminate, near_dedup, queries, substring_dedup, toxicity
from citemill.llm.components import components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(queries.ORACLES[name])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)


def test_queries_are_all_there():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13 and "pipeline" in queries.QUERIES


def test_shared_passages_of_a_repeated_id(spark):
    """Each text of a doc_id loses its own words: none is a source for the others, and copies are told apart."""
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    p, q, r = text("p", 60), text("q", 70), text("r", 130)
    rows = [(1, p), (2, f"{q} {p}"), (2, r), (2, p), (2, f"{q} {r}"), (3, f"{r} x"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.shared_passages(df).collect()}
    assert got == {(1, 60, 0), (2, 130, 60), (2, 130, 0), (2, 60, 60), (2, 200, 0), (3, 131, 130), (2, 0, 0)}


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(None, 1), (7, 7)]
    parent = {x: x for pair in links for x in pair if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(find(n) == c for n, c in got.items()) and {n for n in parent if find(n) != n} <= set(got)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(texts, width):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    out = []
    for i in range(len(texts)):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return [len(s) for s in sets], out


def near_copies():
    draw = random.Random(6)
    texts = []
    for length in (30, 60, 200):
        base = [f"w{draw.randrange(5000)}" for _ in range(length)]
        for _ in range(40):
            words = list(base)
            for _ in range(draw.randrange(0, length // 12)):
                words[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words).upper() if draw.random() < 0.2 else "\n ".join(words))
    texts += ["a b", "A  B", "a b c", None, "", " ", "a"]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("width, block", [(4, near_dedup.BLOCK_SHINGLES), (5, 2000)])
def test_near_duplicates(spark, width, block):
    texts = near_copies()
    sizes, classes = plain_classes(texts, width)
    rows = by_id(near_dedup.near_duplicates(documents(spark, texts), width, block=block))
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == classes
    assert all(rows[i].kept == (classes[i] == i) for i in range(len(texts)))


def test_near_duplicates_odd(spark):
    rows = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == 10 and sorted((r.component_id, r.kept) for r in rows if r.doc_id in (5, 6)) == [(5, False), (5, True), (5, True)]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(odd(spark).limit(0)).collect() == []


def plain_passages(texts, window):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, words in enumerate(split):
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = []
    for i, words in enumerate(split):
        gone = {p for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for p in range(k, k + window)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window, period", [(50, 31), (6, 3), (5, 5), (12, 1)])
def test_shared_passages(spark, window, period):
    draw = random.Random(7)
    passages = [[f"p{draw.randrange(50)}" for _ in range(draw.randrange(window - 2, 2 * window))] for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(draw.randrange(5)):
            words += draw.choice(passages) if draw.random() < 0.6 else [f"f{draw.randrange(9)}" for _ in range(draw.randrange(2 * window))]
        texts.append(" ".join(words))
    texts += [texts[3], None, "", "b " * 200, "b " * 300]
    rows = by_id(substring_dedup.shared_passages(documents(spark, texts), window, period))
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))] == plain_passages(texts, window)


@pytest.mark.parametrize("period", [1, 2, 5, 13, 31, 50])
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_shared_passages_odd(spark):
    rows = substring_dedup.shared_passages(odd(spark)).collect()
    assert len(rows) == 10 and {(r.doc_id, r.n_removed) for r in rows if r.n_words > 50} == {(5, 0), (6, 20_000)}
    assert substring_dedup.shared_passages(odd(spark).limit(0)).collect() == []


def test_wand_gives_all_items_above_the_threshold():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    index = decontaminate.Index([(i, " ".join(draw.choices(words, k=draw.randrange(3, 30)))) for i in range(120)], block=4)
    for _ in range(300):
        query = set(decontaminate.pairs(draw.choices(words, k=60)))
        for least in (0.05, 0.1, 0.3):
            scores = {}
            for t in query & set(index.postings):
                for n, w in zip(index.postings[t].items, index.postings[t].weights):
                    scores[n] = scores.get(n, 0) + w
            assert {n for n, _ in index.retrieve(query, least)} == {n for n, s in scores.items() if s + 1e-9 >= least}


def test_leaks(spark):
    draw = random.Random(9)
    item = [f"q{i}" for i in range(30)]
    noise = [f"n{draw.randrange(300)}" for _ in range(400)]
    edited = [w if i % 11 else "zz" for i, w in enumerate(item)]
    texts = [" ".join(noise[:100] + item + noise[100:]), " ".join(noise), " ".join(noise[:50] + edited), " ".join(noise + item[:15]), None, ""]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "..."), (4, " ".join(f"z{i}" for i in range(20)))], "item_id long, text string")
    docs = documents(spark, texts)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect())
    assert got == [(0, 1), (2, 1)]
    parts = sorted((r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items, index_chars=10).collect())
    assert parts == got
    clean = docs.where(decontaminate.is_clean(docs, items)).select("doc_id").collect()
    assert sorted(r[0] for r in clean) == [1, 3, 4, 5]
    assert decontaminate.leaked_items(docs, items.limit(0)).collect() == [] and decontaminate.leaked_items(odd(spark), items).collect() == []


def test_parts_of_the_index_change_nothing(spark):
    draw = random.Random(11)
    common = [f"w{i}" for i in range(12)]
    texts = [" ".join(draw.choices(common, k=draw.randrange(1, 25))) for _ in range(40)]
    # An item with two texts, one of them with more at its end, and one listed twice.
    items = [*enumerate(texts), (7, f"{texts[7]} and more than that"), (8, texts[8])]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [*(f"{a} {b}" for a, b in zip(texts, texts[1:])), " ".join(draw.choices(common, k=900)), f"{texts[7]} and more than that"])
    docs = docs.unionByName(docs.where("doc_id = 3")).coalesce(1)

    def rows(**bound):
        found = decontaminate.leaked_items(docs, table, **bound).collect()
        return sorted((r.doc_id, r.item_id, round(r.score, 7), round(r.question_overlap, 7), round(r.answer_overlap, 7)) for r in found)

    whole = rows()
    assert rows(index_chars=700) == whole and len(whole) > 40
    assert sum(r[:2] == (3, 3) for r in whole) == 2 and all(whole.count(r) == (2 if r[0] == 3 else 1) for r in whole)


def test_short_items_are_found(spark):
    noise = [f"n{i % 70}" for i in range(400)]
    items = ["solo", "two words", "it takes three", "what is two five", "What is 2+2? 4", "a first b second c third"]
    items += ["日本の首都はどこですか東京", "กรุงเทพ"]
    texts = [" ".join([*noise[:150], item.upper(), *noise[150:]]) for item in items[:6]]
    texts += [f"前の文{items[6]}後の文。" * 3, f"มา{items[7]}นี้", items[0], items[1]]
    # All their words, but not next to each other.
    texts += ["words and then two", "it all takes and three", "what is it: two or five", "what is 2 and 2, 4", "日本の都は東京です", " ".join(noise)]
    docs, table = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaked_items(docs, table).collect()}
    assert sorted(got) == [*((i, i) for i in range(8)), (8, 0), (9, 1)]
    assert all(r.score > 1 - 1e-9 and r.question_overlap == r.answer_overlap == 1 for r in got.values())
    clean = docs.where(decontaminate.is_clean(docs, table)).select("doc_id").collect()
    assert sorted(r[0] for r in clean) == list(range(10, 16))


def test_severity_is_ordered(spark):
    draw = random.Random(10)
    common, marks = [f"c{chr(97 + i)}x" for i in range(26)], ["vile", "vileness", "brute", "foul"]
    texts, toxic = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append(" ".join(draw.choices(common, k=40) + (draw.choices(marks, k=draw.randrange(1, 6)) if bad else [])))
        toxic.append(int(bad))
    docs = documents(spark, [*texts, "a vile brute and foul", None, "", "ca cb"])
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(None, 1, 1), (999, None, 0)], "doc_id long, toxic int, kept int")
    model = toxicity.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and min(model.weights.values()) > 0
    rows = by_id(toxicity.toxic_documents(docs, labels))
    assert all(rows[i].kept != bool(toxic[i]) for i in range(300))
    assert not rows[300].kept and rows[301].kept and rows[302].expected_severity == 0 and rows[303].kept
    assert all(0 <= r.expected_severity <= 2 for r in rows.values())


def test_severity_sample_is_of_labels_with_documents(spark):
    docs = documents(spark, [f"foul vile words {i}" if i % 2 else f"common plain words {i}" for i in range(40)])
    near = [(i, i % 2) for i in range(40)]
    labels = spark.createDataFrame([*near, *((i, i % 2) for i in range(1000, 4000))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=20)
    assert model.weights and model == toxicity.fit(docs, spark.createDataFrame(near, "doc_id long, toxic int"), sample=20)
    assert all(r.kept == (r.doc_id % 2 == 0) for r in toxicity.toxic_documents(docs, labels, sample=20).collect())


def test_severity_gradient():
    """The steps follow the gradient of the cumulative-link likelihood."""
    def loss(score, thresholds, grade):
        borders = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper, lower = (1 / (1 + np.exp(score - borders[grade + k])) for k in (1, 0))
        return np.log(upper - lower), upper + lower - 1

    for grade in (0, 1, 2):
        for score in (-2.0, 0.3, 4.0):
            t = np.array([0.5, 2.0])
            numeric = (loss(score + 1e-6, t, grade)[0] - loss(score - 1e-6, t, grade)[0]) / 2e-6
            assert abs(numeric - loss(score, t, grade)[1]) < 1e-5


def test_severity_odd(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    rows = toxicity.toxic_documents(odd(spark), labels).collect()
    assert len(rows) == 10 and all(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in toxicity.toxic_documents(odd(spark), labels.limit(0)).collect())
    assert toxicity.toxic_documents(odd(spark).limit(0), labels).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in left.collect()}
        left = spark.createDataFrame(function(spark, left, FOLDER).collect(), docs.schema)
        after = {r.doc_id: r.text for r in left.collect()}
        assert set(after) <= set(before) and left.columns == docs.columns
        if name == "minhash_near_dedup":
            ids = sorted(before)
            _, classes = plain_classes([before[i] for i in ids], 5)
            assert set(after) == {i for k, i in enumerate(ids) if classes[k] == k}
        elif name == "contextual_pii":
            assert set(after) == set(before) and any(after[i] != before[i] for i in before)
        else:
            assert all(after[i] == before[i] for i in after)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(after) and all(r.n_tokens == len(r.ids) for r in rows)


def plain_leaks(texts, items):
    """(doc_id, item_id) by a search for every item: 0.7 of the runs of three words of its first part and of its last quarter."""
    def runs(words):
        return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}

    out = set()
    split = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items.items() if t}
    assert min(map(len, split.values())) >= 12
    for doc_id, text in texts.items():
        there = runs(re.findall(r"[^\W_]+", (text or "").lower()))
        for item_id, words in split.items():
            cut = len(words) - round(len(words) / 4)
            if all(10 * len(r & there) >= 7 * len(r) for r in (runs(words[:cut]), runs(words[cut:]))):
                out.add((doc_id, item_id))
    return out


def test_leaks_and_stages_as_a_plain_search(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    leaks = plain_leaks(texts, {r.item_id: r.text for r in items.collect()})
    assert leaks and {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()} == leaks
    stages = dict(corpus_pipeline.STAGES)
    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, FOLDER).collect()}
    assert clean == set(texts) - {d for d, _ in leaks}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r.doc_id: r.kept for r in toxicity.toxic_documents(docs, labels).collect()}
    left = {r.doc_id for r in stages["toxicity"](spark, docs, FOLDER).collect()}
    assert left == {i for i, k in kept.items() if k} and left != set(texts)


def test_pipeline_takes_odd_rows(spark):
    df = odd(spark).withColumn("n_chars", __import__("pyspark").sql.functions.length("text").cast("long"))
    for frame in (df, df.limit(0)):
        left = frame
        for _, function in corpus_pipeline.STAGES:
            left = function(spark, left, FOLDER)
            left = spark.createDataFrame(left.collect(), left.schema)
        assert left.count() == (9 if frame is df else 0)
