"""Fill-in-the-middle forms, simhash classes and hard negatives against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import by_id, documents, odd
from pyspark.sql import functions as F

from citemill.llm import fill_middle, hard_negatives, simhash

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_form(doc_id, text, fim=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def odd_texts():
    draw = random.Random(3)
    pieces = ["a", "é", "\U0001f600", " ", "\n", "\t\x0b", " ", " ", "<", "P>", "<S", "$1", "\\", "\x85", "\x1c", "word", "<P"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(30))) for _ in range(300)]
    return texts + [None, "", " ", "x <P> y", "a<M>", "<S>", " ".join(f"w{i}" for i in range(120_000)) + "\n"]


@pytest.mark.parametrize("fim, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, fim, spm):
    texts = odd_texts()
    df = fill_middle.fill_in_middle(documents(spark, texts), fim, spm)
    rows = by_id(df.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))))
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_form(i, text, fim, spm)
        assert r.again == (text or "")


def test_fill_in_middle_odd(spark):
    rows = fill_middle.fill_in_middle(odd(spark)).collect()
    texts = {None: "", 4: "x"}
    assert len(rows) == 10 and {r.form for r in rows if r.doc_id in (1, 2)} == {"plain"}
    assert all((r.n, r.form, r.output) == plain_form(r.doc_id, texts[4])[:3] for r in rows if r.doc_id == 4)
    assert fill_middle.fill_in_middle_digests(odd(spark).limit(0)).collect() == []
    assert all(r.restored_sha256 for r in fill_middle.fill_in_middle_digests(odd(spark)).collect())


def test_fill_in_middle_needs_neither_shuffle_nor_python(spark):
    plan = fill_middle.fill_in_middle_digests(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def plain_fingerprint(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_sparks_hash_of_the_whole_text(spark):
    for text in (None, "", " \n", "A b", "One two three", "É x y \U0001f600 Q z", " ".join(f"w{i}" for i in range(60_000))):
        assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == plain_fingerprint(text)
    own = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert simhash.fingerprint("One TWO three", 3) == own


def test_simhash_components(spark):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    draw = random.Random(1)
    for _ in range(60):
        words = (draw.choice([t for t in texts if t]) or "x").split()
        if words:
            words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "\t", "a", "A", "a b"]
    prints = [plain_fingerprint(t) for t in texts]
    rows = by_id(simhash.simhash_components(documents(spark, texts)))
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    expected = plain_components(list(range(len(texts))), prints)
    assert [rows[i].component_id for i in range(len(texts))] == expected
    assert len(set(expected)) < len(set(prints)), "some different fingerprints are linked"


@pytest.mark.parametrize("bits", [1, 2])
def test_fingerprint_links_are_whole(spark, bits):
    """Large lists, small lists and lists over several batches: every pair within the distance, once."""
    draw = random.Random(bits)
    top = (1 << 64) - 1
    prints = {0, top, 1, 3, 7, 1 << 63}
    hot = draw.randrange(top)
    prints |= {hot & ~0xFFFF | draw.randrange(1 << 16) for _ in range(1500)}
    for _ in range(40):
        base = draw.randrange(top)
        for _ in range(30):
            prints.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(4))}))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        classes = spark.createDataFrame([(p,) for p in signed], "fp long")
        links = [tuple(sorted((r.x & top, r.y & top))) for r in simhash.fingerprint_links(classes, bits).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    array = np.array(prints, dtype=np.uint64)
    expected = set()
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits) + i + 1
        expected |= {(prints[i], prints[j]) for j in near.tolist()}
    assert sorted(links) == sorted(expected) and len(expected) > 500


def test_simhash_odd(spark):
    rows = simhash.simhash_components(odd(spark)).collect()
    assert len(rows) == 10
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    alone = [r for r in rows if r.doc_id is None and r.fingerprint != "0" * 16]
    assert [r.component_id for r in alone] == [None]
    assert simhash.simhash_components(odd(spark).limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.fingerprint_links(odd(spark), 3)


def plain_negatives(rows, positives=5, negatives=5):
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        if vec_id not in known or (label, list(vector)) < known[vec_id][:2]:
            known[vec_id] = (label, list(vector), ints)
    out = []
    for a, (label, _, ints) in known.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(ints, o[2])), b, o[0]) for b, o in known.items() if b != a)
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(a, p, i, n, -s, -t) for i, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim, at_once, levels", [(64, 4096, 4), (7, 2, 1), (100, 3, 2)])
def test_hard_negatives(spark, dim, at_once, levels):
    draw = np.random.default_rng(dim)
    centres = draw.standard_normal((6, dim))
    rows = []
    for i in range(900):
        v = centres[i % 6] + draw.standard_normal(dim) * 0.8
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(draw.integers(0, 10))))
    rows += [(900, rows[3][1], 3), (901, rows[3][1], 4), (902, rows[3][1], 4), (1000, [0.0] * dim, 1), (903, [0.0] * dim, 2)]
    rows += [(100, rows[5][1], 9), (100, rows[5][1], 0), (1100, [-x for x in rows[8][1]], 2), (1200, rows[9][1][: dim - 2], 3)]
    rows += [(None, rows[1][1], 1), (1300, None, 1), (1400, rows[1][1], None), (1500, [float("nan")] * dim, 1), (1600, [float("inf")] * dim, 1)]
    rows += [(1700, [None] + rows[1][1][1:], 1), (1800, rows[2][1], 77)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("other")).repartition(5)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, moved, levels=levels, anchors_at_once=at_once)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_hard_negatives_of_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.label_negatives(empty).collect() == []
    none = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.label_negatives(none).collect() == []


@pytest.mark.parametrize("dim, levels, planes", [(64, 4, 8), (64, 1, 4), (30, 2, 8), (130, 3, 6)])
def test_intervals_hold_and_narrow(dim, levels, planes):
    draw = np.random.default_rng(5)
    vectors = np.floor(draw.standard_normal((500, dim)) * 40).astype(np.int64)
    vectors[3], vectors[4] = 0, vectors[5]
    turn = hard_negatives.rotation(dim)
    codes, weights, rest = hard_negatives.sign_codes(vectors.astype(float), turn, levels)
    rows = object.__new__(hard_negatives._Rows)
    rows.ids, rows.labels, rows.vectors, rows.codes, rows.weights = np.arange(500), np.zeros(500), vectors, codes, weights
    rows.length, rows.rest = np.linalg.norm(vectors, axis=1), rest
    anchors = hard_negatives.Anchors(np.arange(40), np.zeros(40), vectors[:40], turn, levels, planes)
    low, high = anchors.intervals(rows)
    exact = vectors[:40] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(rest / np.maximum(rows.length, 1)) < 0.7**levels
