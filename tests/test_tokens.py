import random
import re
import time
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_chunking import LAYOUTS, model_chunks, sentence

from citemill.config import Settings, from_tree
from citemill.functions import tokens
from citemill.functions.text import GAPS, SPACES
from citemill.operators.boundaries import abbreviations, learned_sentences, learned_types
from citemill.operators.chunking import chunk_sections

SETTINGS = Settings()
PATTERN = "citemill.functions.tokens:pattern_tokenizer"
BPE = "/opt/tokenizers/word_bpe_49k.json"


def chunked(spark, texts, settings):
    rows = [(str(i), "s", t, "other") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "accession_number string, section string, text string, tokens string").repartition(4)
    out = {}
    for r in chunk_sections(df, settings).collect():
        assert r.tokens == "other"
        out.setdefault(int(r.accession_number), {})[r.chunk_index_in_section] = r.text
    return [[out.get(i, {})[k] for k in sorted(out.get(i, {}))] for i in range(len(texts))]


def test_offsets_pack_as_the_pattern_does(spark):
    draw = random.Random(8)
    texts = [" ".join(sentence(n, 1000 * k) for k, n in enumerate(layout)) for layout in LAYOUTS] + ["", "  ", "one.", None]
    texts += [" \n".join(sentence(draw.choice((2, 30, 119, 121, 700, 900))) for _ in range(draw.randrange(1, 9))) for _ in range(15)]
    got = chunked(spark, texts, replace(SETTINGS, tokenizer_loader=PATTERN))
    assert got == [model_chunks(t or "") for t in texts] and got == chunked(spark, texts, SETTINGS)


def test_chunks_of_a_tokenizer_file(spark):
    settings = replace(
        SETTINGS, tokenizer_loader="citemill.functions.tokens:file_tokenizer", tokenizer_path=BPE, chunk_size_tokens=60, chunk_overlap_tokens=10,
        min_chunk_tokens=5,
    )
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    docs.append("\U0001f600 é " * 200 + "end. Next one.")
    count = tokens.file_tokenizer(BPE)
    length = lambda t: len(count([t])[0])
    found = chunked(spark, docs, settings)
    for text, chunks in zip(docs, found):
        text = text or ""
        # A cut may tokenize a little differently from the text it was cut from.
        assert all(length(c) <= settings.safe_max_tokens + 3 for c in chunks)
        assert all(any(w in c for c in chunks) for w in set(text.split()) if length(w) <= 8)
    assert max(map(len, found)) > 5


def test_tokenizer_in_settings():
    got = from_tree({"chunking": {"tokenizer_loader": PATTERN, "tokenizer_path": "x"}}, {})
    assert (got.tokenizer_loader, got.tokenizer_path) == (PATTERN, "x")
    assert tokens.pattern_tokenizer()(["a b-c", ""]) == [[(0, 1), (2, 3), (3, 4), (4, 5)], []]


def told(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_abbreviations_are_learned_and_do_not_end_sentences(spark):
    draw = random.Random(2)
    words = ["house", "river", "green", "walks", "under", "stone", "seven", "light"]
    texts = []
    for i in range(120):
        body = [draw.choice(words) for _ in range(40)]
        body[5], body[20], body[30] = "approx.", "e.g.", "(Dr."
        texts.append(" ".join(body) + f". Then it {draw.choice(words)}.\nWhy? Yes")
    df = told(spark, texts + [None, ""])
    types = learned_types(df)
    assert {"e.g", "dr"} <= set(types) and not set(types) & set(words)
    split = learned_sentences(F.col("text"), types)
    one = told(spark, ["We met (Dr.  Who) e.g. here. He left! Why?  Yes", "", None, "e.g. e.g.", " end. "]).select(split.alias("s"))
    assert [r.s for r in one.collect()] == [["We met (Dr.  Who) e.g. here.", "He left!", "Why?", "Yes"], [], None, ["e.g. e.g."], ["end."]]
    plain = told(spark, ["A e.g. b. C"]).select(learned_sentences(F.col("text"), []).alias("s")).first().s
    assert plain == ["A e.g.", "b.", "C"]


def test_chunks_by_learned_sentences(spark):
    from test_store import filings

    from citemill.operators.chunking import chunk_filings

    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice(("house", "river", "green", "walks", "under", "stone", "light")) for _ in range(n))
    text = " ".join(f"{some(20)}. {some(9)} e.g. {some(15)}." for _ in range(60))
    rows = filings(spark, "aa").withColumn("parsed_sections", F.array(F.struct(F.lit(0).alias("ord"), F.lit("Item 1").alias("section"), F.lit(text).alias("text"))))
    learned = [r.text for r in chunk_filings(rows, replace(SETTINGS, sentence_splitter="learned", chunk_size_tokens=100, chunk_overlap_tokens=35, min_chunk_tokens=1)).collect()]
    assert not any(c.endswith("e.g.") for c in learned)


def test_no_words_have_no_abbreviations(spark):
    assert abbreviations(told(spark, [None, "", "1. 2. 3."])).collect() == [] and abbreviations(told(spark, ["x"]).where("false")).collect() == []
    with pytest.raises(ValueError):
        import citemill.operators.boundaries as boundaries

        boundaries.MAX_TYPES, kept = 0, boundaries.MAX_TYPES
        try:
            learned_types(told(spark, ["see z.B. one e.g. two i.e. three " * 30 + "and so on. The end."]), threshold=0.0)
        finally:
            boundaries.MAX_TYPES = kept


def test_offsets_are_taken_in_slices(spark):
    seen = []

    def load():
        def tokenize(texts):
            seen.append(sum(map(len, texts)))
            return [[(i, i + 1) for i in range(len(t))] for t in texts]

        return tokenize

    run = tokens.offsets_of(load).func
    texts = [["a" * 200_000, "", "b" * 200_000], None, ["c" * 200_000] * 3, [], ["d" * 900_000], ["e"]]
    got = list(run(iter([pa.array(texts, pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))])))
    # Of a batch of rows, only a slice of its texts is tokenized at a time; a longer text goes alone.
    assert max(seen) == 900_000 and len(seen) >= 4 and sorted(seen)[-2] <= tokens.SLICE_CHARS
    assert [[len(t) for t in row] for row in got[0].to_pylist()] == [[200_000, 0, 200_000], [], [200_000] * 3, [], [900_000], [1]]
    assert len(got[1]) == 0


def test_learned_sentences_of_long_words_take_linear_time(spark):
    # Words without white space, as in texts that are written without it; the last word of each sentence was sought from every place.
    text = " ".join("\u5b57" * 60_000 + "z.B. x." for _ in range(3))
    one = spark.range(1).select(F.lit(text).alias("text"))
    start = time.monotonic()
    got = one.select(learned_sentences(F.col("text"), ["z.b"]).alias("s")).first().s
    assert [len(s) for s in got] == [60_004, 2] * 3
    assert time.monotonic() - start < 20


def test_learned_sentences_match_every_boundary(spark):
    draw = random.Random(5)
    pieces = ["z.B.", "(z.B.)", "end.", "why?!", "a.b", "...", ".", "!", "\u300cz.B.\u300d", "word", " ", "\u3000", "\n", "\u2003", "\x85", "\xa0"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 30))) for _ in range(300)] + ["", " ", None]
    space = "[" + re.escape(SPACES) + "]"
    edges = "()[]{}\"'\u201c\u201d\u2018\u2019\u00ab\u00bb,;:"

    def plain(text):
        out, held = [], ""
        for part in re.findall(f"(?s).*?[.!?]{space}+|.+$", text):
            held += part
            last = re.search(f"[^{re.escape(SPACES)}]+$", part.strip(SPACES))
            word = last.group().strip(edges) if last else ""
            if not (word.endswith(".") and word.lower()[:-1] == "z.b"):
                out, held = [*out, held], ""
        return [s for s in (x.strip(SPACES) for x in [*out, held]) if s]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", learned_sentences(F.col("text"), ["z.b"]).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else plain(t) for t in texts]


def test_gaps_are_the_spaces():
    assert {chr(i) for i in range(0x10000) if re.match(f"[{GAPS}]", chr(i))} == set(SPACES)
