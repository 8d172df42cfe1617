import random
import re

import pytest
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.chunking import chunk_filings, chunk_sections, chunk_texts, tail_slice, window_texts

SETTINGS = Settings()
TOKEN = re.compile(r"\w+|[^\w\s]")


def spans(text):
    return [m.span() for m in TOKEN.finditer(text)]


def model_windows(text):
    at = spans(text)
    if not at:
        return [text]
    return [text[at[i][0]:at[min(i + 800, len(at)) - 1][1]].strip() for i in range(0, len(at), 680)]


def model_chunks(text):
    """The rules of chunking, spelled out with lists of (sentence, tokens)."""
    text = text.strip()
    if not text:
        return []
    if len(spans(text)) <= 800:
        return [text]
    out, buffer = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        n = len(spans(sentence))
        used = sum(c for _, c in buffer)
        if n > 800:
            if buffer:
                out.append(" ".join(s for s, _ in buffer))
            buffer = []
            out += model_windows(sentence)
            continue
        if buffer and used + n > 800:
            out.append(" ".join(s for s, _ in buffer))
            keep, room = [], 120
            while len(keep) < len(buffer) and buffer[-1 - len(keep)][1] <= room:
                room -= buffer[-1 - len(keep)][1]
                keep.append(buffer[-1 - len(keep)])
            if not keep:
                last = buffer[-1][0]
                tail = last[spans(last)[-120][0]:].strip()
                keep = [(tail, 120)]
            buffer = keep[::-1]
        buffer.append((sentence, n))
    if buffer:
        out.append(" ".join(s for s, _ in buffer))
    joined = []
    for chunk in out:
        if joined and len(spans(chunk)) < 32:
            joined[-1] += " " + chunk
        else:
            joined.append(chunk)
    if len(joined) > 1 and len(spans(joined[0])) < 32:
        joined[:2] = [joined[0] + " " + joined[1]]
    return [piece for chunk in joined for piece in (model_windows(chunk) if len(spans(chunk)) > 840 else [chunk])]


def sentence(n, start=0):
    """A sentence of n tokens, the full stop included."""
    return " ".join(f"w{start + i}" for i in range(n - 1)) + "."


def chunks_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = df.select("i", chunk_texts(F.col("t"), SETTINGS).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.i)]


LAYOUTS = [
    [800], [801], [841], [1400], [1481], [1380], [400, 400], [400, 401], [120, 800], [100, 100, 600, 800, 50],
    [20, 900, 10], [700, 130, 700], [60, 60, 600, 100, 700], [5, 5, 1000], [31, 1361, 31], [799, 1, 1], [121, 680, 2],
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_layouts(spark, layout):
    text = " ".join(sentence(n, 1000 * i) for i, n in enumerate(layout))
    assert chunks_of(spark, [text]) == [model_chunks(text)]


def test_cap_case(spark):
    text = " ".join(sentence(n, 1000 * i) for i, n in enumerate([100, 100, 600, 800, 50]))
    assert [len(spans(c)) for c in chunks_of(spark, [text])[0]] == [800, 800, 240, 170]


def test_random_texts_match_model(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(120):
        lengths = [rng.choice([1, 5, 20, 60, 119, 120, 121, 300, 700, 799, 800, 801, 1500]) for _ in range(rng.randint(1, 14))]
        glue = rng.choice([" ", "\n", "  \n"])
        texts.append(glue.join(sentence(n, 3000 * i) for i, n in enumerate(lengths)) + rng.choice(["", " ", "\n"]))
    texts += ["", "  \n ", "...", "no end", "x" * 5000]
    got = chunks_of(spark, texts)
    assert got == [model_chunks(t) for t in texts]
    for text, chunks in zip(texts, got):
        assert all(len(spans(c)) <= 840 for c in chunks)
        assert set(TOKEN.findall(text)) == {t for c in chunks for t in TOKEN.findall(c)}


def test_windows_and_tail(spark):
    text = "  " + sentence(1400) + "\n"
    df = spark.createDataFrame([(text,), ("",), (" ",)], "t string")
    row = df.select(window_texts(F.col("t"), 800, 680).alias("w"), tail_slice(F.col("t"), 120).alias("tail")).collect()
    assert [len(spans(w)) for w in row[0].w] == [800, 720, 40]
    assert row[0].w == model_windows(text) and len(spans(row[0].tail)) == 120
    assert row[1].w == [""] and row[2].w == [" "] and row[2].tail == " "


def test_chunk_rows(spark):
    filing = [(
        "Acme", "ACM", "1", "10-K", 2024, "2024-12-31", "acc/1", "https://x",
        [(0, "Item 1", sentence(900)), (1, "Item 1A", "  "), (2, "Item 7", " short text. ")],
    )]
    schema = (
        "company_name string, ticker string, cik string, form_type string, fiscal_year int, fiscal_year_end_date string, "
        "accession_number string, source_url string, parsed_sections array<struct<ord:int,section:string,text:string>>"
    )
    rows = chunk_filings(spark.createDataFrame(filing, schema), SETTINGS).collect()
    assert sorted((r.section, r.chunk_index_in_section) for r in rows) == [("Item 1", 0), ("Item 1", 1), ("Item 7", 0)]
    short = next(r for r in rows if r.section == "Item 7")
    import hashlib

    assert short.text == "short text."
    assert short.chunk_id == hashlib.sha1(b"acc/1|Item 7|0|short text.").hexdigest()[:16]


def test_chunks_do_not_shuffle(spark):
    df = spark.createDataFrame([("a", "s", "t")], "accession_number string, section string, text string")
    plan = chunk_sections(df, SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
