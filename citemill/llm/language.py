"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over every training row: each task adds n-grams into a matrix
of (language, bucket) and sends its non-zero cells, which Spark sums. The
matrix of log probabilities has languages x buckets cells, a bound that does
not depend on the corpus, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citemill.llm.batches import slices, text_column

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
MAX_LANGUAGES = 500
UNKNOWN = "und"
_SPACE, _MARK = ord(" "), ord("\x00")


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the lower-cased texts end to end, and where each text begins.

    All that is no letter counts as a space. A place gives an n-gram of each size; those that cross into the next
    text have a mark in place of its characters.
    """
    joined = "\x00".join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.flatnonzero(codes == _MARK) + 1)) if len(texts) else np.zeros(0, np.int64)
    if len(starts) != len(texts):  # a text has the mark, or lower case makes more of it
        return grams([t.replace("\x00", " ") for t in texts], buckets)
    letters = (codes >= 0x80) | ((codes >= 97) & (codes <= 122)) | (codes == _MARK)
    h = np.where(letters, codes, _SPACE).astype(np.uint32)
    out = np.zeros((len(h), len(SIZES)), dtype=np.int32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    acc = np.zeros(len(h), dtype=np.uint32)
    padded = np.concatenate((h, np.zeros(max(SIZES), np.uint32)))
    for n in range(1, max(SIZES) + 1):
        acc = (acc * np.uint32(0x01000193)) ^ padded[n - 1 : n - 1 + len(h)]
        if n in SIZES:
            out[:, SIZES.index(n)] = ((acc + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift
    return out.reshape(-1), starts * len(SIZES)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix (languages, buckets + 1) of log probabilities; its last column is the priors.

    Rows whose text or language is null teach nothing.
    """
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in slices(batch.column(1)):
                langs, texts = (c[a:b].to_pylist() for c in batch.columns)
                for name in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs) if x == name]
                    total = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                    total[:-1] += np.bincount(grams(own, buckets)[0], minlength=buckets)
                    total[-1] += len(own)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(used)), "bucket": pa.array(used, pa.int32()), "n": pa.array(total[used])
            })

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    cells = known.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix = np.zeros((len(names), buckets + 1))
    table = cells.toArrow()  # at most languages * buckets rows
    place = {name: i for i, name in enumerate(names)}
    rows = np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    matrix[rows, table["bucket"].to_numpy()] = table["n"].to_numpy()
    if len(names):
        matrix[:, -1] = np.log(matrix[:, -1] / matrix[:, -1].sum())
        body = matrix[:, :-1] + 0.5
        matrix[:, :-1] = np.log(body / body.sum(axis=1, keepdims=True))
    return names, matrix


def predict(model: tuple[list[str], np.ndarray], docs: DataFrame, text: str = "text") -> Column:
    """A struct of lang_pred and score, the posterior. Equal posteriors give the language first in order.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    """
    names, matrix = model
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    # In rows by bucket, so that an n-gram reads neighbouring cells.
    shared = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(matrix[:, :-1].T, np.float32), matrix[:, -1]))

    def run(texts: list) -> list:
        names, table, priors = shared.value
        out = [{"lang_pred": UNKNOWN, "score": 0.0}] * len(texts)
        usable = [i for i, t in enumerate(texts) if has_letter(t)]
        if not usable or not names:
            return out
        cells, starts = grams([texts[i] for i in usable], len(table))
        ends = np.append(starts[1:], len(cells))
        for i, a, b in zip(usable, starts.tolist(), ends.tolist()):
            times = np.bincount(cells[a:b], minlength=len(table))
            used = np.flatnonzero(times)
            logs = times[used] @ table[used].astype(np.float64) + priors
            best = int(np.argmax(logs))
            out[i] = {"lang_pred": names[best], "score": float(1 / np.exp(logs - logs[best]).sum())}
        return out

    return text_column(run, kind, F.col(text))


def held_out_languages(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang; others are not read).

    Learns from the rows whose crc32 of the doc_id as text is not 0 modulo 5. A row without doc_id has a null
    remainder: it teaches nothing and is held out. Predictions use the text alone.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = train(docs.where(~held), buckets=buckets)
    return docs.select("doc_id", held.alias("held_out"), predict(model, docs).alias("p")).select("doc_id", "held_out", "p.*")
