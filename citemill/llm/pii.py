"""Personal data: four kinds by their form, and unseen identifiers by the contexts they share with them.

What the forms find are seed entities. The words around each seed and around
every other identifier-like token are lexical patterns. Over the graph of
patterns and instances Spark scores in turn patterns (the share of their
instances that is trusted, with enough of them) and instances (the chance that
one of their patterns is right). Instances above a threshold are trusted in the
next round, and their spans are reported as ``context``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from citemill.llm.batches import text_column
from citemill.session import stage

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 5.0, 0.8, 0.95
MIN_DIGITS, MIN_LENGTH, MAX_LENGTH = 4, 8, 64

# The lookbehinds only skip starts that cannot match, inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONTEXT_CHARS = 80

_SPAN = StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_MENTION = StructType([
    StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("instance", StringType()),
    StructField("seed", BooleanType()), StructField("patterns", ArrayType(StringType())),
])
FOUND = StructType([StructField("spans", ArrayType(_SPAN)), StructField("mentions", ArrayType(_MENTION))])


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address form, from each at sign outwards, so that a long run without one costs nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            end = match.end()
        else:
            end = max(end, at)  # nothing before this sign can be part of a later match
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def formed(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four forms, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def identifiers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens of letters, digits and joints with enough digits to be an identifier, beside the spans ``taken``."""
    out, end, k = [], 0, 0
    taken = sorted(taken)
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > end and text[a - 1] in _TOKEN:
            a -= 1
        while b < len(text) and text[b] in _TOKEN:
            b += 1
        end = b
        while b > a and text[b - 1] in "._/-":
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        if MIN_LENGTH <= b - a <= MAX_LENGTH and sum(map(str.isdigit, text[a:b])) >= MIN_DIGITS:
            out.append((a, b))
    return out


def _plain(word: str) -> str:
    return re.sub(r"[0-9]+", "#", word.lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the word before, the two before, the words on either side, what is glued to it.
    Words are looked for within ``CONTEXT_CHARS`` characters of the span, on its line."""
    before = text[max(0, start - CONTEXT_CHARS) : start].rpartition("\n")[2]
    after = text[end : end + CONTEXT_CHARS].partition("\n")[0]
    left = [_plain(w) for w in _WORD.findall(before)[-2:]]
    right = [_plain(w) for w in _WORD.findall(after)[:1]]
    out = []
    if left:
        out.append(f"1 {left[-1]}")
        if len(left) == 2:
            out.append(f"2 {left[0]} {left[1]}")
        if right:
            out.append(f"3 {left[-1]} _ {right[0]}")
    if right:
        out.append(f"4 _ {right[0]}")
    glued = before[len(before.rstrip("=:\"'([{<")) :]
    if glued and left:
        out.append(f"5 {left[-1]}")
    return out


def find(text: str | None) -> dict:
    text = text or ""
    spans = formed(text)
    taken = [(a, b) for _, a, b in spans]
    mentions = [(a, b, True) for a, b in taken]
    mentions += [(a, b, False) for a, b in identifiers(text, taken)] if _DIGITS.search(text) else []
    return {
        "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans],
        "mentions": [
            {"start": a, "end": b, "instance": hashlib.md5(text[a:b].encode()).hexdigest(), "seed": seed, "patterns": contexts(text, a, b)}
            for a, b, seed in mentions
        ],
    }


def trusted_instances(
    edges: DataFrame, rounds: int = ROUNDS, min_seeds: float = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """(instance, score) of instances that are no seeds and are trusted after ``rounds`` rounds.

    ``edges`` (pattern, instance, seed) has a row for each pattern an instance was seen with. A pattern counts with
    at least ``min_seeds`` trusted instances that make up ``min_confidence`` of all; its confidence is that share,
    with one failure added. An instance is trusted if two patterns or more give it ``min_score`` together.
    """
    trusted = None
    for _ in range(rounds):
        known = edges.withColumn("good", F.col("seed").cast("double"))
        if trusted is not None:
            known = edges.join(trusted, "instance", "left").withColumn(
                "good", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
            )
        patterns = known.groupBy("pattern").agg(F.sum("good").alias("good"), F.count("*").alias("n")).where(
            (F.col("good") >= min_seeds) & (F.col("good") >= min_confidence * F.col("n"))
        ).select("pattern", (F.col("good") / (F.col("n") + 1)).alias("confidence"))
        trusted = stage(
            edges.where("NOT seed").join(patterns, "pattern").groupBy("instance").agg(
                F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9).alias("score"), F.count("*").alias("n"),
            ).where((F.col("score") >= min_score) & (F.col("n") >= 2)).select("instance", "score"), "trusted",
        )
    return trusted


def detect(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, text_key, spans) for each row of ``docs`` (doc_id, text; other columns are not read): all spans as
    structs of kind (a number of ``KINDS``), start and end in code points, by kind and start.

    ``text_key`` is a hash of doc_id and text that tells rows apart. A null text has no spans. ``limits`` go to
    :func:`trusted_instances`.
    """
    found = stage(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), text_column(lambda ts: [find(t) for t in ts], FOUND, "text").alias("f"))
        .select("doc_id", "text_key", "f.*"), "found",
    )
    mentions = found.where("size(mentions) > 0").select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.*")
    edges = mentions.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(
        F.max("seed").alias("seed")
    )
    trusted = trusted_instances(stage(edges, "edges"), **limits)
    more = (
        mentions.where("NOT seed").join(trusted, "instance")
        .select("text_key", F.struct(F.lit(KINDS.index("context")).alias("kind"), "start", "end").alias("span"))
        .distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("span")).alias("more"))
    )
    return found.join(more, "text_key", "left").select(
        "doc_id", "text_key", F.concat("spans", F.coalesce("more", F.array().cast(ArrayType(_SPAN)))).alias("spans")
    )


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) for each row of ``docs``; spans are
    written kind:start:end and joined by commas, base_sha256 is of those of the four forms."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return detect(docs, **limits).select(
        "doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def masked_texts(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; spans that overlap are one, named
    after the first. Other columns stay as they are; null texts stay null."""

    def run(batch: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(batch.to_pylist(), spans.to_pylist()):
            parts, end = [], 0
            for s in sorted(found or [], key=lambda s: (s["start"], s["kind"])):
                if s["start"] >= end:
                    parts += [text[end : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                end = max(end, s["end"])
            out.append("".join([*parts, text[end:]]) if parts else text)
        return pa.array(out, pa.string())

    run.__annotations__ = {"batch": pa.Array, "spans": pa.Array, "return": pa.Array}
    key, spans = "pii_key", "pii_spans"
    while {key, spans} & set(docs.columns):
        key, spans = f"{key}_", f"{spans}_"
    # Only rows with spans are in the table of spans; the others have no match in it.
    found = detect(docs, **limits).where("size(spans) > 0").select(F.col("text_key").alias(key), F.col("spans").alias(spans))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found.dropDuplicates([key]), key, "left")
    masked = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.arrow_udf(run, StringType())("text", spans))
    return joined.select(*[masked.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
