"""Queries of the operators over their whole tables, and SQL that gives the same rows where it can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citemill.llm import (
    bpe, decontaminate, fill_middle, hard_negatives, html_main, language, near_dedup, pii, repetition, simhash,
    substring_dedup, toxicity, weak_quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(rf"""
WITH RECURSIVE
lowered AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM lowered)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT x AS node, y AS other FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other),
found AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN found f ON f.node = d.doc_id
""")
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near copies by 4-word shingles at a similarity of 0.8."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle_words=4)


@query(rf"""
WITH split AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (s) WHERE doc_id > low),
listed AS (SELECT doc_id, list(i) AS gone FROM removed GROUP BY 1),
cut AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w
  ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM split LEFT JOIN listed USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
""")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words in passages of 50 words that an earlier document has."""
    return substring_dedup.shared_passages(table(spark, folder, "documents"))


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from four fifths of them."""
    return language.held_out_languages(table(spark, folder, "documents"))


@query()
def op10_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents and the text they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(table(spark, folder, "documents"), path).drop("ids")


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of all documents."""
    return toxicity.toxic_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _windows(k: int, source: str = "split") -> str:
    """Places of the words inside windows of k words that are in their text twice or more."""
    return rf"""
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS times
      FROM (SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM (
        SELECT doc_id, list_transform(range(1, len(w) - {k - 2}), lambda i: md5(array_to_string(w[i:i + {k - 1}], ' '))) AS hs
        FROM {source} WHERE len(w) >= {k})))
    WHERE times > 1) GROUP BY 1"""


# A repeated window lies in repeated shorter ones, so longer ones are looked for only where enough words do.
@query(rf"""
WITH split AS (SELECT doc_id, text, {WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
thirds AS ({_windows(3)}), partly AS (SELECT * FROM split WHERE doc_id IN (SELECT doc_id FROM thirds WHERE n >= 8)),
eights AS ({_windows(8, "partly")}), few AS (SELECT * FROM split WHERE doc_id IN (SELECT doc_id FROM eights WHERE n >= 101)),
long AS ({_windows(101, "few")}),
counted AS (
  SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words,
    coalesce(e.n, 0) AS n_covered_words, l.n IS NOT NULL AS too_long
  FROM split s LEFT JOIN thirds t USING (doc_id) LEFT JOIN eights e USING (doc_id) LEFT JOIN long l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 45 * n_words AND NOT too_long AS kept
FROM counted
""")
def op1_suffix_array_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition inside each document."""
    return repetition.repetition(table(spark, folder, "documents")).drop("longest_repeat", "spans")


@query()
def op4_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.personal_data(table(spark, folder, "documents"))


@query()
def op2_html_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Main texts of all pages."""
    return html_main.main_texts(table(spark, folder, "pages"))


@query()
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that give benchmark items away, a row for each document and item."""
    return decontaminate.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op5_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents from weak labels."""
    return weak_quality.quality(table(spark, folder, "documents"))


@query(r"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS d
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda i: ('0x' || substr(d, (8 * i + 1)::BIGINT, 8))::BIGINT) AS h FROM cut),
placed AS (
  SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""")
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents, as digests."""
    return fill_middle.fill_in_middle_digests(table(spark, folder, "documents"))


@query()
def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose fingerprints differ in at most two bits."""
    return simhash.simhash_components(table(spark, folder, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the vectors whose vec_id is divisible by 100."""
    return hard_negatives.label_negatives(table(spark, folder, "embeddings"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)
