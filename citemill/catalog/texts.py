"""Queries on text: cleaning, sections, sentences, tokens and chunks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.catalog import sqltext as q
from citemill.catalog.registry import Tables, query
from citemill.config import Settings
from citemill.functions.binding import let
from citemill.functions.hashing import chunk_id, text_sha256
from citemill.functions.text import keywords, normalize_text, sentences, token_count
from citemill.operators import ingest, sections
from citemill.operators.boundaries import abbreviations as find_abbreviations
from citemill.operators.boundaries import learned_sentences, learned_types
from citemill.operators.chunking import chunk_sections, tail_slice, window_texts
from citemill.sources.files import html_text

SETTINGS = Settings()


# No document has page furniture or item headings, so both are put in by the
# same expression here and in the SQL. {n} runs over the document ids.
FURNISHED = """concat(
  CASE WHEN doc_id % 2 = 0 THEN concat(CAST(doc_id % 90 AS {str}), ' Item 1. ') ELSE '' END,
  text,
  CASE WHEN doc_id % 3 = 0 THEN concat({nl}, 'Acme Inc.2025 Form 10-K', {nl}, '| 12 |', {nl}) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('  Table of Contents', {nl}, {nl}, {nl}, '17', {nl}) ELSE '' END,
  source, '  ')"""
HEADED = """concat(
  'Contents', {nl},
  CASE WHEN doc_id % 7 <> 1 THEN concat(CASE WHEN doc_id % 2 = 0 THEN 'Item\u00a01.\u00a0Business ' ELSE 'Item 1. Business ' END, text, {nl}) ELSE '' END,
  CASE WHEN doc_id % 7 <> 2 THEN concat('ITEM 1A. Risk\u2009\u00a0Factors ', text, {nl}) ELSE '' END,
  CASE WHEN doc_id % 7 <> 3 THEN concat('Item 7. Management ', source, {nl}) ELSE '' END,
  CASE WHEN doc_id % 7 <> 4 THEN concat('Item 7A ', lang, {nl}) ELSE '' END,
  CASE WHEN doc_id % 7 <> 5 THEN concat('Item 8. Financial Statements ', text, {nl}) ELSE '' END,
  CASE WHEN doc_id % 7 <> 6 THEN concat('Item 9A', ' Controls  ', {nl}) ELSE '' END)"""


def _spark(template: str):
    return F.expr(template.format(str="string", nl="chr(10)"))


def _duck(template: str) -> str:
    return template.format(str="varchar", nl="chr(10)")


@query(f"""
SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS n_chars
FROM (SELECT doc_id, {q.normalized('raw')} AS clean FROM (SELECT doc_id, {_duck(FURNISHED)} AS raw FROM documents))
""")
def normalize_texts(t: Tables) -> DataFrame:
    clean = t.texts.select("doc_id", normalize_text(_spark(FURNISHED)).alias("clean"))
    return clean.select(
        "doc_id", F.md5(F.encode("clean", "UTF-8")).alias("clean_md5"), F.length("clean").alias("n_chars")
    )


# White space as RE2 writes it: the ASCII ones, then the separators of Unicode.
_GAP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"
_STOP = _GAP.replace("[", "[.", 1)
_HEADINGS = (
    ("Item 1", f"(?i)item{_GAP}*1{_STOP}+business"), ("Item 1A", f"(?i)item{_GAP}*1a{_STOP}+risk{_GAP}+factors"),
    ("Item 7", f"(?i)item{_GAP}*7{_STOP}+management"), ("Item 7A", f"(?i)item{_GAP}*7a"),
    ("Item 8", f"(?i)item{_GAP}*8{_STOP}+financial{_GAP}+statements"), ("Item 9A", f"(?i)item{_GAP}*9a"),
)


def _heading_sql() -> str:
    starts, ends = [], []
    for i, (label, pattern) in enumerate(_HEADINGS):
        starts.append(f"len(regexp_extract(body, '(?s)^(.*?)(?:' || '{pattern}' || ')', 1)) AS s{i}, "
                      f"regexp_matches(body, '{pattern}') AS f{i}")
        if i + 1 < len(_HEADINGS):
            nxt = _HEADINGS[i + 1][1]
            rest = f"substr(body, s{i} + 2)"
            ends.append(
                f"SELECT doc_id, {i} AS ord, '{label}' AS section, CASE WHEN regexp_matches({rest}, '{nxt}') "
                f"THEN substr(body, s{i} + 1, 1 + len(regexp_extract({rest}, '(?s)^(.*?)(?:' || '{nxt}' || ')', 1))) "
                f"ELSE substr(body, s{i} + 1) END AS part FROM found WHERE f{i}"
            )
        else:
            ends.append(f"SELECT doc_id, {i}, '{label}', substr(body, s{i} + 1) FROM found WHERE f{i}")
    return (
        f"WITH raw AS (SELECT doc_id, {_duck(HEADED)} AS body FROM documents), "
        f"found AS (SELECT doc_id, body, {', '.join(starts)} FROM raw), "
        f"sec AS ({' UNION ALL '.join(ends)}) "
    )


@query(_heading_sql() + f"""
SELECT doc_id, ord, section, md5({q.strip('part')}) AS text_md5 FROM sec
""")
def sections_by_heading(t: Tables) -> DataFrame:
    found = t.texts.select("doc_id", sections.headed_sections(_spark(HEADED)).alias("s"))
    # The outer form keeps Spark from testing the array for emptiness beforehand,
    # which would extract the sections twice.
    return found.select("doc_id", F.explode_outer("s").alias("s")).where("s IS NOT NULL").select(
        "doc_id", "s.ord", "s.section", F.md5(F.encode("s.text", "UTF-8")).alias("text_md5")
    )


ITEMS = {
    "Item 1": "text", "Item 1A": "concat(source, ' ', text)", "Item 7": "CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE text END",
    "Item 7A": "lang", "Item 8": "CASE WHEN doc_id % 3 <> 0 THEN concat(text, ' ') END", "Item 9A": "concat(lang, ' ', source)",
}


@query("WITH item AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{label}' AS section, {q.normalized(e)} AS clean FROM documents"
    for i, (label, e) in enumerate(ITEMS.items())
) + ") SELECT doc_id, ord, section, md5(clean) AS text_md5 FROM item WHERE length(clean) >= 30 AND lower(clean) <> 'none'")
def sections_by_label(t: Tables) -> DataFrame:
    pairs = [part for label, e in ITEMS.items() for part in (F.lit(label), F.expr(e))]
    kept = t.texts.select("doc_id", F.explode(sections.labelled_sections(F.create_map(*pairs))).alias("s"))
    return kept.select("doc_id", "s.ord", "s.section", F.md5(F.encode("s.text", "UTF-8")).alias("text_md5"))


@query(_heading_sql() + f"""
, held AS (SELECT doc_id, section, length({q.strip('part')}) AS n FROM sec),
want AS (SELECT doc_id, unnest(['Item 1', 'Item 1A', 'Item 7']) AS section FROM documents),
opt AS (SELECT doc_id, unnest(['Item 7A', 'Item 8', 'Item 9A']) AS section FROM documents)
SELECT *, CASE WHEN n_missing + n_truncated > 0 THEN 'failed' ELSE 'ok' END AS status FROM (
SELECT d.doc_id,
  (SELECT count(*) FROM want w WHERE w.doc_id = d.doc_id AND NOT EXISTS
     (SELECT 1 FROM held h WHERE h.doc_id = w.doc_id AND h.section = w.section)) AS n_missing,
  (SELECT count(*) FROM held h WHERE h.doc_id = d.doc_id AND n < 500
     AND section IN ('Item 1', 'Item 1A', 'Item 7')) AS n_truncated,
  (SELECT count(*) FROM opt o WHERE o.doc_id = d.doc_id AND NOT EXISTS
     (SELECT 1 FROM held h WHERE h.doc_id = o.doc_id AND h.section = o.section)) AS n_warnings
FROM documents d)
""")
def section_gate(t: Tables) -> DataFrame:
    parsed = t.texts.select("doc_id", sections.headed_sections(_spark(HEADED)).alias("parsed_sections"))
    return sections.gate_sections(parsed).select(
        "doc_id", F.size("missing").alias("n_missing"), F.size("truncated").alias("n_truncated"),
        F.size("warnings").alias("n_warnings"), "status",
    )


@query("""
SELECT o_orderkey,
  coalesce(try_cast(substr(period, 1, 4) AS INTEGER), 2026) AS fiscal_year,
  CASE WHEN o_orderpriority IN ('10-K', '10-K/A') THEN o_orderpriority ELSE '10-K' END AS form_type,
  coalesce(nullif(a, ''), nullif(b, ''), '') AS source_url,
  replace(o_orderpriority, '/', '_') AS file_key
FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'FY' || o_orderdate::VARCHAR ELSE o_orderdate::VARCHAR END AS period,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'https://a' END AS a,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'https://b' END AS b FROM orders)
""")
def filing_fields(t: Tables) -> DataFrame:
    period = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("FY"), F.col("o_orderdate").cast("string"))).otherwise(
        F.col("o_orderdate").cast("string")
    )
    return t.orders.select(
        "o_orderkey",
        ingest.fiscal_year(period, 2026).alias("fiscal_year"),
        ingest.known_form(F.col("o_orderpriority")).alias("form_type"),
        ingest.first_filled(
            F.when(F.col("o_orderstatus") == "F", "").otherwise("https://a"),
            F.when(F.col("o_orderstatus") != "O", "https://b"),
        ).alias("source_url"),
        F.replace("o_orderpriority", F.lit("/"), F.lit("_")).alias("file_key"),
    )


@query(f"""
SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '~')) AS sentences_md5
FROM (SELECT doc_id, {q.sentence_list(q.strip('text'))} AS s FROM documents)
""")
def sentence_split(t: Tables) -> DataFrame:
    split = t.texts.select("doc_id", sentences(F.btrim("text", F.lit(q.SPACES))).alias("s"))
    return split.select(
        "doc_id", F.size("s").alias("n_sentences"),
        F.md5(F.encode(F.array_join("s", "~"), "UTF-8")).alias("sentences_md5"),
    )


# No text has abbreviations, so some are put in by the same expression here and in the SQL: behind every whole word
# "of", "de", "la" or "der" inside a line stands one. Words that end sentences have other words' share of stops.
ABBREVIATED = r"regexp_replace(text, ' (of|de|la|der) ', ' $1 z.B. approx. '{flag})"
_EDGES = """'()[]{}"''“”‘’«»,;:'"""
_LEARNED = q.with_("told AS (SELECT doc_id, " + ABBREVIATED.format(flag=", 'g'").replace("$1", r"\1") + " AS text FROM documents)", rf"""
word AS (SELECT trim(w, {_EDGES}) AS w FROM (SELECT unnest(regexp_split_to_array(text, '{q.S}+')) AS w FROM told) WHERE w <> ''),
typed AS (SELECT regexp_replace(lower(w), '\.$', '') AS type, w LIKE '%.' AS stop FROM word),
types AS MATERIALIZED (
  SELECT type, count(*) FILTER (stop) AS with_stop, count(*) FILTER (NOT stop) AS without_stop FROM typed
  WHERE regexp_matches(type, '\p{{L}}') GROUP BY 1),
share AS (SELECT least(greatest(sum(with_stop) / sum(with_stop + without_stop), 1e-9), 1 - 1e-9)::DOUBLE AS p FROM types),
scored AS (
  SELECT type, with_stop, without_stop, 2 * (with_stop * ln(0.99::DOUBLE / p) + without_stop * (ln(0.01::DOUBLE) - ln(1 - p)))
    * exp(-l) * (length(type) - l + 1) * pow(l::DOUBLE, -without_stop) AS score
  FROM (SELECT *, length(replace(type, '.', '')) AS l FROM types WHERE with_stop > 0), share),
abbreviation AS (SELECT * FROM scored WHERE score >= 0.3)""")


def _told(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", F.expr(ABBREVIATED.format(flag="")).alias("text"))


@query(_LEARNED + "SELECT type, with_stop, without_stop, round(score, 4) AS score FROM abbreviation")
def abbreviations(t: Tables) -> DataFrame:
    """Word types that the corpus itself shows to be abbreviations."""
    return find_abbreviations(_told(t)).withColumn("score", F.round("score", 4))


@query(_LEARNED.rstrip() + rf""",
stretch AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i
  FROM (SELECT doc_id, regexp_extract_all(trim(text, '{q.SPACES}'), '(?s)(.*?[.!?]{q.S}+|.+$)') AS parts FROM told)),
ended AS (
  SELECT doc_id, i, part, NOT (trim(last, {_EDGES}) LIKE '%.' AND regexp_replace(lower(trim(last, {_EDGES})), '\.$', '') IN (SELECT type FROM abbreviation)) AS ends
  FROM (SELECT *, regexp_extract({q.strip('part')}, '[^{q.SPACES}]+$') AS last FROM stretch)),
numbered AS (
  SELECT doc_id, i, part, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ended),
sentence AS (SELECT doc_id, s, {q.strip("string_agg(part, '' ORDER BY i)")} AS text FROM numbered GROUP BY ALL)
SELECT doc_id, count(*) AS n_sentences, md5(string_agg(text, '~' ORDER BY s)) AS sentences_md5 FROM sentence WHERE text <> '' GROUP BY 1
""")
def sentence_split_learned(t: Tables) -> DataFrame:
    """Sentences that do not end after a learned abbreviation."""
    told = _told(t)
    row = lambda s: F.when(F.size(s) > 0, F.array(F.struct(
        F.size(s).cast("long").alias("n_sentences"), F.md5(F.encode(F.array_join(s, "~"), "UTF-8")).alias("sentences_md5")
    )))
    split = learned_sentences(F.btrim("text", F.lit(q.SPACES)), learned_types(told))
    found = told.select("doc_id", F.explode_outer(let(split, row)).alias("s"))
    # A filter on the array would be moved below and split the text twice.
    return found.where("s IS NOT NULL").select("doc_id", "s.n_sentences", "s.sentences_md5")


@query(f"SELECT doc_id, {q.n_tokens('text')} AS n_tokens FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(k, ' ')) AS keywords_md5 "
       f"FROM (SELECT doc_id, {q.keyword_list('text')} AS k FROM documents)")
def keyword_tokens(t: Tables) -> DataFrame:
    kept = t.texts.select("doc_id", keywords(F.col("text")).alias("k"))
    return kept.select(
        "doc_id", F.size("k").alias("n_keywords"),
        F.md5(F.encode(F.array_join("k", " "), "UTF-8")).alias("keywords_md5"),
    )


@query(f"SELECT doc_id, md5({q.tail('text')}) AS tail_md5 FROM documents")
def tail_slices(t: Tables) -> DataFrame:
    return t.texts.select(
        "doc_id",
        F.md5(F.encode(tail_slice(F.col("text"), SETTINGS.chunk_overlap_tokens), "UTF-8")).alias("tail_md5"),
    )


@query(f"""
SELECT doc_id, unnest(range(len(w))) AS idx, md5(unnest(w)) AS window_md5
FROM (SELECT doc_id, {q.windows(q.pieces('text'))} AS w FROM documents)
""")
def hard_split_windows(t: Tables) -> DataFrame:
    cut = window_texts(F.col("text"), SETTINGS.chunk_size_tokens, SETTINGS.split_stride)
    return t.texts.select("doc_id", F.posexplode(cut).alias("idx", "w")).select(
        "doc_id", "idx", F.md5(F.encode("w", "UTF-8")).alias("window_md5")
    )


@query(q.with_(q.CHUNKS) + """
SELECT acc AS accession_number, section, idx AS chunk_index_in_section, chunk_id, length(text) AS n_chars,
       md5(text) AS text_md5 FROM chunks
""")
def chunk_pack(t: Tables) -> DataFrame:
    return chunk_sections(t.sections, SETTINGS).select(
        "accession_number", "section", "chunk_index_in_section", "chunk_id",
        F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
    )


@query(q.with_(q.CHUNKS) + """
SELECT acc AS accession_number, section, idx AS chunk_index_in_section, chunk_id, length(text) AS n_chars,
       md5(text) AS text_md5 FROM chunks
""")
def chunk_pack_offsets(t: Tables) -> DataFrame:
    """The same chunks from token offsets of a loaded tokenizer, here the pattern's."""
    loaded = replace(SETTINGS, tokenizer_loader="citemill.functions.tokens:pattern_tokenizer")
    return chunk_sections(t.sections, loaded).select(
        "accession_number", "section", "chunk_index_in_section", "chunk_id",
        F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
    )


@query("""
SELECT conv_id, turn, substr(sha1(concat(conv_id, '|', role, '|', turn, '|', substr(text, 1, 200))), 1, 16) AS chunk_id
FROM conversations
""")
def chunk_ids(t: Tables) -> DataFrame:
    key = chunk_id(F.col("conv_id").cast("string"), F.col("role"), F.col("turn"), F.col("text"))
    return t.conversations.select("conv_id", "turn", key.alias("chunk_id"))


@query("SELECT doc_id, sha256(text) AS file_sha256 FROM documents")
def content_sha256(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text_sha256(F.col("text")).alias("file_sha256"))


@query(r"""
WITH marked AS (
  SELECT page_id, regexp_replace(html,
    '(?s)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)>|<[!/a-zA-Z][^>]*>', chr(1), 'g') AS body FROM pages),
node AS (
  SELECT page_id, list_transform(list_filter(string_split(body, chr(1)), lambda x: x <> ''),
    lambda x: CASE WHEN trim(x, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)) <> '' THEN x
                   WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END) AS nodes FROM marked)
SELECT page_id, md5(replace(replace(replace(replace(
  array_to_string(nodes, chr(10)), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')) AS text_md5 FROM node
""")
def html_texts(t: Tables) -> DataFrame:
    from citemill.session import spread

    plain = spread(t.pages).select("page_id", "html", html_text(F.col("html")).alias("body"))
    return plain.select(
        "page_id", F.md5(F.encode("body", "UTF-8")).alias("text_md5")
    )
