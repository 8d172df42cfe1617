"""SQL fragments of the checking queries, in DuckDB's dialect.

They restate the operators from their definition, in relational form: lists
are unnested, windows and recursion take the place of array folds.
"""

from citemill.config import ABSTENTION
from citemill.functions.stopwords import EFFECTIVE_STOPWORDS
from citemill.functions.text import ODD_SPACES, SPACES

S = f"[{SPACES}]"
PIECE = rf"(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]){S}*"
STOP = ", ".join(f"'{w}'" for w in EFFECTIVE_STOPWORDS)
MARKER = rf"\[(\d+(?:{S}*[,\-]{S}*\d+)*)\]"
PHRASE = ABSTENTION.replace("'", "''")


def strip(e: str) -> str:
    return f"trim({e}, '{SPACES}')"


def pieces(e: str) -> str:
    return f"regexp_extract_all({e}, '{PIECE}')"


def n_tokens(e: str) -> str:
    return f"len({pieces(e)})"


def sentence_list(e: str) -> str:
    cut = rf"regexp_replace({e}, '([.!?]){S}+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({cut}, chr(1)), lambda x: {strip('x')} <> '')"


def words(e: str) -> str:
    blank = rf"regexp_replace(lower({e}), '[!-/:-@\[-`{{-~]', ' ', 'g')"
    return f"string_split(trim(regexp_replace({blank}, '{S}+', ' ', 'g'), ' '), ' ')"


def keyword_list(e: str) -> str:
    return f"list_filter({words(e)}, lambda w: w <> '' AND w NOT IN ({STOP}))"


def normalized(e: str) -> str:
    plain = f"regexp_replace({e}, '[{ODD_SPACES}]', ' ', 'g')"
    for pattern, put in (
        (r"(?im)^.{0,60}?20\p{Nd}\p{Nd}\s+form\s+10-?k.*$", ""),
        (r"(?im)^[ \t]*table of contents[ \t]*$", ""),
        (r"(?m)^[ \t]*\|?[ \t]*\p{Nd}{1,4}[ \t]*\|?[ \t]*$", ""),
        (r"(?i)\A\s*\p{Nd}{1,4}\s+(item\s)", r"\1"),
        (r"\n{3,}", chr(10) + chr(10)),
    ):
        plain = f"regexp_replace({plain}, '{pattern}', '{put}', 'g')"
    return strip(plain)


def windows(p: str, size: int = 800, stride: int = 680) -> str:
    """List of window texts of a piece list."""
    one = strip(f"array_to_string({p}[i + 1 : i + {size}], '')")
    return f"list_transform(range(0, len({p}), {stride}), lambda i: {one})"


def tail(e: str, n: int = 120) -> str:
    p = pieces(e)
    last = strip(f"array_to_string({p}[greatest(len({p}) - {n}, 0) + 1 :], '')")
    return f"CASE WHEN len({p}) <= {n} THEN {e} ELSE {last} END"


# chunks(acc, section, company, idx, text, chunk_id): the chunks of all documents.
CHUNKS = f"""
body AS (
  SELECT doc_id::VARCHAR AS acc, lang AS section, source AS company, {strip('text')} AS body
  FROM documents WHERE {strip('text')} <> ''),
cut AS (
  SELECT *, list_transform(sents, lambda x: {n_tokens('x')}) AS counts
  FROM (SELECT *, {sentence_list('body')} AS sents FROM body)),
big AS (SELECT * FROM cut WHERE list_sum(counts) > 800),
step AS (
  SELECT acc, 0 AS i, 0 AS lo, 0 AS total, false AS seeded,
         -1 AS from_s, -1 AS to_s, '' AS kind, false AS is_long FROM big
  UNION ALL
  SELECT acc, i + 1,
         CASE WHEN c > 800 THEN i + 1 WHEN closing THEN i - k ELSE lo END,
         CASE WHEN c > 800 THEN 0
              WHEN closing THEN c + CASE WHEN k = 0 THEN 120 ELSE list_sum(counts[i - k + 1 : i]) END
              ELSE total + c END,
         CASE WHEN c > 800 THEN false WHEN closing THEN k = 0 ELSE seeded END,
         CASE WHEN lo < i AND (c > 800 OR closing) THEN lo ELSE -1 END,
         CASE WHEN lo < i AND (c > 800 OR closing) THEN i - 1 ELSE -1 END,
         CASE WHEN seeded THEN 'seeded' ELSE 'plain' END,
         c > 800
  FROM (
    SELECT step.*, counts, counts[i + 1] AS c,
           total + counts[i + 1] > 800 AND lo < i AS closing,
           len(list_filter(range(1, least(i - lo, 120) + 1),
                           lambda k: list_sum(counts[i - k + 1 : i]) <= 120)) AS k
    FROM step JOIN big USING (acc) WHERE i < len(counts))),
spans AS (
  SELECT acc, i * 2 AS ord, from_s, to_s, kind FROM step WHERE from_s >= 0
  UNION ALL SELECT acc, i * 2 + 1, i - 1, i - 1, 'long' FROM step WHERE is_long
  UNION ALL SELECT acc, i * 2 + 2, lo, i - 1, CASE WHEN seeded THEN 'seeded' ELSE 'plain' END
            FROM step JOIN big USING (acc) WHERE i = len(counts) AND lo < i),
span_texts AS (
  SELECT acc, ord, unnest(parts) AS text, unnest(range(len(parts))) AS sub
  FROM (SELECT acc, ord, CASE
          WHEN kind = 'long' THEN {windows(pieces('sents[from_s + 1]'))}
          WHEN kind = 'seeded' THEN [({tail('sents[from_s]')}) || ' ' || array_to_string(sents[from_s + 1 : to_s + 1], ' ')]
          ELSE [array_to_string(sents[from_s + 1 : to_s + 1], ' ')] END AS parts
        FROM spans JOIN big USING (acc))),
sized AS (
  SELECT acc, text, {n_tokens('text')} AS n, row_number() OVER (PARTITION BY acc ORDER BY ord, sub) AS k
  FROM span_texts),
grouped AS (
  SELECT *, sum(CASE WHEN k = 1 OR n >= 32 THEN 1 ELSE 0 END) OVER (PARTITION BY acc ORDER BY k) AS g FROM sized),
headed AS (
  SELECT *, sum(CASE WHEN g = 1 THEN n ELSE 0 END) OVER (PARTITION BY acc) AS head_n FROM grouped),
merged AS (
  SELECT acc, CASE WHEN head_n < 32 THEN greatest(g, 2) ELSE g END AS g,
         {strip("string_agg(text, ' ' ORDER BY k)")} AS text
  FROM headed GROUP BY ALL),
capped AS (
  SELECT acc, g, unnest(parts) AS text, unnest(range(len(parts))) AS sub
  FROM (SELECT acc, g, CASE WHEN {n_tokens('text')} > 840 THEN {windows(pieces('text'))} ELSE [text] END AS parts
        FROM merged)),
numbered AS (
  SELECT acc, row_number() OVER (PARTITION BY acc ORDER BY g, sub) - 1 AS idx, text FROM capped
  UNION ALL SELECT acc, 0, body FROM cut WHERE list_sum(counts) <= 800),
chunks AS (
  SELECT n.acc, b.section, b.company, n.idx, n.text,
         substr(sha1(concat(n.acc, '|', b.section, '|', n.idx, '|', substr(n.text, 1, 200))), 1, 16) AS chunk_id
  FROM numbered n JOIN body b USING (acc))"""

# store(chunk_id, text, company, section): whole documents as chunks.
DOCUMENT_STORE = """
store AS (SELECT doc_id AS chunk_id, text, source AS company, lang AS section FROM documents)"""
# The same over the chunks above.
CHUNK_STORE = CHUNKS + """,
store AS (SELECT chunk_id, text, company, section FROM chunks)"""

QUESTIONS = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"

POSTINGS = f"""
posting AS MATERIALIZED (
  SELECT chunk_id, term, count(*) AS tf
  FROM (SELECT chunk_id, unnest({keyword_list('text')}) AS term FROM store) GROUP BY ALL),
length AS (SELECT chunk_id, sum(tf)::BIGINT AS dl FROM posting GROUP BY chunk_id),
corpus AS (
  SELECT (SELECT count(*) FROM store) AS n, (SELECT sum(tf) FROM posting) / (SELECT count(*) FROM store) AS avg_dl),
df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
raw_idf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, corpus),
idf AS (
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf
  FROM raw_idf)"""

KEYWORD = f"""
asked AS (
  SELECT question_id, term, count(*) AS uses
  FROM (SELECT question_id, unnest({keyword_list('question')}) AS term FROM questions) GROUP BY ALL),
bm25 AS (
  SELECT question_id, chunk_id, round(sum(
    uses * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl)))), 9) AS score
  FROM asked JOIN posting USING (term) JOIN idf USING (term) JOIN length USING (chunk_id), corpus
  /*keyword where*/
  GROUP BY ALL),
keyword AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
    FROM bm25 WHERE score > 0) WHERE rank <= 20)"""


def vectors(name: str, source: str, key: str, text: str, prefix: str) -> str:
    """Hashed word vectors: name(key, slot, v), unit length in single precision."""
    return f"""
{name}_slot AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot,
         sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN -1 ELSE 1 END) AS v
  FROM (SELECT {key}, unnest({words(f"'{prefix}' || {text}")}) AS w FROM {source}) WHERE w <> '' GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}_slot GROUP BY {key}),
{name} AS (
  SELECT {key}, slot, CASE WHEN norm > 0 THEN v::DOUBLE / norm ELSE 0 END::FLOAT::DOUBLE AS v
  FROM {name}_slot JOIN {name}_norm USING ({key}))"""


STORE_VECTORS = vectors("sv", "store", "chunk_id", "text", "search_document: ")
QUESTION_VECTORS = vectors("qv", "questions", "question_id", "question", "search_query: ")

DENSE = f"""
{STORE_VECTORS}, {QUESTION_VECTORS},
sl AS (SELECT chunk_id, sqrt(sum(v * v)) AS l FROM sv GROUP BY chunk_id),
ql AS (SELECT question_id, sqrt(sum(v * v)) AS l FROM qv GROUP BY question_id),
cosine AS (
  SELECT question_id, chunk_id, round(coalesce(dot / nullif(ql.l * sl.l, 0), 0), 9) AS score
  FROM (SELECT question_id, chunk_id, sum(coalesce(qv.v * sv.v, 0)) AS dot
        FROM (SELECT question_id, chunk_id FROM questions, store) LEFT JOIN qv USING (question_id)
        LEFT JOIN sv USING (chunk_id, slot) GROUP BY ALL)
  JOIN sl USING (chunk_id) JOIN ql USING (question_id) JOIN store USING (chunk_id)
  /*dense where*/),
dense AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cosine)
  WHERE rank <= 20)"""

FUSED = """
legs AS (
  SELECT coalesce(d.question_id, k.question_id) AS question_id, coalesce(d.chunk_id, k.chunk_id) AS chunk_id,
         d.rank AS dr, k.rank AS kr,
         coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS rrf,
         CASE WHEN k.rank IS NULL THEN d.score ELSE 0 END AS score
  FROM dense d FULL JOIN keyword k ON d.question_id = k.question_id AND d.chunk_id = k.chunk_id),
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, dr NULLS LAST, kr NULLS LAST) AS rank
    FROM legs) WHERE rank <= 20)"""

# top(question_id, chunk_id, rank, rerank_score, ...) from candidates(question_id, chunk_id, rank, score).
RERANKED = f"""
pair AS (
  SELECT c.question_id, q.question, c.chunk_id, c.rank AS candidate_rank, s.text, s.company, s.section,
         list_distinct({keyword_list('q.question')}) AS asked_words, {keyword_list('s.text')} AS text_words
  FROM candidates c JOIN questions q USING (question_id) JOIN store s USING (chunk_id)),
lexical AS (
  SELECT *, coalesce(len(list_intersect(asked_words, text_words))::DOUBLE / nullif(len(asked_words), 0), 0)
            * 8.0::DOUBLE - 4.0::DOUBLE AS rerank_score FROM pair),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, candidate_rank) AS rank
    FROM lexical WHERE rerank_score >= -2.0) WHERE rank <= 5)"""

# reply(question_id, answer): the extractive answer of every question with sources.
ANSWERS = f"""
line AS (
  SELECT question_id, rank, asked_words, unnest(sents) AS sentence, unnest(range(len(sents))) AS i
  FROM (SELECT *, {sentence_list('text')} AS sents FROM top)),
overlap AS (
  SELECT *, len(list_intersect(asked_words, {keyword_list('sentence')})) AS shared FROM line),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, rank ORDER BY shared DESC, i) AS r FROM overlap)
  WHERE r = 1 AND shared > 0),
reply AS (
  SELECT t.question_id, coalesce(b.text, '{PHRASE}') AS reply
  FROM (SELECT DISTINCT question_id FROM top) t LEFT JOIN (
    SELECT question_id, string_agg(sentence || ' [' || rank || ']', ' ' ORDER BY rank) AS text FROM best GROUP BY 1
  ) b USING (question_id))"""


def marker_numbers(key: str, source: str, text: str) -> str:
    """marker(key, n, place): numbers cited in a text, at their first place."""
    return f"""
grp AS (
  SELECT {key}, unnest(grps) AS grp, unnest(range(len(grps))) AS g
  FROM (SELECT {key}, regexp_extract_all({text}, '{MARKER}', 1) AS grps FROM {source})),
part AS (
  SELECT {key}, unnest(ps) AS part, g * 1000 + unnest(range(len(ps))) AS o
  FROM (SELECT {key}, g, string_split(grp, ',') AS ps FROM grp)),
ends AS (SELECT *, list_transform(string_split(part, '-'), lambda x: trim(x, '{SPACES}')::BIGINT) AS e FROM part),
number AS (
  SELECT {key}, o, unnest(CASE WHEN len(e) = 1 THEN [e[1]] WHEN len(e) = 2 THEN range(e[1], e[2] + 1)
                             ELSE []::BIGINT[] END) AS n FROM ends),
marker AS (
  SELECT {key}, n, row_number() OVER (PARTITION BY {key} ORDER BY first_o, n) AS place
  FROM (SELECT {key}, n, min(o) AS first_o FROM number GROUP BY ALL))"""


def with_(*parts: str) -> str:
    """A WITH clause of the given fragments."""
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + "\n"
