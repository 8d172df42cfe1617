"""Queries from candidates to cited answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.catalog import sqltext as q
from citemill.catalog.registry import Tables, built_once, query
from citemill.catalog.search import HYBRID, SETTINGS, document_store, keyword_index
from citemill.config import ABSTENTION, GENERATION_ERROR_ANSWER
from citemill.functions.citations import is_abstention, marker_ranges
from citemill.functions.text import sentences
from citemill.operators.alignment import aligned_judge, sentence_support
from citemill.operators.chunking import chunk_sections
from citemill.operators.citing import conclude, out_of_range, resolve_citations
from citemill.operators.evaluation import exact_overlap
from citemill.operators.generation import extractive_answer, generation_cost
from citemill.operators.keyword import KeywordIndex, keyword_search
from citemill.operators.prompting import collect_sources, prompt
from citemill.operators.rerank import lexical_scorer, model_scorer, proximity_scorer, rerank
from citemill.plans.ask import ask_many, valid_question, with_payload
from citemill.plans.evaluate import evaluate
from citemill.plans.index import embed_chunks
from citemill.session import spread, stage


def candidates(t: Tables) -> DataFrame:
    """Keyword candidates of the benchmark questions, with their texts."""
    store = document_store(t, embed=False).withColumns({
        "fiscal_year": F.lit(2024), "source_url": F.lit("https://example.com"),
    })
    found = keyword_search(keyword_index(t), t.questions, SETTINGS)
    return with_payload(found, store, t.questions, SETTINGS)


_CANDIDATES = "candidates AS (SELECT question_id, chunk_id, rank FROM keyword)"
_TOP = q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, _CANDIDATES, q.RERANKED)


@query(_TOP + "SELECT question_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score FROM top")
def rerank_threshold(t: Tables) -> DataFrame:
    return rerank(candidates(t), SETTINGS).select(
        "question_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score")
    )


@query(_TOP.replace("FROM lexical WHERE rerank_score >= -2.0", "FROM lexical WHERE rerank_score >= -2.0 AND chunk_id % 3 <> 0")
       + "SELECT question_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score FROM top")
def rerank_nan(t: Tables) -> DataFrame:
    """Scores that are no number, here for every third document, are dropped."""
    tagged = candidates(t).withColumn("text", F.concat((F.col("chunk_id") % 3).cast("string"), F.lit("|"), F.col("text")))
    own = lambda text: F.substring(text, 3, F.length(text))
    scorer = lambda question, text: F.when(
        F.substring(text, 1, 1) == "0", F.lit(float("nan"))
    ).otherwise(lexical_scorer(question, own(text)))
    return rerank(tagged, SETTINGS, scorer).select(
        "question_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score")
    )


_ASKED = q.keyword_list("q.question")


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, _CANDIDATES) + f""",
pair AS MATERIALIZED (
  SELECT question_id, chunk_id, rank, list_filter(every, lambda x, i: list_position(every, x) = i) AS asked, words
  FROM (SELECT c.question_id, c.chunk_id, c.rank, {_ASKED} AS every, {q.keyword_list('s.text')} AS words
        FROM candidates c JOIN questions q USING (question_id) JOIN store s USING (chunk_id))),
hit AS MATERIALIZED (
  SELECT question_id, chunk_id, w, i FROM (SELECT question_id, chunk_id, asked, unnest(words) AS w, unnest(range(len(words))) AS i FROM pair)
  WHERE list_contains(asked, w)),
asked_pair AS (
  SELECT question_id, chunk_id, asked[k] AS a, asked[k + 1] AS b FROM (SELECT *, unnest(range(1, len(asked))) AS k FROM pair)),
close AS (
  SELECT DISTINCT x.question_id, x.chunk_id, x.w AS a, y.w AS b, y.i = x.i + 1 AS beside
  FROM (SELECT *, unnest(range(i - 7, i + 8)) AS j FROM hit) x JOIN hit y ON y.question_id = x.question_id AND y.chunk_id = x.chunk_id AND y.i = x.j),
pair_met AS (
  SELECT question_id, chunk_id, count(DISTINCT (a, b)) FILTER (beside) AS n_beside, count(DISTINCT (a, b)) AS n_near
  FROM asked_pair JOIN close USING (question_id, chunk_id, a, b) GROUP BY 1, 2),
scored AS (
  SELECT question_id, chunk_id, rank AS candidate_rank, (0.85 * coalesce(len(list_intersect(asked, words)) / nullif(len(asked), 0)::DOUBLE, 0)
    + 0.10 * coalesce(n_beside / nullif(len(asked) - 1, 0)::DOUBLE, 0) + 0.05 * coalesce(n_near / nullif(len(asked) - 1, 0)::DOUBLE, 0)) * 8 - 4 AS s
  FROM pair LEFT JOIN pair_met USING (question_id, chunk_id))
SELECT question_id, chunk_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9) DESC, candidate_rank) AS rank
FROM scored WHERE round(s, 9) >= -2.0 QUALIFY rank <= 5
""")
def rerank_proximity(t: Tables) -> DataFrame:
    """Candidates by words, pairs of words and their nearness."""
    scorer = lambda question, text: F.round(proximity_scorer(question, text), 9)
    return rerank(candidates(t), SETTINGS, scorer).select("question_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


def _pair_model():
    """Scores a pair by the length of its text; fails for questions of even length."""

    def predict(pairs: list[tuple[str, str]]) -> list[float]:
        if len(pairs[0][0]) % 2 == 0:
            raise RuntimeError("no score")
        return [float(len(text) % 997) for _, text in pairs]

    return predict


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + """
SELECT question_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC NULLS LAST, rank) AS rank
FROM (SELECT k.question_id, k.chunk_id, k.rank, CASE WHEN length(question) % 2 = 1 THEN (length(s.text) % 997)::DOUBLE END AS rerank_score
      FROM keyword k JOIN questions USING (question_id) JOIN store s USING (chunk_id)) 
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC NULLS LAST, rank) <= 5
""")
def rerank_model(t: Tables) -> DataFrame:
    """A pair model that fails for some questions: only those fall back to the order of the candidates."""
    return rerank(candidates(t), SETTINGS, model_scorer(_pair_model, 30.0)).select(
        "question_id", "chunk_id", "rank", "rerank_score"
    )


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + "SELECT question_id, chunk_id, rank FROM keyword WHERE rank <= 5")
def rerank_disabled(t: Tables) -> DataFrame:
    return rerank(candidates(t), SETTINGS, None).select("question_id", "chunk_id", "rank")


def _sources(t: Tables) -> DataFrame:
    return collect_sources(rerank(candidates(t), SETTINGS)).join(t.questions, "question_id")


@query(_TOP + """
SELECT question_id, md5('QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'CONTEXT:' || chr(10) ||
  string_agg('[' || rank || '] ' || text || chr(10) || '    (Source: ' || company || ' 2024 10-K, ' || section ||
             ', chunk ' || chunk_id || ')', chr(10) || chr(10) ORDER BY rank) ||
  chr(10) || chr(10) || 'ANSWER:') AS prompt_md5
FROM top GROUP BY question_id, question
""")
def prompt_build(t: Tables) -> DataFrame:
    built = _sources(t).select("question_id", prompt(F.col("question"), F.col("sources")).alias("p"))
    return built.select("question_id", F.md5(F.encode("p", "UTF-8")).alias("prompt_md5"))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, _CANDIDATES, q.RERANKED, q.ANSWERS)
       + "SELECT question_id, reply AS answer FROM reply")
def extractive_answers(t: Tables) -> DataFrame:
    return _sources(t).select(
        "question_id", extractive_answer(F.col("question"), F.col("sources")).alias("answer")
    )


@query("""
SELECT conv_id, turn, round(tokens_in / 1e6 * coalesce(price_in, 0) + tokens_out / 1e6 * coalesce(price_out, 0), 9) AS cost_usd
FROM (SELECT *, CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'claude-sonnet-4-6' ELSE 'other' END AS model,
             length(text) AS tokens_in, length(text) // 2 AS tokens_out FROM conversations)
LEFT JOIN (VALUES ('claude-sonnet-4-6', 3.0::DOUBLE, 15.0::DOUBLE), ('gpt-4o', 2.5, 10.0)) p(model, price_in, price_out) USING (model)
""")
def generation_costs(t: Tables) -> DataFrame:
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "claude-sonnet-4-6").otherwise("other")
    n = F.length("text")
    return t.conversations.select(
        "conv_id", "turn", F.round(generation_cost(model, n, F.floor(n / 2)), 9).alias("cost_usd")
    )


# No conversation has citation markers, so they are put in by the same
# expression here and in the SQL.
MARKED = """concat(text, ' [', CAST(turn % 7 AS {str}), '] [', CAST(turn % 3 + 1 AS {str}), '-', CAST(conv_id % 6 AS {str}),
  '] [2, ', CAST(conv_id % 4 AS {str}), '] [1-2-3] [', CAST(turn % 4 AS {str}), '-200000] [00', CAST(turn % 5 AS {str}),
  '] [9223372036854775800-92233720368547758079] [12345678901234567890123]')"""
_MARKED_SQL = "said AS (SELECT conv_id * 1000 + turn AS k, " + MARKED.format(str="varchar") + " AS answer FROM conversations)"
# ranged(k, o, first, last): ranges in the order they are written.
_RANGED = rf"""
grp AS (SELECT k, unnest(grps) AS grp, unnest(range(len(grps))) AS g
  FROM (SELECT k, regexp_extract_all(answer, '{q.MARKER}', 1) AS grps FROM said)),
part AS (SELECT k, g * 1000 + unnest(range(len(ps))) AS o, unnest(ps) AS p FROM (SELECT k, g, string_split(grp, ',') AS ps FROM grp)),
ends AS (SELECT k, o, list_transform(string_split(p, '-'), lambda x: trim(x, '{q.SPACES}')::HUGEINT) AS e FROM part),
ranged AS (SELECT k, o, e[1] AS first, e[-1] AS last FROM ends WHERE len(e) = 1 OR len(e) = 2 AND e[1] <= e[2])"""
_RANGES = q.with_(_MARKED_SQL, _RANGED)


def _said(t: Tables) -> DataFrame:
    return spread(t.conversations).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "conv_id", "turn", F.expr(MARKED.format(str="string")).alias("answer")
    )


@query(_RANGES + "SELECT k, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS place, first::VARCHAR AS first, last::VARCHAR AS last FROM ranged")
def citation_markers(t: Tables) -> DataFrame:
    found = _said(t).select("k", F.posexplode(marker_ranges(F.col("answer"))).alias("place", "r"))
    return found.select("k", "place", F.col("r.first").cast("string").alias("first"), F.col("r.last").cast("string").alias("last"))


def _numbered_sources():
    """Three sources for every answer."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda r: F.struct(
            r.alias("rank"), F.lit("t").alias("text"), F.lit("c").alias("company"), F.lit(2024).alias("fiscal_year"),
            F.lit("s").alias("section"), F.concat(F.lit("id"), r.cast("string")).alias("chunk_id"), F.lit("u").alias("source_url"),
        ),
    )


@query(_RANGES + """
SELECT k, n, 'id' || n AS chunk_id, row_number() OVER (PARTITION BY k ORDER BY min(o), n) - 1 AS place
FROM ranged JOIN (VALUES (1), (2), (3)) source(n) ON n BETWEEN first AND last GROUP BY k, n
""")
def citations_resolved(t: Tables) -> DataFrame:
    cited = resolve_citations(marker_ranges(F.col("answer")), _numbered_sources())
    return _said(t).select("k", F.posexplode(cited).alias("place", "c")).select("k", "c.n", "c.chunk_id", "place")


@query(_RANGES + """
SELECT DISTINCT k, low::VARCHAR AS first, high::VARCHAR AS last FROM (
  SELECT k, first AS low, least(last, 0) AS high FROM ranged UNION ALL SELECT k, greatest(first, 4), last FROM ranged)
WHERE low <= high
""")
def citations_out_of_range(t: Tables) -> DataFrame:
    stray = out_of_range(marker_ranges(F.col("answer")), _numbered_sources())
    return _said(t).select("k", F.explode(stray).alias("r")).select(
        "k", F.col("r.first").cast("string").alias("first"), F.col("r.last").cast("string").alias("last")
    )


SPOKEN = """CASE conv_id % 4 WHEN 0 THEN concat('> "{phrase}" Because ', text)
  WHEN 1 THEN concat(text, ' {phrase}') WHEN 2 THEN concat(text, ' [', CAST(turn AS {str}), ']') ELSE upper('  ** {phrase}') END"""
_SPOKEN_SQL = SPOKEN.format(phrase=q.PHRASE, str="varchar")
_DECLINED_SQL = f"starts_with(lower(ltrim({q.strip('said')}, '>#*-\").“”'' ')), '{ABSTENTION.rstrip('.').lower()}')"


@query(f"SELECT conv_id, turn, {_DECLINED_SQL} AS abstained FROM (SELECT *, {_SPOKEN_SQL} AS said FROM conversations)")
def abstention_flag(t: Tables) -> DataFrame:
    said = F.expr(SPOKEN.format(phrase=ABSTENTION, str="string"))
    return t.conversations.select("conv_id", "turn", is_abstention(said).alias("abstained"))


@query(f"""
SELECT conv_id, turn,
  CASE WHEN role = 'system' THEN 'error' WHEN declined THEN 'abstained'
       WHEN conv_id % 4 = 2 AND turn BETWEEN 1 AND 3 THEN 'answered' ELSE 'ungrounded' END AS outcome
FROM (SELECT *, {_DECLINED_SQL} AS declined FROM (SELECT *, {_SPOKEN_SQL} AS said FROM conversations))
""")
def groundedness_guard(t: Tables) -> DataFrame:
    """Errors, abstentions, answers without a valid citation, and answers."""
    rows = t.conversations.withColumn("sources", _numbered_sources()).withColumn("generation", F.struct(
        F.expr(SPOKEN.format(phrase=ABSTENTION, str="string")).alias("text"), F.lit(False).alias("truncated"),
        F.when(F.col("role") == "system", "TimeoutError: late").alias("error"),
    ))
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("ungrounded"), "ungrounded")
        .when(F.col("abstained"), "abstained").otherwise("answered")
    )
    return conclude(rows).select("conv_id", "turn", outcome.alias("outcome"))


@query("SELECT conv_id, turn, length(text) BETWEEN 3 AND 2000 AS valid FROM conversations")
def question_valid(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", valid_question(F.col("text")).alias("valid"))


def chunk_store(t: Tables) -> DataFrame:
    """The chunks of all documents, embedded and written, as a store holds them."""
    return built_once(
        "chunks", t, lambda: stage(embed_chunks(chunk_sections(t.sections, SETTINGS), SETTINGS), "chunks")
    )


def chunk_index(t: Tables) -> KeywordIndex:
    return built_once("chunk postings", t, lambda: KeywordIndex.build(chunk_store(t), SETTINGS))


_FUSED_CANDIDATES = "candidates AS (SELECT question_id, chunk_id, rank FROM fused)"
# Some questions are too short or too long to be asked.
POSED = "CASE item_id % 10 WHEN 3 THEN substring(text, 1, 2) WHEN 7 THEN repeat(text, 40) ELSE text END"
_POSED = f"posed AS (SELECT item_id AS question_id, {POSED} AS question FROM benchmark)"
_VALID = "questions AS (SELECT * FROM posed WHERE length(question) BETWEEN 3 AND 2000)"
# Golden questions are asked whatever their length.
_ALL = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"
_DECLINED = f"starts_with(reply, '{q.PHRASE}')"
# final(question_id, answer, ids): answers with the sources they cite. The
# extractive answer cites every sentence it quotes; a quoted sentence may hold
# markers of its own, so they are read off the answer.
_FINAL = q.marker_numbers("question_id", "reply", "reply") + f""",
cited AS (
  SELECT m.question_id, m.place, t.chunk_id, t.company, t.section, t.text AS head
  FROM marker m JOIN top t ON t.question_id = m.question_id AND t.rank = m.n
  JOIN reply r ON r.question_id = m.question_id WHERE NOT {_DECLINED}),
final AS (
  SELECT q.question_id, q.question, CASE WHEN c.ids IS NULL THEN '{q.PHRASE}' ELSE r.reply END AS answer,
         c.ids IS NULL AS abstained, coalesce(c.ids, '') AS ids, coalesce(c.context, '') AS context
  FROM questions q LEFT JOIN reply r USING (question_id) LEFT JOIN (
    SELECT question_id, string_agg(chunk_id, ',' ORDER BY place) AS ids, string_agg(head, ' | ' ORDER BY place) AS context
    FROM cited GROUP BY 1) c USING (question_id))"""
_ANSWERED = (q.POSTINGS, q.KEYWORD, q.DENSE, q.FUSED, _FUSED_CANDIDATES, q.RERANKED, q.ANSWERS, _FINAL)
_ASK = (q.CHUNK_STORE, _ALL, *_ANSWERED)


@query(q.with_(q.CHUNK_STORE, _POSED, _VALID, *_ANSWERED) + f"""
SELECT p.question_id, md5(coalesce(f.answer, '{GENERATION_ERROR_ANSWER}')) AS answer_md5, coalesce(abstained, false) AS abstained,
  coalesce(ids, '') AS cited_ids, f.question_id IS NULL AS refused
FROM posed p LEFT JOIN final f USING (question_id)
""")
def ask_batch(t: Tables) -> DataFrame:
    """Cited answers to all benchmark questions over the chunks of all documents, and a response to those not asked."""
    posed = t.benchmark.select(F.col("item_id").alias("question_id"), F.expr(POSED).alias("question"))
    responses = ask_many(chunk_store(t), posed, HYBRID, index=chunk_index(t))
    return responses.select(
        F.col("error").isNotNull().alias("refused"),
        "question_id", F.md5(F.encode("answer", "UTF-8")).alias("answer_md5"), "abstained",
        F.array_join(F.transform("citations", lambda c: c.chunk_id), ",").alias("cited_ids"),
    )


def golden(t: Tables) -> DataFrame:
    """Benchmark items as golden questions. A document that holds the item's
    last sentence, word for word, is an expected source; an item that no
    document holds should be refused."""
    last = F.element_at(sentences(F.col("text")), -1)
    items = t.benchmark.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.col("text").alias("reference_answer"), last.alias("sentence"),
    )
    held = t.texts.select(
        F.col("source").alias("company"), F.col("lang").alias("section"), F.explode(sentences(F.col("text"))).alias("sentence")
    )
    found = held.join(items.select("question_id", "sentence"), "sentence").select(
        "question_id", "company", "section"
    ).distinct()
    sources = found.groupBy("question_id").agg(F.collect_list(F.struct(
        "company", F.lit(2024).alias("year"), "section", F.lit(None).cast("string").alias("chunk_id")
    )).alias("expected_sources"))
    return items.drop("sentence").join(sources, "question_id", "left").withColumn(
        "should_abstain", F.col("expected_sources").isNull()
    )


_GOLDEN = f"""
item AS (
  SELECT item_id AS question_id, text, {q.sentence_list('text')}[-1] AS sentence FROM benchmark),
held AS (
  SELECT DISTINCT source AS company, lang AS section, unnest({q.sentence_list('text')}) AS sentence FROM documents),
expected AS (SELECT question_id, company, section FROM item JOIN held USING (sentence)),
golden AS (SELECT question_id, text, question_id NOT IN (SELECT question_id FROM expected) AS refuse FROM item)"""
_SAID = f"regexp_replace(f.answer, '{q.MARKER}', ' ', 'g')"
_SCORED = f"""
scored AS (
  SELECT g.question_id, g.refuse, f.abstained,
    CASE WHEN NOT refuse THEN (SELECT count(*) > 0 FROM cited c JOIN expected e
      ON c.question_id = e.question_id AND c.company = e.company AND c.section = e.section
      WHERE c.question_id = g.question_id)::INT::DOUBLE END AS hit,
    CASE WHEN NOT refuse AND NOT f.abstained THEN
      len(list_intersect({q.keyword_list(_SAID)}, {q.keyword_list('f.context')}))::DOUBLE
        / nullif(len(list_distinct({q.keyword_list(_SAID)})), 0) END AS grounded,
    CASE WHEN NOT refuse AND NOT f.abstained THEN
      len(list_intersect({q.keyword_list('f.question')}, {q.keyword_list(_SAID)}))::DOUBLE
        / nullif(len(list_distinct({q.keyword_list('f.question')})), 0) END AS relevant
  FROM golden g JOIN final f USING (question_id))"""


@query(q.with_(*_ASK, _GOLDEN, _SCORED) + """
SELECT question_id, coalesce(hit, -1) AS hit_10, coalesce(round(grounded, 6), -1) AS groundedness,
       coalesce(round(relevant, 6), -1) AS relevance, refuse AS should_abstain, abstained FROM scored
""")
def evaluation_scores(t: Tables) -> DataFrame:
    """Scores per question; -1 where a score does not apply."""
    scored, _ = evaluate(chunk_store(t), golden(t), HYBRID, index=chunk_index(t))
    known = lambda c, name: F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(name)
    return scored.select(
        "question_id", known("hit_10", "hit_10"), known("judge.groundedness", "groundedness"),
        known("judge.relevance", "relevance"), F.col("refuse").alias("should_abstain"), "abstained",
    )


@query(q.with_(*_ASK, _GOLDEN, _SCORED) + """
SELECT count(*) AS n_questions, round(coalesce(avg(hit), 0), 4) AS recall_10,
  round(coalesce(avg(grounded), 0), 4) AS groundedness, round(coalesce(avg(relevant), 0), 4) AS relevance,
  count(*) FILTER (refuse AND abstained) AS abstain_correct, count(*) FILTER (refuse) AS abstain_total,
  round(count(*) FILTER (refuse AND abstained) / nullif(count(*) FILTER (refuse), 0), 4) AS abstain_accuracy,
  coalesce(avg(hit), 0) >= 0.85 AND coalesce(avg(grounded), 0) >= 0.9 AS phase1_pass FROM scored
""")
def scorecard(t: Tables) -> DataFrame:
    _, row = evaluate(chunk_store(t), golden(t), HYBRID, index=chunk_index(t))
    return row.select(
        "n_questions", "recall_10", "groundedness", "relevance", "abstain_correct", "abstain_total",
        "abstain_accuracy", "phase1_pass",
    )


@query(f"""
WITH test AS (SELECT item_id, unnest({q.sentence_list('text')}) AS question FROM benchmark)
SELECT item_id, question FROM test WHERE question IN (SELECT unnest({q.sentence_list('text')}) FROM documents)
""")
def leakage_exact(t: Tables) -> DataFrame:
    """Benchmark sentences that occur, word for word, as document sentences."""
    test = t.benchmark.select("item_id", F.explode(sentences(F.col("text"))).alias("question"))
    train = t.texts.select(F.explode(sentences(F.col("text"))).alias("question"))
    return exact_overlap(test, train).select("item_id", "question")


def _aligned(sides: str, where: str = "true") -> str:
    """support(key, part, i, sentence, support, place) of the sentences of ``own`` in the rows (key, part, own, other) of ``sides``."""
    return f"""
sides AS ({sides}),
own AS (
  SELECT key, part, unnest(range(len(s))) AS i, unnest(s) AS sentence
  FROM (SELECT key, part, {q.sentence_list('own')} AS s FROM sides)),
mine AS (SELECT key, part, i, sentence, {q.keyword_list('sentence')} AS a FROM own),
other AS (
  SELECT key, part, unnest(range(len(s))) + 1 AS place, unnest(s) AS sentence
  FROM (SELECT key, part, {q.sentence_list('other')} AS s FROM sides)),
theirs AS (SELECT key, part, place, {q.keyword_list('sentence')} AS b FROM other),
both_sides AS (
  SELECT key, part, i, place, list_filter(a, lambda x: list_contains(b, x)) AS a, list_filter(b, lambda x: list_contains(a, x)) AS b
  FROM mine JOIN theirs USING (key, part)),
aligned_pair AS (
  SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM both_sides WHERE len(a) > 0 AND a <> b)),
aligned_lengths AS (
  SELECT pid, 0 AS j, list_transform(range(len(a) + 1), lambda x: 0) AS line FROM aligned_pair
  UNION ALL
  SELECT pid, j + 1, [0] || list_transform(range(2, len(a) + 2), lambda i: list_max(list_transform(
    range(2, i + 1), lambda k: greatest(line[k], line[k - 1] + CASE WHEN a[k - 1] = b[j + 1] THEN 1 ELSE 0 END))))
  FROM aligned_lengths JOIN aligned_pair USING (pid) WHERE j < len(b)),
aligned_common AS (
  SELECT key, part, i, place, CASE WHEN a = b THEN len(a) ELSE line[-1] END AS n
  FROM both_sides LEFT JOIN aligned_pair USING (a, b) LEFT JOIN aligned_lengths USING (pid)
  WHERE len(a) > 0 AND (a = b OR j = len(aligned_pair.b))),
support AS (
  SELECT key, part, i, coalesce(max(n), 0)::DOUBLE / len(any_value(a)) AS support,
         coalesce(arg_max(place, (n, -place)), 0)::INT AS place
  FROM mine LEFT JOIN aligned_common USING (key, part, i) WHERE len(a) > 0 GROUP BY key, part, i)"""


_JUDGED = f"""
judged AS (
  SELECT g.question_id AS key, g.text, f.question, f.context, {_SAID} AS said FROM golden g JOIN final f USING (question_id)
  WHERE NOT refuse AND NOT f.abstained)"""


@query(q.with_(*_ASK, _GOLDEN, _JUDGED, _aligned("""
  SELECT key, 'g' AS part, said AS own, context AS other FROM judged
  UNION ALL SELECT key, 'r', question, said FROM judged UNION ALL SELECT key, 'c', text, said FROM judged""")) + """
SELECT key AS question_id, coalesce(round(avg(support) FILTER (part = 'g'), 6), 0) AS groundedness,
  coalesce(round(avg(support) FILTER (part = 'r'), 6), 0) AS relevance,
  coalesce(round(avg(support) FILTER (part = 'c'), 6), 0) AS correctness FROM judged LEFT JOIN support USING (key) GROUP BY key
""")
def groundedness_aligned(t: Tables) -> DataFrame:
    """Scores of the answered golden questions by the judge that aligns sentences."""
    scored, _ = evaluate(chunk_store(t), golden(t), HYBRID, judge=aligned_judge, index=chunk_index(t))
    names = ("groundedness", "relevance", "correctness")
    return scored.where("judged").select("question_id", *[F.round(f"judge.{n}", 6).alias(n) for n in names])


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, _CANDIDATES, q.RERANKED, _aligned(
    "SELECT (question_id, chunk_id) AS key, 't' AS part, question AS own, text AS other FROM top")) + """
SELECT key[1] AS question_id, key[2] AS chunk_id, row_number() OVER (PARTITION BY key ORDER BY i) AS number,
  round(support, 6) AS support, place FROM support
""")
def sentence_alignment(t: Tables) -> DataFrame:
    """Each sentence of a question aligned to the sentences of its reranked documents."""
    top = rerank(candidates(t), SETTINGS)
    found = top.select("question_id", "chunk_id", F.posexplode(sentence_support(F.col("question"), F.col("text"))).alias("at", "s"))
    return found.select(
        "question_id", "chunk_id", (F.col("at") + 1).alias("number"), F.round("s.support", 6).alias("support"), F.col("s.place").alias("place")
    )
