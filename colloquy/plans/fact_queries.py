"""Facts drawn from meetings: actions, decisions, questions, entities, topics, timeline, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.operators import entities as en
from colloquy.operators import extractors as ex
from colloquy.operators import facts as fa
from colloquy.operators import introductions as intro
from colloquy.operators import topics as tp
from colloquy.plans.registry import query
from colloquy.plans.sql_views import due_sql, esc, sql_list
from colloquy.sources.corpus import Corpus

_ACTION = "job_id, sent_no, seg_idx, speaker_id, at_ms, text, task, owner, due_date, confidence, reason"
_DECISION = "job_id, sent_no, seg_idx, speaker_id, at_ms, text, decision, confidence, reason"
_QUESTION = "job_id, sent_no, seg_idx, speaker_id, at_ms, question, is_answered, confidence, reason"


def _cols(names: str) -> list[str]:
    return names.split(", ")


@query("G1", f"SELECT {_ACTION} FROM actions")
def action_items(c: Corpus) -> DataFrame:
    return fa.action_items(c.sentences(), c.names())


@query("G2", """SELECT due_date, count(*) AS n FROM actions WHERE due_date IS NOT NULL GROUP BY due_date""")
def due_dates(c: Corpus) -> DataFrame:
    return c.actions().filter("due_date is not null").groupBy("due_date").agg(F.count("*").alias("n"))


# Orders as sentences: eight ways to say when, with the order's own date.
_WAYS = (
    ("'by ' || day || '.'", lambda d: F.concat(F.lit("by "), d("EEEE"), F.lit("."))), ("'by next ' || day || ', please'", lambda d: F.concat(F.lit("by next "), d("EEEE"), F.lit(", please"))),
    ("'by ' || month || ' ' || dom || ', ' || year || '!'", lambda d: F.concat(F.lit("by "), d("MMMM"), F.lit(" "), d("d"), F.lit(", "), d("yyyy"), F.lit("!"))),
    ("'BY ' || upper(month) || ' ' || dom || 'th. ' || year || ' is over'", lambda d: F.concat(F.lit("BY "), F.upper(d("MMMM")), F.lit(" "), d("d"), F.lit("th. "), d("yyyy"), F.lit(" is over"))),
    ("'this week or today'", lambda d: F.lit("this week or today")), ("'tomorrow, not by EOD'", lambda d: F.lit("tomorrow, not by EOD")),
    ("'(today) by ' || dom", lambda d: F.concat(F.lit("(today) by "), d("d"))), ("'next ' || month || ' by and by'", lambda d: F.concat(F.lit("next "), d("MMMM"), F.lit(" by and by"))),
)
_ORDER_SQL = " ".join(f"WHEN {i} THEN {sql}" for i, (sql, _) in enumerate(_WAYS))


@query("G2", f"""
    SELECT o_orderkey, {due_sql("text")} AS due_date FROM (
      SELECT o_orderkey, 'Ship order ' || o_orderkey || ' ' || CASE o_orderkey % 8 {_ORDER_SQL} END AS text FROM (
        SELECT o_orderkey, dayname(o_orderdate) AS day, monthname(o_orderdate) AS month, day(o_orderdate)::VARCHAR AS dom, year(o_orderdate)::VARCHAR AS year FROM orders))""")
def order_due_dates(c: Corpus) -> DataFrame:
    """When each order is due, said in eight ways."""
    def part(pattern: str):
        return F.date_format("o_orderdate", pattern)

    said = F.lit(None).cast("string")
    for i, (_, way) in enumerate(_WAYS):
        said = F.when(F.col("o_orderkey") % len(_WAYS) == i, way(part)).otherwise(said)
    texts = c.table("orders").select("o_orderkey", F.concat(F.lit("Ship order "), F.col("o_orderkey").cast("string"), F.lit(" "), said).alias("text"))
    return texts.select("o_orderkey", fa.due_date(F.col("text")).alias("due_date"))


@query("G3", f"SELECT {_DECISION} FROM decisions")
def decisions(c: Corpus) -> DataFrame:
    return fa.decisions(c.sentences())


@query("G4 C11", f"SELECT {_QUESTION} FROM questions")
def questions(c: Corpus) -> DataFrame:
    return fa.questions(c.sentences(), c.segments()).select(*_cols(_QUESTION))


@query("G5", "SELECT job_id, kind, value FROM entities")
def entities(c: Corpus) -> DataFrame:
    return en.entities(c.segments(), c.names())


_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in en.KINDS)


@query("E21", f"SELECT job_id, {_COUNTS}, count(*) AS n_total FROM entities GROUP BY job_id")
def entity_counts(c: Corpus) -> DataFrame:
    return en.entity_counts(c.entities())


@query("G6", """
    SELECT m.job_id, kind, value, seg_idx, start_ms AS at_ms, m.speaker_id, display FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, kind, value ORDER BY seg_idx) AS nth FROM seg_mentions) m
    JOIN names USING (job_id, speaker_id) WHERE nth = 1""")
def first_mentions(c: Corpus) -> DataFrame:
    return en.first_mentions(c.segments(), c.names())


@query("G7", r"""
    SELECT m.job_id, value, seg_idx, start_ms AS at_ms, m.speaker_id, display FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, value ORDER BY seg_idx) AS nth FROM (
        SELECT job_id, seg_idx, start_ms, speaker_id, unnest(regexp_extract_all(text, '\b\d{4,}\b')) AS value FROM segments)) m
    JOIN names USING (job_id, speaker_id)
    WHERE nth = 1 AND (m.job_id, value) NOT IN (
      SELECT (job_id, unnest(regexp_extract_all(value, '\d{4,}'))) FROM mentions
      WHERE kind IN ('dollars', 'percent', 'loan_id', 'ticket', 'date'))""")
def bare_numbers(c: Corpus) -> DataFrame:
    return en.bare_numbers(c.segments(), c.names())


@query("D4", "SELECT job_id, seg_idx, chunk, start_ms, end_ms FROM topic_walk")
def topic_chunks(c: Corpus) -> DataFrame:
    return tp.topic_chunks(c.segments())


@query("E5", "SELECT job_id, chunk, term, n_seen, place FROM topic_terms")
def topic_keywords(c: Corpus) -> DataFrame:
    return tp.chunk_terms(c.segments(), c.topic_chunks()).withColumn("place", F.col("place").cast("long"))


@query("G8", "SELECT job_id, chunk, start_ms, end_ms, label, keywords FROM topics")
def topics(c: Corpus) -> DataFrame:
    return tp.topics(c.segments(), c.topic_chunks())


@query("E6", "SELECT job_id, term, n_seen, place FROM summary_terms")
def summary_keywords(c: Corpus) -> DataFrame:
    return tp.summary_terms(c.spoken_pieces()).withColumn("place", F.col("place").cast("long"))


@query("G9 M7", "SELECT job_id, at_ms, kind_no, item_no, event, label, speaker_id FROM timeline")
def timeline(c: Corpus) -> DataFrame:
    return tp.timeline(c.segments(), c.names(), c.topics(), c.decisions(), c.actions())


@query("G10", """
    SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY part, r) AS bullet_no, bullet FROM (
      SELECT j.job_id, 0 AS part, 0 AS r,
             CASE WHEN n = 2 THEN one || ' and ' || two || ' met for ' || dur || '.'
                  WHEN n > 2 THEN 'Meeting with ' || n || ' participants, ' || dur || ' long.'
                  ELSE 'Single-speaker recording, ' || dur || ' long.' END AS bullet
      FROM (SELECT job_id, CASE WHEN s // 60 > 0 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS dur
            FROM (SELECT job_id, duration_ms // 1000 AS s FROM jobs)) j
      LEFT JOIN (SELECT job_id, count(*) AS n, arg_min(display, speaker_id) AS one, arg_max(display, speaker_id) AS two
                 FROM names GROUP BY job_id) USING (job_id)
      UNION ALL SELECT job_id, 1, 0, 'Topics discussed: ' || string_agg(term, ', ' ORDER BY place) || '.' FROM summary_terms GROUP BY job_id
      UNION ALL SELECT job_id, 2, r, '**Decision:** ' || rtrim(decision, '.') || '.' FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sent_no) AS r FROM decisions) WHERE r <= 3
      UNION ALL SELECT job_id, 3, r, '**Action — ' || coalesce(owner, 'Team') || ':** ' || rtrim(task, '.') || coalesce(' by ' || due_date, '') || '.'
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sent_no) AS r FROM actions) WHERE r <= 5)""")
def summary_bullets(c: Corpus) -> DataFrame:
    found = tp.summary(c.jobs(), c.names(), c.spoken_pieces(), c.decisions(), c.actions())
    return found.withColumn("bullet_no", F.col("bullet_no").cast("long"))


@query("G11", f"""
    SELECT job_id, seg_idx, speaker_id, sure, at_char, name FROM introduced
    WHERE sure OR name NOT IN ({sql_list(lx.NOT_NAMES)})""")
def introductions(c: Corpus) -> DataFrame:
    return intro.introductions(c.segments())


@query("G11", f"""
    SELECT job_id, speaker_id, name, sure FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, speaker_id ORDER BY sure DESC, seg_idx, at_char, name) AS nth
      FROM introduced WHERE sure OR name NOT IN ({sql_list(lx.NOT_NAMES)})) WHERE nth = 1""")
def introduced_speakers(c: Corpus) -> DataFrame:
    return intro.best_introductions(intro.introductions(c.segments()))


_BODIES = {
    "action": ("actions", "at_ms, confidence, due_date, owner, reason, sent_no, seg_idx, speaker_id, task, text"),
    "decision": ("decisions", "at_ms, confidence, decision, reason, sent_no, seg_idx, speaker_id, text"),
    "question": ("questions", "at_ms, confidence, is_answered, question, reason, sent_no, seg_idx, speaker_id, text"),
    "entity": ("entities", "kind, value"),
    "topic": ("topics", "chunk, end_ms, keywords, label, start_ms"),
    "event": ("timeline", "at_ms, event, item_no, kind_no, label, speaker_id"),
}


def _body_sql(kind: str) -> str:
    table, fields = _BODIES[kind]
    packed = ", ".join(f"{f} := {f}" for f in sorted(fields.split(", ")))
    return f"SELECT job_id, '{kind}' AS kind, to_json(struct_pack({packed}))::VARCHAR AS body FROM {table}"


@query("G12 N3", " UNION ALL ".join(_body_sql(kind) for kind in _BODIES))
def fact_bundle(c: Corpus) -> DataFrame:
    """Every fact of every registered extractor."""
    return ex.bundle(ex.extract(c))


def _doc_mentions(kinds) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id AS job_id, source, '{k}' AS kind, unnest(regexp_extract_all(text, '{esc(lx.ENTITY_PATTERNS[k])}')) AS value FROM documents"
        for k in kinds
    )


def _nobody(c: Corpus) -> DataFrame:
    """No display names: documents keep their source as the speaker."""
    return c.spark.createDataFrame([], "job_id long, speaker_id string, display string")


_NUMBER_KINDS = ("dollars", "percent", "loan_id", "ticket", "date")


@query("G7", rf"""
    SELECT DISTINCT job_id, value, source AS display FROM (
      SELECT doc_id AS job_id, source, unnest(regexp_extract_all(text, '\b\d{{4,}}\b')) AS value FROM documents)
    WHERE (job_id, value) NOT IN (SELECT (job_id, unnest(regexp_extract_all(value, '\d{{4,}}'))) FROM ({_doc_mentions(_NUMBER_KINDS)}))""")
def document_numbers(c: Corpus) -> DataFrame:
    """Bare numbers of the written documents."""
    return en.bare_numbers(c.written_texts(), _nobody(c)).select("job_id", "value", "display")


@query("G6", f"SELECT DISTINCT job_id, kind, value, source AS display FROM ({_doc_mentions(en.NUMBER_KINDS)})")
def document_mentions(c: Corpus) -> DataFrame:
    """Amounts, codes and addresses of the written documents."""
    return en.first_mentions(c.written_texts(), _nobody(c)).select("job_id", "kind", "value", "display")
