"""Statistics, quality, review and search over all meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.operators import attribution as at
from colloquy.operators import metrics as me
from colloquy.operators import review as rv
from colloquy.operators import search as se
from colloquy.plans.registry import query
from colloquy.plans.sql_views import VIEWS, mean, rnd, sql_list
from colloquy.sources.corpus import Corpus

_BARE = "regexp_replace(text, '[.,;:!?]+$', '')"

VIEWS["word_stats"] = f"""
    SELECT job_id, count(*) AS n_words, count(confidence) AS n_scored, count(*) FILTER (confidence < 0.65) AS n_low,
           {rnd(mean('confidence'), 4)} AS avg_confidence FROM words GROUP BY job_id"""
VIEWS["meeting_stats"] = """
    SELECT w.*, n_speakers, n_segments, coalesce(n_corrections, 0) AS n_corrections FROM word_stats w
    JOIN (SELECT job_id, count(DISTINCT speaker_id) AS n_speakers, count(*) AS n_segments FROM segments GROUP BY job_id) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_corrections FROM corrections GROUP BY job_id) USING (job_id)"""
_EDGES = [None, 0.5, 0.6, 0.7, 0.8, 0.9, None]
_BINS = ", ".join(
    f"count(*) FILTER (confidence >= {lo if lo is not None else -1} AND confidence < {hi if hi is not None else 99}) AS bin_{i}"
    for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))
)
VIEWS["histogram"] = f"SELECT job_id, {_BINS} FROM words GROUP BY job_id"
VIEWS["name_parts"] = """
    SELECT DISTINCT job_id, unnest(string_split(lower(display), ' ')) AS token FROM names"""


@query("E1", "SELECT * FROM meeting_stats")
def transcript_stats(c: Corpus) -> DataFrame:
    return me.transcript_stats(c.words(), c.segments(), c.corrections())


@query("E2", "SELECT * FROM histogram")
def confidence_histogram(c: Corpus) -> DataFrame:
    return me.confidence_histogram(c.words())


@query("E4", """
    SELECT j.job_id, round(duration_ms / 1000.0, 2)::DOUBLE AS duration_s, language, s.* EXCLUDE (job_id), h.* EXCLUDE (job_id),
           coalesce(n_actions, 0) AS n_actions, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_questions, 0) AS n_questions,
           coalesce(n_open_questions, 0) AS n_open_questions, coalesce(n_entities, 0) AS n_entities,
           coalesce(n_events, 0) AS n_events, coalesce(n_topics, 0) AS n_topics, """ + rnd('n_words / 200.0', 2) + """ AS reading_minutes
    FROM jobs j LEFT JOIN meeting_stats s USING (job_id) LEFT JOIN histogram h USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_actions FROM actions GROUP BY 1) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_decisions FROM decisions GROUP BY 1) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_questions, count(*) FILTER (NOT is_answered) AS n_open_questions FROM questions GROUP BY 1) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_entities FROM entities GROUP BY 1) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_events FROM timeline GROUP BY 1) USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS n_topics FROM topics GROUP BY 1) USING (job_id)""")
def meeting_metrics(c: Corpus) -> DataFrame:
    stats = me.transcript_stats(c.words(), c.segments(), c.corrections())
    return me.meeting_metrics(
        c.jobs(), stats, me.confidence_histogram(c.words()), c.actions(), c.decisions(), c.questions(),
        c.entities(), c.timeline(), c.topics(),
    )


def _top_sql(source: str, where: str, having: str) -> str:
    return f"""
    SELECT job_id, term, n_seen, place FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_seen DESC, first_idx) AS place FROM (
        SELECT job_id, term, count(*) AS n_seen, min(word_idx) AS first_idx FROM ({source}) WHERE {where} GROUP BY job_id, term HAVING {having}))"""


@query("E7 C13", _top_sql(
    f"SELECT job_id, word_idx, {_BARE} AS term FROM words",
    f"regexp_matches(term, '^[A-Z][a-z]{{2,}}$') AND term NOT IN ({sql_list(lx.OPENING_WORDS)}) "
    "AND (job_id, lower(term)) NOT IN (SELECT (job_id, token) FROM name_parts)", "count(*) >= 2"))
def frequent_names(c: Corpus) -> DataFrame:
    return me.frequent_names(c.words(), c.names())


@query("E8 C13", _top_sql(
    f"SELECT job_id, word_idx, {_BARE} AS term FROM words",
    "regexp_matches(term, '^[A-Z]{2,}$') AND (job_id, term) NOT IN (SELECT (job_id, upper(original)) FROM corrections "
    "UNION SELECT (job_id, upper(replacement)) FROM corrections)", "true"))
def unknown_acronyms(c: Corpus) -> DataFrame:
    return me.unknown_acronyms(c.words(), c.corrections())


@query("E9", _top_sql(
    f"SELECT job_id, word_idx, lower({_BARE}) AS term FROM words WHERE confidence < 0.65", "length(term) > 2", "count(*) >= 2"))
def repeated_uncertain_words(c: Corpus) -> DataFrame:
    return me.repeated_uncertain(c.words())


@query("E9", _top_sql(
    f"SELECT 0::BIGINT AS job_id, job_id * 1000000 + word_idx AS word_idx, lower({_BARE}) AS term FROM words WHERE confidence < 0.65", "length(term) > 2", "count(*) >= 2"))
def one_meeting_uncertain_words(c: Corpus) -> DataFrame:
    """All words as those of one meeting, their ranks in seven ranges."""
    one = c.words().withColumn("word_idx", F.col("job_id") * 1_000_000 + F.col("word_idx")).withColumn("job_id", F.lit(0).cast("long"))
    return me.repeated_uncertain(one, ranges=7)


@query("E10", """
    SELECT * FROM (
      SELECT job_id, seg_idx, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS place, n_low, start_ms, end_ms, text,
             CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview
      FROM segments JOIN (SELECT job_id, seg_idx, count(*) AS n_low FROM words WHERE confidence < 0.65 GROUP BY ALL HAVING count(*) >= 2)
      USING (job_id, seg_idx))""")
def low_segments_by_count(c: Corpus) -> DataFrame:
    return me.low_segments_by_count(c.words(), c.segments())


@query("E11", f"""
    SELECT job_id, seg_idx, speaker_id, start_ms, {rnd('a', 4)} AS avg_confidence, text,
           CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS preview
    FROM segments JOIN (SELECT job_id, seg_idx, {mean('confidence')} AS a FROM words GROUP BY ALL) USING (job_id, seg_idx) WHERE a < 0.65""")
def low_segments_by_average(c: Corpus) -> DataFrame:
    return me.low_segments_by_average(c.words(), c.segments())


@query("E12 C13", f"""
    WITH terms AS (SELECT job_id, seg_idx, word_idx, confidence, {_BARE} AS term FROM words),
    small AS (SELECT DISTINCT job_id, lower(term) AS token FROM terms WHERE regexp_matches(term, '^\\p{{Ll}}')),
    titled AS (SELECT job_id, term, count(*) AS n_seen, {mean('confidence')} AS a, min(seg_idx) AS seg_idx FROM terms
               WHERE regexp_matches(term, '^[A-Z][a-z]{{2,}}$') GROUP BY job_id, term)
    SELECT * FROM (
      SELECT t.job_id, term, row_number() OVER (PARTITION BY t.job_id ORDER BY term) AS place, n_seen,
             {rnd('a', 4)} AS avg_confidence, start_ms AS first_ms
      FROM titled t JOIN segments USING (job_id, seg_idx)
      WHERE (n_seen = 1 OR a < 0.65) AND NOT EXISTS (SELECT 1 FROM small s WHERE s.job_id = t.job_id AND s.token = lower(t.term))
        AND NOT EXISTS (SELECT 1 FROM name_parts s WHERE s.job_id = t.job_id AND s.token = lower(t.term)))""")
def doubtful_names(c: Corpus) -> DataFrame:
    return me.doubtful_names(c.words(), c.segments(), c.names())


@query("E13", """
    SELECT term, n_seen, n_total FROM (
      SELECT term, count(*) AS n_seen, CAST(sum(count(*)) OVER () AS BIGINT) AS n_total
      FROM (SELECT trim(text, '.,!?;:') AS term FROM words) WHERE term <> '' GROUP BY term)
    WHERE n_seen >= 3 AND (regexp_matches(term, '^[A-Z][A-Z0-9_]+$') OR regexp_matches(term, '^[A-Z][a-z]{2,}$'))""")
def suggested_vocabulary(c: Corpus) -> DataFrame:
    return me.suggested_vocabulary(c.words())


@query("D5", """
    SELECT job_id, seg_idx, para_no, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words,
           string_agg(text, ' ' ORDER BY word_idx) AS text
    FROM (SELECT *, CAST(sum(CASE WHEN runs_on THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY word_idx) - 1 AS BIGINT) AS para_no FROM (
      SELECT *, coalesce(lag(seg_idx) OVER w = seg_idx AND start_ms - lag(end_ms) OVER w < 2500, false) AS runs_on
      FROM words WINDOW w AS (PARTITION BY job_id ORDER BY word_idx))) GROUP BY job_id, seg_idx, para_no""")
def paragraphs(c: Corpus) -> DataFrame:
    return rv.paragraphs(c.words())


@query("H1", """
    SELECT job_id, word_idx, seg_idx, start_ms, display, word, confidence, context FROM (
      SELECT job_id, word_idx, seg_idx, start_ms, speaker_id, text AS word, confidence,
             string_agg(text, ' ') OVER (PARTITION BY job_id, sent_no ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS context
      FROM words) JOIN names USING (job_id, speaker_id) WHERE confidence < 0.65""")
def uncertain_words(c: Corpus) -> DataFrame:
    return rv.uncertain_words(c.words(), c.sentences(), c.names())


VIEWS["changes"] = """
    SELECT job_id, start_ms, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS k FROM (
      SELECT *, lag(speaker_id) OVER (PARTITION BY job_id ORDER BY seg_idx) AS p FROM segments) WHERE p <> speaker_id"""


@query("D7", """
    WITH RECURSIVE counted AS (
      SELECT a.job_id, a.k, a.start_ms, count(*) AS n_changes FROM changes a JOIN changes b
        ON a.job_id = b.job_id AND b.start_ms >= a.start_ms AND b.start_ms < a.start_ms + 30000 GROUP BY ALL),
    hop AS (SELECT *, CASE WHEN n_changes >= 4 THEN k + n_changes ELSE k + 1 END AS nxt FROM counted),
    walk AS (SELECT * FROM hop WHERE k = 1 UNION ALL SELECT h.* FROM walk w JOIN hop h ON h.job_id = w.job_id AND h.k = w.nxt)
    SELECT job_id, start_ms, start_ms + 30000 AS end_ms, n_changes FROM walk WHERE n_changes >= 4""")
def rapid_switches(c: Corpus) -> DataFrame:
    return rv.rapid_switches(c.segments())


@query("D8", """
    SELECT job_id, seg_idx, start_ms, end_ms, speaker_id, other FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS nth FROM (
        SELECT job_id, seg_idx, start_ms, speaker_id, lead(end_ms, 5) OVER w AS end_ms, lead(speaker_id) OVER w AS other,
               lead(speaker_id, 2) OVER w AS s2, lead(speaker_id, 3) OVER w AS s3, lead(speaker_id, 4) OVER w AS s4, lead(speaker_id, 5) OVER w AS s5
        FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seg_idx))
      WHERE speaker_id <> other AND s2 = speaker_id AND s4 = speaker_id AND s3 = other AND s5 = other) WHERE nth = 1""")
def alternating_pairs(c: Corpus) -> DataFrame:
    return rv.alternating_pairs(c.segments())


@query("D9", """
    SELECT job_id, seg_idx, speaker_id, start_ms, end_ms, text FROM segments WHERE end_ms - start_ms < 1500 AND n_words > 0""")
def short_segments(c: Corpus) -> DataFrame:
    return rv.short_segments(c.segments())


@query("C12", """
    SELECT c.job_id, c.seg_idx, step, original, replacement, confidence, seg_id, start_ms AS at_ms
    FROM corrections c LEFT JOIN segments USING (job_id, seg_idx)""")
def corrections_with_time(c: Corpus) -> DataFrame:
    left = c.segments().select("job_id", "seg_idx", "seg_id", F.col("start_ms").alias("at_ms"))
    return c.corrections().join(left, ["job_id", "seg_idx"], "left").select(
        "job_id", "seg_idx", "step", "original", "replacement", "confidence", "seg_id", "at_ms"
    )


_SNIPPET = """(SELECT (CASE WHEN lo > 0 THEN '…' ELSE '' END) || array_to_string(list_concat(w[lo + 1:i], ['**' || w[i + 1] || '**'], w[i + 2:hi]), ' ')
                 || (CASE WHEN hi < n THEN '…' ELSE '' END))"""
VIEWS["phrase_hits"] = f"""
    SELECT job_id, 0 AS kind_no, 'segment' AS kind, seg_idx AS item_no, start_ms AS at_ms, display AS speaker, text, {_SNIPPET} AS context
    FROM (SELECT *, greatest(i - 8, 0) AS lo, least(i + 9, n) AS hi FROM (
      SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n,
             length(left(text, strpos(lower(text), 'the budget'))) - length(replace(left(text, strpos(lower(text), 'the budget')), ' ', '')) AS i
      FROM segments JOIN names USING (job_id, speaker_id) WHERE contains(lower(text), 'the budget')))
    UNION ALL SELECT job_id, 1, 'action_item', sent_no, at_ms, speaker_id, task, 'Action item, owner: ' || coalesce(owner, '—') FROM actions WHERE contains(lower(task), 'the budget')
    UNION ALL SELECT job_id, 2, 'decision', sent_no, at_ms, speaker_id, decision, 'Decision' FROM decisions WHERE contains(lower(decision), 'the budget')
    UNION ALL SELECT job_id, 3, 'question', sent_no, at_ms, speaker_id, question, 'Question' FROM questions WHERE contains(lower(question), 'the budget')"""


def _hits(c: Corpus) -> DataFrame:
    return se.search("The Budget", c.segments(), c.names(), c.actions(), c.decisions(), c.questions())


@query("H3 H5", "SELECT * FROM phrase_hits")
def phrase_search(c: Corpus) -> DataFrame:
    return _hits(c)


@query("H3", "SELECT * FROM phrase_hits ORDER BY at_ms, job_id, kind_no, item_no LIMIT 20")
def earliest_hits(c: Corpus) -> DataFrame:
    return se.first_hits(_hits(c), 20)


@query("H4", """
    SELECT job_id, 'action' AS kind, sent_no, at_ms, speaker_id, task AS text FROM actions
    UNION ALL SELECT job_id, 'decision', sent_no, at_ms, speaker_id, decision FROM decisions
    UNION ALL SELECT job_id, 'question', sent_no, at_ms, speaker_id, question FROM questions""")
def preset_lists(c: Corpus) -> DataFrame:
    tables = (c.actions(), c.decisions(), c.questions())
    return se.preset("action items", *tables).union(se.preset("decisions", *tables)).union(se.preset("questions", *tables))


@query("H6", """
    SELECT job_id, seg_idx, start_ms, display, text, (SELECT count(*) FROM segments WHERE contains(lower(text), 'is')) > 50 AS truncated
    FROM (SELECT * FROM segments WHERE contains(lower(text), 'is') ORDER BY job_id, seg_idx LIMIT 50) JOIN names USING (job_id, speaker_id)""")
def typed_search(c: Corpus) -> DataFrame:
    return se.typed_search("is", c.segments(), c.names())


def _json_sql(source: str, section: str, place: str, fields: str) -> str:
    pack = ", ".join(f"{f} := {f}" if ":=" not in f else f for f in fields.split(", "))
    return f"SELECT job_id, '{section}' AS section, {place}::BIGINT AS place, to_json(struct_pack({pack}))::VARCHAR AS body FROM {source}"


_INDEX_PARTS = [
    ("jobs", "meta", "0", "version := 1, language, duration_ms"),
    ("names", "speaker", "first_seg", "speaker_id, display"),
    ("segments JOIN names USING (job_id, speaker_id)", "segment", "seg_idx", "seg_id, speaker_id, display, start_ms, end_ms, text"),
    ("words", "word", "word_idx", "seg_idx, text, start_ms, end_ms, confidence"),
    ("topics", "topic", "chunk", "start_ms, end_ms, label, keywords"),
    ("actions", "action", "sent_no", "task, owner, due_date, at_ms, speaker_id, confidence, reason"),
    ("decisions", "decision", "sent_no", "decision, at_ms, speaker_id, confidence, reason"),
    ("questions", "question", "sent_no", "question, is_answered, at_ms, speaker_id, confidence"),
    ("entities", "entity", "('0x' || left(md5(value), 5))::INT", "kind, value"),
    ("corrections LEFT JOIN segments USING (job_id, seg_idx)", "correction", "seg_idx", "original, replacement, confidence, profile, seg_id, start_ms"),
]
VIEWS["index_all"] = " UNION ALL ".join(_json_sql(*p) for p in _INDEX_PARTS)


def _index(c: Corpus) -> DataFrame:
    return se.index_rows(
        c.jobs(), c.names(), c.words(), c.segments(), c.topics(), c.entities(), c.actions(), c.decisions(), c.questions(), c.corrections()
    )


@query("A10", "SELECT * FROM index_all")
def search_index_rows(c: Corpus) -> DataFrame:
    return _index(c)


@query("A10", """
    SELECT job_id, section, place // 1000 AS piece, count(*) AS n, '[' || string_agg(body, ',' ORDER BY place, body) || ']' AS document
    FROM index_all GROUP BY ALL""")
def search_index_documents(c: Corpus) -> DataFrame:
    return se.index_documents(_index(c))


@query("C8", """
    SELECT job_id, speaker_id, CASE WHEN (job_id, speaker_id) IN (SELECT (job_id, speaker_id) FROM introduced WHERE sure)
      THEN 'Alice' ELSE display END AS display FROM names""")
def renamed_speakers(c: Corpus) -> DataFrame:
    from colloquy.operators import introductions as intro

    sure = intro.best_introductions(intro.introductions(c.segments())).filter("sure")
    return at.rename_speakers(c.names(), sure.select("job_id", "speaker_id", F.col("name").alias("new_name")))
