"""The corpus tables again, as DuckDB views: the other side of every cross-check."""

from __future__ import annotations

import re

from colloquy.functions import lexicon as lx
from colloquy.sources.corpus import CUES


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding on the decimal form, as Spark rounds doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 12)), {digits}) AS DOUBLE)"


def mean(expr: str) -> str:
    """Mean over whole millionths, independent of row order."""
    return f"(sum(CAST(round({expr} * 1000000) AS BIGINT)) / count({expr}) / 1000000.0)"


_CUES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CUES.items())

VIEWS: dict[str, str] = {
    "utterances": f"""
        SELECT conv_id AS job_id, turn, role,
               trim(text) || CASE CAST((conv_id * 7 + turn) % 12 AS INT) {_CUES} ELSE '' END AS text
        FROM conversations""",
    "tokens": r"""
        SELECT job_id, turn, role, unnest(range(len(a))) AS pos, unnest(a) AS text
        FROM (SELECT job_id, turn, role, regexp_extract_all(text, '\S+') AS a FROM utterances)""",
    "timed_words": """
        SELECT job_id, turn, role, pos, word_idx, text, base AS start_ms, base + 350 AS end_ms,
               CASE WHEN (job_id * 31 + turn * 17 + pos * 7) % 10 = 0 THEN NULL
                    ELSE CAST((job_id * 13 + turn * 7 + pos * 3) % 100 AS DOUBLE) / 100 END AS confidence
        FROM (SELECT *, 400 * word_idx + 1500 * turn + 9000 * CAST(floor(turn / 4) AS BIGINT) AS base
              FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY turn, pos) - 1 AS word_idx FROM tokens))""",
    "turns": """
        SELECT job_id, turn AS turn_idx,
               CASE role WHEN 'system' THEN 'SPEAKER_02' WHEN 'user' THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker_id,
               min(start_ms) + CASE WHEN turn % 4 = 0 THEN 900 ELSE 120 END AS start_ms,
               max(end_ms) + CASE WHEN turn % 3 = 0 THEN 2600 ELSE -500 END AS end_ms
        FROM timed_words GROUP BY job_id, turn, role HAVING count(*) > 3""",
    "pairs": """
        SELECT w.job_id, w.word_idx, t.turn_idx, t.speaker_id, t.start_ms AS t_start,
               least(greatest(w.end_ms, w.start_ms + 1), t.end_ms) - greatest(w.start_ms, t.start_ms) AS overlap_ms
        FROM timed_words w JOIN turns t ON w.job_id = t.job_id
         AND t.start_ms < greatest(w.end_ms, w.start_ms + 1) AND t.end_ms > w.start_ms""",
    "best": """
        SELECT job_id, word_idx, speaker_id FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id, word_idx
                                       ORDER BY overlap_ms DESC, t_start, turn_idx) AS rn FROM pairs) WHERE rn = 1""",
    "spoken": """
        SELECT w.* EXCLUDE (speaker_id), coalesce(last_value(speaker_id IGNORE NULLS) OVER (
                 PARTITION BY job_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING), 'SPEAKER_UNKNOWN') AS speaker_id
        FROM (SELECT a.*, b.speaker_id FROM timed_words a LEFT JOIN best b USING (job_id, word_idx)) w""",
    "flagged": """
        SELECT *, same_run IS NOT TRUE AS new_seg, (same_run AND NOT prev_ends) IS NOT TRUE AS new_sent FROM (
          SELECT *, lag(speaker_id) OVER w = speaker_id AS same_run,
                 regexp_matches(lag(text) OVER w, '[.!?]$') AS prev_ends, lag(end_ms) OVER w AS lag_end
          FROM spoken WINDOW w AS (PARTITION BY job_id ORDER BY word_idx))""",
    "words": """
        SELECT job_id, turn, role, pos, word_idx, text, start_ms, end_ms, confidence, speaker_id,
               CASE WHEN NOT new_seg THEN lag_end END AS prev_end_ms,
               CAST(sum(CAST(new_seg AS INT)) OVER w - 1 AS BIGINT) AS seg_idx,
               CAST(sum(CAST(new_sent AS INT)) OVER w - 1 AS BIGINT) AS sent_no
        FROM flagged WINDOW w AS (PARTITION BY job_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING)""",
    "segments": """
        SELECT job_id, seg_idx, min(speaker_id) AS speaker_id, arg_min(start_ms, word_idx) AS start_ms,
               arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words, min(word_idx) AS first_word,
               string_agg(text, ' ' ORDER BY word_idx) AS text,
               sha256(job_id || ':' || seg_idx) AS seg_id
        FROM words GROUP BY job_id, seg_idx""",
    "sentences": """
        SELECT job_id, seg_idx, sent_no, min(speaker_id) AS speaker_id,
               arg_min(coalesce(prev_end_ms, start_ms), word_idx) AS start_ms,
               arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words,
               string_agg(text, ' ' ORDER BY word_idx) AS text
        FROM words GROUP BY job_id, seg_idx, sent_no""",
    "names": """
        SELECT job_id, speaker_id, first_seg,
               CASE WHEN speaker_id = 'SPEAKER_UNKNOWN' THEN 'Unknown' ELSE 'Speaker ' || CAST(
                 sum(CASE WHEN speaker_id <> 'SPEAKER_UNKNOWN' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY job_id ORDER BY first_seg ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS display
        FROM (SELECT job_id, speaker_id, min(seg_idx) AS first_seg FROM segments GROUP BY ALL)""",
    "jobs": """
        SELECT job_id, max(end_ms) + 500 AS duration_ms, 'en' AS language FROM timed_words GROUP BY job_id""",
}



def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


def _rule_rows(rules) -> str:
    items = ", ".join(
        f"struct_pack(rank := {i}, confidence := {conf}::DOUBLE, owned := {str(owned).lower()}, reason := '{reason}', item := "
        f"regexp_replace(trim(regexp_extract(text, '{esc(rf'(?i)\b{lead}\b{gap}{lx.ITEM}')}', 1)), '[.,;:]+$', ''))"
        for i, (lead, gap, conf, owned, reason) in enumerate(rules)
    )
    # First rule that matches in each sentence, then the first sentence of each item.
    return f"""
        SELECT * EXCLUDE (nth) FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id, lower(item) ORDER BY sent_no) AS nth FROM (
            SELECT s.job_id, s.sent_no, s.seg_idx, s.speaker_id, s.start_ms AS at_ms, s.text, m.* FROM (
              SELECT *, list_filter([{items}], lambda x: length(x.item) >= 1)[1] AS m FROM sentences) s
            WHERE m IS NOT NULL)) WHERE nth = 1"""


def _bounded(kind: str) -> str:
    # RE2 sees a word border beside accented letters; a digit in their place keeps acronyms whole.
    return r"regexp_replace(text, '[^\x00-\x7F]', '0', 'g')" if kind == "acronym" else "text"


def _in(values) -> str:
    return "(" + sql_list(values) + ")"


def due_sql(text: str) -> str:
    """Due date of a text: first hit of each rule in a numbered list of its words."""
    words = f"list_transform(string_split_regex({text}, '\\s+'), lambda w: {{'r': w, 'b': regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')}})"
    which, span = (_in(x) for x in lx.DUE_WORDS)
    days, months = _in(lx.WEEKDAYS), _in(lx.MONTHS)
    low = lambda i: f"coalesce(lower(v.w[{i}].b), '')"
    fits = f"{low('i')} = 'by' AND {low('i + 1')} IN {months} AND regexp_full_match({low('i + 2')}, '[0-9]{{1,2}}(st|nd|rd|th)?')"
    year = f"regexp_full_match({low('i + 3')}, '[0-9]{{4}}') AND regexp_matches(v.w[i + 2].r, '[^.!?;:]$')"
    rules = [
        f"CASE WHEN {low('i')} = 'by' AND {low('i + 1')} IN {days} THEN v.w[i + 1].b WHEN {low('i')} = 'by' AND {low('i + 1')} = 'next' AND {low('i + 2')} IN {days} THEN v.w[i + 1].b || ' ' || v.w[i + 2].b END",
        f"CASE WHEN {fits} AND {year} THEN v.w[i + 1].b || ' ' || v.w[i + 2].r || ' ' || v.w[i + 3].b WHEN {fits} THEN v.w[i + 1].b || ' ' || v.w[i + 2].b END",
        f"CASE WHEN {low('i')} IN {which} AND {low('i + 1')} IN {span} THEN v.w[i].b || ' ' || v.w[i + 1].b END",
        f"CASE WHEN {low('i')} = 'by' AND {low('i + 1')} = 'eod' THEN 'end of day' END", f"CASE WHEN {low('i')} = 'tomorrow' THEN 'tomorrow' END", f"CASE WHEN {low('i')} = 'today' THEN 'today' END",
    ]
    found = ", ".join(f"list_filter(list_transform(range(1, len(v.w) + 1), lambda i: {r}), lambda x: x IS NOT NULL)[1]" for r in rules)
    return f"list_transform([{{'w': {words}}}], lambda v: coalesce({found}))[1]"


_FIRST = esc(r"(?i),?\s*(?:" + "|".join(lx.TAGS) + r")\?$")

VIEWS.update({
    "acted": _rule_rows(lx.ACTION_RULES),
    "decided": _rule_rows(lx.DECISION_RULES),
    "actions": f"""
        SELECT a.job_id, sent_no, seg_idx, speaker_id, at_ms, text, item AS task,
               CASE WHEN owned THEN coalesce(display, speaker_id) END AS owner,
               {due_sql('text')} AS due_date,
               confidence, reason
        FROM acted a LEFT JOIN names n USING (job_id, speaker_id)""",
    "decisions": """
        SELECT job_id, sent_no, seg_idx, speaker_id, at_ms, text, item AS decision, confidence, reason
        FROM decided""",
    "asked": f"""
        SELECT *, row_number() OVER (PARTITION BY job_id, lower(text) ORDER BY sent_no) AS nth FROM (
          SELECT *, trim(regexp_replace(text, '{_FIRST}', '')) AS core,
                 trim(lower(regexp_replace(text, '[? ]+$', ''))) AS bare FROM sentences WHERE text LIKE '%?')
        WHERE bare NOT IN {_in(lx.BACKCHANNELS)} AND length(text) >= 20
          AND NOT (core <> '' AND core NOT LIKE '%?' AND
                   regexp_replace(lower(regexp_extract(core, '^(\\S+)', 1)), '[?,;:]+$', '') NOT IN {_in(lx.QUESTION_WORDS)})""",
    "questions": f"""
        SELECT job_id, sent_no, seg_idx, speaker_id, at_ms, text, text AS question,
               coalesce(reply_ms - at_ms <= 30000 AND NOT unsure, false) AS is_answered,
               0.95::DOUBLE AS confidence, 'ends with a question mark' AS reason
        FROM (SELECT a.job_id, a.sent_no, a.seg_idx, a.speaker_id, a.start_ms AS at_ms, a.text,
                     r.start_ms AS reply_ms,
                     {" OR ".join(f"starts_with(lower(trim(r.text)), '{esc(p)}')" for p in lx.UNSURE)} AS unsure,
                     row_number() OVER (PARTITION BY a.job_id, a.sent_no ORDER BY r.seg_idx) AS rn
              FROM asked a LEFT JOIN segments r ON r.job_id = a.job_id AND r.seg_idx > a.seg_idx
                                               AND r.speaker_id <> a.speaker_id
              WHERE a.nth = 1) WHERE rn = 1""",
    "full_text": """
        SELECT job_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM segments GROUP BY job_id""",
    "mentions": " UNION ALL ".join(
        f"SELECT job_id, '{kind}' AS kind, unnest(regexp_extract_all({_bounded(kind)}, '{esc(p)}')) AS value FROM full_text"
        for kind, p in {"person": lx.TITLED_PERSON, **lx.ENTITY_PATTERNS}.items()
    ),
    "entities": f"""
        SELECT DISTINCT job_id, kind, value FROM (
          SELECT * FROM mentions WHERE NOT (kind = 'acronym' AND value IN {_in(lx.SHORT_CAPS)})
          UNION ALL SELECT job_id, 'person', display FROM names)""",
    "seg_mentions": " UNION ALL ".join(
        f"SELECT job_id, seg_idx, start_ms, speaker_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{esc(lx.ENTITY_PATTERNS[kind])}')) AS value FROM segments"
        for kind in ("dollars", "percent", "date", "loan_id", "ticket", "url", "email")
    ),
    "topic_walk": """
        SELECT job_id, seg_idx, start_ms, end_ms, CAST(0 AS BIGINT) AS chunk, start_ms AS chunk_start FROM segments WHERE seg_idx = 0
        UNION ALL
        SELECT s.job_id, s.seg_idx, s.start_ms, s.end_ms,
               CASE WHEN s.start_ms - w.end_ms >= 8000 OR s.end_ms - w.chunk_start >= 300000 THEN w.chunk + 1 ELSE w.chunk END,
               CASE WHEN s.start_ms - w.end_ms >= 8000 OR s.end_ms - w.chunk_start >= 300000 THEN s.start_ms ELSE w.chunk_start END
        FROM topic_walk w JOIN segments s ON s.job_id = w.job_id AND s.seg_idx = w.seg_idx + 1""",
    "topic_terms": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id, chunk ORDER BY n_seen DESC, first) AS place FROM (
            SELECT job_id, chunk, term, count(*) AS n_seen, min(word_idx * 100000 + spot) AS first FROM (
              SELECT w.job_id, t.chunk, w.word_idx, unnest(range(len(a))) AS spot, unnest(a) AS term
              FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS a FROM words) w
              JOIN topic_walk t USING (job_id, seg_idx))
            WHERE term NOT IN {_in(lx.STOP_WORDS)} GROUP BY ALL)) WHERE place <= 3""",
    "topics": """
        SELECT c.job_id, c.chunk, start_ms, end_ms, coalesce(keywords, '') AS keywords,
               CASE WHEN k IS NULL THEN 'General discussion' WHEN len(k) = 1 THEN 'Discussion about ' || k[1]
                    ELSE 'Discussion about ' || k[1] || ', ' || k[2] END AS label
        FROM (SELECT job_id, chunk, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms
              FROM topic_walk GROUP BY ALL) c
        LEFT JOIN (SELECT job_id, chunk, string_agg(term, ',' ORDER BY place) AS keywords, list(term ORDER BY place) AS k
                   FROM topic_terms GROUP BY ALL) t USING (job_id, chunk)""",
    "timeline": """
        SELECT * EXCLUDE (nth) FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id, at_ms, event ORDER BY kind_no, item_no) AS nth FROM (
            SELECT job_id, arg_min(start_ms, seg_idx) AS at_ms, 0 AS kind_no, 0 AS item_no, 'Meeting begins' AS event, 'Meeting begins' AS label, NULL AS speaker_id
            FROM segments GROUP BY job_id
            UNION ALL SELECT n.job_id, s.start_ms, 1, s.seg_idx, display || ' speaks', display || ' speaks', n.speaker_id
            FROM names n JOIN segments s ON s.job_id = n.job_id AND s.seg_idx = n.first_seg
            WHERE (SELECT count(*) FROM names m WHERE m.job_id = n.job_id) > 1
            UNION ALL SELECT job_id, start_ms, 2, chunk, 'Topic: ' || label, 'Topic: ' || CASE WHEN length(label) > 60 THEN left(label, 60) || '...' ELSE label END, NULL
            FROM topics
            UNION ALL SELECT job_id, at_ms, 3, sent_no, 'Decision: ' || decision, 'Decision: ' || CASE WHEN length(decision) > 60 THEN left(decision, 60) || '...' ELSE decision END, speaker_id
            FROM decisions
            UNION ALL SELECT job_id, at_ms, 4, sent_no, 'Action item: ' || task, 'Action item: ' || CASE WHEN length(task) > 60 THEN left(task, 60) || '...' ELSE task END, speaker_id
            FROM actions
            UNION ALL SELECT job_id, arg_max(end_ms, seg_idx), 5, 0, 'Meeting ends', 'Meeting ends', NULL FROM segments GROUP BY job_id)) WHERE nth = 1""",
    "summary_terms": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_seen DESC, first) AS place FROM (
            SELECT job_id, term, count(*) AS n_seen, min(word_idx * 100000 + spot) AS first FROM (
              SELECT job_id, word_idx, unnest(range(len(a))) AS spot, unnest(a) AS term
              FROM (SELECT *, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS a FROM words))
            WHERE regexp_full_match(term, '[a-z]{{4,}}') AND term NOT IN {_in(lx.STOP_WORDS)} GROUP BY ALL)) WHERE place <= 5""",
    # Words of a segment with their neighbours and places; a phrase is a row whose next words fit.
    "spoken_words": r"""
        SELECT *, regexp_matches(r0, '[\\p{L}\\p{N}]$') AND regexp_matches(r1, '^[\\p{L}\\p{N}]') AS c1, regexp_matches(r1, '[\\p{L}\\p{N}]$') AND regexp_matches(r2, '^[\\p{L}\\p{N}]') AS c2,
               regexp_matches(r2, '[\\p{L}\\p{N}]$') AND regexp_matches(r3, '^[\\p{L}\\p{N}]') AS c3, regexp_matches(r2, '[\\p{L}\\p{N}]$') AS open2 FROM (
          SELECT *, coalesce(lead(b0) OVER w, '') AS b1, coalesce(lead(b0, 2) OVER w, '') AS b2, coalesce(lead(b0, 3) OVER w, '') AS b3,
                 lead(r0) OVER w AS r1, lead(r0, 2) OVER w AS r2, lead(r0, 3) OVER w AS r3, coalesce(sum(length(r0) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + length(regexp_extract(r0, '^([^\\p{L}\\p{N}]*)', 1)) + 1 AS at_char FROM (
            SELECT job_id, seg_idx, speaker_id, i, r0, regexp_replace(r0, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS b0 FROM (
              SELECT job_id, seg_idx, speaker_id, unnest(range(len(a))) AS i, unnest(a) AS r0 FROM (SELECT *, string_split(text, ' ') AS a FROM segments)))
          WINDOW w AS (PARTITION BY job_id, seg_idx ORDER BY i))""".replace("\\\\", "\\"),
    "introduced": f"""
        SELECT job_id, seg_idx, speaker_id, sure, min(at_char)::BIGINT AS at_char, name FROM (
          SELECT *, CASE WHEN b0 = 'I' AND b1 = 'am' AND c1 AND c2 AND regexp_full_match(b2, '[A-Z][A-Za-z]+') THEN b2 WHEN b0 IN ('I''m', 'Im') AND c1 AND regexp_full_match(b1, '[A-Z][A-Za-z]+') THEN b1
                 WHEN lower(b0) = 'my' AND lower(b1) = 'name' AND lower(b2) = 'is' AND c1 AND c2 AND c3 AND regexp_full_match(b3, '[A-Za-z]{{2,}}') THEN b3
                 WHEN lower(b0) = 'my' AND lower(b1) IN ('name''s', 'names') AND c1 AND c2 AND regexp_full_match(b2, '[A-Za-z]{{2,}}') THEN b2 END AS sure_name,
                 CASE WHEN i = 0 AND b1 IN ('here', 'speaking') AND c1 AND regexp_full_match(b0, '[A-Z][A-Za-z]+') THEN b0
                 WHEN b0 IN ('This', 'this') AND b1 = 'is' AND c1 AND c2 AND regexp_full_match(b2, '[A-Z][A-Za-z]+') AND NOT (open2 AND lower(b3) IN {_in(lx.POINTING)}) THEN b2 END AS likely_name,
                 coalesce(sure_name, likely_name) AS name, sure_name IS NOT NULL AS sure FROM spoken_words)
        WHERE name IS NOT NULL GROUP BY job_id, seg_idx, speaker_id, sure, name""",
})

_RECURSIVE = {"topic_walk"}


def with_views(sql: str) -> str:
    """Prefix sql with the views it uses, directly or through others."""
    seen: set[str] = set()
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"(?i)\b(?:from|join)\s+{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    own = re.match(r"(?is)^\s*with\s+(recursive\s+)?(.*)$", sql)
    word = "WITH RECURSIVE " if seen & _RECURSIVE or (own and own.group(1)) else "WITH "
    parts = [f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({VIEWS[n]})" for n in order]
    return word + ",\n".join(parts) + (",\n" + own.group(2) if own else "\n" + sql.strip())
