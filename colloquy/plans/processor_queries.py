"""Text processors over all meetings."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.functions.text import glued
from colloquy.operators import attribution as at
from colloquy.operators import processors as pr
from colloquy.operators import vocabulary as vo
from colloquy.operators.fuzzy import near_words
from colloquy.plans.registry import query
from colloquy.plans.sql_views import VIEWS, esc, rnd, sql_list
from colloquy.sources.corpus import Corpus
from colloquy.sources.profiles import list_profiles, load_profile, vocabulary_table

SALES = load_profile("sales")
GENERIC = load_profile("generic")


# -- the SQL side ----------------------------------------------------------------------

VIEWS["kept_words"] = f"""
    SELECT * EXCLUDE (psg, plow) FROM (
      SELECT *, lag(seg_idx) OVER w AS psg, lag(lower(text)) OVER w AS plow FROM words
      WINDOW w AS (PARTITION BY job_id ORDER BY word_idx))
    WHERE NOT coalesce(psg = seg_idx AND plow = lower(text), false)
       OR lower(text) IN ({sql_list(lx.EMPHASIS)}) OR length(text) < 4"""

_WORDISH = r"[\p{L}\p{N}_]"
VIEWS["kept_texts"] = """
    SELECT job_id, seg_idx, string_agg(text, ' ' ORDER BY word_idx) AS text FROM kept_words GROUP BY ALL"""
VIEWS["pieces"] = rf"""
    SELECT job_id, seg_idx, i, piece, regexp_matches(piece, '^{_WORDISH}') AS wordish FROM (
      SELECT job_id, seg_idx, unnest(range(len(p))) AS i, unnest(p) AS piece FROM (
        SELECT job_id, seg_idx, regexp_extract_all(text, '{_WORDISH}+|[^\p{{L}}\p{{N}}_]+') AS p FROM kept_texts))"""
VIEWS["word_runs"] = r"""
    SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, seg_idx ORDER BY i) AS run FROM (
      SELECT *, coalesce(lower(piece) = lower(lag(piece, 2) OVER w) AND wordish
                         AND regexp_full_match(lag(piece) OVER w, '\s+'), false) AS again
      FROM pieces WINDOW w AS (PARTITION BY job_id, seg_idx ORDER BY i)) WHERE wordish"""
VIEWS["dropped_pieces"] = f"""
    SELECT job_id, seg_idx, i FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, seg_idx, run ORDER BY i) AS nth,
             count(*) OVER (PARTITION BY job_id, seg_idx, run) AS n FROM word_runs)
    WHERE nth > 1 AND (n > 2 OR lower(piece) NOT IN ({sql_list(lx.EMPHASIS)}))"""
VIEWS["tidy_texts"] = r"""
    SELECT job_id, seg_idx, trim(regexp_replace(regexp_replace(regexp_replace(
             string_agg(piece, '' ORDER BY i), '\s+([,.!?;:])', '\1', 'g'), '^[,.]+\s*', ''), ' {2,}', ' ', 'g')) AS text
    FROM pieces p WHERE NOT EXISTS (
      SELECT 1 FROM dropped_pieces d WHERE d.job_id = p.job_id AND d.seg_idx = p.seg_idx AND d.i IN (p.i, p.i + 1)
        AND (d.i = p.i OR NOT p.wordish))
    GROUP BY ALL"""


def _vocabulary_sql() -> str:
    inner = "SELECT job_id, seg_idx, text AS t0 FROM segments"
    steps = list(pr._alias_steps(SALES))
    for k, (entry, alias, _) in enumerate(steps):
        pattern = esc(("" if entry.case_sensitive else "(?i)") + rf"\b{re.escape(alias)}\b")
        t = f"t{k}"
        if entry.context:
            hits = " + ".join(f"CAST(contains(lower({t}), '{esc(c.lower())}') AS INT)" for c in entry.context)
            conf = f"CASE WHEN {hits} = 0 THEN {entry.confidence}::DOUBLE * 0.4::DOUBLE ELSE least(1.0::DOUBLE, {entry.confidence}::DOUBLE + 0.02::DOUBLE * ({hits})) END"
        else:
            conf = f"{entry.confidence}::DOUBLE"
        inner = (
            f"SELECT *, CASE WHEN c{k} >= 0.8 THEN regexp_replace({t}, '{pattern}', '{entry.canonical}', 'g') ELSE {t} END AS t{k + 1}"
            f" FROM (SELECT *, {conf} AS c{k} FROM ({inner}))"
        )
    return inner


def _fix_rows() -> str:
    parts = []
    for k, (entry, alias, _) in enumerate(pr._alias_steps(SALES)):
        pattern = esc(("" if entry.case_sensitive else "(?i)") + rf"\b{re.escape(alias)}\b")
        near = "[" + ", ".join(f"CASE WHEN contains(lower(t{k}), '{c.lower()}') THEN '{c}' END" for c in entry.context) + "]"
        reason = f"'alias {alias}'" + (
            f" || coalesce(' near ' || nullif(array_to_string(list_filter({near}, lambda x: x IS NOT NULL), ', '), ''), '')" if entry.context else ""
        )
        parts.append(
            f"SELECT job_id, seg_idx, {k} AS step, regexp_extract(t{k}, '{pattern}') AS original, '{entry.canonical}' AS replacement, "
            f"{reason} AS reason, {rnd(f'c{k}', 3)} AS confidence, 'sales' AS profile FROM vocab_steps WHERE t{k + 1} <> t{k}"
        )
    return " UNION ALL ".join(parts)


_LAST = len(list(pr._alias_steps(SALES)))
VIEWS["vocab_steps"] = _vocabulary_sql()
VIEWS["corrections"] = _fix_rows()
VIEWS["vocab_texts"] = f"SELECT job_id, seg_idx, t{_LAST} AS text, t{_LAST} <> t0 AS touched FROM vocab_steps"
VIEWS["new_tokens"] = r"""
    SELECT job_id, seg_idx, n_new, unnest(range(n_new)) AS i, unnest(a) AS text FROM (
      SELECT job_id, seg_idx, a, len(a) AS n_new FROM (
        SELECT job_id, seg_idx, regexp_extract_all(text, '\S+') AS a FROM vocab_texts))"""
VIEWS["realigned"] = """
    SELECT t.job_id, t.seg_idx, t.i, t.text,
           CASE WHEN n_new = n_old THEN o.start_ms ELSE CAST(round_even(s + i * ((e - s) / n_new), 0) AS BIGINT) END AS start_ms,
           CASE WHEN n_new = n_old THEN o.end_ms ELSE CAST(round_even(s + (i + 1) * ((e - s) / n_new), 0) AS BIGINT) END AS end_ms,
           o.confidence, g.speaker_id
    FROM new_tokens t JOIN (
      SELECT job_id, seg_idx, speaker_id, start_ms AS s, end_ms AS e, n_words AS n_old, first_word FROM segments) g USING (job_id, seg_idx)
    JOIN words o ON o.job_id = t.job_id AND o.word_idx = g.first_word + CASE WHEN n_new = n_old THEN i
      ELSE CAST(round_even(i / greatest(n_new - 1, 1) * greatest(n_old - 1, 0), 0) AS BIGINT) END"""


def readable_sql(source: str) -> str:
    return rf"""
    SELECT * EXCLUDE (opens, closes, opening, pt, fixed) REPLACE (
      CASE WHEN opens OR regexp_matches(pt, '[.!?]$')
           THEN regexp_extract(fixed, '^([^\p{{L}}]*)', 1) || upper(regexp_extract(fixed, '^[^\p{{L}}]*(\p{{L}})', 1)) || regexp_extract(fixed, '^[^\p{{L}}]*\p{{L}}(.*)$', 1)
           ELSE fixed END ||
      CASE WHEN closes AND NOT regexp_matches(fixed, '[.!?]$')
             AND lower(regexp_replace(fixed, '[.,;:!?]+$', '')) NOT IN ({sql_list(lx.FILLERS)})
             AND length(regexp_replace(fixed, '[.,;:!?]+$', '')) > 1
           THEN CASE WHEN lower(regexp_replace(opening, '[.,;:!?]+$', '')) IN ({sql_list(lx.ASKING_WORDS)}) THEN '?' ELSE '.' END
           ELSE '' END AS text)
    FROM (
      SELECT *, lag(fixed) OVER w AS pt, coalesce(lag(seg_idx) OVER w <> seg_idx, true) AS opens,
             coalesce(lead(seg_idx) OVER w <> seg_idx, true) AS closes,
             first_value(text) OVER (PARTITION BY job_id, seg_idx ORDER BY word_idx) AS opening
      FROM (SELECT *, regexp_replace(text, '^[iI]([.,;:!?]?)$', 'I\1') AS fixed FROM {source})
      WINDOW w AS (PARTITION BY job_id ORDER BY word_idx))"""


def glued_sql(source: str) -> str:
    return rf"""
    SELECT job_id, seg_idx, min(speaker_id) AS speaker_id,
           trim(regexp_replace(string_agg(text, ' ' ORDER BY word_idx), ' ([.,;:!?])', '\1', 'g')) AS text
    FROM {source} GROUP BY job_id, seg_idx"""


VIEWS["readable"] = readable_sql("words")
VIEWS["chain_words"] = readable_sql("kept_words")
VIEWS["chain_texts"] = glued_sql("chain_words")
VIEWS["near_words"] = """
    SELECT *, array_to_string(list(text) OVER (PARTITION BY job_id ORDER BY word_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), ' ') AS near
    FROM words"""
_RULES = " ".join(
    f"WHEN regexp_matches(text, '{esc(t)}') AND regexp_matches(near, '{esc(s)}') AND text <> '{c}' THEN '{c}'"
    for c, t, s in lx.CONTEXT_RULES
)
VIEWS["context_fixed"] = f"""SELECT * REPLACE (CASE {_RULES} ELSE text END AS text) FROM near_words"""

_ALWAYS = "text"
for _e, _a, _p in pr._alias_steps(SALES):
    _ALWAYS = f"regexp_replace({_ALWAYS}, '{esc(('' if _e.case_sensitive else '(?i)') + rf'\b{re.escape(_a)}\b')}', '{_e.canonical}', 'g')"


# -- the queries -----------------------------------------------------------------------


@query("F1", "SELECT job_id, seg_idx, word_idx, text FROM kept_words")
def words_without_repeats(c: Corpus) -> DataFrame:
    return pr.without_repeats(c.words()).select("job_id", "seg_idx", "word_idx", "text")


@query("F2 F3 F4 F5", "SELECT job_id, seg_idx, text FROM tidy_texts")
def tidied_texts(c: Corpus) -> DataFrame:
    return pr.clean_up(pr.transcripts(c.words(), c.segments()), GENERIC).texts


@query("F6 N1", "SELECT job_id, seg_idx, step, original, replacement, reason, confidence, profile FROM corrections")
def vocabulary_corrections(c: Corpus) -> DataFrame:
    return pr.correct_vocabulary(pr.transcripts(c.words(), c.segments()), SALES).corrections


@query("F6", "SELECT job_id, seg_idx, text FROM vocab_texts WHERE touched")
def vocabulary_texts(c: Corpus) -> DataFrame:
    fixed = pr.apply_vocabulary(c.segments().select("job_id", "seg_idx", "text"), SALES)
    return fixed.filter(F.size("fixes") > 0).select("job_id", "seg_idx", "text")


@query("F7", "SELECT job_id, seg_idx, i, text, start_ms, end_ms, confidence, speaker_id FROM realigned")
def realigned_words(c: Corpus) -> DataFrame:
    fixed = pr.correct_vocabulary(pr.transcripts(c.words(), c.segments()), SALES).words
    first = fixed.groupBy("job_id", "seg_idx").agg(F.min("word_idx").alias("f"))
    return fixed.join(first, ["job_id", "seg_idx"]).select(
        "job_id", "seg_idx", (F.col("word_idx") - F.col("f")).alias("i"), "text", "start_ms", "end_ms", "confidence", "speaker_id"
    )


@query("F8", f"SELECT job_id, seg_idx, {_ALWAYS} AS text FROM segments")
def unconditional_corrections(c: Corpus) -> DataFrame:
    return c.segments().select("job_id", "seg_idx", pr.correct_always(F.col("text"), SALES).alias("text"))


def _fuzzy_sql(tokens: str, aliases: str) -> str:
    """First alias whose common subsequence (one bit per letter of the alias) is long enough, over all pairs of possible lengths."""
    return f"""
    SELECT token, b.replacement AS replacement, b.alias AS alias, b.score AS score FROM (
      SELECT token, min({{'rank': rank, 'replacement': replacement, 'alias': alias, 'score': score}}) AS b FROM (
        SELECT token, rank, replacement, alias, 200 * (n - bit_count(list_reduce(list_prepend((1::BIGINT << n) - 1, list_transform(string_split(low, ''), lambda c:
                 list_sum(list_transform(range(n), lambda i: CASE WHEN substr(alias, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)),
                 lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << n) - 1))))::DOUBLE / (n + length(low)) AS score
        FROM (SELECT DISTINCT text AS token, lower(text) AS low FROM ({tokens}) WHERE length(text) >= 2)
        JOIN (SELECT rank, replacement, lower(alias) AS alias, length(alias)::INT AS n FROM ({aliases}) WHERE length(alias) >= 6)
        ON 200 * least(n, length(low)) >= 88 * (n + length(low)))
      WHERE score >= 88 GROUP BY token)"""


_FUZZY = [(e.canonical, x) for e in SALES.vocabulary if e.fuzzy for x in e.aliases]


@query("F8 N4", _fuzzy_sql("SELECT text FROM words", f"SELECT * FROM (VALUES {', '.join(f'({i}, \'{esc(c)}\', \'{esc(x)}\')' for i, (c, x) in enumerate(_FUZZY))}) v(rank, replacement, alias)"))
def fuzzy_corrections(c: Corpus) -> DataFrame:
    return pr.fuzzy_corrections(c.words(), SALES)


VIEWS["long_words"] = "SELECT DISTINCT lower(text) AS text FROM words WHERE regexp_matches(text, '^[A-Za-z]{2,}$')"
# Words of eleven letters stand for the aliases of a large vocabulary, in alphabetical order.
VIEWS["spellings"] = "SELECT (row_number() OVER (ORDER BY text) - 1)::INTEGER AS rank, upper(text) AS replacement, text AS alias FROM long_words WHERE length(text) = 11"


@query("F8 N4", _fuzzy_sql("SELECT text FROM long_words", "SELECT * FROM spellings"))
def near_spellings(c: Corpus) -> DataFrame:
    """Words of the meetings near one of their words of eleven letters."""
    return near_words(c.long_words(), c.spellings())


# Entries for half of all words and for some pairs of words, in alphabetical order; words of seven letters bring in the alias of the last entry.
VIEWS["large_entries"] = """
    WITH spoken AS (SELECT lower(text) AS a, lower(lead(text) OVER (PARTITION BY job_id, seg_idx ORDER BY word_idx)) AS b FROM words),
    entries AS (
      SELECT DISTINCT a AS alias, CASE WHEN length(a) = 7 THEN a || ' zz' ELSE upper(a) END AS canonical FROM spoken WHERE regexp_matches(a, '^[a-z]{4,}$') AND ascii(a) % 2 = 0
      UNION ALL SELECT DISTINCT a || ' ' || b, b || '-' || a FROM spoken WHERE regexp_matches(a, '^[a-z]{3,}$') AND regexp_matches(b, '^[a-z]{3,}$') AND (length(a) + 3 * length(b)) % 5 = 0
      UNION ALL SELECT 'zz', 'end')
    SELECT (row_number() OVER (ORDER BY alias) - 1)::INTEGER AS step, alias, canonical, CASE WHEN length(alias) % 3 = 0 THEN 0.79::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
           CASE WHEN length(alias) % 3 = 0 THEN ['the', 'und'] ELSE [] END AS context
    FROM entries"""
_WRAP = "regexp_replace({0}, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
_BARE = "translate({0}, chr(1) || chr(2), '')"


@query("F6", f"""
    SELECT job_id, seg_idx, {_BARE.format('s.t')} AS text, s.log AS log FROM (
      SELECT job_id, seg_idx, list_reduce(list_prepend({{'step': -1, 'alias': '', 'p': '', 'w': '', 'confidence': 0.0::DOUBLE, 'context': ['x'], 't': {_WRAP.format('text')}, 'log': ''}}, todo),
        lambda s, e: CASE WHEN (CASE WHEN len(e.context) = 0 THEN e.confidence WHEN len(list_filter(e.context, lambda c: contains(lower({_BARE.format('s.t')}), c))) = 0 THEN e.confidence * 0.4::DOUBLE
                            ELSE least(1.0::DOUBLE, e.confidence + 0.02::DOUBLE * len(list_filter(e.context, lambda c: contains(lower({_BARE.format('s.t')}), c)))) END) >= 0.8
                          AND regexp_replace(s.t, e.p, e.w, 'g') <> s.t
          THEN {{'step': s.step, 'alias': s.alias, 'p': s.p, 'w': s.w, 'confidence': s.confidence, 'context': s.context, 't': regexp_replace(s.t, e.p, e.w, 'g'),
                 'log': s.log || e.step || '|' || {_BARE.format('regexp_extract(s.t, e.p)')} || '|' || {_BARE.format('e.w')} || ';'}} ELSE s END) AS s
      FROM (SELECT g.job_id, g.seg_idx, g.text, list({{'step': step, 'alias': alias, 'p': '(?i)' || {_WRAP.format('alias')}, 'w': {_WRAP.format('canonical')}, 'confidence': confidence, 'context': context, 't': '', 'log': ''}} ORDER BY step) AS todo
            FROM segments g JOIN large_entries e ON alias = 'zz' OR len(list_filter(string_split(alias, ' '), lambda w: NOT contains(lower(g.text), w))) = 0 GROUP BY ALL)) WHERE s.log <> ''""")
def large_vocabulary(c: Corpus) -> DataFrame:
    """Texts corrected by a vocabulary as large as the meetings' own, with the log of steps."""
    fixed = vo.correct_texts(c.segments().select("job_id", "seg_idx", "text"), vo.steps(c.large_vocabulary()))
    line = F.transform("fixes", lambda f: F.concat_ws("|", f["step"].cast("string"), f["original"], f["replacement"]))
    return fixed.filter(F.size("fixes") > 0).select("job_id", "seg_idx", "text", F.concat(F.array_join(line, ";"), F.lit(";")).alias("log"))


@query("C10", "SELECT job_id, word_idx, text, near FROM near_words")
def word_neighbourhoods(c: Corpus) -> DataFrame:
    return pr.neighbourhood(c.words()).select("job_id", "word_idx", "text", "near")


@query("F9", "SELECT job_id, word_idx, text FROM context_fixed")
def context_corrections(c: Corpus) -> DataFrame:
    return pr.context_rules(c.words().select(*pr._W)).select("job_id", "word_idx", "text")


@query("F10 F11 F12 M4", "SELECT job_id, seg_idx, word_idx, text FROM readable")
def readable_words(c: Corpus) -> DataFrame:
    return pr.readable_words(c.words().select(*pr._W)).select("job_id", "seg_idx", "word_idx", "text")


@query("F13", f"SELECT job_id, seg_idx, text FROM ({glued_sql('readable')})")
def readable_texts(c: Corpus) -> DataFrame:
    return pr.make_readable(pr.transcripts(c.words(), c.segments()), GENERIC).texts


@query("F14 D3", "SELECT job_id, seg_idx, text FROM chain_texts")
def processed_texts(c: Corpus) -> DataFrame:
    return pr.run_processors(pr.transcripts(c.words(), c.segments()), GENERIC).texts.select("job_id", "seg_idx", "text")


@query("D3", """
    SELECT job_id, seg_idx AS run_idx, speaker_id, s.start_ms, end_ms, n_words, text FROM segments s""")
def merged_segments(c: Corpus) -> DataFrame:
    # Sentences as segments: merging neighbours of one speaker must give the speaker runs back.
    parts = c.sentences().join(c.segments().select("job_id", "seg_idx"), ["job_id", "seg_idx"]).select(
        "job_id", F.col("sent_no").alias("seg_idx"), "speaker_id", "start_ms", "end_ms", "n_words", "text"
    )
    return at.merge_consecutive(parts)


_USES = " UNION ALL ".join(
    f"SELECT {i} AS entry_idx, '{e.canonical}' AS canonical, count(*) FILTER (regexp_matches(text, "
    f"'{esc(('' if e.case_sensitive else '(?i)') + '|'.join(rf'\b{re.escape(a)}\b' for a in e.aliases))}')) AS n_segments FROM segments"
    for i, e in enumerate(SALES.vocabulary)
)


@query("A3 A4", _USES)
def vocabulary_usage(c: Corpus) -> DataFrame:
    """How many segments each vocabulary entry could touch."""
    def hit(e):
        pattern = ("(?U)" if e.case_sensitive else "(?iU)") + "|".join(rf"\b{re.escape(a)}\b" for a in e.aliases)
        near = reduce(or_, (pr.may_hold(F.col("text"), F.col("low"), a, e.case_sensitive) for a in e.aliases))
        return F.when(near, F.col("text").rlike(pattern))

    hits = [F.count_if(hit(e)).alias(str(i)) for i, e in enumerate(SALES.vocabulary)]
    counts = c.segments().select("text", pr.plain_low(F.col("text")).alias("low")).agg(*hits)
    rows = F.array(*[
        F.struct(F.lit(i).alias("entry_idx"), F.lit(e.canonical).alias("canonical"), F.col(str(i)).alias("n_segments"))
        for i, e in enumerate(SALES.vocabulary)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


_ALL = [load_profile(name) for name in list_profiles()]
_TOUCHES = " UNION ALL ".join(
    f"SELECT '{p.name}' AS profile, {len(p.vocabulary)}::BIGINT AS n_entries, {sum(len(e.aliases) for e in p.vocabulary)}::BIGINT AS n_aliases, count(*) FILTER ("
    + (" OR ".join(f"regexp_matches(text, '{esc(('' if e.case_sensitive else '(?i)') + rf'\b{re.escape(a)}\b')}')" for e in p.vocabulary for a in e.aliases) or "false")
    + ") AS n_segments FROM segments"
    for p in _ALL
)


@query("A3 A4", _TOUCHES)
def profile_listing(c: Corpus) -> DataFrame:
    """Every shipped profile: its entries, its aliases and the segments that any of them matches."""
    listed = c.spark.createDataFrame([(p.name, len(p.vocabulary), sum(len(e.aliases) for e in p.vocabulary)) for p in _ALL], "profile string, n_entries long, n_aliases long")
    table = reduce(DataFrame.unionByName, [vocabulary_table(c.spark, p) for p in _ALL])
    hits = vo.touched(c.segments(), vo.steps(table)).select("profile", "job_id", "seg_idx").distinct().groupBy("profile").agg(F.count("*").alias("n_segments"))
    return listed.join(hits, "profile", "left").fillna(0, ["n_segments"])
