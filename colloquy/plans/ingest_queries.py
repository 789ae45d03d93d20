"""Chunk plans, word ingestion, stitching, reconciliation, audio decisions and voices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.functions.vectors import cosine
from colloquy.operators import audio as au
from colloquy.operators import chunking as ck
from colloquy.operators import identity as idn
from colloquy.operators import introductions as intro
from colloquy.operators import reconcile as rc
from colloquy.plans.registry import query
from colloquy.plans.sql_views import VIEWS, rnd, sql_list
from colloquy.session import shared_folder
from colloquy.sources import transcripts as ts
from colloquy.sources.corpus import Corpus

VIEWS["asr_plan"] = """
    SELECT job_id, i AS chunk_idx, i * 60000 AS nominal_start_ms, least((i + 1) * 60000, d) AS nominal_end_ms,
           CASE WHEN d <= 60000 THEN 0 ELSE greatest(i * 60000 - 500, 0) END AS read_start_ms,
           least(CASE WHEN d <= 60000 THEN d ELSE (i + 1) * 60000 + 500 END, d) AS read_end_ms
    FROM (SELECT job_id, d, unnest(range(n)) AS i FROM (
      SELECT job_id, duration_ms AS d, CASE WHEN duration_ms <= 60000 THEN 1
        ELSE duration_ms // 60000 + CASE WHEN duration_ms % 60000 > 100 THEN 1 ELSE 0 END END AS n FROM jobs))"""
VIEWS["diar_plan"] = """
    SELECT job_id, i AS chunk_idx, CASE WHEN single THEN 0 ELSE i * d // 6 END AS chunk_start_ms,
           CASE WHEN single THEN d ELSE least((i + 1) * d // 6 + 30000, d) END AS chunk_end_ms,
           CASE WHEN i > 0 THEN 30000 ELSE 0 END::BIGINT AS overlap_ms
    FROM (SELECT job_id, duration_ms AS d, duration_ms <= 60000 AS single,
                 unnest(range(CASE WHEN duration_ms <= 60000 THEN 1 ELSE 6 END)) AS i FROM jobs)"""
VIEWS["chunk_turns"] = """
    SELECT job_id, chunk_idx, 'SPEAKER_0' || CASE WHEN chunk_idx = 1 THEN translate(s, '01', '10') WHEN chunk_idx = 2 THEN translate(s, '02', '20') ELSE s END AS speaker_id,
           greatest(start_ms, chunk_start_ms) AS start_ms, least(end_ms, chunk_end_ms) AS end_ms
    FROM (SELECT *, right(speaker_id, 1) AS s FROM turns) JOIN diar_plan USING (job_id)
    WHERE start_ms < chunk_end_ms AND end_ms > chunk_start_ms"""


@query("B1", "SELECT job_id, chunk_idx, nominal_start_ms, nominal_end_ms, read_start_ms, read_end_ms FROM asr_plan")
def asr_chunk_plan(c: Corpus) -> DataFrame:
    return c.asr_plan()


@query("B2", "SELECT job_id, chunk_idx, chunk_start_ms, chunk_end_ms, overlap_ms FROM diar_plan")
def diarization_chunk_plan(c: Corpus) -> DataFrame:
    return c.diar_plan()


@query("B3", """
    SELECT job_id, turn_idx, speaker_id, i AS window_idx, start_ms + 5000 * i AS start_ms,
           CASE WHEN i < n THEN start_ms + 5000 * (i + 1) ELSE end_ms END AS end_ms
    FROM (SELECT *, unnest(range(n + 1)) AS i FROM (
      SELECT *, greatest(0, CAST(ceil((end_ms - start_ms - 10000) / 5000.0) AS BIGINT)) AS n FROM turns WHERE end_ms - start_ms >= 2000))""")
def embedding_windows(c: Corpus) -> DataFrame:
    return idn.embedding_windows(c.turns())


@query("B4", r"""
    SELECT job_id, seg_idx, i AS pos, tok AS text, CAST(round_even(s + i * (d / n), 0) AS BIGINT) AS start_ms,
           CAST(round_even(s + (i + 1) * (d / n), 0) AS BIGINT) AS end_ms, CAST(NULL AS DOUBLE) AS confidence
    FROM (SELECT job_id, seg_idx, start_ms AS s, end_ms - start_ms AS d, len(a) AS n, unnest(range(len(a))) AS i, unnest(a) AS tok
          FROM (SELECT *, regexp_extract_all(text, '\S+') AS a FROM segments))""")
def evenly_timed_words(c: Corpus) -> DataFrame:
    return ck.spread_text(c.segments(), ["job_id", "seg_idx"])


@query("B5", """
    WITH spans AS (SELECT job_id, turn, min(start_ms) AS s, max(end_ms) AS e FROM timed_words GROUP BY ALL),
    read AS (
      SELECT w.job_id, w.turn, w.pos, w.text, CASE WHEN pos % 7 = 3 THEN s ELSE start_ms END AS b,
             CASE WHEN pos % 11 = 5 THEN e ELSE end_ms END AS f,
             CASE WHEN pos % 2 = 0 THEN nullif(confidence, 0) ELSE confidence END AS confidence
      FROM timed_words w JOIN spans USING (job_id, turn) WHERE w.turn % 5 <> 0 AND pos % 13 <> 12)
    SELECT job_id, turn, row_number() OVER (PARTITION BY job_id, turn ORDER BY pos) - 1 AS pos, text, b AS start_ms,
           CASE WHEN f <= b THEN b + 50 ELSE f END AS end_ms, confidence FROM read
    UNION ALL
    SELECT w.job_id, w.turn, pos, text, s + 320 * pos, s + 320 * (pos + 1), NULL FROM timed_words w JOIN spans USING (job_id, turn) WHERE w.turn % 5 = 0""")
def extracted_words(c: Corpus) -> DataFrame:
    return ck.extract_words(c.asr_outputs(), ["job_id", "turn"])


@query("B6", """
    WITH spans AS (SELECT job_id, turn, min(start_ms) AS s FROM timed_words GROUP BY ALL)
    SELECT w.job_id, w.turn, row_number() OVER (PARTITION BY w.job_id, w.turn ORDER BY pos) - 1 AS pos, text,
           CASE w.turn % 3 WHEN 0 THEN start_ms - s WHEN 1 THEN (start_ms - s) // 80 * 80 ELSE pos * 250 END AS start_ms,
           CASE w.turn % 3 WHEN 0 THEN start_ms - s + CASE WHEN pos % 5 = 0 THEN 100 ELSE 350 END
             WHEN 1 THEN ((start_ms - s) // 80 + CASE WHEN pos % 4 = 0 THEN 1 ELSE 4 END) * 80 ELSE (pos + 1) * 250 END AS end_ms
    FROM timed_words w JOIN spans USING (job_id, turn) WHERE w.turn % 3 = 2 OR pos % 13 <> 12""")
def normalised_hypotheses(c: Corpus) -> DataFrame:
    return ck.normalise_hypotheses(c.hypotheses(), ["job_id", "turn"])


@query("B7", "SELECT job_id, start_ms // 60000 AS chunk_idx, text, start_ms, end_ms, confidence FROM timed_words")
def stitched_words(c: Corpus) -> DataFrame:
    return ck.stitch_words(c.chunk_words(), c.asr_plan())


@query("B8", """
    SELECT job_id, chunk_idx, speaker_id, start_ms, end_ms FROM chunk_turns WHERE (job_id + chunk_idx) % 4 <> 0 AND job_id % 10 <> 9
    UNION ALL SELECT job_id, chunk_idx, 'SPEAKER_00', chunk_start_ms, chunk_end_ms FROM diar_plan WHERE (job_id + chunk_idx) % 4 = 0 OR job_id % 10 = 9""")
def filled_chunks(c: Corpus) -> DataFrame:
    failed = c.diar_plan().filter("(job_id + chunk_idx) % 4 = 0 or job_id % 10 = 9").select("job_id", "chunk_idx")
    return ck.fill_failed_chunks(c.chunk_turns(), c.diar_plan(), failed)


@query("B9", f"""
    SELECT job_id, {rnd('n_speech / n', 6)} AS speech_ratio, {rnd('1 - n_speech / n', 6)} AS silence_ratio,
           {rnd("CASE WHEN loud IS NULL OR quiet IS NULL THEN 20.0::DOUBLE WHEN quiet <= 0 THEN 40.0::DOUBLE ELSE 20 * log10(loud / quiet) END", 6)} AS snr_db
    FROM (SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (l_discount > t) AS n_speech,
                 avg(l_discount) FILTER (l_discount > t) AS loud, avg(l_discount) FILTER (NOT l_discount > t) AS quiet
          FROM (SELECT *, 0.15::DOUBLE * avg(l_discount) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) GROUP BY 1)""")
def energy_profile(c: Corpus) -> DataFrame:
    found = au.energy_profile(c.audio_frames(), first_frames=None)
    return found.select("job_id", *[F.round(x, 6).alias(x) for x in ("speech_ratio", "silence_ratio", "snr_db")])


VIEWS["recordings"] = "SELECT o_orderkey AS job_id, o_orderkey * 7919 % 7200 * 1000 + 250 AS duration_ms FROM orders"


@query("B10", """
    SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY offset_ms) - 1)::INTEGER AS window_idx, offset_ms FROM (
      SELECT DISTINCT job_id, CASE WHEN n = 1 THEN 0 ELSE CAST(floor(i * (duration_ms - 60000) / (n - 1)) AS BIGINT) END AS offset_ms
      FROM (SELECT *, unnest(range(n)) AS i FROM (
        SELECT *, CASE WHEN duration_ms <= 60000 THEN 1 ELSE least(4, greatest(2, duration_ms // 60000)) END AS n FROM recordings)))""")
def sample_offsets(c: Corpus) -> DataFrame:
    return au.sample_offsets(c.recordings())


VIEWS["estimates"] = f"""
    SELECT r.job_id, duration_ms, coalesce(speakers, 2) AS speakers, coalesce(spread, 0) AS spread,
           CASE WHEN duration_ms < 120000 OR coalesce(n, 0) < 2 THEN 0.5::DOUBLE
                WHEN least_n = speakers THEN {rnd('least(0.95::DOUBLE, 0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, n * 60 / (duration_ms / 1000.0::DOUBLE)))', 3)}
                ELSE 0.4::DOUBLE END AS trust
    FROM recordings r LEFT JOIN (
      SELECT job_id, max(c) AS speakers, min(c) AS least_n, count(*) AS n, max(std) AS spread FROM (
        SELECT l_orderkey AS job_id, l_tax * 10 AS std, CASE WHEN l_tax * 10 < 0.3 THEN 1 WHEN l_tax * 10 < 0.6 THEN 2 ELSE 3 END AS c FROM lineitem)
      GROUP BY job_id) USING (job_id)"""


@query("B11", "SELECT job_id, duration_ms, speakers, spread, trust FROM estimates")
def speaker_estimates(c: Corpus) -> DataFrame:
    return au.estimate_speakers(c.recordings(), c.sample_windows())


@query("B12", """
    SELECT job_id, NOT one AS use_diarization, NOT long_one AS use_alignment,
           CASE WHEN one THEN 540 ELSE 0 END + CASE WHEN long_one THEN CAST(round_even(duration_ms / 1000.0::DOUBLE * 0.08::DOUBLE, 0) AS BIGINT) ELSE 0 END AS saved_s,
           CASE WHEN one THEN 'one speaker, no diarization' ELSE 'diarization for ' || speakers || ' speakers' END || '; ' ||
           CASE WHEN long_one THEN 'long recording, native word times' ELSE 'short recording, word alignment' END AS reasons
    FROM (SELECT *, speakers = 1 AND trust >= 0.85 AS one, duration_ms >= 600000 AS long_one FROM estimates)""")
def processing_decisions(c: Corpus) -> DataFrame:
    made = au.decide(au.estimate_speakers(c.recordings(), c.sample_windows()))
    return made.withColumn("reasons", F.array_join("reasons", "; "))


# A seam belongs to the chunk behind it; its turns are those of that chunk and of the one before.
_MARKS = """
    SELECT job_id, chunk_idx, t, arg_min(speaker_id, ord) AS speaker_id FROM (
      SELECT s.job_id, s.chunk_idx, s.t, c.speaker_id, c.start_ms * 100000000 + c.end_ms AS ord FROM marks s JOIN chunk_turns c
        ON c.job_id = s.job_id AND c.chunk_idx = s.chunk_idx - {back} AND c.start_ms <= s.t * 1000 + 500 AND c.end_ms >= s.t * 1000 + 500) GROUP BY ALL"""
VIEWS["votes"] = f"""
    WITH seams AS (SELECT b.job_id, b.chunk_idx, b.chunk_start_ms AS x, a.chunk_end_ms AS y FROM diar_plan a JOIN diar_plan b
                   ON a.job_id = b.job_id AND b.chunk_idx = a.chunk_idx + 1 WHERE a.chunk_end_ms > b.chunk_start_ms + 500),
    marks AS (SELECT job_id, chunk_idx, unnest(range(x // 1000, y // 1000)) AS t FROM seams),
    k AS ({_MARKS.format(back=1)}), l AS ({_MARKS.format(back=0)})
    SELECT job_id, chunk_idx, l.speaker_id AS local, k.speaker_id AS known, count(*) AS votes, min(t) AS first_t
    FROM l JOIN k USING (job_id, chunk_idx, t) GROUP BY ALL"""
_SEAM = ("job_id", "chunk_idx")


def _seams(c: Corpus):
    """Turns before and behind every seam, and the seams."""
    turns = c.chunk_turns().withColumn("turn_no", F.col("start_ms") * 100_000_000 + F.col("end_ms"))
    ends = c.diar_plan().select("job_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.col("chunk_end_ms").alias("seam_end"))
    seams = c.diar_plan().select("job_id", "chunk_idx", F.col("chunk_start_ms").alias("seam_start")).join(ends, list(_SEAM))
    return turns.withColumn("chunk_idx", F.col("chunk_idx") + 1), turns, seams


@query("C3", "SELECT job_id, chunk_idx, local, known, votes, first_t FROM votes")
def seam_votes(c: Corpus) -> DataFrame:
    """Votes on every seam, by the labels of the chunks on both sides."""
    return rc.seam_votes(*_seams(c), _SEAM)


@query("C4", """
    WITH RECURSIVE ordered AS (
      SELECT *, row_number() OVER (PARTITION BY job_id, chunk_idx ORDER BY total DESC, seen, local, votes DESC, first_t, known) AS p FROM (
        SELECT *, sum(votes) OVER w AS total, min(first_t) OVER w AS seen FROM votes WINDOW w AS (PARTITION BY job_id, chunk_idx, local))),
    walk AS (
      SELECT job_id, chunk_idx, 1::BIGINT AS p, [local] AS locals, [known] AS knowns FROM ordered WHERE p = 1
      UNION ALL
      SELECT o.job_id, o.chunk_idx, o.p,
             CASE WHEN list_contains(locals, local) OR list_contains(knowns, known) THEN locals ELSE list_append(locals, local) END,
             CASE WHEN list_contains(locals, local) OR list_contains(knowns, known) THEN knowns ELSE list_append(knowns, known) END
      FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.chunk_idx = w.chunk_idx AND o.p = w.p + 1)
    SELECT job_id, chunk_idx, unnest(locals) AS local, unnest(knowns) AS known FROM (
      SELECT job_id, chunk_idx, arg_max(locals, p) AS locals, arg_max(knowns, p) AS knowns FROM walk GROUP BY ALL)""")
def seam_mapping(c: Corpus) -> DataFrame:
    return rc.greedy_map(rc.seam_votes(*_seams(c), _SEAM), _SEAM)


VIEWS["own_parts"] = """
    SELECT c.*, p.chunk_start_ms, p.own_from FROM chunk_turns c JOIN (
      SELECT *, lag(chunk_end_ms) OVER (PARTITION BY job_id ORDER BY chunk_idx) AS own_from FROM diar_plan) p USING (job_id, chunk_idx)"""
VIEWS["deep_votes"] = """
    WITH seams AS (SELECT job_id, chunk_idx, unnest(range(chunk_start_ms // 1000, own_from // 1000)) AS t FROM (
      SELECT *, lag(chunk_end_ms) OVER (PARTITION BY job_id ORDER BY chunk_idx) AS own_from FROM diar_plan) WHERE own_from > chunk_start_ms + 500),
    l AS (SELECT s.job_id, s.chunk_idx, s.t, arg_min(c.speaker_id, {'s': c.start_ms, 'e': c.end_ms, 'p': c.speaker_id}) AS local FROM seams s JOIN chunk_turns c
      ON c.job_id = s.job_id AND c.chunk_idx = s.chunk_idx AND c.start_ms <= s.t * 1000 + 500 AND c.end_ms >= s.t * 1000 + 500 GROUP BY ALL),
    k AS (SELECT s.job_id, s.chunk_idx, s.t, arg_min({'c': c.chunk_idx, 'p': c.speaker_id}, {'c': c.chunk_idx, 's': c.start_ms, 'e': c.end_ms, 'p': c.speaker_id}) AS k FROM seams s JOIN own_parts c
      ON c.job_id = s.job_id AND c.chunk_idx < s.chunk_idx AND greatest(c.start_ms, coalesce(c.own_from, 0)) <= s.t * 1000 + 500 AND c.end_ms >= s.t * 1000 + 500 AND c.end_ms > coalesce(c.own_from, 0) GROUP BY ALL)
    SELECT job_id, chunk_idx, local, k.c AS known_chunk, k.p AS known, count(*) AS votes, min(t) AS first_t FROM l JOIN k USING (job_id, chunk_idx, t) GROUP BY ALL"""
#: Labels of all chunks, one chunk of all meetings after the other: m has (chunk, local, label) so far.
_LABELS = """
    WITH RECURSIVE speakers AS (
      SELECT job_id, chunk_idx, list(speaker_id ORDER BY seen, speaker_id) AS locals FROM (
        SELECT job_id, chunk_idx, speaker_id, min({'s': start_ms, 'e': end_ms, 'p': speaker_id}) AS seen FROM chunk_turns GROUP BY ALL) GROUP BY ALL),
    seam AS (SELECT job_id, chunk_idx, locals, coalesce(votes, []) AS votes FROM speakers LEFT JOIN (
        SELECT job_id, chunk_idx, list({'l': local, 'c': known_chunk, 'k': known, 'n': votes, 't': first_t}) AS votes FROM deep_votes GROUP BY ALL) USING (job_id, chunk_idx)),
    walk AS (
      SELECT job_id, chunk_idx, list_transform(locals, lambda x: {'c': chunk_idx, 'l': x, 'g': x}) AS m,
             1 + coalesce(list_max(list_transform(locals, lambda x: TRY_CAST(regexp_extract(x, '^SPEAKER_([0-9]+)$', 1) AS BIGINT))), -1) AS number
      FROM seam WHERE chunk_idx = 0
      UNION ALL
      SELECT job_id, chunk_idx, list_concat(m, list_transform(locals, lambda x: {'c': chunk_idx, 'l': x, 'g': CASE WHEN list_contains(taken, x)
               THEN labels[list_position(taken, x)] ELSE printf('SPEAKER_%02d', number + list_position(fresh, x) - 1) END})), number + len(fresh)
      FROM (
        SELECT *, list_filter(locals, lambda x: NOT list_contains(taken, x)) AS fresh FROM (
          SELECT *, list_transform(picked, lambda x: x.l) AS taken, list_transform(picked, lambda x: x.g) AS labels FROM (
            SELECT *, list_reduce(list_prepend([{'l': '', 'g': ''}], list_transform(ranked, lambda x: [{'l': x.l, 'g': x.g}])),
                     lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.l), x[1].l) OR list_contains(list_transform(a, lambda y: y.g), x[1].g) THEN a ELSE list_concat(a, x) END) AS picked FROM (
              SELECT *, list_sort(list_transform(pairs, lambda p: {
                       'a': -list_sum(list_transform(list_filter(named, lambda v: v.l = p.l), lambda v: v.n)), 'b': list_min(list_transform(list_filter(named, lambda v: v.l = p.l), lambda v: v.t)), 'l': p.l,
                       'd': -list_sum(list_transform(list_filter(named, lambda v: v.l = p.l AND v.g = p.g), lambda v: v.n)),
                       'e': list_min(list_transform(list_filter(named, lambda v: v.l = p.l AND v.g = p.g), lambda v: v.t)), 'g': p.g})) AS ranked FROM (
                SELECT *, list_distinct(list_transform(named, lambda v: {'l': v.l, 'g': v.g})) AS pairs FROM (
                  SELECT s.job_id, s.chunk_idx, s.locals, w.m, w.number,
                         list_transform(s.votes, lambda v: {'l': v.l, 'n': v.n, 't': v.t, 'g': list_filter(w.m, lambda x: x.c = v.c AND x.l = v.k)[1].g}) AS named
                  FROM walk w JOIN seam s ON s.job_id = w.job_id AND s.chunk_idx = w.chunk_idx + 1)))))))
    SELECT job_id, u.c AS chunk_idx, u.l AS speaker_id, u.g AS label FROM (SELECT job_id, unnest(arg_max(m, chunk_idx)) AS u FROM walk GROUP BY job_id)"""


@query("C5 N4", f"""
    SELECT job_id, label AS speaker_id, greatest(start_ms, coalesce(own_from, start_ms)) AS start_ms, end_ms
    FROM own_parts JOIN ({_LABELS}) USING (job_id, chunk_idx, speaker_id) JOIN (SELECT job_id, count(*) AS n FROM diar_plan GROUP BY job_id) USING (job_id)
    WHERE (own_from IS NULL OR end_ms > own_from) AND (n = 1 OR end_ms - greatest(start_ms, coalesce(own_from, start_ms)) > 100)""")
def reconciled_turns(c: Corpus) -> DataFrame:
    return rc.reconcile(c.chunk_turns(), c.diar_plan())


@query("C6", """
    SELECT job_id, chunk_idx, speaker_id, greatest(start_ms, coalesce(y, start_ms)) AS start_ms, end_ms
    FROM chunk_turns JOIN (SELECT job_id, chunk_idx, lag(chunk_end_ms) OVER (PARTITION BY job_id ORDER BY chunk_idx) AS y FROM diar_plan)
    USING (job_id, chunk_idx) WHERE (y IS NULL OR end_ms > y) AND end_ms - greatest(start_ms, coalesce(y, start_ms)) > 100""")
def clipped_seams(c: Corpus) -> DataFrame:
    return rc.clip_seams(c.chunk_turns(), c.diar_plan()).select("job_id", "chunk_idx", "speaker_id", "start_ms", "end_ms")


# -- voices ----------------------------------------------------------------------------

VIEWS["voice_windows"] = """
    SELECT vec_id // 10 // 3 AS job_id, 'SPEAKER_0' || (vec_id // 10 % 3) AS speaker_id, CAST(embedding AS DOUBLE[]) AS embedding, vec_id FROM embeddings"""
VIEWS["stored_vectors"] = """
    SELECT 'P' || lpad((vec_id // 10)::VARCHAR, 9, '0') AS profile_id, vec_id % 7 AS job_id, CAST(embedding AS DOUBLE[]) AS embedding
    FROM embeddings WHERE vec_id % 10 < 3 + vec_id // 10 % 6 AND vec_id // 10 % 11 <> 5"""
VIEWS["profile_names"] = """
    SELECT DISTINCT 'P' || lpad((vec_id // 10)::VARCHAR, 9, '0') AS profile_id,
           CASE WHEN vec_id // 10 % 5 = 2 THEN 'Alice' ELSE 'Voice ' || (vec_id // 10) END AS display_name,
           CASE WHEN vec_id // 10 % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS status FROM embeddings"""


def _centroid_sql(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, max(n) AS n_vectors, list(x ORDER BY dim) AS mean FROM (
      SELECT {keys}, dim, avg(x) AS x, count(*) AS n FROM (
        SELECT {keys}, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM {source}) GROUP BY ALL) GROUP BY {keys}"""


VIEWS["voice_means"] = _centroid_sql("voice_windows", "job_id, speaker_id")
VIEWS["profile_means"] = _centroid_sql("stored_vectors", "profile_id")
VIEWS["voice_matches"] = """
    SELECT job_id, speaker_id, sim AS similarity, CASE WHEN sim >= 0.8 THEN 'high' WHEN sim >= 0.65 THEN 'medium' ELSE 'unknown' END AS confidence,
           CASE WHEN sim >= 0.65 THEN profile_id END AS profile_id, CASE WHEN sim >= 0.65 THEN display_name END AS display_name
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id, speaker_id ORDER BY sim DESC, profile_id) AS nth FROM (
      SELECT v.job_id, v.speaker_id, p.profile_id, list_cosine_similarity(v.mean, p.mean) AS sim FROM voice_means v CROSS JOIN profile_means p))
    JOIN profile_names USING (profile_id) WHERE nth = 1"""
VIEWS["sure_intros"] = f"""
    SELECT job_id, speaker_id, name FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, speaker_id ORDER BY sure DESC, seg_idx, at_char, name) AS nth FROM introduced
      WHERE sure OR name NOT IN ({sql_list(lx.NOT_NAMES)})) WHERE nth = 1 AND sure"""
VIEWS["identified"] = """
    SELECT job_id, speaker_id,
           CASE WHEN confidence = 'high' THEN m.display_name WHEN i.name IS NOT NULL THEN i.name WHEN confidence = 'medium' THEN m.display_name END AS display_name,
           CASE WHEN m.confidence = 'high' OR i.name IS NOT NULL THEN 'high' WHEN m.confidence = 'medium' THEN 'medium' ELSE 'unknown' END AS confidence,
           CASE WHEN m.confidence = 'high' OR (i.name IS NULL AND m.confidence = 'medium') THEN 'voice_match:' || m.confidence || ':' || printf('%.3f', similarity)
                WHEN i.name IS NOT NULL THEN 'self_identification:high' END AS evidence,
           CASE WHEN m.confidence = 'high' THEN m.profile_id WHEN i.name IS NOT NULL THEN coalesce(p.profile_id, 'inferred:' || i.name) END AS enrol_into
    FROM names n LEFT JOIN voice_matches m USING (job_id, speaker_id) LEFT JOIN sure_intros i USING (job_id, speaker_id)
    LEFT JOIN (SELECT display_name, min(profile_id) AS profile_id FROM profile_names GROUP BY 1) p ON p.display_name = i.name"""
VIEWS["added_vectors"] = """
    SELECT enrol_into AS profile_id, v.job_id, evidence, vec_id FROM voice_windows v JOIN identified USING (job_id, speaker_id) WHERE enrol_into IS NOT NULL"""


@query("E14 M6", f"""
    SELECT job_id, speaker_id, n_vectors, dim, {rnd('x / len', 6)} AS x FROM (
      SELECT job_id, speaker_id, n_vectors, sqrt(list_dot_product(mean, mean)) AS len, unnest(range(len(mean))) AS dim, unnest(mean) AS x FROM voice_means)""")
def voice_centroids(c: Corpus) -> DataFrame:
    found = idn.centroids(c.voice_windows(), ["job_id", "speaker_id"])
    return found.select("job_id", "speaker_id", "n_vectors", F.posexplode("centroid").alias("dim", "x")).select(
        "job_id", "speaker_id", "n_vectors", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")
    )


@query("M6", f"""
    SELECT profile_id, {rnd('list_cosine_similarity(p.mean, s.embedding)', 6)} AS similarity, job_id FROM profile_means p JOIN stored_vectors s USING (profile_id)""")
def vector_similarities(c: Corpus) -> DataFrame:
    """Each stored vector against the centroid of its own profile."""
    own = c.profiles().select("profile_id", "centroid").join(c.stored_vectors(), "profile_id")
    return own.select("profile_id", F.round(cosine(F.col("centroid"), F.col("embedding")), 6).alias("similarity"), "job_id")


def _matches(c: Corpus) -> DataFrame:
    return c.keep("voice_matches", lambda: idn.match_voices(
        c.keep("voice_centroids", lambda: idn.centroids(c.voice_windows(), ["job_id", "speaker_id"])),
        c.keep("profiles", c.profiles),
    ))


def _identified(c: Corpus) -> DataFrame:
    sure = intro.best_introductions(intro.introductions(c.segments()))
    return c.keep("identified", lambda: idn.identify(
        c.names().select("job_id", "speaker_id"), _matches(c), sure, c.keep("profiles", c.profiles)
    ))


@query("C9", f"SELECT job_id, speaker_id, profile_id, display_name, {rnd('similarity', 6)} AS similarity, confidence FROM voice_matches")
def matched_voices(c: Corpus) -> DataFrame:
    return _matches(c).withColumn("similarity", F.round("similarity", 6))


@query("I1", "SELECT job_id, seg_idx, speaker_id FROM segments WHERE end_ms - start_ms >= 2000 AND n_words >= 3")
def enrollable_segments(c: Corpus) -> DataFrame:
    return idn.enrollable(c.segments()).select("job_id", "seg_idx", "speaker_id")


@query("I2", "SELECT job_id, speaker_id, display_name, confidence, evidence, enrol_into FROM identified")
def identified_speakers(c: Corpus) -> DataFrame:
    return _identified(c)


@query("I3 A5", """
    SELECT profile_id, coalesce(p.display_name, new_name) AS display_name, coalesce(status, 'inferred') AS status,
           coalesce(n, 0) AS n_vectors, coalesce(n_new, 0) AS n_new, coalesce(jobs, 0) AS n_source_jobs
    FROM profile_names p FULL JOIN (SELECT enrol_into AS profile_id, min(display_name) AS new_name FROM identified
                                    WHERE starts_with(enrol_into, 'inferred:') GROUP BY 1) USING (profile_id)
    LEFT JOIN (SELECT profile_id, count(*) AS n, CAST(sum(new) AS BIGINT) AS n_new, count(DISTINCT job_id) AS jobs FROM (
      SELECT profile_id, job_id, 0 AS new FROM stored_vectors UNION ALL SELECT profile_id, job_id, 1 FROM added_vectors) GROUP BY 1) USING (profile_id)""")
def enrolled_profiles(c: Corpus) -> DataFrame:
    identified = _identified(c)
    added = idn.enrolled_vectors(identified, c.voice_windows())
    found = idn.enrolled_profiles(c.keep("profiles", c.profiles), c.stored_vectors(), identified, added)
    # Into a new version of the store, and back from there.
    folder, vector = f"{shared_folder(c.spark)}/profile-store-{uuid.uuid4().hex}", ("profile_id", "job_id", "embedding")
    ts.write_profiles(found, c.stored_vectors().select(*vector).union(added.select(*vector)), folder, 1)
    return ts.read_profiles(c.spark, folder, 1)[0]


@query("I3", "SELECT profile_id, job_id, evidence, count(*) AS n FROM added_vectors GROUP BY ALL")
def enrolled_vectors(c: Corpus) -> DataFrame:
    added = idn.enrolled_vectors(_identified(c), c.voice_windows())
    return added.groupBy("profile_id", "job_id", "evidence").agg(F.count("*").alias("n"))
