"""Job tables, stages, resources, artifacts and progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions import timefmt as tf
from colloquy.operators import ops
from colloquy.plans.registry import query
from colloquy.plans.sql_views import VIEWS, mean, rnd, sql_list
from colloquy.sources.corpus import MESSAGES, RUN_STAGES, STAGES, UPLOAD_ENDS, Corpus
from colloquy.streaming import job_state as js
from colloquy.streaming import progress as pg


def _pick(values, index: str) -> str:
    return f"([{sql_list(values)}])[CAST({index} % {len(values)} AS INT) + 1]"


VIEWS["job_table"] = """
    SELECT o_orderkey AS job_id, o_custkey AS owner_id, (epoch_us(o_orderdate) // 1000) AS created_ms,
           CASE WHEN o_orderkey % 7 = 0 THEN (epoch_us(o_orderdate) // 1000) + 86400000 END AS deleted_ms, 'uploads/' || o_orderkey AS audio_key FROM orders"""
VIEWS["job_events"] = "SELECT event_id, user_id AS job_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS kind, value FROM events"
VIEWS["uploads"] = f"""
    SELECT doc_id AS upload_id, source || '/call#' || doc_id || ' v1' || {_pick(UPLOAD_ENDS, 'doc_id')} AS file_name, n_chars AS size_mb FROM documents"""
VIEWS["artifact_listing"] = f"""
    SELECT l_orderkey AS job_id, {_pick(ops.ARTIFACTS, 'l_partkey')} AS artifact, CAST(l_quantity AS BIGINT) AS size_bytes FROM lineitem"""
VIEWS["stage_runs"] = f"""
    SELECT l_orderkey AS job_id, {_pick(RUN_STAGES, 'l_partkey')} AS stage, l_quantity AS duration_s,
           CASE WHEN l_returnflag = 'R' THEN 'beside' ELSE 'alone' END AS variant FROM lineitem"""
VIEWS["stage_sums"] = "SELECT job_id, stage, sum(duration_s) AS s FROM stage_runs GROUP BY ALL"
VIEWS["progress_events"] = f"""
    SELECT event_id, user_id AS job_id, (epoch_us(ts) // 1000) AS ts_ms, ts,
           CASE WHEN event_id % 8 IN (0, 5) THEN 'stage' WHEN event_id % 8 = 1 THEN 'resource' WHEN event_id % 8 = 2 THEN 'chunk_progress'
                WHEN event_id % 8 = 3 THEN 'partial_transcript' WHEN event_id % 8 = 4 THEN 'audio_info'
                WHEN event_id % 256 = 7 THEN 'completed' ELSE 'error' END AS type,
           CASE WHEN event_id % 8 IN (0, 5) THEN {_pick(STAGES, 'event_id')} END AS stage,
           CASE WHEN event_id % 8 IN (0, 5) THEN (event_id % 100) / 100.0::DOUBLE END AS fraction,
           CASE WHEN event_id % 8 IN (0, 5) THEN {_pick(MESSAGES, 'event_id')} WHEN event_id % 8 = 3 THEN 'words'
                WHEN event_id % 256 = 15 THEN 'CUDA device lost' END AS message,
           CASE WHEN event_id % 8 = 1 THEN (event_id % 97)::DOUBLE END AS cpu_pct, CASE WHEN event_id % 8 = 1 THEN event_id % 9 + 0.5::DOUBLE END AS ram_gb
    FROM events WHERE event_id % 8 < 6 OR event_id % 256 IN (7, 15)"""


@query("A8", """
    SELECT j.job_id, owner_id, created_ms, deleted_ms, coalesce(n, 0) AS n_events, last_ms FROM job_table j
    LEFT JOIN (SELECT job_id, count(*) AS n, max(ts_ms) AS last_ms FROM job_events GROUP BY job_id) USING (job_id)""")
def jobs_overview(c: Corpus) -> DataFrame:
    per_job = c.job_events().groupBy("job_id").agg(F.count("*").alias("n_events"), F.max("ts_ms").alias("last_ms"))
    return c.job_table().join(per_job, "job_id", "left").fillna(0, ["n_events"]).select(
        "job_id", "owner_id", "created_ms", "deleted_ms", "n_events", "last_ms"
    )


@query("A9 M10", rf"""
    SELECT upload_id, reason IS NULL AS accepted, reason, CASE WHEN clean = '' THEN 'recording' ELSE clean END AS safe_name, suffix FROM (
      SELECT *, CASE WHEN suffix NOT IN ({sql_list(ops.SUFFIXES)}) THEN 'type' WHEN size_mb > 2000 THEN 'size' END AS reason,
             regexp_replace(regexp_replace(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^\p{{L}}\p{{N}} _-]', '_', 'g'), '^_+|_+$', '', 'g') AS clean
      FROM (SELECT *, lower(regexp_extract(file_name, '(\.[^./]+)$', 1)) AS suffix FROM uploads))""")
def checked_uploads(c: Corpus) -> DataFrame:
    return ops.validate_uploads(c.uploads())


@query("M10 M5", r"""
    SELECT upload_id, regexp_replace(file_name, '[^\p{L}\p{N}_.-]', '_', 'g') AS object_name,
           translate(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '_-', '  ') AS title FROM uploads""")
def upload_names(c: Corpus) -> DataFrame:
    return c.uploads().select("upload_id", tx.safe_file_name(F.col("file_name")).alias("object_name"), F.lower(tx.title_of_path(F.col("file_name"))).alias("title"))


@query("M11", f"""
    SELECT upload_id, mode IN ({sql_list(ops.MODES)}) AND regexp_full_match(profile, '[a-zA-Z0-9_-]{{1,100}}') AND fmt IN ({sql_list(ops.FORMATS)}) AS valid
    FROM (SELECT doc_id AS upload_id, {_pick(('fast', 'balanced', 'slow'), 'doc_id')} AS mode, source AS profile, {_pick(('txt', 'srt', 'pdf', 'md', 'vtt'), 'doc_id')} AS fmt FROM documents)""")
def valid_requests(c: Corpus) -> DataFrame:
    def pick(values):
        return F.array(*[F.lit(v) for v in values])[(F.col("doc_id") % len(values)).cast("int")]

    ok = ops.valid_request(pick(("fast", "balanced", "slow")), F.col("source"), pick(("txt", "srt", "pdf", "md", "vtt")))
    return c.table("documents").select(F.col("doc_id").alias("upload_id"), ok.alias("valid"))


@query("L1", """
    SELECT event_id AS request_id, r.job_id, CASE WHEN owner_id IS NULL THEN 'not_found' WHEN owner_id <> user_id THEN 'forbidden' ELSE 'ok' END AS verdict
    FROM (SELECT event_id, event_id * 3 % 40000 AS job_id, user_id FROM events) r
    LEFT JOIN (SELECT job_id, owner_id FROM job_table WHERE deleted_ms IS NULL) USING (job_id)""")
def job_access(c: Corpus) -> DataFrame:
    requests = c.table("events").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 3 % 40000).alias("job_id"), "user_id")
    return ops.access(requests, c.job_table())


@query("L2", """
    SELECT j.job_id, owner_id, coalesce(deleted_ms, at_ms) AS deleted_ms, CASE WHEN coalesce(deleted_ms, at_ms) IS NULL THEN audio_key END AS audio_key
    FROM job_table j LEFT JOIN (SELECT event_id AS job_id, min(ts_ms) AS at_ms FROM job_events WHERE kind = 'error' GROUP BY 1) USING (job_id)""")
def tombstones(c: Corpus) -> DataFrame:
    asked = c.job_events().filter("kind = 'error'").select(F.col("event_id").alias("job_id"), F.col("ts_ms").alias("at_ms"))
    return ops.tombstone(c.job_table(), asked)


@query("L3", """
    SELECT job_id, arg_max(kind, row(ts_ms, event_id)) AS status, max(ts_ms) AS last_ms, min(ts_ms) AS first_ms, count(*) AS n_events,
           count(*) FILTER (kind = 'error') AS n_errors FROM job_events GROUP BY job_id""")
def job_rollup(c: Corpus) -> DataFrame:
    return ops.job_rollup(c.job_events())


_CLASSES = " ".join(
    "WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(m), '{w}')" for w in ws) + ")" for ws in alternatives) + f" THEN '{name}'"
    for name, alternatives in ops.FAILURES
)


@query("L4", f"""
    SELECT source, failure, count(*) AS n FROM (
      SELECT source, CASE {_CLASSES} ELSE 'other' END AS failure FROM (SELECT source, unnest(string_split(text, chr(10))) AS m FROM documents)) GROUP BY ALL""")
def failure_classes(c: Corpus) -> DataFrame:
    """Classes of all lines of the given texts, as of messages of jobs, by source."""
    lines = c.table("documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source", ops.failure_class(F.col("line")).alias("failure")).agg(F.count("*").alias("n"))


@query("C14", f"""
    SELECT job_id, count(*) AS n_expected, count(size_bytes) AS n_present, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
           coalesce(string_agg(artifact, ',' ORDER BY artifact) FILTER (size_bytes IS NULL), '') AS missing
    FROM (SELECT job_id, unnest([{sql_list(ops.ARTIFACTS)}]) AS artifact FROM job_table)
    LEFT JOIN (SELECT job_id, artifact, max(size_bytes) AS size_bytes FROM artifact_listing GROUP BY ALL) USING (job_id, artifact) GROUP BY job_id""")
def artifact_completeness(c: Corpus) -> DataFrame:
    return ops.artifact_totals(c.job_table(), c.artifact_listing())


@query("C14", f"""
    SELECT job_id, artifact, size_bytes, CASE WHEN size_bytes IS NULL THEN 'missing' ELSE 'ok' END AS status
    FROM (SELECT job_id, unnest([{sql_list(ops.ARTIFACTS)}]) AS artifact FROM job_table)
    LEFT JOIN (SELECT job_id, artifact, max(size_bytes) AS size_bytes FROM artifact_listing GROUP BY ALL) USING (job_id, artifact)""")
def artifact_status(c: Corpus) -> DataFrame:
    return ops.artifact_report(c.job_table(), c.artifact_listing())


@query("D10", f"""
    SELECT job_id, stage, min(ts_ms) - min(t0) AS start_ms, CAST(sum(until - ts_ms) AS BIGINT) AS duration_ms,
           {rnd('100 * sum(until - ts_ms) / (min(t1) - min(t0))', 1)} AS pct
    FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS until, min(ts_ms) OVER (PARTITION BY job_id) AS t0,
                 max(ts_ms) OVER (PARTITION BY job_id) AS t1, kind AS stage FROM job_events) WHERE until IS NOT NULL GROUP BY job_id, stage""")
def stage_durations(c: Corpus) -> DataFrame:
    return ops.stage_report(c.job_events().withColumnRenamed("kind", "stage"))


_LOADS = ", ".join(f"max({e}) AS peak_{m}, {rnd(mean(e), 3)} AS mean_{m}" for m, e in (("cpu_pct", "cpu"), ("ram_gb", "ram"), ("swap_gb", "swap")))


@query("E15", f"""
    SELECT job_id, {_LOADS} FROM (SELECT job_id, fmod(value, 100) AS cpu, value / 100 AS ram, value / 1000 AS swap FROM job_events) GROUP BY job_id""")
def resource_summary(c: Corpus) -> DataFrame:
    samples = c.job_events().select(
        "job_id", (F.col("value") % 100).alias("cpu_pct"), (F.col("value") / 100).alias("ram_gb"), (F.col("value") / 1000).alias("swap_gb")
    )
    return ops.resource_summary(samples)


VIEWS["stage_words"] = """
    SELECT job_id, 0 AS stage_no, 'recognition' AS stage, count(*) AS n_words FROM timed_words w JOIN asr_plan p USING (job_id)
    WHERE start_ms >= read_start_ms AND start_ms < read_end_ms GROUP BY job_id
    UNION ALL SELECT job_id, 1, 'stitching', count(*) FROM timed_words GROUP BY job_id
    UNION ALL SELECT job_id, 2, 'attribution', count(*) FROM words GROUP BY job_id
    UNION ALL SELECT job_id, 3, 'cleanup', count(*) FROM kept_words GROUP BY job_id
    UNION ALL SELECT job_id, 4, 'vocabulary', count(*) FROM realigned GROUP BY job_id"""


@query("E22", "SELECT job_id, stage, n_words FROM stage_words")
def stage_word_counts(c: Corpus) -> DataFrame:
    return c.stage_word_counts().select("job_id", "stage", "n_words")


@query("E16", """
    SELECT job_id, stage_no, stage, n_words, n_before, coalesce(n_words < n_before * 0.95::DOUBLE, false) AS lost
    FROM (SELECT *, lag(n_words) OVER (PARTITION BY job_id ORDER BY stage_no) AS n_before FROM stage_words)""")
def word_loss(c: Corpus) -> DataFrame:
    return ops.word_loss(c.stage_word_counts())


@query("E23", f"""
    SELECT job_id, stage, n_words, {rnd('r', 2)} AS words_per_minute, CASE WHEN r < 100 THEN 'low' WHEN r > 200 THEN 'high' ELSE 'normal' END AS verdict
    FROM (SELECT *, n_words * 60000 / duration_ms AS r FROM stage_words JOIN jobs USING (job_id))""")
def word_rates(c: Corpus) -> DataFrame:
    return ops.word_rate(c.stage_word_counts(), c.jobs())


@query("E17", """
    SELECT job_id, coalesce(n, 0) AS n_words, CASE WHEN n IS NULL AND duration_ms > 30000 THEN 'failed' ELSE 'completed' END AS status
    FROM recordings LEFT JOIN (SELECT job_id, count(*) AS n FROM words GROUP BY job_id) USING (job_id)""")
def empty_outputs(c: Corpus) -> DataFrame:
    return ops.empty_output(c.recordings(), c.words())


@query("E18", f"""
    SELECT job_id, {rnd('CASE WHEN coalesce(e, 0) > 0 THEN duration_ms / 1000.0::DOUBLE / e ELSE 0 END', 6)} AS rtf
    FROM recordings LEFT JOIN (SELECT job_id, sum(duration_s) AS e FROM stage_runs GROUP BY job_id) USING (job_id)""")
def real_time_factors(c: Corpus) -> DataFrame:
    return ops.real_time_factor(c.recordings(), c.stage_runs())


_GROUP = "CASE WHEN starts_with(stage, 'proc_') THEN 'processors' WHEN starts_with(stage, 'intel_') THEN 'intelligence' ELSE stage END"


@query("E19", f"""
    SELECT job_id, level, name, s, total_s, {rnd('100 * s / total_s', 1)} AS pct FROM (
      SELECT job_id, 'group' AS level, {_GROUP} AS name, sum(s) AS s FROM stage_sums GROUP BY ALL
      UNION ALL SELECT job_id, 'detail', stage, s FROM stage_sums WHERE {_GROUP} <> stage)
    JOIN (SELECT job_id, coalesce(sum(s) FILTER (stage NOT IN ('transcribe', 'diarize')), 0) + coalesce(max(s) FILTER (stage IN ('transcribe', 'diarize')), 0) AS total_s
          FROM stage_sums GROUP BY job_id) USING (job_id)""")
def profile_report(c: Corpus) -> DataFrame:
    return ops.profile_report(c.stage_runs())


@query("E20", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC, stage) AS place FROM stage_sums) WHERE place <= 5""")
def bottlenecks(c: Corpus) -> DataFrame:
    return ops.bottlenecks(c.stage_runs())


@query("E24", f"""
    SELECT job_id, stage, {rnd('a * 1000 / duration_ms', 4)} AS share, coalesce(a * 1000 / duration_ms > 0.1::DOUBLE, false) AS slow,
           {rnd('b / a', 4)} AS ratio, coalesce(b / a > 1.5::DOUBLE, false) AS contended
    FROM (SELECT job_id, stage, sum(duration_s) FILTER (variant = 'alone') AS a, sum(duration_s) FILTER (variant = 'beside') AS b FROM stage_runs GROUP BY ALL)
    JOIN recordings USING (job_id)""")
def stage_slowdowns(c: Corpus) -> DataFrame:
    return ops.slowdowns(c.stage_runs(), c.recordings())


# -- progress events -------------------------------------------------------------------


@query("K1", "SELECT job_id, event_id, ts_ms, type, stage, fraction, message, cpu_pct, ram_gb FROM progress_events")
def decoded_events(c: Corpus) -> DataFrame:
    return c.progress_events().select("job_id", "event_id", "ts_ms", "type", "stage", "fraction", "message", "cpu_pct", "ram_gb")


_LABELS = " ".join(f"WHEN message = '{m}' THEN '{v}'" for m, v in pg.LABELS.items()) + " " + " ".join(
    "WHEN " + " AND ".join([f"contains(lower(message), '{w}')" for w in every] + (["(" + " OR ".join(f"contains(lower(message), '{w}')" for w in some) + ")"] if some else []))
    + f" THEN '{name}'" for every, some, name in pg.LABEL_RULES
)
_WEIGHTS = " ".join(f"WHEN '{k}' THEN {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * fraction" for k, (a, b) in pg.WEIGHTS.items())


@query("K2 K3 K4", rf"""
    SELECT job_id, event_id, CASE {_LABELS} ELSE 'Processing' END AS label,
           CAST(nullif(regexp_extract(message, '(?i)chunk\s+(\d+)/(\d+)', 1), '') AS INT) AS chunk,
           CAST(nullif(regexp_extract(message, '(?i)chunk\s+(\d+)/(\d+)', 2), '') AS INT) AS chunks,
           {rnd(f"CASE stage {_WEIGHTS} ELSE fraction END", 6)} AS overall FROM progress_events WHERE type = 'stage'""")
def labelled_stages(c: Corpus) -> DataFrame:
    at = pg.chunk_progress(F.col("message"))
    return c.progress_events().filter("type = 'stage'").select(
        "job_id", "event_id", pg.stage_label(F.col("message")).alias("label"), at["current"].alias("chunk"), at["total"].alias("chunks"),
        F.round(pg.overall_fraction(F.col("stage"), F.col("fraction")), 6).alias("overall"),
    )


@query("K5", """
    SELECT job_id, event_id, ts_ms, progress FROM (
      SELECT *, max(bar) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM (
        SELECT *, CASE WHEN type = 'completed' THEN 1.0::DOUBLE WHEN type = 'stage' THEN least(fraction, 0.95::DOUBLE) END AS bar FROM progress_events))
    WHERE bar IS NOT NULL""")
def monotone_progress(c: Corpus) -> DataFrame:
    return pg.monotone_progress(c.progress_events())


@query("K6", """
    SELECT job_id, event_id, ts_ms, ts_ms + 2700000 AS stalled_ms FROM (
      SELECT *, lead(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS next_ms FROM progress_events WHERE type <> 'resource')
    WHERE coalesce(next_ms, (SELECT max(ts_ms) FROM progress_events)) - ts_ms >= 2700000 AND type NOT IN ('completed', 'error')""")
def stalled_jobs(c: Corpus) -> DataFrame:
    return pg.stalls(c.progress_events())


@query("K6", """
    SELECT job_id, event_id, ts_ms, ts_ms + 2700000 AS stalled_ms FROM (
      SELECT 0::BIGINT AS job_id, event_id, ts_ms, type, lead(ts_ms) OVER (ORDER BY ts_ms, event_id) AS next_ms FROM progress_events WHERE type NOT IN ('resource', 'chunk_progress'))
    WHERE coalesce(next_ms, (SELECT max(ts_ms) FROM progress_events)) - ts_ms >= 2700000 AND type NOT IN ('completed', 'error')""")
def one_job_stalls(c: Corpus) -> DataFrame:
    """All events as those of one job, in seven ranges: carries over borders."""
    events = c.progress_events().filter("type <> 'chunk_progress'").withColumn("job_id", F.lit(0).cast("long"))
    return pg.stalls(events, ranges=7)


@query("K5", """
    SELECT 0::BIGINT AS job_id, event_id, ts_ms, progress FROM (
      SELECT *, max(bar) OVER (ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM (
        SELECT *, CASE WHEN type = 'completed' THEN 1.0::DOUBLE WHEN type = 'stage' THEN least(fraction, 0.95::DOUBLE) END AS bar FROM progress_events))
    WHERE bar IS NOT NULL""")
def one_job_progress(c: Corpus) -> DataFrame:
    """All events as those of one job, in seven ranges."""
    return pg.monotone_progress(c.progress_events().withColumn("job_id", F.lit(0).cast("long")), ranges=7)


@query("D10", f"""
    SELECT 0::BIGINT AS job_id, stage, min(ts_ms) - min(t0) AS start_ms, CAST(sum(until - ts_ms) AS BIGINT) AS duration_ms,
           {rnd('100 * sum(until - ts_ms) / (min(t1) - min(t0))', 1)} AS pct
    FROM (SELECT *, lead(ts_ms) OVER (ORDER BY ts_ms, event_id) AS until, min(ts_ms) OVER () AS t0,
                 max(ts_ms) OVER () AS t1, kind AS stage FROM job_events) WHERE until IS NOT NULL GROUP BY stage""")
def one_job_stages(c: Corpus) -> DataFrame:
    """All stage changes as those of one job, in seven ranges."""
    return ops.stage_report(c.job_events().withColumnRenamed("kind", "stage").withColumn("job_id", F.lit(0).cast("long")), ranges=7)


@query("K5 K6 K7 K8", """
    WITH ends AS (SELECT job_id, min({'t': ts_ms, 'e': event_id}) AS over FROM progress_events WHERE type IN ('completed', 'error') GROUP BY job_id),
    live AS (SELECT p.* FROM progress_events p LEFT JOIN ends USING (job_id) WHERE over IS NULL OR {'t': ts_ms, 'e': event_id} <= over),
    bars AS (SELECT *, CASE WHEN type = 'completed' THEN 1.0::DOUBLE WHEN type = 'stage' THEN least(fraction, 0.95::DOUBLE) END AS bar FROM live)
    SELECT job_id, 'progress' AS kind, event_id, ts_ms, max(bar) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS progress, NULL::VARCHAR AS stage
    FROM bars WHERE bar IS NOT NULL
    UNION ALL
    SELECT job_id, 'stage', event_id, ts_ms, NULL, stage FROM (
      SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS p FROM live WHERE type = 'stage' AND stage IS NOT NULL) WHERE p IS NULL OR p <> stage
    UNION ALL
    SELECT job_id, 'stalled', event_id, ts_ms, NULL, NULL FROM (
      SELECT *, lead(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS next_ms FROM live WHERE type <> 'resource')
    WHERE (next_ms IS NULL OR next_ms - ts_ms >= 2700000) AND type NOT IN ('completed', 'error')
    UNION ALL
    SELECT job_id, 'end', event_id, ts_ms, NULL, type FROM live WHERE type IN ('completed', 'error')""")
def streamed_progress(c: Corpus) -> DataFrame:
    """What the stream with state per job says of all events; a last event of another job, far ahead, drives the watermark past all."""
    return js.streamed(c.progress_lines())


@query("K7", """
    SELECT p.job_id, event_id, p.ts_ms AS joined_ms, e.end_ms, e.type FROM progress_events p JOIN (
      SELECT job_id, arg_min(type, {'t': ts_ms, 'e': event_id}) AS type, min(ts_ms) AS end_ms FROM progress_events WHERE type IN ('completed', 'error') GROUP BY job_id) e
    ON p.job_id = e.job_id AND p.ts_ms >= e.end_ms""")
def replayed_ends(c: Corpus) -> DataFrame:
    """The end of its job for every one who joins when an event comes in."""
    events = c.progress_events()
    return js.replay(events.select("job_id", "event_id", F.col("ts_ms").alias("joined_ms")), pg.terminal_events(events))


@query("K7", """
    SELECT job_id, ts_ms, event_id, type, message FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS nth FROM progress_events WHERE type IN ('completed', 'error')) WHERE nth = 1""")
def terminal_events(c: Corpus) -> DataFrame:
    return pg.terminal_events(c.progress_events())


@query("K8", """
    SELECT job_id, stage, since_ms FROM (
      SELECT job_id, stage, ts_ms AS since_ms, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms DESC, event_id DESC) AS nth FROM (
        SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS p FROM progress_events WHERE type = 'stage')
      WHERE p IS NULL OR p <> stage) WHERE nth = 1""")
def live_stages(c: Corpus) -> DataFrame:
    return pg.live_view(c.progress_events())


@query("K8", f"""
    SELECT job_id, ts_ms // 10000 * 10000 AS start_ms, count(*) AS n, {rnd(mean('cpu_pct'), 3)} AS cpu_pct, {rnd(mean('ram_gb'), 3)} AS ram_gb
    FROM progress_events WHERE type = 'resource' GROUP BY 1, 2""")
def resource_windows(c: Corpus) -> DataFrame:
    return pg.resource_windows(c.progress_events().withColumn("ts", F.timestamp_millis("ts_ms")))


@query("K8", """
    SELECT job_id, event_id, cpu_pct, nth FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS nth FROM progress_events WHERE type = 'resource')""")
def sampled_resources(c: Corpus) -> DataFrame:
    """All resource events, numbered; a report of half the length would take every=2."""
    return pg.sampled_resources(c.progress_events()).select("job_id", "event_id", "cpu_pct", "nth")


@query("K9", """
    SELECT job_id, kind, created_ms AS modified_ms FROM (SELECT job_id, created_ms, CASE WHEN job_id % 3 = 0 THEN 'temp' ELSE 'output' END AS kind FROM job_table)
    WHERE created_ms < (SELECT max(created_ms) FROM job_table) + 3600000 - CASE WHEN kind = 'output' THEN 24 ELSE 26 END * 3600000""")
def expired_files(c: Corpus) -> DataFrame:
    files = c.job_table().select(
        "job_id", F.when(F.col("job_id") % 3 == 0, "temp").otherwise("output").alias("kind"), F.col("created_ms").alias("modified_ms")
    )
    return pg.expired(files, files.agg(F.max("modified_ms") + 3_600_000).scalar())


@query("M1 M2 M3", """
    SELECT job_id, seg_idx, printf('[%02d:%02d]', start_ms // 60000, start_ms // 1000 % 60) AS clock,
           printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt,
           printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS vtt,
           CASE WHEN t >= 3600 THEN printf('%dh %02dm %02ds', t // 3600, t // 60 % 60, t % 60) WHEN t >= 60 THEN printf('%dm %02ds', t // 60, t % 60)
                ELSE printf('%.1fs', t::DOUBLE) END AS took
    FROM (SELECT *, end_ms // 1000 * 17 AS t FROM segments)""")
def time_formats(c: Corpus) -> DataFrame:
    took = (F.floor(F.col("end_ms") / 1000) * 17).cast("double")
    return c.segments().select(
        "job_id", "seg_idx", tf.clock(F.col("start_ms")).alias("clock"), tf.srt_time(F.col("start_ms")).alias("srt"),
        tf.vtt_time(F.col("end_ms")).alias("vtt"), tf.duration_text(took).alias("took"),
    )


@query("M8 M9", r"""
    SELECT upload_id, printf('%.0f%%', round_even(n / 1000 * 100, 0)) AS pct, printf('%.1f%%', round_even(n / 1000 * 100, 1)) AS pct_1,
           replace(line, '|', '\|') AS escaped
    FROM (SELECT doc_id AS upload_id, doc_id % 1000 AS n, source || '|' || lang AS line FROM documents)""")
def percent_formats(c: Corpus) -> DataFrame:
    share = (F.col("doc_id") % 1000) / 1000
    return c.table("documents").select(
        F.col("doc_id").alias("upload_id"), tx.percent(share).alias("pct"), tx.percent(share, 1).alias("pct_1"),
        tx.pipes_escaped(F.concat_ws("|", "source", "lang")).alias("escaped"),
    )
