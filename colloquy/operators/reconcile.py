"""One set of speaker labels from diarization chunks that were labelled apart."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.ordered import dense_axis, previous, scan
from colloquy.session import ship_package, written

LEAST_OVERLAP_MS = 500
LEAST_TURN_MS = 100
#: Chunks of a plan that are looked at together for the end of the chunk before.
CHUNKS = 1024


def _probes(turns: DataFrame, seams: DataFrame, keys) -> DataFrame:
    """Who speaks at each half second mark of each seam: (*keys, t, speaker_id), first turn in order."""
    in_seam = turns.join(seams, keys).filter("end_ms >= seam_start and start_ms <= seam_end")
    # Marks lie at t + 0.5 s for whole seconds t of the seam.
    lo = F.greatest(F.floor(F.col("seam_start") / 1000), F.ceil((F.col("start_ms") - 500) / 1000))
    hi = F.least(F.floor(F.col("seam_end") / 1000) - 1, F.floor((F.col("end_ms") - 500) / 1000))
    marks = in_seam.filter(lo <= hi).select(*keys, "turn_no", "speaker_id", F.explode(F.sequence(lo, hi)).alias("t"))
    return marks.groupBy(*keys, "t").agg(F.min_by("speaker_id", "turn_no").alias("speaker_id"))


def seam_votes(known: DataFrame, local: DataFrame, seams: DataFrame, keys=("job_id",)) -> DataFrame:
    """Seconds on which a local and a known speaker coincide: (*keys, local, known, votes, first_t).

    `keys` name a seam: the meeting, and the chunk behind the seam if all seams are looked at together.
    """
    keys = list(keys)
    usable = seams.filter(F.col("seam_end") > F.col("seam_start") + LEAST_OVERLAP_MS)
    k = _probes(known, usable, keys).withColumnRenamed("speaker_id", "known")
    v = _probes(local, usable, keys).withColumnRenamed("speaker_id", "local")
    return v.join(k, [*keys, "t"]).groupBy(*keys, "local", "known").agg(
        F.count("*").alias("votes"), F.min("t").alias("first_t")
    )


def _take(acc: Column, pair: Column) -> Column:
    free = ~F.array_contains(acc["locals"], pair["local"]) & ~F.array_contains(acc["knowns"], pair["known"])
    return F.when(
        free,
        F.struct(
            F.array_append(acc["locals"], pair["local"]).alias("locals"),
            F.array_append(acc["knowns"], pair["known"]).alias("knowns"),
        ),
    ).otherwise(acc)


def greedy_map(votes: DataFrame, keys=("job_id",)) -> DataFrame:
    """One-to-one mapping: locals by total votes, each takes its best known speaker still free.

    A seam has at most as many pairs as overlap seconds, so its pairs fold in one cell.
    """
    keys = list(keys)
    per_local = votes.groupBy(*keys, "local").agg(F.sum("votes").alias("total"), F.min("first_t").alias("seen"))
    ranked = votes.join(per_local, [*keys, "local"]).select(
        *keys, F.struct((-F.col("total")).alias("a"), F.col("seen").alias("b"), "local", (-F.col("votes")).alias("c"), "first_t", "known").alias("p")
    )
    start = F.struct(F.array().cast("array<string>").alias("locals"), F.array().cast("array<string>").alias("knowns"))
    folded = ranked.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("p")), start, _take).alias("m"))
    return folded.select(*keys, F.explode(F.arrays_zip(F.col("m.locals").alias("local"), F.col("m.knowns").alias("known"))).alias("z")).select(
        *keys, "z.local", "z.known"
    )


def clip_seams(chunk_turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns without the part that the chunk before already covers, longer than 0.1 s."""
    ends = plan.select("job_id", "chunk_idx", "chunk_end_ms")
    seam = scan(ends, dense_axis("job_id", "chunk_idx"), seam_end=previous(F.col("chunk_end_ms"))).drop("chunk_end_ms")
    start = F.greatest("start_ms", F.coalesce("seam_end", "start_ms"))
    return chunk_turns.join(seam, ["job_id", "chunk_idx"]).filter(
        F.col("seam_end").isNull() | (F.col("end_ms") > F.col("seam_end"))
    ).withColumn("start_ms", start).filter(F.col("end_ms") - F.col("start_ms") > LEAST_TURN_MS).drop("seam_end")


def chunk_votes(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Votes on all seams at once: (job_id, chunk_idx, local, known_chunk, known, votes, first_t).

    What is known at a mark belongs to the chunk in whose part of the meeting it lies, which the plan alone tells: behind the end of the chunk
    before. Where chunks are shorter than their overlap, a seam reaches over several chunks. Turns and seams meet on (meeting, second).
    """
    seams = plan.filter(F.col("seam_end") > F.col("chunk_start_ms") + LEAST_OVERLAP_MS).select(
        "job_id", "chunk_idx", F.explode(F.sequence(F.floor(F.col("chunk_start_ms") / 1000), F.floor(F.col("seam_end") / 1000) - 1)).alias("t")
    )
    ends = plan.select("job_id", F.col("chunk_idx").alias("of"), F.coalesce("seam_end", F.lit(0)).alias("own_from"))
    lo, hi = F.ceil((F.col("start_ms") - 500) / 1000), F.floor((F.col("end_ms") - 500) / 1000)
    heard = turns.withColumnRenamed("chunk_idx", "of").join(ends, ["job_id", "of"]).filter(lo <= hi).select(
        "job_id", "of", "speaker_id", "turn_no", "own_from", F.explode(F.sequence(lo, hi)).alias("t")
    )
    mark = F.col("t") * 1000 + 500
    at = seams.join(heard, ["job_id", "t"]).filter(F.col("of") <= F.col("chunk_idx"))
    local = F.min_by("speaker_id", F.when(F.col("of") == F.col("chunk_idx"), F.col("turn_no")))
    before = (F.col("of") < F.col("chunk_idx")) & (mark >= F.col("own_from")) & (F.col("turn_no.end_ms") > F.col("own_from"))
    known = F.min_by(F.struct(F.col("of").alias("known_chunk"), F.col("speaker_id").alias("known")), F.when(before, F.col("turn_no")))
    said = at.groupBy("job_id", "chunk_idx", "t").agg(local.alias("local"), known.alias("k")).filter("local is not null and k is not null")
    return said.groupBy("job_id", "chunk_idx", "local", "k.known_chunk", "k.known").agg(F.count("*").alias("votes"), F.min("t").alias("first_t"))


def _chosen(votes: list[dict], label: dict) -> dict[str, str]:
    """One-to-one: locals by total votes, each takes its best label still free."""
    sums: dict[str, dict[str, list[int]]] = {}
    for v in votes:
        got = sums.setdefault(v["local"], {}).setdefault(label[v["known_chunk"], v["known"]], [0, v["first_t"]])
        got[0] += v["votes"]
        got[1] = min(got[1], v["first_t"])
    out: dict[str, str] = {}
    for local, found in sorted(sums.items(), key=lambda x: (-sum(n for n, _ in x[1].values()), min(t for _, t in x[1].values()), x[0])):
        for name, _ in sorted(found.items(), key=lambda x: (-x[1][0], x[1][1], x[0])):
            if name not in out.values():
                out[local] = name
                break
    return out


def _labels(batches):
    """Labels of the speakers of all chunks, from rows (job_id, chunk_idx, speakers, votes, start, end) sorted by meeting and chunk."""
    job, label, number = None, {}, 0
    # (end, chunk) of the chunks that a later seam may reach.
    near: list[tuple[int, int]] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            i, speakers = row["chunk_idx"], row["speakers"]
            if row["job_id"] != job:
                job, label, near = row["job_id"], {}, []
                number = 1 + max((int(s[8:]) for s in speakers if i == 0 and s.startswith("SPEAKER_") and s[8:].isdigit()), default=-1)
            chosen = {s: s for s in speakers} if i == 0 else _chosen(row["votes"], label)
            for s in speakers:
                if s not in chosen:
                    chosen[s] = f"SPEAKER_{number:02d}"
                    number += 1
            near = [(e, c) for e, c in near if e >= row["chunk_start_ms"] - 1000] + [(row["chunk_end_ms"], i)]
            stay = {c for _, c in near}
            label = {k: v for k, v in label.items() if k[0] in stay} | {(i, s): x for s, x in chosen.items()}
            out += [(job, i, s, x) for s, x in chosen.items()]
        fields = batch.schema
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], fields.field(0).type), pa.array([r[1] for r in out], fields.field(1).type), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())],
            names=["job_id", "chunk_idx", "speaker_id", "label"],
        )


def reconcile(chunk_turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns of each meeting with the labels of its first chunk carried through.

    Votes of all seams are counted at once. What is left of a seam is a row with its speakers and a few votes; these rows pass in order of chunks, as a
    stream per meeting, and every chunk's labels follow from those of the chunks that its seam reaches. A local speaker
    without a partner gets the next free SPEAKER_nn, in order of first words. Meetings of one chunk are returned as they are.
    """
    ship_package(chunk_turns.sparkSession)
    turn_no = F.struct("chunk_idx", "start_ms", "end_ms", "speaker_id")
    turns = written(chunk_turns.withColumn("turn_no", turn_no), "chunk_turns")
    seam = F.lag("chunk_end_ms").over(Window.partitionBy("job_id", "_slice").orderBy("chunk_idx"))
    # The end of the chunk before; chunks come in slices with the last chunk of the slice before as a guest.
    homes = F.array_distinct(F.array(F.floor(F.col("chunk_idx") / CHUNKS), F.floor((F.col("chunk_idx") + 1) / CHUNKS)))
    plan = plan.withColumn("_slice", F.explode(homes)).withColumn("seam_end", seam).filter(F.col("_slice") == F.floor(F.col("chunk_idx") / CHUNKS))
    plan = written(plan.select("job_id", "chunk_idx", "chunk_start_ms", "chunk_end_ms", "seam_end"), "chunk_plan")
    # A chunk has few speakers, and an overlap few votes: both fit a cell.
    speakers = turns.groupBy("job_id", "chunk_idx", "speaker_id").agg(F.min("turn_no").alias("seen")).groupBy("job_id", "chunk_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "speaker_id"))), lambda x: x["speaker_id"]).alias("speakers")
    )
    votes = chunk_votes(turns, plan).groupBy("job_id", "chunk_idx").agg(F.collect_list(F.struct("local", "known_chunk", "known", "votes", "first_t")).alias("votes"))
    seams = speakers.join(votes, ["job_id", "chunk_idx"], "left").withColumn("votes", F.coalesce("votes", F.array().cast(votes.schema["votes"].dataType)))
    types = dict(chunk_turns.dtypes)
    seams = seams.join(plan, ["job_id", "chunk_idx"])
    ordered = seams.select("job_id", "chunk_idx", "speakers", "votes", "chunk_start_ms", "chunk_end_ms").repartition("job_id").sortWithinPartitions("job_id", "chunk_idx")
    labels = ordered.mapInArrow(_labels, f"job_id {types['job_id']}, chunk_idx {types['chunk_idx']}, speaker_id string, label string")
    several = plan.select("job_id", "chunk_idx", "seam_end")
    single = plan.groupBy("job_id").agg((F.count("*") == 1).alias("single"))
    start = F.greatest("start_ms", F.coalesce("seam_end", "start_ms"))
    return (
        turns.join(labels, ["job_id", "chunk_idx", "speaker_id"]).join(several, ["job_id", "chunk_idx"]).join(single, "job_id")
        .filter(F.col("seam_end").isNull() | (F.col("end_ms") > F.col("seam_end")))
        .select("job_id", F.col("label").alias("speaker_id"), start.alias("start_ms"), "end_ms", "single")
        .filter(F.col("single") | (F.col("end_ms") - F.col("start_ms") > LEAST_TURN_MS)).drop("single")
    )
