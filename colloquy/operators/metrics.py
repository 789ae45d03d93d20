"""Counts and shares per meeting, speaker and corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.functions.numbers import exact_mean
from colloquy.functions.text import bare_word, clipped
from colloquy.operators.ordered import places

LOW = 0.65
BIN_EDGES = (0.5, 0.6, 0.7, 0.8, 0.9)
WORDS_PER_MINUTE = 200


def _low():
    return F.col("confidence") < LOW


def word_stats(words: DataFrame) -> DataFrame:
    return words.groupBy("job_id").agg(
        F.count("*").alias("n_words"), F.count("confidence").alias("n_scored"), F.count_if(_low()).alias("n_low"),
        F.round(exact_mean(F.col("confidence")), 4).alias("avg_confidence"),
    )


def transcript_stats(words: DataFrame, segs: DataFrame, corrections: DataFrame) -> DataFrame:
    shape = segs.groupBy("job_id", "speaker_id").agg(F.count("*").alias("n")).groupBy("job_id").agg(
        F.count("*").alias("n_speakers"), F.sum("n").alias("n_segments")
    )
    fixes = corrections.groupBy("job_id").agg(F.count("*").alias("n_corrections"))
    return word_stats(words).join(shape, "job_id").join(fixes, "job_id", "left").fillna(0, ["n_corrections"])


def confidence_histogram(words: DataFrame) -> DataFrame:
    """Scored words per bin; a bin holds its lower edge."""
    c = F.col("confidence")
    edges = [None, *BIN_EDGES, None]
    bins = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c < hi)
        bins.append(F.count_if(c.isNotNull() & inside).alias(f"bin_{i}"))
    return words.groupBy("job_id").agg(*bins)


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("job_id").agg(F.count("*").alias(name))


def meeting_metrics(jobs, stats, histogram, actions, decisions, questions, entities, timeline, topics) -> DataFrame:
    asked = questions.groupBy("job_id").agg(
        F.count("*").alias("n_questions"), F.count_if(~F.col("is_answered")).alias("n_open_questions")
    )
    parts = [
        _counts(actions, "n_actions"), _counts(decisions, "n_decisions"), asked, _counts(entities, "n_entities"),
        _counts(timeline, "n_events"), _counts(topics, "n_topics"),
    ]
    out = jobs.select("job_id", F.round(F.col("duration_ms") / 1000.0, 2).alias("duration_s"), "language")
    for part in [stats, histogram, *parts]:
        out = out.join(part, "job_id", "left")
    counts = [c for c in out.columns if c.startswith(("n_", "bin_"))]
    return out.fillna(0, counts).withColumn("reading_minutes", F.round(F.col("n_words") / WORDS_PER_MINUTE, 2))


def listed(df: DataFrame, order: tuple[str, ...], shown: int | None, ranges: int | None = None) -> DataFrame:
    """All rows with their place in the meeting along the order, or only the first `shown`.

    A limit is cut before the shuffle; all rows are numbered range by range.
    """
    if shown is None:
        return places(df, "job_id", order, ranges)
    return df.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)).cast("long")).filter(F.col("place") <= shown)


def _ranked(counted: DataFrame, shown: int | None, ranges: int | None = None) -> DataFrame:
    """Terms of each meeting by count, ties to the first seen."""
    return listed(counted.withColumn("_fewer", -F.col("n_seen")), ("_fewer", "first_idx"), shown, ranges).drop("first_idx", "_fewer")


def _count_terms(words: DataFrame) -> DataFrame:
    return words.groupBy("job_id", "term").agg(F.count("*").alias("n_seen"), F.min("word_idx").alias("first_idx"))


def name_tokens(names: DataFrame) -> DataFrame:
    """Lower-case parts of the display names."""
    return names.select("job_id", F.explode(F.split(F.lower("display"), r"\s+")).alias("token")).distinct()


def frequent_names(words: DataFrame, names: DataFrame, shown: int | None = None) -> DataFrame:
    """Capitalised words said at least twice that are neither sentence openers nor speaker names."""
    terms = words.select("job_id", "word_idx", bare_word(F.col("text")).alias("term")).filter(
        F.col("term").rlike("^[A-Z][a-z]{2,}$") & ~F.col("term").isin(*lx.OPENING_WORDS)
    )
    counted = _count_terms(terms).filter("n_seen >= 2").withColumn("token", F.lower("term"))
    return _ranked(counted.join(name_tokens(names), ["job_id", "token"], "left_anti").drop("token"), shown)


def unknown_acronyms(words: DataFrame, corrections: DataFrame, shown: int | None = None) -> DataFrame:
    terms = words.select("job_id", "word_idx", bare_word(F.col("text")).alias("term")).filter(F.col("term").rlike("^[A-Z]{2,}$"))
    known = corrections.select("job_id", F.explode(F.array(F.upper("original"), F.upper("replacement"))).alias("term")).distinct()
    return _ranked(_count_terms(terms).join(known, ["job_id", "term"], "left_anti"), shown)


def repeated_uncertain(words: DataFrame, shown: int | None = None, ranges: int | None = None) -> DataFrame:
    terms = words.filter(_low()).select("job_id", "word_idx", F.lower(bare_word(F.col("text"))).alias("term"))
    return _ranked(_count_terms(terms.filter(F.length("term") > 2)).filter("n_seen >= 2"), shown, ranges)


def low_segments_by_count(words: DataFrame, segs: DataFrame, shown: int | None = None) -> DataFrame:
    """Segments with two or more uncertain words."""
    low = words.filter(_low()).groupBy("job_id", "seg_idx").agg(F.count("*").alias("n_low")).filter("n_low >= 2")
    return listed(low, ("seg_idx",), shown).join(segs, ["job_id", "seg_idx"]).select(
        "job_id", "seg_idx", "place", "n_low", "start_ms", "end_ms", "text", clipped(F.col("text"), 80).alias("preview")
    )


def low_segments_by_average(words: DataFrame, segs: DataFrame) -> DataFrame:
    """Segments whose scored words average below the threshold."""
    avg = words.groupBy("job_id", "seg_idx").agg(exact_mean(F.col("confidence")).alias("a")).filter(F.col("a") < LOW)
    return avg.join(segs, ["job_id", "seg_idx"]).select(
        "job_id", "seg_idx", "speaker_id", "start_ms", F.round("a", 4).alias("avg_confidence"),
        "text", clipped(F.col("text"), 80, "…").alias("preview"),
    )


def doubtful_names(words: DataFrame, segs: DataFrame, names: DataFrame, shown: int | None = None) -> DataFrame:
    """Title-case words never seen in lower case, said once or with low confidence."""
    terms = words.select("job_id", "seg_idx", "word_idx", "confidence", bare_word(F.col("text")).alias("term"))
    lower_seen = terms.filter(F.col("term").rlike(r"^\p{Ll}")).select("job_id", F.lower("term").alias("token")).distinct()
    titled = terms.filter(F.col("term").rlike("^[A-Z][a-z]{2,}$")).groupBy("job_id", "term").agg(
        F.count("*").alias("n_seen"), exact_mean(F.col("confidence")).alias("a"), F.min("seg_idx").alias("seg_idx")
    ).withColumn("token", F.lower("term"))
    doubtful = titled.filter((F.col("n_seen") == 1) | (F.col("a") < LOW))
    kept = doubtful.join(name_tokens(names), ["job_id", "token"], "left_anti").join(lower_seen, ["job_id", "token"], "left_anti")
    return listed(kept, ("term",), shown).join(segs.select("job_id", "seg_idx", "start_ms"), ["job_id", "seg_idx"]).select(
        "job_id", "term", "place", "n_seen", F.round("a", 4).alias("avg_confidence"), F.col("start_ms").alias("first_ms")
    )


def suggested_vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    """Names and codes frequent across the whole corpus, with the corpus word total."""
    term = F.regexp_replace("text", r"^[.,!?;:]+|[.,!?;:]+$", "")
    counted = words.select(term.alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n_seen"))
    total = counted.agg(F.sum("n_seen").alias("n_total"))
    shaped = F.col("term").rlike("^[A-Z][A-Z0-9_]+$") | F.col("term").rlike("^[A-Z][a-z]{2,}$")
    return counted.filter((F.col("n_seen") >= least) & shaped).withColumn("n_total", total.scalar())
