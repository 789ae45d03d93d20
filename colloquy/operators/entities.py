"""Named things in meetings: people, organisations, amounts, dates, identifiers, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.operators.attribution import with_display_names
from colloquy.operators.ordered import concat_in_order, dense_axis, running_sum, scan


def _labelled(kind: str):
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _matches(text, patterns: dict[str, str]):
    """Array of (kind, value) for every match of every pattern."""
    return F.concat(
        *[
            F.transform(F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)), _labelled(kind))
            for kind, p in patterns.items()
        ]
    )


def _kept(df: DataFrame) -> DataFrame:
    return df.filter(~((F.col("kind") == "acronym") & F.col("value").isin(lx.SHORT_CAPS)))


def stretches(segs: DataFrame) -> DataFrame:
    """Meeting text cut where no entity can run on, so that the pieces can be searched apart.

    A border is kept only if the next segment starts with a token that can continue an entity (capital, digit, amount word) and the
    segment before doesn't end a sentence: no entity has such a mark inside, but for the full stop of a title.
    """
    first, last = F.regexp_extract("text", r"^(\S*)", 1), F.regexp_extract("text", r"(\S*)$", 1)
    opens = F.when(first.rlike(lx.CONTINUES_ENTITY), 0).otherwise(1)
    closes = F.when(last.rlike("[.!?;:]$") & ~F.regexp_replace(last, "[.]$", "").isin(*lx.TITLES), 1).otherwise(0)
    flagged = segs.select("job_id", "seg_idx", "text", opens.alias("opens"), closes.alias("closes"))
    placed = scan(flagged, dense_axis("job_id", "seg_idx"), _begun=running_sum(F.col("opens")), _ended=running_sum(F.col("closes")))
    placed = placed.withColumn("stretch", F.col("_begun") + F.col("_ended") - F.col("closes"))
    return concat_in_order(placed, ["job_id", "stretch"], "seg_idx", "text")


def entities(segs: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (job_id, kind, value); people are display names and titled names."""
    patterns = {"person": lx.TITLED_PERSON, **lx.ENTITY_PATTERNS}
    found = stretches(segs).select("job_id", F.explode(_matches(F.col("text"), patterns)).alias("m")).select("job_id", "m.*")
    people = names.select("job_id", F.lit("person").alias("kind"), F.col("display").alias("value"))
    return _kept(found).union(people).distinct()


KINDS = ("person", *lx.ENTITY_PATTERNS)


def entity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("job_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.count("*").alias("n_total")
    )


NUMBER_KINDS = ("dollars", "percent", "date", "loan_id", "ticket", "url", "email")


def first_mentions(segs: DataFrame, names: DataFrame) -> DataFrame:
    """First segment of each number, code or address, with its speaker."""
    patterns = {k: lx.ENTITY_PATTERNS[k] for k in NUMBER_KINDS}
    found = segs.select(
        "job_id", "seg_idx", "start_ms", "speaker_id", F.explode(_matches(F.col("text"), patterns)).alias("m")
    ).select("job_id", "seg_idx", "start_ms", "speaker_id", "m.*")
    first = found.groupBy("job_id", "kind", "value").agg(
        F.min(F.struct("seg_idx", "start_ms", "speaker_id")).alias("f")
    )
    return with_display_names(
        first.select("job_id", "kind", "value", "f.seg_idx", F.col("f.start_ms").alias("at_ms"), "f.speaker_id"), names
    )


def bare_numbers(segs: DataFrame, names: DataFrame) -> DataFrame:
    """First mention of 4+ digit numbers that are not part of an amount, date, loan or ticket."""
    digits = F.regexp_extract_all("text", F.lit(r"(?U)\b\d{4,}\b"), F.lit(0))
    rows = segs.select("job_id", "seg_idx", "start_ms", "speaker_id", F.explode(digits).alias("value"))
    first = rows.groupBy("job_id", "value").agg(F.min(F.struct("seg_idx", "start_ms", "speaker_id")).alias("f"))
    patterns = {k: lx.ENTITY_PATTERNS[k] for k in ("dollars", "percent", "loan_id", "ticket", "date")}
    taken = (
        stretches(segs)
        .select("job_id", F.explode(_matches(F.col("text"), patterns)).alias("m"))
        .select("job_id", F.explode(F.regexp_extract_all("m.value", F.lit(r"\d{4,}"), F.lit(0))).alias("value"))
        .distinct()
    )
    return with_display_names(
        first.join(taken, ["job_id", "value"], "left_anti").select(
            "job_id", "value", "f.seg_idx", F.col("f.start_ms").alias("at_ms"), "f.speaker_id"
        ),
        names,
    )
