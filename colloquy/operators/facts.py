"""Action items, decisions and questions from sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.operators.attribution import with_display_names
from colloquy.operators.ordered import dense_axis, previous, running_sum, scan
from colloquy.session import written

ANSWER_WITHIN_MS = 30_000


def _captured(text: Column, lead: str, gap: str) -> Column:
    """What follows the trigger phrase up to the end of the sentence."""
    return F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?iU)\b{lead}\b{gap}{lx.ITEM}", 1)), "[.,;:]+$", "")


def candidates(sents: DataFrame, rules, least_chars: int = 1) -> DataFrame:
    """Every rule a sentence matches, as (job_id, sent_no, rank, item), rank in rule order; shorter items are left out."""
    # One plain filter first, so that most sentences never reach the capturing patterns.
    anywhere = lx.whole_words(*(lead for lead, *_ in rules))
    items = F.array(*[_captured(F.col("text"), lead, gap) for lead, gap, *_ in rules])
    return (
        sents.filter(F.col("text").rlike(anywhere))
        .select("job_id", "sent_no", F.posexplode(items).alias("rank", "item"))
        .filter(F.length("item") >= least_chars)
        .withColumn("key", F.lower("item"))
    )


def first_free(cands: DataFrame) -> DataFrame:
    """Each sentence takes its first item that no earlier sentence of the meeting has taken.

    Sentences propose their best remaining item, the earliest proposer of an item holds it, and
    the others move on to their next one. A sentence can only lose an item to an earlier one, so
    the rounds end with exactly the picks of a walk in sentence order; they stop as soon as no
    losing sentence has another item. Duplicates collapse by partial aggregation.
    """
    while True:
        top = cands.groupBy("job_id", "sent_no").agg(
            F.min("rank").alias("rank"), F.min_by("item", "rank").alias("item"), F.min_by("key", "rank").alias("key")
        )
        held = top.groupBy("job_id", "key").agg(F.min("sent_no").alias("sent_no"))
        lost = top.join(held, ["job_id", "key", "sent_no"], "left_anti").select("job_id", "sent_no", "rank")
        further = cands.select("job_id", "sent_no", F.col("rank").alias("next_rank"))
        contested = lost.join(further, ["job_id", "sent_no"]).filter("next_rank > rank")
        if contested.isEmpty():
            return top.join(held, ["job_id", "key", "sent_no"], "left_semi")
        cands = written(cands.join(lost, ["job_id", "sent_no", "rank"], "left_anti"), "candidates")


def _rule_value(rules, at: int) -> Column:
    return F.array(*[F.lit(r[at]) for r in rules])[F.col("rank")]


def _picked(sents: DataFrame, rules) -> DataFrame:
    # The few sentences with a phrase are stored, since the rounds read them several times: all sentences are searched once.
    said = written(sents.filter(F.col("text").rlike(lx.whole_words(*(lead for lead, *_ in rules)))), "said")
    picks = first_free(written(candidates(said, rules), "candidates")).select("job_id", "sent_no", "rank", "item")
    return picks.join(said, ["job_id", "sent_no"]).select(
        "job_id", "sent_no", "seg_idx", "speaker_id", F.col("start_ms").alias("at_ms"), "text", "item", "rank",
        _rule_value(rules, 2).alias("confidence"), _rule_value(rules, 4).alias("reason"),
    )


def due_date(text: Column) -> Column:
    """When a sentence says the work is due, null if it does not.

    The sentence is read as words without the marks around them. Of the places where a rule fits, the first counts; of the rules, the
    first in this order: by a weekday (or the next one), by month and day (with the year behind it, if any), this or next week or month,
    by eod, tomorrow, today.
    """
    raw = F.split(text, r"\s+")
    words = F.struct(raw.alias("raw"), F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("bare"))
    words = F.transform(F.array(words), lambda w: F.struct(w["raw"].alias("raw"), w["bare"].alias("bare"), F.transform(w["bare"], F.lower).alias("low")))
    return F.transform(words, _due)[0]


def _due(w: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(w["low"]) - 1)

    def first(value) -> Column:
        return F.get(F.filter(F.transform(places, value), lambda v: v.isNotNull()), F.lit(0))

    def low(i: Column) -> Column:
        return F.coalesce(F.get(w["low"], i), F.lit(""))

    def bare(i: Column) -> Column:
        return F.get(w["bare"], i)

    def weekday(i: Column) -> Column:
        by = low(i) == "by"
        return F.when(by & low(i + 1).isin(*lx.WEEKDAYS), bare(i + 1)).when(by & (low(i + 1) == "next") & low(i + 2).isin(*lx.WEEKDAYS), F.concat_ws(" ", bare(i + 1), bare(i + 2)))

    def date(i: Column) -> Column:
        day = F.coalesce(F.get(w["raw"], i + 2), F.lit(""))
        year = low(i + 3).rlike("^[0-9]{4}$") & day.rlike("[^.!?;:]$")
        fits = (low(i) == "by") & low(i + 1).isin(*lx.MONTHS) & low(i + 2).rlike("^[0-9]{1,2}(st|nd|rd|th)?$")
        return F.when(fits & year, F.concat_ws(" ", bare(i + 1), day, bare(i + 3))).when(fits, F.concat_ws(" ", bare(i + 1), bare(i + 2)))

    def period(i: Column) -> Column:
        which, span = lx.DUE_WORDS
        return F.when(low(i).isin(*which) & low(i + 1).isin(*span), F.concat_ws(" ", bare(i), bare(i + 1)))

    return F.coalesce(
        first(weekday), first(date), first(period), first(lambda i: F.when((low(i) == "by") & (low(i + 1) == "eod"), "end of day")),
        F.when(F.array_contains(w["low"], "tomorrow"), "tomorrow"), F.when(F.array_contains(w["low"], "today"), "today"),
    )


def action_items(sents: DataFrame, names: DataFrame) -> DataFrame:
    found = with_display_names(_picked(sents, lx.ACTION_RULES), names)
    return found.select(
        "job_id", "sent_no", "seg_idx", "speaker_id", "at_ms", "text",
        F.col("item").alias("task"), F.when(_rule_value(lx.ACTION_RULES, 3), F.col("display")).alias("owner"),
        due_date(F.col("text")).alias("due_date"), "confidence", "reason",
    )


def decisions(sents: DataFrame) -> DataFrame:
    return _picked(sents, lx.DECISION_RULES).select(
        "job_id", "sent_no", "seg_idx", "speaker_id", "at_ms", "text",
        F.col("item").alias("decision"), "confidence", "reason",
    )


_TAG = r"(?i),?\s*(?:" + "|".join(lx.TAGS) + r")\?$"


def open_sentences(sents: DataFrame) -> DataFrame:
    """Sentences that really ask: no backchannels, nothing under 20 characters, no tag questions."""
    text = F.col("text")
    bare = F.trim(F.lower(F.regexp_replace(text, "[? ]+$", "")))
    core = F.trim(F.regexp_replace(text, _TAG, ""))
    opener = F.regexp_replace(F.lower(F.regexp_extract(core, r"^(\S+)", 1)), "[?,;:]+$", "")
    tag_only = (core != "") & ~core.endswith("?") & ~opener.isin(lx.QUESTION_WORDS)
    return sents.filter(text.endswith("?")).filter(
        ~bare.isin(lx.BACKCHANNELS) & (F.length(text) >= 20) & ~tag_only
    )


def replies(segs: DataFrame) -> DataFrame:
    """For each segment the first later segment of another speaker: (job_id, seg_idx, reply_ms, unsure)."""
    axis = dense_axis("job_id", "seg_idx")
    opening = F.lower(F.trim("text"))
    unsure = F.lit(False)
    for phrase in lx.UNSURE:
        unsure = unsure | opening.startswith(phrase)
    slim = segs.select("job_id", "seg_idx", "speaker_id", "start_ms", unsure.alias("unsure"))
    flagged = scan(slim, axis, _prev=previous(F.col("speaker_id"))).withColumn(
        "_new", F.when(F.col("_prev").eqNullSafe(F.col("speaker_id")), 0).otherwise(1)
    )
    runs = written(scan(written(flagged, "reply_flags"), axis, run=running_sum(F.col("_new"))), "reply_runs")
    opener = runs.filter("_new = 1").select(
        "job_id", (F.col("run") - 1).alias("run"), F.col("start_ms").alias("reply_ms"), "unsure"
    )
    return runs.select("job_id", "seg_idx", "run").join(opener, ["job_id", "run"]).drop("run")


def questions(sents: DataFrame, segs: DataFrame) -> DataFrame:
    asked = open_sentences(sents).withColumn("key", F.lower("text"))
    first = asked.groupBy("job_id", "key").agg(
        F.min_by(F.struct("sent_no", "seg_idx", "speaker_id", "start_ms", "text"), "sent_no").alias("q")
    ).select("job_id", "q.*")
    heard = first.join(replies(segs), ["job_id", "seg_idx"], "left")
    in_time = F.col("reply_ms") - F.col("start_ms") <= ANSWER_WITHIN_MS
    return heard.select(
        "job_id", "sent_no", "seg_idx", "speaker_id", F.col("start_ms").alias("at_ms"),
        "text", F.col("text").alias("question"),
        F.coalesce(in_time & ~F.col("unsure"), F.lit(False)).alias("is_answered"),
        F.lit(0.95).alias("confidence"), F.lit("ends with a question mark").alias("reason"),
    )
