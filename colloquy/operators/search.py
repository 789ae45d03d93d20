"""Phrase search over meetings and their facts, and the search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.attribution import with_display_names

NEAR = 8
PIECE_PLACES = 1_000


def _has(text: Column, phrase: str) -> Column:
    return F.lower(text).contains(phrase.lower())


def snippet(text: Column, phrase: str, k: int = NEAR) -> Column:
    """Words around the first match, the matched word in bold, dots where text was left out."""
    at = F.locate(phrase.lower(), F.lower(text))
    before = F.substring(text, F.lit(1), at)
    i = F.length(before) - F.length(F.replace(before, F.lit(" ")))
    words = F.split(text, " ")
    n = F.size(words)
    lo = F.greatest(i - k, F.lit(0))
    hi = F.least(i + k + 1, n)
    left = F.slice(words, lo + 1, i - lo)
    right = F.slice(words, i + 2, hi - i - 1)
    bold = F.array(F.concat(F.lit("**"), F.get(words, i), F.lit("**")))
    return F.concat(
        F.when(lo > 0, "…").otherwise(""), F.array_join(F.concat(left, bold, right), " "), F.when(hi < n, "…").otherwise("")
    )


def search(phrase: str, segs: DataFrame, names: DataFrame, actions: DataFrame, decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits in segments, tasks, decisions and questions: sort by (at_ms, kind_no, item_no)."""

    def facts(df, kind_no, kind, text, context):
        return df.filter(_has(F.col(text), phrase)).select(
            "job_id", F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), F.col("sent_no").alias("item_no"), "at_ms",
            F.col("speaker_id").alias("speaker"), F.col(text).alias("text"), context.alias("context"),
        )

    spoken = with_display_names(segs.filter(_has(F.col("text"), phrase)), names).select(
        "job_id", F.lit(0).alias("kind_no"), F.lit("segment").alias("kind"), F.col("seg_idx").alias("item_no"),
        F.col("start_ms").alias("at_ms"), F.col("display").alias("speaker"), "text", snippet(F.col("text"), phrase).alias("context"),
    )
    owner = F.concat(F.lit("Action item, owner: "), F.coalesce("owner", F.lit("—")))
    return (
        spoken.union(facts(actions, 1, "action_item", "task", owner))
        .union(facts(decisions, 2, "decision", "decision", F.lit("Decision")))
        .union(facts(questions, 3, "question", "question", F.lit("Question")))
    )


def first_hits(hits: DataFrame, n: int = 20) -> DataFrame:
    """The n earliest hits, a top-n by time."""
    return hits.orderBy("at_ms", "job_id", "kind_no", "item_no").limit(n)


PRESETS = {"action items": "action", "action item": "action", "decisions": "decision", "questions": "question"}


def preset(name: str, actions: DataFrame, decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """All rows behind a preset query such as "decisions"."""
    kind = PRESETS[name.strip().lower()]
    table, text = {
        "action": (actions, "task"), "decision": (decisions, "decision"), "question": (questions, "question")
    }[kind]
    return table.select("job_id", F.lit(kind).alias("kind"), "sent_no", "at_ms", "speaker_id", F.col(text).alias("text"))


def typed_search(typed: str, segs: DataFrame, names: DataFrame, shown: int = 50) -> DataFrame:
    """First segments containing what was typed (two characters at least), and whether there are more."""
    if len(typed.strip()) < 2:
        return with_display_names(segs, names).limit(0).select("job_id", "seg_idx", "start_ms", "display", "text", F.lit(False).alias("truncated"))
    found = segs.filter(_has(F.col("text"), typed.strip())).orderBy("job_id", "seg_idx").limit(shown + 1)
    # One row more than shown tells whether there are more; the windows see these few rows only.
    few = Window.partitionBy(F.lit(0))
    placed = found.withColumn("truncated", F.count("*").over(few) > shown).withColumn("_r", F.row_number().over(few.orderBy("job_id", "seg_idx")))
    kept = placed.filter(F.col("_r") <= shown)
    return with_display_names(kept, names).select("job_id", "seg_idx", "start_ms", "display", "text", "truncated")


def _rows(df: DataFrame, section: str, place: Column, *fields) -> DataFrame:
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select("job_id", F.lit(section).alias("section"), place.cast("long").alias("place"), body.alias("body"))


def index_rows(jobs, names, words, segs, topics, entities, actions, decisions, questions, corrections) -> DataFrame:
    """The search index in long form: (job_id, section, place, body as JSON)."""
    with_time = corrections.join(segs.select("job_id", "seg_idx", "seg_id", "start_ms"), ["job_id", "seg_idx"], "left")
    c = F.col
    return (
        _rows(jobs, "meta", F.lit(0), F.lit(1).alias("version"), "language", "duration_ms")
        .union(_rows(names, "speaker", c("first_seg"), "speaker_id", "display"))
        .union(_rows(with_display_names(segs, names), "segment", c("seg_idx"), "seg_id", "speaker_id", "display", "start_ms", "end_ms", "text"))
        .union(_rows(words, "word", c("word_idx"), "seg_idx", "text", "start_ms", "end_ms", "confidence"))
        .union(_rows(topics, "topic", c("chunk"), "start_ms", "end_ms", "label", "keywords"))
        .union(_rows(entities, "entity", F.conv(F.substring(F.md5("value"), 1, 5), 16, 10), "kind", "value"))
        .union(_rows(actions, "action", c("sent_no"), "task", "owner", "due_date", "at_ms", "speaker_id", "confidence", "reason"))
        .union(_rows(decisions, "decision", c("sent_no"), "decision", "at_ms", "speaker_id", "confidence", "reason"))
        .union(_rows(questions, "question", c("sent_no"), "question", "is_answered", "at_ms", "speaker_id", "confidence"))
        .union(_rows(with_time, "correction", c("seg_idx"), "original", "replacement", "confidence", "profile", "seg_id", "start_ms"))
    )


def index_documents(rows: DataFrame, per_piece: int = PIECE_PLACES) -> DataFrame:
    """Index rows gathered into JSON lists; a long section comes in numbered pieces of bounded size."""
    piece = F.floor(F.col("place") / per_piece)
    items = F.array_sort(F.collect_list(F.struct("place", "body")))
    return rows.groupBy("job_id", "section", piece.alias("piece")).agg(
        F.count("*").alias("n"),
        F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["body"]), ","), F.lit("]")).alias("document"),
    )
