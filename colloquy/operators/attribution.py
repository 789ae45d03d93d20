"""Who said each word: interval join of words and speaker turns, forward fill, speaker runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import (
    concat_in_order, dense_axis, joined_text, known_before, last_known, previous, running_sum, scan,
)
from colloquy.session import written

UNKNOWN = "SPEAKER_UNKNOWN"
BIN_MS = 30_000


def _bins(start, end):
    """Time bins touched by [start, end), at least one."""
    return F.explode(
        F.sequence(
            F.floor(start / BIN_MS),
            F.floor(F.greatest(end - 1, start) / BIN_MS),
        )
    )


def overlap_pairs(words: DataFrame, turns: DataFrame) -> DataFrame:
    """All (word, turn) pairs with a positive overlap, once each.

    Both sides are cut into 30 s bins so that the join has equality keys (job_id, bin); a pair is
    kept only in the first bin both touch.
    """
    w = words.select(
        "job_id", "word_idx", F.col("start_ms").alias("w_start"),
        F.greatest(F.col("end_ms"), F.col("start_ms") + 1).alias("w_end"),
    )
    w = w.withColumn("bin", _bins(F.col("w_start"), F.col("w_end")))
    t = turns.select(
        "job_id", "turn_idx", "speaker_id", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end")
    ).filter("t_end > t_start")
    t = t.withColumn("bin", _bins(F.col("t_start"), F.col("t_end")))
    overlap = F.least("w_end", "t_end") - F.greatest("w_start", "t_start")
    return (
        w.join(t, ["job_id", "bin"])
        .withColumn("overlap_ms", overlap)
        .filter("overlap_ms > 0")
        .filter(F.col("bin") == F.floor(F.greatest("w_start", "t_start") / BIN_MS))
    )


def best_speaker(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every word with the speaker of its longest overlapping turn, ties to the earliest turn."""
    rank = F.struct("overlap_ms", -F.col("t_start"), -F.col("turn_idx"))
    best = overlap_pairs(words, turns).groupBy("job_id", "word_idx").agg(
        F.max_by("speaker_id", rank).alias("speaker_id")
    )
    return words.join(best, ["job_id", "word_idx"], "left")


def fill_unknown(words: DataFrame) -> DataFrame:
    """Words without a turn take the last known speaker; leading ones stay unknown."""
    filled = scan(words, dense_axis("job_id", "word_idx"), speaker_id=last_known(F.col("speaker_id")))
    return filled.withColumn("speaker_id", F.coalesce("speaker_id", F.lit(UNKNOWN)))


def assign_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    matched = written(best_speaker(words, turns), "matched_words")
    return fill_unknown(matched)



def ends_sentence(word: Column) -> Column:
    """A sentence ends at a word ending in . ! ?"""
    return word.endswith(".") | word.endswith("!") | word.endswith("?")


def number_runs(words: DataFrame) -> DataFrame:
    """Number speaker runs (seg_idx) and sentences (sent_no), both dense from 0 in each meeting.

    A sentence ends at a word ending in . ! ? or at the end of the speaker run. prev_end_ms is
    null on the first word of a run.
    """
    seen = scan(words, dense_axis("job_id", "word_idx"), _before=previous(F.struct("speaker_id", "text", "end_ms")))
    return _numbered(seen, F.col("_before.speaker_id"), words.columns)


def attributed_runs(words: DataFrame, turns: DataFrame) -> DataFrame:
    """number_runs(assign_speakers(words, turns)) in one pass less: the speaker of the word before is
    the last known one before this word, so filling and comparing share a scan."""
    matched = written(best_speaker(words, turns), "matched_words")
    seen = scan(
        matched, dense_axis("job_id", "word_idx"), speaker_id=last_known(F.col("speaker_id")),
        _known=known_before(F.col("speaker_id")), _before=previous(F.struct("text", "end_ms")),
    )
    filled = seen.withColumn("speaker_id", F.coalesce("speaker_id", F.lit(UNKNOWN)))
    before = F.when(F.col("_before").isNotNull(), F.coalesce("_known", F.lit(UNKNOWN)))
    return _numbered(filled, before, matched.columns)


def _numbered(seen: DataFrame, speaker_before, columns: list[str]) -> DataFrame:
    axis = dense_axis("job_id", "word_idx")
    before = F.col("_before")
    same_run = before.isNotNull() & (speaker_before == F.col("speaker_id"))
    flagged = seen.select(
        *columns,
        F.when(same_run, 0).otherwise(1).alias("new_seg"),
        F.when(same_run & ~ends_sentence(before["text"]), 0).otherwise(1).alias("new_sent"),
        F.when(same_run, before["end_ms"]).alias("prev_end_ms"),
    )
    flagged = written(flagged, "flagged_words")
    numbered = scan(
        flagged, axis, seg_idx=running_sum(F.col("new_seg")), sent_no=running_sum(F.col("new_sent"))
    )
    return numbered.withColumn("seg_idx", F.col("seg_idx") - 1).withColumn("sent_no", F.col("sent_no") - 1)


def _let(value: Column, use) -> Column:
    """use(value); the lambda gives value a name, so that it is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_turns(blocks: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns that overlap each block (`_near`), joined by 30 s bins as in overlap_pairs."""
    b = blocks.select("job_id", "block", F.col("start_ms").alias("b_start"), F.greatest("end_ms", F.col("start_ms") + 1).alias("b_end"))
    b = b.withColumn("bin", _bins(F.col("b_start"), F.col("b_end")))
    t = turns.select(
        "job_id", "turn_idx", "speaker_id", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end")
    ).filter("t_end > t_start")
    t = t.withColumn("bin", _bins(F.col("t_start"), F.col("t_end")))
    both = b.join(t, ["job_id", "bin"]).filter((F.col("b_start") < F.col("t_end")) & (F.col("t_start") < F.col("b_end")))
    return both.filter(F.col("bin") == F.floor(F.greatest("b_start", "t_start") / BIN_MS)).groupBy("job_id", "block").agg(
        F.collect_list(F.struct("t_start", "t_end", "turn_idx", "speaker_id")).alias("_near")
    )


def even_places(near: Column, start: Column, step: int, n: Column) -> Column:
    """Places of evenly spaced words at which the speaker can change, ascending.

    Word p starts at start + p * step; all are equally long, at most step. Words that no turn begins or ends in or between are covered by the same turns
    for the same time, so the words around the begins and ends of the turns stand for all.
    """
    edges = F.flatten(F.transform(near, lambda t: F.array(t["t_start"], t["t_end"])))
    at = F.flatten(F.transform(edges, lambda e: F.array(F.floor((e - start) / step), F.floor((e - start) / step) + 1)))
    inside = F.filter(F.array_distinct(at), lambda p: (p > 0) & (p < n))
    return F.concat(F.array(F.lit(0)), F.coalesce(F.array_sort(inside).cast("array<int>"), F.array().cast("array<int>")))


def _block_speakers(near: Column, time, places: Column) -> Column:
    """(at, who) where the speaker of the longest overlapping turn changes inside a block; words without a turn change nothing."""

    def who(word):
        end = F.greatest(word["end_ms"], word["start_ms"] + 1)
        best = F.array_max(F.transform(near, lambda t: F.struct(
            (F.least(end, t["t_end"]) - F.greatest(word["start_ms"], t["t_start"])).alias("overlap"), -t["t_start"], -t["turn_idx"], t["speaker_id"].alias("who"),
        )))
        return _let(best, lambda x: F.when(x["overlap"] > 0, x["who"]))

    heard = F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), _let(time(i), who).alias("who"))), lambda x: x["who"].isNotNull())
    return _let(heard, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["who"] != x["who"])))


def numbered_blocks(blocks: DataFrame, turns: DataFrame, times: Column | Callable[[Column], Column], places: Callable[[Column], Column] | None = None) -> DataFrame:
    """number_runs(assign_speakers(words, turns)) over blocks of consecutive words, so that no word is a row.

    blocks: (job_id, block, n, start_ms, end_ms, ends, ...), none empty; `block` is the index of the first word, start_ms and end_ms span the words, `ends`
    lists the places (from 0) of words that end a sentence, and `times` gives the (start_ms, end_ms) of each word from the columns of blocks, as an array or
    by the place. `places` gives the places at which the speaker can change from the turns (t_start, t_end) near a block, such as `even_places`; without it
    every word is looked at.
    Adds to the blocks `_runs` (at, who) and `_starts`, the places where runs and sentences begin, whether the first run and sentence go on from the block
    before (`_same`, `_goes_on`), `_prev_end`, the end of the word before in that run, and how many runs and sentences there are up to here (`_segs`,
    `_sents`). The texts need not come along. A block meets the turns that overlap it in one cell.
    """
    axis = dense_axis("job_id", "block")
    runs, before, n = F.col("_runs"), F.col("_before"), F.col("n")
    time = times if callable(times) else lambda i: F.get(times, i)
    looked_at = places(F.col("_near")) if places else F.sequence(F.lit(0), (n - 1).cast("int"))
    heard = written(
        blocks.join(_block_turns(blocks, turns), ["job_id", "block"], "left").select(
            *blocks.columns, _block_speakers(F.col("_near"), time, looked_at).alias("_runs"), time((n - 1).cast("int"))["end_ms"].alias("_end"),
        ),
        "block_speakers",
    )
    last = F.get(runs, F.size(runs) - 1)["who"]
    seen = scan(
        heard, axis, _fill=known_before(last),
        _before=previous(F.struct(F.col("_end").alias("end_ms"), F.array_contains("ends", (n - 1).cast("int")).alias("ends"))),
    ).withColumn("_fill", F.coalesce("_fill", F.lit(UNKNOWN)))
    # Words before the first turn of a block go on with the last known speaker.
    opening = F.struct(F.lit(0).alias("at"), F.col("_fill").alias("who"))
    later = F.filter(runs, lambda x, i: (i > 0) | (x["who"] != F.col("_fill")))
    whole = F.when(F.get(runs, F.lit(0))["at"] == 0, runs).otherwise(F.concat(F.array(opening), later))
    filled = seen.withColumn("_runs", whole)
    same = before.isNotNull() & (F.get(runs, F.lit(0))["who"] == F.col("_fill"))
    after_mark = F.filter(F.transform("ends", lambda p: p + 1), lambda p: p < n)
    flagged = filled.select(
        *blocks.columns, "_runs", same.alias("_same"), (same & ~before["ends"]).alias("_goes_on"), F.when(same, before["end_ms"]).alias("_prev_end"),
        F.array_sort(F.array_distinct(F.concat(F.transform(runs, lambda r: r["at"]), after_mark))).alias("_starts"),
    )
    new_segs, new_sents = F.size("_runs") - F.col("_same").cast("int"), F.size("_starts") - F.col("_goes_on").cast("int")
    return scan(written(flagged, "block_flags"), axis, _segs=running_sum(new_segs), _sents=running_sum(new_sents))


def _block_facts() -> tuple[Column, Column, Column]:
    """Of numbered_blocks: numbers of the first run and sentence, and whether a mark ends the block; without one its last sentence may go on in the next."""
    return F.col("_segs") - F.size("_runs"), F.col("_sents") - F.size("_starts"), F.array_contains("ends", (F.col("n") - 1).cast("int"))


def block_runs(blocks: DataFrame, turns: DataFrame, times: Column | Callable[[Column], Column], places: Callable[[Column], Column] | None = None) -> DataFrame:
    """numbered_blocks as (job_id, block, pieces).

    A piece is a stretch of words of one sentence: at (place of the first), n_words, seg_idx, sent_no, speaker_id, and prev_end_ms of its first word.
    """
    runs, starts, n = F.col("_runs"), F.col("_starts"), F.col("n")
    time = times if callable(times) else lambda i: F.get(times, i)
    first_seg, first_sent, marked = _block_facts()

    def piece(at, k, run):
        own = F.get(runs, run)
        prev_end = F.when(k == 0, F.col("_prev_end")).when(own["at"] != at, time(at - 1)["end_ms"])
        return F.struct(
            at.alias("at"), (F.coalesce(F.get(starts, k + 1), n) - at).cast("long").alias("n_words"), (first_seg + run).alias("seg_idx"),
            (first_sent + k).alias("sent_no"), own["who"].alias("speaker_id"), prev_end.alias("prev_end_ms"),
            (((k > 0) | ~F.col("_goes_on")) & ((k + 1 < F.size(starts)) | marked)).alias("whole"),
        )

    pieces = F.transform(starts, lambda at, k: _let(F.size(F.filter(runs, lambda r: r["at"] <= at)) - 1, lambda run: piece(at, k, run)))
    return numbered_blocks(blocks, turns, times, places).select("job_id", "block", pieces.alias("pieces"))


def run_stretches(numbered: DataFrame, *kept: str) -> DataFrame:
    """The words of each run of numbered_blocks, beside the `text` of the block whose words single spaces part: a row per block and run.

    Columns kept, then pos (place of the first word), n_words, seg_idx, speaker_id, prev_end_ms of the first word, first_sent (number of its sentence),
    starts (places in the stretch where sentences begin), opens and closes (whether they begin and end in the stretch), and text.
    """
    runs, starts, n = F.col("_runs"), F.col("_starts"), F.col("n").cast("int")
    first_seg, first_sent, marked = _block_facts()

    def stretch(tokens, own, i):
        at, until = own["at"], F.coalesce(F.get(runs, i + 1)["at"], n)
        return F.struct(
            i.alias("i"), at.alias("at"), until.alias("until"), own["who"].alias("who"), F.size(F.filter(starts, lambda s: s < at)).alias("before"),
            F.transform(F.filter(starts, lambda s: (s >= at) & (s < until)), lambda s: s - at).alias("starts"),
            F.array_join(F.slice(tokens, at + 1, until - at), " ").alias("text"),
        )

    each = _let(F.split("text", " "), lambda tokens: F.transform(runs, lambda own, i: stretch(tokens, own, i)))
    first, last = F.col("s.i") == 0, F.col("s.i") + 1 == F.size(runs)
    # Only what does not grow with the text is repeated beside each run.
    spread = numbered.select(*kept, "_runs", first_seg.alias("_seg"), first_sent.alias("_sent"), marked.alias("_marked"), "_goes_on", "_prev_end", F.explode(each).alias("s"))
    return spread.select(
        *kept, F.col("s.at").cast("long").alias("pos"), (F.col("s.until") - F.col("s.at")).cast("long").alias("n_words"), (F.col("_seg") + F.col("s.i")).alias("seg_idx"),
        F.col("s.who").alias("speaker_id"), F.when(first, F.col("_prev_end")).alias("prev_end_ms"), (F.col("_sent") + F.col("s.before")).alias("first_sent"),
        F.col("s.starts").alias("starts"), (~first | ~F.col("_goes_on")).alias("opens"), (~last | F.col("_marked")).alias("closes"), F.col("s.text").alias("text"),
    )


def stretch_pieces(stretches: DataFrame) -> DataFrame:
    """Stretches cut into pieces of one sentence each: place in the stretch (`at`), n_words, sent_no, `whole` sentence or not, and text."""
    starts = F.col("starts")

    def piece(tokens, at, k):
        size = F.coalesce(F.get(starts, k + 1), F.col("n_words").cast("int")) - at
        return F.struct(k.alias("k"), at.alias("at"), size.alias("n"), F.array_join(F.slice(tokens, at + 1, size), " ").alias("text"))

    each = _let(F.split("text", " "), lambda tokens: F.transform(starts, lambda at, k: piece(tokens, at, k)))
    others = [c for c in stretches.columns if c not in ("n_words", "text", "starts", "first_sent", "opens", "closes")]
    spread = stretches.select(*others, F.size(starts).alias("_n"), "first_sent", "opens", "closes", F.explode(each).alias("p"))
    return spread.select(
        *others, F.col("p.at").alias("at"), F.col("p.n").cast("long").alias("n_words"), (F.col("first_sent") + F.col("p.k")).alias("sent_no"),
        (((F.col("p.k") > 0) | F.col("opens")) & ((F.col("p.k") + 1 < F.col("_n")) | F.col("closes"))).alias("whole"), F.col("p.text").alias("text"),
    )


def _n_words(rows: DataFrame) -> Column:
    return F.sum("n_words") if "n_words" in rows.columns else F.count("*")


def segments(words: DataFrame) -> DataFrame:
    """One row per speaker run, with its text, from words or from pieces (several words with their number `n_words`)."""
    rows = _gathered(words, ["job_id", "seg_idx"], F.col("start_ms"))
    return rows.select("job_id", "seg_idx", "speaker_id", "start_ms", "end_ms", "n_words", "first_word", "text").withColumn(
        "seg_id", F.sha2(F.concat_ws(":", F.col("job_id").cast("string"), F.col("seg_idx").cast("string")), 256)
    )


def sentences(words: DataFrame) -> DataFrame:
    """One row per sentence; it starts where its run starts or the previous sentence ended.

    Pieces marked as `whole` sentences are rows already; only the others are gathered.
    """
    columns, start = ["job_id", "sent_no", "seg_idx", "speaker_id", "start_ms", "end_ms", "n_words", "text"], F.coalesce("prev_end_ms", "start_ms")
    rows = words.filter(~F.col("whole")) if "whole" in words.columns else words
    rows = _gathered(rows, ["job_id", "sent_no", "seg_idx"], start).select(*columns)
    return rows.union(words.filter("whole").withColumn("start_ms", start).select(*columns)) if "whole" in words.columns else rows


def _gathered(words: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Times, number of words and text of each group, gathered together, as concat_in_order does for a text alone.

    Single words are gathered in bounded pieces first; rows of several words are such pieces already, so their texts move once.
    """
    def of(rows: DataFrame, place: str, start: Column, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.min("speaker_id").alias("speaker_id"), F.min_by(start, place).alias("start_ms"), F.max_by("end_ms", place).alias("end_ms"),
            _n_words(rows).alias("n_words"), F.min("first_word").alias("first_word"), joined_text("text", [place]).alias("text"),
        )

    rows = words.withColumn("first_word", F.col("word_idx"))
    if "n_words" in words.columns:
        return of(rows, "word_idx", start, keys)
    parts = of(rows.withColumn("_block", F.floor(F.col("word_idx") / 1024)), "word_idx", start, [*keys, "_block"])
    return of(parts, "_block", F.col("start_ms"), keys)


def speaker_names(segs: DataFrame) -> DataFrame:
    """"Speaker n" by first appearance; the unknown bucket takes no number."""
    from pyspark.sql import Window

    first = segs.groupBy("job_id", "speaker_id").agg(F.min("seg_idx").alias("first_seg"))
    known = F.when(F.col("speaker_id") != UNKNOWN, 1).otherwise(0)
    place = Window.partitionBy("job_id").orderBy("first_seg")
    number = F.sum(known).over(place.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn(
        "display",
        F.when(F.col("speaker_id") == UNKNOWN, "Unknown").otherwise(F.concat(F.lit("Speaker "), number.cast("string"))),
    )


def with_display_names(df: DataFrame, names: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Add `display`: the mapped name, else the raw id."""
    lookup = names.select("job_id", F.col("speaker_id").alias(speaker), F.col("display").alias("_name"))
    return (
        df.join(lookup, ["job_id", speaker], "left")
        .withColumn("display", F.coalesce("_name", speaker))
        .drop("_name")
    )


def rename_speakers(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Overlay mapping(job_id, speaker_id, new_name) on the names; the mapping wins."""
    return names.select("job_id", "speaker_id", "display").join(
        mapping, ["job_id", "speaker_id"], "full"
    ).select("job_id", "speaker_id", F.coalesce("new_name", "display").alias("display"))


def merge_consecutive(segs: DataFrame) -> DataFrame:
    """Merge neighbouring segments of one speaker (job_id, seg_idx, speaker_id, times, text, n_words)."""
    axis = dense_axis("job_id", "seg_idx")
    seen = scan(segs, axis, _prev=previous(F.col("speaker_id")))
    seen = seen.withColumn("_new", F.when(F.col("_prev").eqNullSafe(F.col("speaker_id")), 0).otherwise(1))
    runs = scan(written(seen, "run_flags"), axis, run_idx=running_sum(F.col("_new")))
    runs = runs.withColumn("run_idx", F.col("run_idx") - 1)
    facts = runs.groupBy("job_id", "run_idx").agg(
        F.min("speaker_id").alias("speaker_id"),
        F.min_by("start_ms", "seg_idx").alias("start_ms"),
        F.max_by("end_ms", "seg_idx").alias("end_ms"),
        F.sum("n_words").alias("n_words"),
    )
    return facts.join(concat_in_order(runs, ["job_id", "run_idx"], "seg_idx", "text"), ["job_id", "run_idx"])
