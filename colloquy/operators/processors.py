"""Text processors on transcripts, and the registry that chains them."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.functions.text import bare_word, capitalised, glued
from colloquy.operators import vocabulary
from colloquy.operators.fuzzy import near_words
from colloquy.operators.ordered import (
    concat_in_order, dense_axis, following, previous, running_sum, scan, with_halo,
)
from colloquy.session import written
from colloquy.sources.profiles import Profile, vocabulary_table

log = logging.getLogger(__name__)

# Fixed value: the words around a word.
NEAR_WORDS = 8
_W = ("job_id", "seg_idx", "word_idx", "text", "start_ms", "end_ms", "confidence", "speaker_id")


@dataclass(frozen=True)
class Transcripts:
    """Words in long form, the text of each segment, and the corrections made so far.

    The two texts may differ: some processors edit only the segment text.
    """

    words: DataFrame
    texts: DataFrame
    corrections: DataFrame | None = None


def transcripts(words: DataFrame, segs: DataFrame) -> Transcripts:
    return Transcripts(words.select(*_W), segs.select("job_id", "seg_idx", "text"))


# -- cleanup ---------------------------------------------------------------------------


def without_repeats(words: DataFrame) -> DataFrame:
    """Drop a word that repeats the word before it in its segment.

    Words of emphasis and words under four letters stay. A run of equal words keeps its first, so
    comparing with the direct neighbour equals comparing with the last word kept.
    """
    seen = scan(words, dense_axis("job_id", "word_idx"), _prev=previous(F.struct("seg_idx", F.lower("text").alias("low"))))
    low = F.lower("text")
    repeated = (F.col("_prev.seg_idx") == F.col("seg_idx")) & (F.col("_prev.low") == low)
    droppable = ~low.isin(*lx.EMPHASIS) & (F.length("text") >= 4)
    return seen.filter(~F.coalesce(repeated & droppable, F.lit(False))).select(*words.columns)


def n_without_repeats(text: Column) -> Column:
    """How many words of a segment's text, parted by single spaces, without_repeats keeps."""

    def droppable(words: Column, i: Column) -> Column:
        low = F.lower(F.get(words, i))
        return F.coalesce((low == F.lower(F.get(words, i - 1))) & ~low.isin(*lx.EMPHASIS) & (F.length(F.get(words, i)) >= 4), F.lit(False))

    kept = F.transform(F.array(F.split(text, " ")), lambda words: F.size(F.filter(words, lambda _, i: ~droppable(words, i))))
    return F.get(kept, F.lit(0))


_WORD = r"[\p{L}\p{N}_]"


def _let(value: Column, use) -> Column:
    """use(value); the lambda gives value a name, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bound(value: Column, use) -> Column:
    """use(value) for an array result; the lambda gives value a name, so that it is computed once."""
    return F.flatten(F.transform(F.array(value), use))


def _repeats(pieces: Column, i: Column) -> Column:
    """Piece i is the word that stands two pieces before, in any case."""
    word, before = F.get(pieces, i), F.get(pieces, i - 2)
    return F.coalesce((F.lower(word) == F.lower(before)) & word.rlike(f"^{_WORD}"), F.lit(False))


def _without(pieces: Column, marks: Column, goes) -> Column:
    """Pieces without the words for which goes(i) holds and what stands in front of them; marks has a character for each piece."""
    return _bound(marks, lambda m: F.filter(pieces, lambda _, i: ~(goes(m, i) | goes(m, i + 1))))


def _mark(marks: Column, i: Column) -> Column:
    return marks.substr(i + 1, F.lit(1))


def _without_stutters(pieces: Column) -> Column:
    """A word behind the same word, a hyphen and white space goes; of a chain every second one."""
    gap = lambda i: F.get(pieces, i - 1)
    stutter = lambda i: _repeats(pieces, i) & gap(i).rlike(r"^-\s+$")
    marks = F.array_join(F.transform(pieces, lambda _, i: F.when(stutter(i), "s").otherwise(".")), "")
    return _without(pieces, F.regexp_replace(marks, r"s\.s", "s.."), lambda m, i: _mark(m, i) == "s")


def _without_echoes(pieces: Column) -> Column:
    """A word behind the same word and white space goes, unless it is a word of emphasis said just twice."""
    echo = lambda i: _repeats(pieces, i) & F.get(pieces, i - 1).rlike(r"^\s+$")
    emphatic = lambda p: F.lower(p).isin(*lx.EMPHASIS)
    marks = F.array_join(F.transform(pieces, lambda p, i: F.when(~echo(i), ".").when(emphatic(p), "E").otherwise("e")), "")
    return _without(pieces, marks, lambda m, i: (_mark(m, i) == "e") | ((_mark(m, i) == "E") & ((_mark(m, i - 2) == "E") | (_mark(m, i + 2) == "E"))))


def tidy_text(text: Column) -> Column:
    """Collapse stutters and repeated words, close up punctuation, single the spaces.

    The text is taken apart into words and what stands between them, in turn.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"{_WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    text = F.array_join(_bound(_bound(pieces, _without_stutters), _without_echoes), "")
    text = F.ltrim(F.regexp_replace(text, r"\s+(?=[,.!?;:])", ""), F.lit(",."))
    return F.array_join(F.filter(F.split(text, " "), lambda part: part != ""), " ")


def segment_texts(words: DataFrame) -> DataFrame:
    return concat_in_order(words, ["job_id", "seg_idx"], "word_idx", "text")


def clean_up(t: Transcripts, profile: Profile) -> Transcripts:
    kept = without_repeats(t.words)
    return replace(t, words=kept, texts=segment_texts(kept).withColumn("text", tidy_text(F.col("text"))))


# -- vocabulary ------------------------------------------------------------------------


def _alias_steps(profile: Profile):
    """(entry, alias, pattern) in the order of application: entry order, longest alias first."""
    for entry in profile.vocabulary:
        for alias in sorted(entry.aliases, key=len, reverse=True):
            flags = "(?U)" if entry.case_sensitive else "(?iU)"
            yield entry, alias, rf"{flags}\b{re.escape(alias)}\b"


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def apply_vocabulary(texts: DataFrame, profile: Profile, keys: tuple[str, ...] = ("job_id", "seg_idx")) -> DataFrame:
    """Corrected text and the log of corrections (`fixes`) of each text."""
    return vocabulary.correct_texts(texts, vocabulary.steps(vocabulary_table(texts.sparkSession, profile)), keys)


#: Letters that a pattern without case takes for s and i, and that lower() does not turn into these.
_LIKE_PLAIN = ("\u017f", "\u0131", "\u0130")


def plain_low(text: Column) -> Column:
    """The text in lower case, null where that can't tell whether a pattern without case matches."""
    odd = text.contains(_LIKE_PLAIN[0])
    for letter in _LIKE_PLAIN[1:]:
        odd = odd | text.contains(letter)
    return F.when(~odd, F.lower(text))


def may_hold(text: Column, low: Column, alias: str, case_sensitive: bool) -> Column:
    """False only where the pattern of an alias can't match; plain letters are found far sooner than a pattern. `low` is plain_low(text)."""
    if case_sensitive:
        return F.contains(text, F.lit(alias))
    return F.coalesce(F.contains(low, F.lit(alias.lower())), F.lit(True)) if alias.isascii() else F.lit(True)


def correct_always(text: Column, profile: Profile) -> Column:
    """Apply every alias, whatever its confidence or context; its pattern is searched in texts that may hold it only."""

    def stated(t: Column) -> Column:
        return F.struct(t.alias("text"), plain_low(t).alias("low"))

    def step(entry, alias: str, pattern: str):
        def of(s: Column) -> Column:
            changed = _let(F.regexp_replace(s["text"], pattern, _literal(entry.canonical)), stated)
            return F.when(may_hold(s["text"], s["low"], alias, entry.case_sensitive), changed).otherwise(s)

        return of

    state = _let(text, stated)
    for each in _alias_steps(profile):
        state = _let(state, step(*each))
    return state["text"]


def realign(words: DataFrame, new_texts: DataFrame) -> DataFrame:
    """Words of each segment after its text changed.

    With the same number of tokens the texts are put in place; otherwise the times are spread
    evenly, the speaker is that of the first word, and confidence comes from the word at the
    nearest place. word_idx is numbered anew.
    """
    dense = scan(words, dense_axis("job_id", "word_idx"), _rank=running_sum(F.lit(1)))
    facts = dense.groupBy("job_id", "seg_idx").agg(
        F.min("_rank").alias("_first"), F.count("*").alias("n_old"),
        F.min_by("start_ms", "word_idx").alias("s"), F.max_by("end_ms", "word_idx").alias("e"),
        F.min_by("speaker_id", "word_idx").alias("speaker_id"),
    )
    tokens = new_texts.select("job_id", "seg_idx", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("tokens"))
    per_seg = written(facts.join(tokens, ["job_id", "seg_idx"]).withColumn("n_new", F.size("tokens").cast("long")), "realign_segments")
    offsets = scan(
        per_seg.select("job_id", "seg_idx", "n_new"), dense_axis("job_id", "seg_idx"), _upto=running_sum(F.col("n_new"))
    ).select("job_id", "seg_idx", (F.col("_upto") - F.col("n_new")).alias("_offset"))
    new = per_seg.join(offsets, ["job_id", "seg_idx"]).select(
        "job_id", "seg_idx", "_first", "n_old", "n_new", "s", "e", "speaker_id", "_offset", F.posexplode("tokens").alias("i", "text")
    )
    same = F.col("n_new") == F.col("n_old")
    nearest = F.bround(F.col("i") / F.greatest(F.col("n_new") - 1, F.lit(1)) * F.greatest(F.col("n_old") - 1, F.lit(0))).cast("long")
    new = new.withColumn("_rank", F.col("_first") + F.when(same, F.col("i")).otherwise(nearest))
    old = dense.select(
        "job_id", "_rank", "confidence", F.col("start_ms").alias("o_s"), F.col("end_ms").alias("o_e"),
        F.col("speaker_id").alias("o_speaker"),
    )
    step = (F.col("e") - F.col("s")) / F.col("n_new")

    def at(i):
        return F.bround(F.col("s") + i * step).cast("long")

    return new.join(old, ["job_id", "_rank"]).select(
        "job_id", "seg_idx", (F.col("_offset") + F.col("i")).alias("word_idx"), "text",
        F.when(same, F.col("o_s")).otherwise(at(F.col("i"))).alias("start_ms"),
        F.when(same, F.col("o_e")).otherwise(at(F.col("i") + 1)).alias("end_ms"),
        "confidence", F.when(same, F.col("o_speaker")).otherwise(F.col("speaker_id")).alias("speaker_id"),
    )


def _made(fixed: DataFrame, profile: Profile) -> DataFrame:
    return fixed.select("job_id", "seg_idx", F.explode("fixes").alias("f")).select(
        "job_id", "seg_idx", "f.*", F.lit(profile.name).alias("profile")
    )


def vocabulary_log(texts: DataFrame, profile: Profile) -> DataFrame:
    """The corrections that correct_vocabulary makes; without the words, which need not be aligned for it."""
    return _made(apply_vocabulary(texts, profile), profile)


def corrected_counts(segs: DataFrame, profile: Profile) -> DataFrame:
    """How many words (n_words) each segment has after correct_vocabulary: those of its new text, or its own if nothing was corrected."""
    fixed = apply_vocabulary(segs.select("job_id", "seg_idx", "n_words", "text"), profile)
    n = F.when(F.size("fixes") > 0, F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).cast("long")).otherwise(F.col("n_words"))
    return fixed.select("job_id", "seg_idx", n.alias("n_words"))


def correct_vocabulary(t: Transcripts, profile: Profile) -> Transcripts:
    fixed = written(apply_vocabulary(t.texts, profile), "vocabulary_texts")
    made = _made(fixed, profile)
    touched = fixed.filter(F.size("fixes") > 0).select("job_id", "seg_idx", F.col("text").alias("_text"))
    # Untouched segments keep their words, whatever their text.
    own = segment_texts(t.words).join(touched, ["job_id", "seg_idx"], "left").select(
        "job_id", "seg_idx", F.coalesce("_text", "text").alias("text")
    )
    return Transcripts(
        realign(t.words, own), fixed.select("job_id", "seg_idx", "text"),
        made if t.corrections is None else t.corrections.union(made),
    )


def fuzzy_corrections(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Replacement of each distinct token near a fuzzy alias: (token, replacement, alias, score)."""
    fuzzy = [(e.canonical, a) for e in profile.vocabulary if e.fuzzy for a in e.aliases]
    rows = [(rank, canonical, alias) for rank, (canonical, alias) in enumerate(fuzzy)]
    return near_words(tokens, tokens.sparkSession.createDataFrame(rows, "rank int, replacement string, alias string"))


# -- rules on single words and their neighbours ---------------------------------------


def neighbourhood(words: DataFrame, k: int = NEAR_WORDS, before: str = "text") -> DataFrame:
    """Add `near`: the words from k before to k after, across segments, joined by spaces.

    The words before are read from column `before`. Windows run inside blocks; words close to a
    border are copied into the neighbouring block.
    """
    spread = with_halo(words, "word_idx", k, k)
    place = Window.partitionBy("job_id", "_block").orderBy("word_idx")
    left = F.collect_list(before).over(place.rowsBetween(-k, -1))
    right = F.collect_list("text").over(place.rowsBetween(0, k))
    return spread.withColumn("near", F.concat_ws(" ", left, right)).filter("_own = _block").drop("_own", "_block")


def context_rules(words: DataFrame, rules=lx.CONTEXT_RULES) -> DataFrame:
    """Replace words whose neighbourhood shows what was meant, walking from left to right.

    A word sees the corrected words before it and the original words after it. The parallel step
    is repeated until nothing changes, which gives exactly that walk: a word depends only on words
    to its left, so each round settles at least the next one. Two rounds are the usual case.
    """
    now = words.withColumn("_now", F.col("text"))
    while True:
        fixed = F.col("text")
        for canonical, target, signal in reversed(rules):
            hit = F.col("text").rlike(target) & F.col("near").rlike(signal) & (F.col("text") != canonical)
            fixed = F.when(hit, canonical).otherwise(fixed)
        step = written(neighbourhood(now, before="_now").withColumn("_next", fixed).drop("near"), "context_words")
        if step.filter("_next <> _now").isEmpty():
            return step.withColumn("text", F.col("_now")).select(*words.columns)
        now = step.withColumn("_now", F.col("_next")).drop("_next")


def correct_context(t: Transcripts, profile: Profile) -> Transcripts:
    fixed = context_rules(t.words)
    return replace(t, words=fixed, texts=segment_texts(fixed))


# -- readability -----------------------------------------------------------------------


def pronoun_fixed(text: Column) -> Column:
    """A lone i becomes I."""
    return F.regexp_replace(text, r"^[iI](?=[.,;:!?]?$)", "I")


def readable_words(words: DataFrame) -> DataFrame:
    """Capital at the start of segments and sentences, closing mark at the end of segments."""
    fixed = words.withColumn("text", pronoun_fixed(F.col("text")))
    axis = dense_axis("job_id", "word_idx")
    seen = scan(
        fixed, axis, _prev=previous(F.struct("seg_idx", "text")), _next=following(F.col("seg_idx"))
    )
    opens = F.col("_prev").isNull() | (F.col("_prev.seg_idx") != F.col("seg_idx"))
    closes = F.col("_next").isNull() | (F.col("_next") != F.col("seg_idx"))
    first = words.groupBy("job_id", "seg_idx").agg(F.min_by("text", "word_idx").alias("_opening"))
    asks = F.lower(bare_word(F.col("_opening"))).isin(*lx.ASKING_WORDS)
    text = F.when(opens | F.col("_prev.text").rlike("[.!?]$"), capitalised(F.col("text"))).otherwise(F.col("text"))
    last = F.lower(bare_word(F.col("text")))
    needs_mark = closes & ~F.col("text").rlike("[.!?]$") & ~last.isin(*lx.FILLERS) & (F.length(last) > 1)
    marked = F.when(needs_mark, F.concat(text, F.when(asks, "?").otherwise("."))).otherwise(text)
    return seen.join(first, ["job_id", "seg_idx"]).withColumn("text", marked).select(*words.columns)


def make_readable(t: Transcripts, profile: Profile) -> Transcripts:
    fixed = readable_words(t.words)
    return replace(t, words=fixed, texts=segment_texts(fixed).withColumn("text", glued(F.col("text"))))


# -- segments of one speaker -----------------------------------------------------------


def format_speakers(t: Transcripts, profile: Profile) -> Transcripts:
    """Merge neighbouring segments of one speaker, words and texts."""
    axis = dense_axis("job_id", "seg_idx")
    owners = t.words.groupBy("job_id", "seg_idx").agg(F.min("speaker_id").alias("speaker_id"))
    flagged = scan(owners, axis, _prev=previous(F.col("speaker_id"))).withColumn(
        "_new", F.when(F.col("_prev").eqNullSafe(F.col("speaker_id")), 0).otherwise(1)
    )
    runs = written(
        scan(written(flagged, "format_flags"), axis, run=running_sum(F.col("_new"))).select(
            "job_id", "seg_idx", (F.col("run") - 1).alias("run")
        ),
        "format_runs",
    )
    texts = concat_in_order(t.texts.join(runs, ["job_id", "seg_idx"]), ["job_id", "run"], "seg_idx", "text")
    words = t.words.join(runs, ["job_id", "seg_idx"]).withColumn("seg_idx", F.col("run")).drop("run")
    corrections = t.corrections
    if corrections is not None:
        corrections = corrections.join(runs, ["job_id", "seg_idx"]).withColumn("seg_idx", F.col("run")).drop("run")
    return Transcripts(words.select(*_W), texts.withColumnRenamed("run", "seg_idx"), corrections)


# -- registry --------------------------------------------------------------------------

Processor = Callable[[Transcripts, Profile], Transcripts]
PROCESSORS: dict[str, Processor] = {
    "transcript_cleanup": clean_up,
    "vocabulary": correct_vocabulary,
    "context_correction": correct_context,
    "transcript_intelligence": make_readable,
    "speaker_formatting": format_speakers,
}


def register_processor(name: str, processor: Processor) -> None:
    """Add a processor under a new name; plug-ins call this on import."""
    if name in PROCESSORS:
        raise ValueError(f"processor {name!r} is registered already")
    PROCESSORS[name] = processor


def run_processors(t: Transcripts, profile: Profile, on_step=None) -> Transcripts:
    """Apply the processors of the profile in order; unknown names are skipped with a warning."""
    for name in profile.processors:
        step = PROCESSORS.get(name)
        if step is None:
            log.warning("unknown processor %s skipped", name)
            continue
        t = step(t, profile)
        t = replace(t, words=written(t.words, f"after_{name}"), texts=written(t.texts, f"after_{name}_texts"))
        if on_step:
            on_step(name, t)
    return t
