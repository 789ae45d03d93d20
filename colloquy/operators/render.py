"""Documents of meetings, written line by line.

A renderer returns lines (job_id, line_no, line): line_no orders them, and a long meeting is never
gathered into one cell. documents() joins lines into parts of bounded length; a document is the
concatenation of its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import bare_word, glued, percent, pipes_escaped, title_of_path
from colloquy.functions.timefmt import clock, duration_text, srt_time, vtt_time
from colloquy.operators import review as rv
from colloquy.operators.attribution import with_display_names
from colloquy.operators.metrics import LOW
from colloquy.operators.ordered import BLOCK_ROWS, Axis, concat_in_order, dense_axis, previous, running_sum, scan
from colloquy.session import written

PART_LINES = 10_000
_WIDE = 1 << 20


def lines(df: DataFrame, place: Column, line: Column) -> DataFrame:
    return df.select("job_id", place.cast("long").alias("line_no"), line.alias("line"))


def blocks(df: DataFrame, place: Column, *parts: Column) -> DataFrame:
    """Several lines per row, numbered from place."""
    return df.select("job_id", place.alias("_p"), F.posexplode(F.array(*parts)).alias("_i", "line")).select(
        "job_id", (F.col("_p") * len(parts) + F.col("_i")).cast("long").alias("line_no"), "line"
    )


def dense(rendered: DataFrame) -> DataFrame:
    """Number lines 0, 1, 2, ... in each meeting; reports number theirs with gaps."""
    axis = Axis(("job_id",), ("line_no", "line"), F.floor(F.col("line_no") / BLOCK_ROWS))
    counted = scan(written(rendered, "report_lines"), axis, nth=running_sum(F.lit(1)))
    return counted.select("job_id", (F.col("nth") - 1).cast("long").alias("line_no"), "line")


def documents(rendered: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """(job_id, part, content); a part holds at most part_lines lines of a densely numbered document."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rendered.groupBy("job_id", F.floor(F.col("line_no") / part_lines).alias("part")).agg(
        F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("content")
    )


def _named(segs: DataFrame, names: DataFrame) -> DataFrame:
    return with_display_names(segs, names)


def txt(segs: DataFrame, names: DataFrame) -> DataFrame:
    return blocks(_named(segs, names), F.col("seg_idx"), F.concat("display", F.lit(": "), "text"), F.lit(""))


def srt(segs: DataFrame, names: DataFrame) -> DataFrame:
    return blocks(
        _named(segs, names), F.col("seg_idx"), (F.col("seg_idx") + 1).cast("string"),
        F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms"))),
        F.concat(F.lit("["), "display", F.lit("] "), "text"), F.lit(""),
    )


def vtt(segs: DataFrame, names: DataFrame) -> DataFrame:
    cues = blocks(
        _named(segs, names), F.col("seg_idx") + 1, F.concat(F.lit("cue-"), (F.col("seg_idx") + 1).cast("string")),
        F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms"))),
        F.concat(F.lit("<v "), "display", F.lit(">"), "text"), F.lit(""),
    )
    head = blocks(segs.select("job_id").distinct(), F.lit(0), F.lit("WEBVTT"), F.lit(""))
    return head.union(cues)


def markdown(words: DataFrame, segs: DataFrame, names: DataFrame, files: DataFrame, stamps: str = "none", mark_low: bool = False) -> DataFrame:
    """Title, a heading per segment, a paragraph per pause; stamps none, speaker, paragraph or minute.

    Line numbers are made of the paragraph and the kind of line. `files` has (job_id, audio_path).
    """
    text = F.col("text")
    if mark_low:
        bare = bare_word(text)
        shown = F.concat(F.lit("**["), bare, F.lit("?]**"), F.substring(text, F.length(bare) + 1, F.length(text)))
        text = F.when(F.col("confidence") < LOW, shown).otherwise(text)
    numbered = rv.number_paragraphs(words.select("job_id", "seg_idx", "word_idx", text.alias("text"), "start_ms", "end_ms"))
    paras = numbered.groupBy("job_id", "seg_idx", "para_no").agg(F.min_by("start_ms", "word_idx").alias("start_ms"))
    body = concat_in_order(numbered, ["job_id", "para_no"], "word_idx", "text").join(paras, ["job_id", "para_no"])
    stamp = F.concat(clock(F.col("start_ms")), F.lit(" ")) if stamps == "paragraph" else F.lit("")
    para_lines = lines(body, F.col("para_no") * _WIDE + _WIDE - 2, F.concat(stamp, glued(F.col("text"))))
    first = paras.groupBy("job_id", "seg_idx").agg(F.min("para_no").alias("para_no"))
    head = F.concat(F.lit("## "), "display")
    if stamps == "speaker":
        head = F.concat(head, F.lit("  "), clock(F.col("start_ms")))
    headings = _named(first.join(segs.select("job_id", "seg_idx", "speaker_id", "start_ms"), ["job_id", "seg_idx"]), names)
    title = F.concat(F.lit("# "), title_of_path(F.col("audio_path")))
    out = (
        lines(files.join(first.select("job_id").distinct(), "job_id"), F.lit(-2), title)
        .union(lines(files.join(first.select("job_id").distinct(), "job_id"), F.lit(-1), F.lit("")))
        .union(lines(headings, F.col("para_no") * _WIDE, head)).union(lines(headings, F.col("para_no") * _WIDE + 1, F.lit("")))
        .union(para_lines).union(lines(body, F.col("para_no") * _WIDE + _WIDE - 1, F.lit("")))
    )
    if stamps == "minute":
        out = out.union(_minute_marks(paras))
    # Shift so that numbers start at zero.
    return out.withColumn("line_no", F.col("line_no") + 2)


def _minute_marks(paras: DataFrame) -> DataFrame:
    """A mark for each full minute passed since the paragraph before."""
    seen = scan(paras, dense_axis("job_id", "para_no"), _prev=previous(F.col("start_ms")))
    now = F.floor(F.col("start_ms") / 60_000)
    last = F.coalesce(F.floor(F.col("_prev") / 60_000), F.lit(0))
    marks = seen.filter(now > last).select("job_id", "para_no", F.explode(F.sequence(last + 1, now)).alias("m"), last.alias("last"))
    at = F.col("para_no") * _WIDE + 2 + 2 * (F.col("m") - F.col("last"))
    return lines(marks, at, F.concat(F.lit("*["), clock(F.col("m") * 60_000), F.lit("]*"))).union(lines(marks, at + 1, F.lit("")))


# -- reports: a title, sections, one line per row, a sentence where a section is empty --------


def report(jobs: DataFrame, title: str, sections: list[tuple[str, str, str, DataFrame | None]]) -> DataFrame:
    """Lines of a report.

    Each section is (heading, table head or "", sentence when empty, rows), rows having
    (job_id, place, line).
    """
    ids = jobs.select("job_id")
    out = blocks(ids, F.lit(0), F.lit(f"# {title}"), F.lit(""))
    for no, (heading, head, empty, rows) in enumerate(sections, 1):
        base = no << 40
        top = [f"## {heading}", ""]
        filled = rows.select("job_id").distinct()
        table = top + (head.split("\n") if head else [])
        out = out.union(_fixed(filled, base, table)).union(_fixed(ids.join(filled, "job_id", "left_anti"), base, [*top, empty]))
        out = out.union(rows.select("job_id", (F.lit(base + 100) + F.col("place")).cast("long").alias("line_no"), "line"))
    return out


def _fixed(ids: DataFrame, base: int, texts: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(base + i).cast("long").alias("n"), F.lit(t).alias("line")) for i, t in enumerate(texts)])
    return ids.select("job_id", F.explode(rows).alias("r")).select("job_id", F.col("r.n").alias("line_no"), "r.line")


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(pipes_escaped(c.cast("string")), F.lit("—")) for c in cells]), F.lit(" |"))


def table(*heads: str) -> str:
    return "| " + " | ".join(heads) + " |\n|" + "---|" * len(heads)


def listed(df: DataFrame, place: Column, line: Column) -> DataFrame:
    return df.select("job_id", place.cast("long").alias("place"), line.alias("line"))


def action_report(jobs, actions) -> DataFrame:
    c = F.col
    rows = listed(actions, c("sent_no"), row(clock(c("at_ms")), c("task"), c("owner"), c("due_date"), percent(c("confidence"))))
    return report(jobs, "Action items", [("Tasks", table("Time", "Task", "Owner", "Due", "Confidence"), "No action items.", rows)])


def decision_report(jobs, decisions) -> DataFrame:
    c = F.col
    rows = listed(decisions, c("sent_no"), row(clock(c("at_ms")), c("decision"), percent(c("confidence"))))
    return report(jobs, "Decisions", [("Decisions", table("Time", "Decision", "Confidence"), "No decisions.", rows)])


def question_report(jobs, questions) -> DataFrame:
    c = F.col
    line = F.concat(F.lit("- "), clock(c("at_ms")), F.lit(" "), "question")
    return report(jobs, "Questions", [
        ("Open", "", "No open questions.", listed(questions.filter(~c("is_answered")), c("sent_no"), line)),
        ("Answered", "", "No answered questions.", listed(questions.filter(c("is_answered")), c("sent_no"), line)),
    ])


def timeline_report(jobs, timeline) -> DataFrame:
    c = F.col
    rows = listed(timeline, c("at_ms") * 8 + c("kind_no"), F.concat(F.lit("- "), clock(c("at_ms")), F.lit(" "), "event"))
    return report(jobs, "Timeline", [("Events", "", "No events.", rows)])


def summary_report(jobs, bullets) -> DataFrame:
    return report(jobs, "Summary", [("Key points", "", "Nothing to report.", listed(bullets, F.col("bullet_no"), F.concat(F.lit("- "), "bullet")))])


def entities_json(entities: DataFrame) -> DataFrame:
    """One JSON line per entity, sorted by kind and value in each meeting."""
    body = F.to_json(F.struct("kind", "value"))
    return entities.select("job_id", "kind", "value", body.alias("line"))


def correction_report(jobs, corrections) -> DataFrame:
    c = F.col
    rows = listed(corrections, c("seg_idx") * 1000 + c("step"), row(c("original"), c("replacement"), c("reason"), percent(c("confidence"))))
    return report(jobs, "Corrections", [("Applied", table("Original", "Replacement", "Reason", "Confidence"), "No corrections.", rows)])


def quality_report(jobs, stats, low_segments, corrections, names_found, acronyms, repeated) -> DataFrame:
    c = F.col
    facts = stats.select("job_id", F.posexplode(F.array(
        row(F.lit("Words"), c("n_words")), row(F.lit("Speakers"), c("n_speakers")), row(F.lit("Segments"), c("n_segments")),
        row(F.lit("Corrections"), c("n_corrections")), row(F.lit("Average confidence"), percent(c("avg_confidence"))),
        row(F.lit("Uncertain words"), F.concat(c("n_low").cast("string"), F.lit(" ("), percent(c("n_low") / c("n_words"), 1), F.lit(")"))),
    )).alias("place", "line"))

    def counted(df):
        return listed(df, c("place"), F.concat(F.lit("- **"), "term", F.lit("** ×"), c("n_seen").cast("string")))

    return report(jobs, "Quality", [
        ("Summary", table("Measure", "Value"), "No words.", listed(facts, c("place"), c("line"))),
        ("Uncertain segments", "", "None.", listed(low_segments, c("place"), F.concat(F.lit("- "), clock(c("start_ms")), F.lit(" `"), "preview", F.lit("`")))),
        ("Corrections", table("Original", "Replacement", "Confidence"), "None.", listed(corrections, c("seg_idx") * 1000 + c("step"), row(c("original"), c("replacement"), percent(c("confidence"))))),
        ("Possible names", "", "None.", counted(names_found)), ("Unknown acronyms", "", "None.", counted(acronyms)),
        ("Repeated uncertain words", "", "None.", counted(repeated)),
    ])


def review_report(jobs, uncertain, low_segments, corrections, doubtful, mentions, numbers, short, switches, pairs, names, shown: int | None = None) -> DataFrame:
    """The six review sections; with `shown` only so many uncertain words, and the number left out."""
    c = F.col

    def word_lines(df, place):
        return listed(df, place, row(clock(c("start_ms")), c("display"), c("word"), percent(c("confidence")), c("context")))

    if shown is None:
        words = word_lines(uncertain, c("word_idx"))
    else:
        order = Window.partitionBy("job_id").orderBy("word_idx")
        few = uncertain.withColumn("r", F.row_number().over(order)).filter(c("r") <= shown)
        more = uncertain.groupBy("job_id").agg(F.count("*").alias("n")).filter(c("n") > shown)
        words = word_lines(few, c("r")).union(listed(more, F.lit(shown + 1), F.concat(F.lit("and "), (c("n") - shown).cast("string"), F.lit(" more"))))
    span = F.concat(clock(c("start_ms")), F.lit("–"), clock(c("end_ms")))
    issues = (
        listed(short, c("seg_idx"), row(F.lit("Short segment"), span, c("text")))
        .union(listed(switches, F.lit(1 << 30) + c("start_ms"), row(F.lit("Rapid switching"), span, F.concat(c("n_changes").cast("string"), F.lit(" changes")))))
        .union(listed(pairs, F.lit(1 << 39), row(F.lit("Alternating pair"), span, F.concat("speaker_id", F.lit(" and "), "other"))))
    )
    return report(jobs, "Review", [
        ("Uncertain words", table("Time", "Speaker", "Word", "Confidence", "Context"), "None.", words),
        ("Uncertain segments", table("Time", "Speaker", "Average", "Preview"), "None.",
         listed(with_display_names(low_segments, names), c("seg_idx"), row(clock(c("start_ms")), c("display"), percent(c("avg_confidence")), c("preview")))),
        ("Corrections", table("Original", "Replacement", "Reason", "Profile", "Confidence", "Time"), "None.",
         listed(corrections, c("seg_idx") * 1000 + c("step"), row(c("original"), c("replacement"), c("reason"), c("profile"), percent(c("confidence")), clock(c("at_ms"))))),
        ("Possible names", table("Word", "Count", "Average", "First seen"), "None.",
         listed(doubtful, c("place"), row(c("term"), c("n_seen"), percent(c("avg_confidence")), clock(c("first_ms"))))),
        ("Numbers and codes", table("Kind", "Value", "Time", "Speaker"), "None.",
         listed(mentions.unionByName(numbers.withColumn("kind", F.lit("number"))), c("seg_idx"), row(c("kind"), c("value"), clock(c("at_ms")), c("display")))),
        ("Speakers", table("Issue", "Time", "What"), "None.", issues),
    ])


def run_report(jobs, stages, resources, artifacts) -> DataFrame:
    """Processing report: stages by start, load, artifacts."""
    c = F.col
    loads = resources.select("job_id", F.posexplode(F.array(*[
        row(F.lit(m), F.round(c(f"peak_{m}"), 2), F.round(c(f"mean_{m}"), 2)) for m in ("cpu_pct", "ram_gb", "swap_gb")
    ])).alias("place", "line"))
    return report(jobs, "Processing", [
        ("Stages", table("Stage", "Duration", "Share"), "None.",
         listed(stages, c("start_ms"), row(c("stage"), duration_text(c("duration_ms") / 1000), F.concat(c("pct").cast("string"), F.lit("%"))))),
        ("Load", table("Measure", "Peak", "Mean"), "None.", loads),
        ("Artifacts", table("Present", "Expected", "Missing"), "None.", listed(artifacts, F.lit(0), row(c("n_present"), c("n_expected"), c("missing")))),
    ])


# -- registry --------------------------------------------------------------------------

Renderer = Callable[..., DataFrame]
RENDERERS: dict[str, tuple[str, Renderer]] = {"txt": (".txt", txt), "srt": (".srt", srt), "vtt": (".vtt", vtt), "markdown": (".md", markdown)}


def register_renderer(name: str, suffix: str, renderer: Renderer) -> None:
    """Add a renderer under a new format name."""
    if name in RENDERERS:
        raise ValueError(f"renderer {name!r} is registered already")
    RENDERERS[name] = (suffix, renderer)
