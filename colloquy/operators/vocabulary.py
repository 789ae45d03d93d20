"""Corrections by vocabularies of any size.

A vocabulary is a table of steps in the order of application. An alias can only match where its words stand as words of the text, so steps and
texts meet by equality of word n-grams, and only the steps that meet a text are folded over it. A step may act on what an earlier one wrote; the n-grams that
a step brings in are kept, and where they meet further steps, that text is folded again with these, until no step is new.

Patterns of steps are literal words between word boundaries. In texts and steps of plain letters (`PLAIN`), whose cases and boundaries are the same for Java and
Python, they are found by a search for the alias in Arrow batches; the others are left to Spark's patterns.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.operators.ordered import places
from colloquy.session import ship_package, written

#: Least confidence to apply a step, what a context word adds, and what is left without any.
APPLY_FROM, CONTEXT_BONUS, NO_CONTEXT = 0.8, 0.02, 0.4
FIXES = "array<struct<step:int,original:string,replacement:string,reason:string,confidence:double>>"
#: Fixed value: the steps that a worker holds at once.
STEPS_AT_ONCE = 20_000
#: Latin letters with one capital and one small letter each (the sharp s has none), all else up to there, and dashes, quotes and the like.
PLAIN = "".join(c for c in map(chr, range(0x180)) if len(c.lower()) == 1 and (c.upper().lower() == c.lower() or c == "\u00df")) + "".join(map(chr, range(0x2010, 0x2028)))
_WORDS = frozenset(c for c in PLAIN if c.isalpha() or c in "0123456789_")
_ODD, _WORD = re.compile(f"[^{re.escape(PLAIN)}]"), re.compile(f"[{re.escape(''.join(sorted(_WORDS)))}]+")


def words_of(text: Column) -> Column:
    """Words in small letters, as the word boundaries of the patterns see them."""
    # Spark makes lower(upper()) a mere lower() itself; said outright, since _runs_in has to find the same.
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1))


def _pattern(alias: Column, exact: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(alias, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.when(exact, "(?U)").otherwise("(?iU)"), F.lit(r"\b"), quoted, F.lit(r"\b"))


def _literal(canonical: Column) -> Column:
    return F.regexp_replace(canonical, r"([\\$])", r"\\$1")


def steps(vocabulary: DataFrame) -> DataFrame:
    """One row per alias from (profile, entry_idx, canonical, aliases, confidence, context, case_sensitive): entries in order, longest alias first."""
    each = vocabulary.select("profile", "entry_idx", "canonical", "confidence", "context", "case_sensitive", F.posexplode("aliases").alias("pos", "alias"))
    numbered = places(each.withColumn("_shorter", -F.length("alias")), "profile", ("entry_idx", "_shorter", "pos"))
    exact = F.coalesce("case_sensitive", F.lit(False))
    return numbered.select(
        F.col("profile"), (F.col("place") - 1).cast("int").alias("step"), "alias", "canonical", F.col("confidence").cast("double").alias("confidence"), "context", exact.alias("exact"),
        _pattern(F.col("alias"), exact).alias("pattern"), _literal(F.col("canonical")).alias("written"),
        F.array_join(words_of(F.col("alias")), " ").alias("gram"), F.size(words_of(F.col("alias"))).alias("n_words"),
    )


def _runs(words: Column, n: int) -> Column:
    """All runs of n words."""
    if n < 2:
        return words if n else F.array(F.lit(""))
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words) - n + 1, F.lit(0))) for i in range(n)]
    return F.transform(F.arrays_zip(*(x.alias(f"w{i}") for i, x in enumerate(shifted))), lambda z: F.concat_ws(" ", *(z[f"w{i}"] for i in range(n))))


def _grams(texts: Column, sizes: list[int]) -> Column:
    """All n-grams of the given sizes of some texts; size 0 stands for aliases without words, which every text may hold."""
    # The words of a text are the element of an array of one, so that they are found once.
    split = F.transform(texts, words_of)
    return F.array_distinct(F.flatten(F.transform(split, lambda words: F.concat(*(_runs(words, n) for n in sizes)))))


def _apply(state: Column, s: Column) -> Column:
    text = state["text"]
    near = F.filter(s["context"], lambda c: F.contains(F.lower(text), F.lower(c)))
    sure = F.when(F.size(s["context"]) == 0, s["confidence"]).when(F.size(near) == 0, s["confidence"] * NO_CONTEXT).otherwise(
        F.least(F.lit(1.0), s["confidence"] + F.lit(CONTEXT_BONUS) * F.size(near))
    )
    reason = F.concat(F.lit("alias "), s["alias"], F.when(F.size(near) > 0, F.concat(F.lit(" near "), F.array_join(near, ", "))).otherwise(""))
    fix = F.struct(
        s["step"].alias("step"), F.regexp_substr(text, s["pattern"]).alias("original"), s["canonical"].alias("replacement"), reason.alias("reason"), F.round(sure, 3).alias("confidence"),
    )

    def made(changed: Column) -> Column:
        # A text whose words differ in case only has the n-grams of the one before.
        fresh = F.lower(F.upper(changed)) != F.lower(F.upper(text))
        seen = F.when(fresh, F.array_append(state["seen"], changed)).otherwise(state["seen"])
        return F.when(changed != text, F.struct(changed.alias("text"), F.array_append(state["fixes"], fix).alias("fixes"), seen.alias("seen"))).otherwise(state)

    # The element of an array of one, so that the pattern is compiled and searched once.
    changed = F.get(F.transform(F.array(F.regexp_replace(text, s["pattern"], s["written"])), made), F.lit(0))
    return F.when(sure >= APPLY_FROM, changed).otherwise(state)


def _splits(text: str, at: int) -> bool:
    """A word begins or ends in front of place `at`."""
    return (at > 0 and text[at - 1] in _WORDS) != (at < len(text) and text[at] in _WORDS)


def _around(text: str, start: int, end: int, more: int) -> str:
    """A stretch of the text, the words that it touches, and so many more to either side."""
    for k in range(more + 1):
        while k and start and text[start - 1] not in _WORDS:
            start -= 1
        while start and text[start - 1] in _WORDS:
            start -= 1
        while k and end < len(text) and text[end] not in _WORDS:
            end += 1
        while end < len(text) and text[end] in _WORDS:
            end += 1
    return text[start:end]


def _runs_in(text: str, sizes: list[int]) -> set[str]:
    """The n-grams of a plain text, as _grams finds them."""
    words = _WORD.findall(text.lower())
    return set().union(*(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if n else ("",) for n in sizes))


def _folded(text: str, todo: list[tuple], sizes: list[int]) -> tuple[str, list[tuple], list[str]]:
    """What _apply makes of a plain text and plain steps (step, alias, canonical, confidence, context, exact): text, fixes, and the n-grams that the first text lacks."""
    first, low, fixes, fresh = text, text.lower(), [], set()
    for step, alias, canonical, confidence, context, exact in todo:
        plain = alias.lower()
        where, sought = (text, alias) if exact else (low, plain)
        at = where.find(sought)
        if at < 0:
            continue
        near = [c for c in context if c.lower() in low]
        sure = confidence if not context else min(1.0, confidence + CONTEXT_BONUS * len(near)) if near else confidence * NO_CONTEXT
        if not sure >= APPLY_FROM:
            continue
        found = []
        while at >= 0:
            end = at + len(sought)
            hit = _splits(text, at) and _splits(text, end)
            if hit:
                found.append(at)
            # As a search for the pattern goes on: behind what it found, else one letter on.
            at = where.find(sought, end if hit else at + 1)
        if not found:
            continue
        ends = [at + len(sought) for at in found]
        between = [slice(*p) for p in zip([0, *ends], [*found, len(text)], strict=True)]
        changed = canonical.join([text[p] for p in between])
        if changed == text:
            continue
        fixes.append((step, text[found[0] : ends[0]], canonical, f"alias {alias}" + (" near " + ", ".join(near) if near else ""), sure))
        written_low = canonical.lower()
        text, low = changed, written_low.join([low[p] for p in between])
        if written_low != plain:
            grown = len(canonical) - len(sought)
            places = ((at + i * grown, at + i * grown + len(canonical)) for i, at in enumerate(found))
            fresh.update({_around(text, start, end, sizes[-1] - 1) for start, end in places})
    grams = set().union(*(_runs_in(t, sizes) for t in fresh)) - _runs_in(first, sizes) if fresh else ()
    return text, fixes, sorted(grams)


def _fold(sizes: list[int], n_others: int):
    """Fold the steps (last column) over the texts before them; rows of other letters keep their steps, for Spark's patterns."""

    def rows(batches):
        known: dict[tuple, bool] = {}
        for b in batches:
            # A long text has many steps: so many rows at once as bound what Python holds.
            sizes_, row = pa.compute.list_value_length(b.column(n_others + 1)).to_pylist(), 0
            while row < len(sizes_):
                until, held = row + 1, sizes_[row]
                while until < len(sizes_) and held + sizes_[until] <= STEPS_AT_ONCE:
                    held += sizes_[until]
                    until += 1
                yield part(b.slice(row, until - row), sizes_[row:until], known)
                row = until

    def part(b: pa.RecordBatch, lengths: list[int], known: dict[tuple, bool]) -> pa.RecordBatch:
        texts, flat = b.column(n_others).to_pylist(), b.column(n_others + 1).flatten()
        fields = [flat.field(k) for k in range(flat.type.num_fields)]
        words, each_has = iter(fields[4].flatten().to_pylist()), pa.compute.list_value_length(fields[4]).to_pylist()
        contexts = [None if n is None else tuple(islice(words, n)) for n in each_has]
        each = iter(zip(*(f.to_pylist() for f in fields[:4]), contexts, fields[5].to_pylist(), strict=True))
        out, left = [], []
        for row, (text, n) in enumerate(zip(texts, lengths, strict=True)):
            todo = list(islice(each, n))
            easy = not _ODD.search(text) and all(plain(e, known) for e in todo)
            out.append(_folded(text, todo, sizes) if easy else (None, [], []))
            left.append(None if easy else row)
        made = [f for _, fixes, _ in out for f in fixes]
        starts = pa.array(accumulate((len(fixes) for _, fixes, _ in out), initial=0), pa.int32())
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
        fix = pa.StructArray.from_arrays([pa.array([f[k] for f in made], t) for k, t in enumerate(kinds)], ["step", "original", "replacement", "reason", "confidence"])
        done = [pa.array([t for t, _, _ in out], pa.string()), pa.ListArray.from_arrays(starts, fix), pa.array([g for _, _, g in out], pa.list_(pa.string()))]
        kept = b.columns[: n_others + 1]
        return pa.RecordBatch.from_arrays([*kept, *done, b.column(n_others + 1).take(pa.array(left, pa.int32()))], names=[*b.schema.names[: n_others + 1], "text", "fixes", "_new", "_left"])

    def plain(e: tuple, known: dict[tuple, bool]) -> bool:
        _, alias, canonical, confidence, context, _ = e
        if (own := (alias, canonical, context)) not in known:
            if len(known) > STEPS_AT_ONCE:
                known.clear()
            known[own] = bool(alias) and None not in (canonical, context, *(context or ())) and not any(_ODD.search(t) for t in (alias, canonical, *context))
        return known[own] and confidence is not None and confidence == confidence

    return rows


def correct_texts(texts: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("job_id", "seg_idx")) -> DataFrame:
    """The texts (keys, text, ...) corrected by a table of `steps`, and `fixes`, the log of what was done."""
    ship_package(texts.sparkSession)
    # What the patterns are made of is enough to carry. Numbers for n-grams are sorted sooner; a step that meets a text by a number alone finds nothing there to act on.
    table = written(table.drop("profile", "pattern", "written").withColumn("gram", F.xxhash64("gram")), "steps")
    sizes = sorted(r[0] for r in table.select("n_words").distinct().collect())
    others = [c for c in texts.columns if c != "text"]
    none = F.array().cast(FIXES)
    if not sizes:
        return texts.withColumn("fixes", none)
    todo = texts.select(*others, F.col("text").alias("_first"), "text", none.alias("fixes"), _grams(F.array("text"), sizes).alias("_new"))
    step = F.struct("step", "alias", "canonical", "confidence", "context", "exact")
    done, known = [], None
    while True:
        met = todo.select(*keys, F.explode("_new").alias("gram")).withColumn("gram", F.xxhash64("gram")).join(table, "gram")
        # The steps are stored without the texts, of which most meet none and all would be written in three columns.
        fresh = written(met.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("_steps")), "vocabulary_steps")
        if known is not None:
            unknown = F.filter("_more", lambda s: ~F.array_contains("_steps", s))
            both = known.join(fresh.withColumnRenamed("_steps", "_more"), list(keys)).withColumn("_more", unknown).filter(F.size("_more") > 0)
            fresh = written(both.select(*keys, F.array_sort(F.concat("_steps", "_more")).alias("_steps")), "vocabulary_steps")
        if fresh.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(fresh.select(*keys), list(keys), "left_anti"))
        folded = written(_fold_steps(todo.select(*others, "_first").join(fresh, list(keys)).select(*others, "_first", "_steps"), sizes), "vocabulary_texts")
        done.append(folded.filter(F.size("_new") == 0))
        todo, known = folded.filter(F.size("_new") > 0), fresh
    return reduce(DataFrame.unionByName, [d.select(*others, "text", "fixes") for d in done])


def _fold_steps(todo: DataFrame, sizes: list[int]) -> DataFrame:
    """Texts (..., _first, _steps) with all steps applied: text, fixes, and n-grams that may be new (`_new`) instead of the steps."""
    kept = todo.drop("_steps")
    made = StructType.fromDDL(f"text string, fixes {FIXES}, _new array<string>").add("_left", todo.schema["_steps"].dataType)
    schema = StructType([*kept.schema.fields, *made.fields])
    rows = todo.mapInArrow(_fold(sizes, len(kept.columns) - 1), schema)
    whole = F.transform("_left", lambda s: F.struct(
        s["step"].alias("step"), s["alias"].alias("alias"), s["canonical"].alias("canonical"), s["confidence"].alias("confidence"), s["context"].alias("context"),
        _pattern(s["alias"], s["exact"]).alias("pattern"), _literal(s["canonical"]).alias("written"),
    ))
    start = F.struct(F.col("_first").alias("text"), F.array().cast(FIXES).alias("fixes"), F.array("_first").alias("seen"))
    state, mine = F.col("_state"), F.col("_left").isNotNull()
    rounded = F.transform("fixes", lambda f: f.withField("confidence", F.round(f["confidence"], 3)))
    return rows.withColumn("_state", F.when(mine, F.aggregate(whole, start, _apply))).select(
        *kept.columns, F.when(mine, state["text"]).otherwise(F.col("text")).alias("text"), F.when(mine, state["fixes"]).otherwise(rounded).alias("fixes"),
        F.when(mine, F.when(F.size(state["seen"]) > 1, _grams(state["seen"], sizes)).otherwise(F.array().cast("array<string>"))).otherwise(F.col("_new")).alias("_new"),
    )


def touched(texts: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("job_id", "seg_idx")) -> DataFrame:
    """Which steps of a table of `steps` match which texts as they are: (keys, profile, step)."""
    table = written(table, "steps")
    sizes = sorted(r[0] for r in table.select("n_words").distinct().collect())
    if not sizes:
        return texts.select(*keys).join(table.select("profile", "step"), F.lit(False))
    met = texts.select(*keys, "text", F.explode(_grams(F.array("text"), sizes)).alias("gram")).join(table, "gram")
    return met.filter(F.rlike("text", F.col("pattern"))).select(*keys, "profile", "step")
