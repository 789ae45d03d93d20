"""Speakers who say their own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx

#: Marks around a word, and a word that can be a name; whatever follows an apostrophe belongs to it as a possessive.
MARKS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
NAME = r"^([A-Z][A-Za-z]+)$"


def _rules(raw: Column, i: Column) -> Column:
    """What a rule finds where the phrase begins with word i: (sure, name), null if none fits."""

    def bare(k: int) -> Column:
        return F.coalesce(F.regexp_replace(F.get(raw, i + k), MARKS, ""), F.lit(""))

    def low(k: int) -> Column:
        return F.lower(bare(k))

    def close(k: int) -> Column:
        """No mark parts the words up to word k."""
        out = F.lit(True)
        for j in range(k):
            out = out & F.get(raw, i + j).rlike(r"[\p{L}\p{N}]$") & F.get(raw, i + j + 1).rlike(r"^[\p{L}\p{N}]")
        return out

    def named(k: int, pattern: str = NAME) -> Column:
        return F.when(close(k), F.nullif(F.regexp_extract(bare(k), pattern, 1), F.lit("")))

    def found(sure: bool, name: Column) -> Column:
        return F.when(name.isNotNull(), F.struct(F.lit(sure).alias("sure"), name.alias("name")))

    myself = F.when((bare(0) == "I") & (bare(1) == "am"), named(2)).when(bare(0).isin("I'm", "Im"), named(1))
    mine = F.when((low(0) == "my") & (low(1) == "name") & (low(2) == "is"), named(3, "^([A-Za-z]{2,})$")).when(
        (low(0) == "my") & low(1).isin("name's", "names"), named(2, "^([A-Za-z]{2,})$")
    )
    here = F.when((i == 0) & bare(1).isin("here", "speaking") & close(1), named(0))
    this = F.when(bare(0).isin("This", "this") & (bare(1) == "is") & ~(F.get(raw, i + 2).rlike(r"[\p{L}\p{N}]$") & low(3).isin(*lx.POINTING)), named(2))
    return F.coalesce(found(True, myself), found(True, mine), found(False, here), found(False, this))


def _may_begin(word: Column, i: Column) -> Column:
    """A phrase can begin with this word: no mark stands behind it, and the first word may be the name itself."""
    out = (i == 0) | F.lower(word).endswith("my")
    for said in ("I", "I'm", "Im", "This", "this"):
        out = out | word.endswith(said)
    return out


def _hits(raw: Column) -> Column:
    """(sure, at_char, name) of every phrase, by the places of words."""
    places = F.filter(F.transform(raw, lambda word, i: F.when(_may_begin(word, i), i)), lambda i: i.isNotNull())

    def place(i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice(raw, 1, i), " ")) + 1)
        return before + F.length(F.regexp_extract(F.get(raw, i), r"^([^\p{L}\p{N}]*)", 1)) + 1

    found = F.filter(F.transform(places, lambda i: F.struct(_rules(raw, i).alias("m"), i.alias("i"))), lambda x: x["m"].isNotNull())
    return F.transform(found, lambda x: F.struct(x["m"]["sure"].alias("sure"), place(x["i"]).cast("long").alias("at_char"), x["m"]["name"].alias("name")))


def _may_introduce(text: Column) -> Column:
    """A phrase of a rule stands in the text; its words have one space between them, since no mark may part them."""
    low = F.lower(text)
    said = low.contains("my name is ") | low.contains("my name's ") | low.contains("my names ")
    for phrase in ("I am ", "I'm ", "Im ", "This is ", "this is "):
        said = said | text.contains(phrase)
    return said | text.rlike("^[^ ]* (?:here|speaking)")


def introductions(segs: DataFrame) -> DataFrame:
    """Introductions: (job_id, seg_idx, speaker_id, sure, at_char, name), the first place of each name in a segment."""
    words = F.array(F.split("text", " "))
    said = segs.filter(_may_introduce(F.col("text")))
    hits = said.select("job_id", "seg_idx", "speaker_id", F.explode(F.transform(words, _hits)[0]).alias("m")).select("job_id", "seg_idx", "speaker_id", "m.*")
    rows = hits.filter(F.col("sure") | ~F.col("name").isin(lx.NOT_NAMES))
    return rows.groupBy("job_id", "seg_idx", "speaker_id", "sure", "name").agg(F.min("at_char").alias("at_char")).select("job_id", "seg_idx", "speaker_id", "sure", "at_char", "name")


def best_introductions(found: DataFrame) -> DataFrame:
    """One name per speaker: a sure one beats a likely one, else the first."""
    first = F.struct(F.when(F.col("sure"), 0).otherwise(1).alias("tier"), "seg_idx", "at_char", "name")
    return (
        found.groupBy("job_id", "speaker_id").agg(F.min(first).alias("f"))
        .select("job_id", "speaker_id", F.col("f.name").alias("name"), (F.col("f.tier") == 0).alias("sure"))
    )
