"""Small text functions on columns."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_word(text: Column) -> Column:
    """Without trailing punctuation."""
    return F.regexp_replace(text, "[.,;:!?]+$", "")


def clipped(text: Column, n: int, tail: str = "...") -> Column:
    """First n characters, with a tail when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def pipes_escaped(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def safe_file_name(name: Column, longest: int | None = None, fallback: str = "audio") -> Column:
    """Letters, digits, dot, dash and underscore stay; everything else becomes an underscore.

    A name over `longest` characters ends in a part of its digest instead, so that two of them stay apart.
    """
    clean = F.regexp_replace(name, r"(?U)[^\w\-.]", "_")
    if longest is not None:
        short = F.concat(F.substring(clean, 1, longest - 9), F.lit("-"), F.substring(F.sha2(clean, 256), 1, 8))
        clean = F.when(F.length(clean) > longest, short).otherwise(clean)
    return F.when(clean == "", fallback).otherwise(clean)


def title_of_path(path: Column) -> Column:
    """Readable title from a file name without folder and suffix."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.initcap(F.translate(stem, "_-", "  "))


def glued(text: Column) -> Column:
    """Close the gap before tokens that start with punctuation."""
    return F.trim(F.regexp_replace(text, r" (?=[.,;:!?])", ""))


#: Letters whose capital Spark spells with several, and the single letter that stands for it: the capital sharp s, the title form, else the letter itself.
_LONG_CAPITALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1)
_SINGLE = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONG_CAPITALS)


def capital(letter: Column) -> Column:
    """One letter in upper case as one letter."""
    upper = F.upper(letter)
    return F.when(F.length(upper) > 1, F.translate(letter, _LONG_CAPITALS, _SINGLE)).otherwise(upper)


def capitalised(text: Column) -> Column:
    """First letter in upper case, whatever stands before it kept."""
    head = F.regexp_extract(text, r"^([^\p{L}]*)", 1)
    at = F.length(head) + 1
    return F.concat(head, capital(F.substring(text, at, F.lit(1))), F.substring(text, at + 1, F.length(text)))


def percent(share: Column, digits: int = 0) -> Column:
    """A share as percent text, halves to the even digit."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))
