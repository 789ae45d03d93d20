"""Correction profiles: a name, an ordered list of processors, and vocabulary entries.

Profiles are small hand-written configuration and stay on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED = Path(__file__).resolve().parent.parent / "profiles"
DEFAULT_CONFIDENCE = 0.9
DEFAULT_PROCESSORS = ("transcript_cleanup", "transcript_intelligence", "speaker_formatting")


@dataclass(frozen=True)
class Entry:
    canonical: str
    aliases: tuple[str, ...] = ()
    confidence: float = DEFAULT_CONFIDENCE
    context: tuple[str, ...] = ()
    fuzzy: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class Profile:
    name: str
    processors: tuple[str, ...] = DEFAULT_PROCESSORS
    vocabulary: tuple[Entry, ...] = field(default_factory=tuple)


def load_profile(name: str, folder: Path = SHIPPED) -> Profile:
    """The named profile; FileNotFoundError if there is none."""
    path = Path(folder) / f"{name}.json"
    if not path.is_file():
        raise FileNotFoundError(f"no profile {name!r} in {folder}")
    data = json.loads(path.read_text(encoding="utf-8"))
    entries = tuple(
        Entry(
            e["canonical"], tuple(e.get("aliases", ())), float(e.get("confidence", DEFAULT_CONFIDENCE)),
            tuple(e.get("context", ())), bool(e.get("fuzzy", False)), bool(e.get("case_sensitive", False)),
        )
        for e in data.get("vocabulary", [])
        if isinstance(e, dict) and "canonical" in e
    )
    return Profile(data.get("name", name), tuple(data.get("processors", DEFAULT_PROCESSORS)), entries)


def resolve_profile(name: str, folder: Path = SHIPPED) -> Profile:
    """The named profile, or an empty "generic" one when it is missing."""
    try:
        return load_profile(name, folder)
    except FileNotFoundError:
        return Profile("generic")


def list_profiles(folder: Path = SHIPPED) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json") if "name" in json.loads(p.read_text(encoding="utf-8")))


def vocabulary_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """The vocabulary as a dimension table, one row per entry."""
    rows = [
        (profile.name, i, e.canonical, list(e.aliases), e.confidence, list(e.context), e.fuzzy, e.case_sensitive)
        for i, e in enumerate(profile.vocabulary)
    ]
    return spark.createDataFrame(
        rows,
        "profile string, entry_idx int, canonical string, aliases array<string>, confidence double, "
        "context array<string>, fuzzy boolean, case_sensitive boolean",
    )
