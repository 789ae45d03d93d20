"""Registry of extractors: each turns the tables of a corpus of meetings into rows of facts with a job_id.

An extractor takes an object with the methods words(), segments(), sentences() and names(), and those of the extractors it builds
on (actions(), decisions(), questions(), entities(), topics(), timeline()), as `colloquy.sources.corpus.Corpus` has them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

Extractor = Callable[[Any], DataFrame]

# In the order in which they build on one another.
EXTRACTORS: dict[str, Extractor] = {
    "action": lambda c: c.actions(),
    "decision": lambda c: c.decisions(),
    "question": lambda c: c.questions(),
    "entity": lambda c: c.entities(),
    "topic": lambda c: c.topics(),
    "event": lambda c: c.timeline(),
}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Add an extractor under a new name."""
    if name in EXTRACTORS:
        raise ValueError(f"extractor {name!r} is registered already")
    EXTRACTORS[name] = extractor


def extract(tables: Any, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The facts of the named extractors, or of all; unknown names are skipped with a warning."""
    out = {}
    for name in EXTRACTORS if names is None else names:
        if name in EXTRACTORS:
            out[name] = EXTRACTORS[name](tables)
        else:
            log.warning("unknown extractor %s skipped", name)
    return out


def bundle(facts: dict[str, DataFrame]) -> DataFrame:
    """All facts in long form: (job_id, kind, body as JSON)."""
    rows = None
    for kind, df in facts.items():
        fields = sorted(c for c in df.columns if c != "job_id")
        part = df.select("job_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
        rows = part if rows is None else rows.union(part)
    return rows
