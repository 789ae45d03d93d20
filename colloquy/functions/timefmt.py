"""Times in milliseconds as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def clock(ms: Column) -> Column:
    """[MM:SS]; minutes may exceed 59."""
    s = _whole(ms / 1000)
    return F.format_string("[%02d:%02d]", _whole(s / 60), s % 60)


def _timecode(ms: Column, mark: str) -> Column:
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", _whole(ms / 3_600_000), _whole(ms / 60_000) % 60, _whole(ms / 1000) % 60, ms % 1000
    )


def srt_time(ms: Column) -> Column:
    return _timecode(ms, ",")


def vtt_time(ms: Column) -> Column:
    return _timecode(ms, ".")


def duration_text(seconds: Column) -> Column:
    """"12.5s", "3m 04s" or "1h 02m 03s"."""
    s = _whole(seconds)
    h, m, r = _whole(s / 3600), _whole(s / 60) % 60, s % 60
    return (
        F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r))
        .when(m > 0, F.format_string("%dm %02ds", m, r))
        .otherwise(F.format_string("%.1fs", seconds))
    )
