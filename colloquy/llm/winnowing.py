"""Document fingerprints by winnowing.

Every k code points of a text have a rolling hash (each follows from the one before in constant time; here as differences of
running sums of a polynomial). From every window of w hashes the least is chosen, of equal ones the rightmost. The chosen
hashes with their positions are the fingerprint: two texts that share a passage of k + w - 1 code points share a chosen hash of it.

`with_fingerprints` gives hashes and positions of each text. `compare_with_next` also fingerprints an edited text, whose
last quarter comes from the next document in the order of ids, and compares. For that, documents are dealt out once by
blocks of the id order (equally many rows in each); the first document of a block is also sent to the block before as a look ahead.

Defined results: a null or empty text has an empty fingerprint; a text shorter than k has the hash of all of it; a text with fewer than w hashes
has the least of them. Documents without an id stand before all others; repeated ids are ordered by text. The only document
of a table is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import byte_texts, map_texts, prepared

GRAM = 20
WINDOW = 32
BLOCK = 1 << 18
PLACE_BITS = 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, enough for one block."""
    if not _powers:
        n = 2 * BLOCK
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for b in (BASE, inverse):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """45-bit hashes of all runs of k code points (of the whole if there are fewer)."""
    n = len(points)
    k = min(k, n)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[k - 1 : n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(PLACE_BITS)


def winnowed(points: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, ascending. Long texts are done in blocks that overlap by a window."""
    n_grams = max(len(points) - min(k, len(points)) + 1, 0) if len(points) else 0
    n_windows = max(n_grams - w + 1, min(n_grams, 1))
    hashes, places = [], []
    for at in range(0, n_windows, BLOCK):
        windows = min(BLOCK, n_windows - at)
        grams = min(windows + w - 1, n_grams - at)
        h = gram_hashes(points[at : at + grams + min(k, len(points)) - 1], k)
        # The place, counted down, makes the rightmost of equal hashes the least.
        key = h << np.uint64(PLACE_BITS) | (np.uint64((1 << PLACE_BITS) - 1) - np.arange(len(h), dtype=np.uint64))
        width, want = 1, min(w, grams)
        while width < want:
            step = min(width, want - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        chosen = key[np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))]
        places.append(at + ((1 << PLACE_BITS) - 1 - (chosen & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)))
        hashes.append((chosen >> np.uint64(PLACE_BITS)).astype(np.int64))
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<i8").tobytes() + places.astype("<i8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of all distinct hashes of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def with_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """All columns of docs, and the chosen hashes and their positions (code points from 0)."""

    def compute(texts):
        found = [winnowed(points_of(t.decode("utf-8", "replace")), k, w) for t in texts]
        return [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]

    return map_texts(docs, "hashes array<long>, positions array<long>", compute)


class Text:
    """A document on its way through compare_with_next."""

    def __init__(self, key, text: bytes, k: int, w: int):
        self.key, self.text = key, text.decode("utf-8", "replace")
        self.hashes, self.places = winnowed(points_of(self.text), k, w)
        self.set = np.unique(self.hashes)

    def row(self, after: Text, k: int, w: int) -> tuple:
        n = len(self.text)
        edited = self.text[: n - n // 4] + after.text[: n // 4]
        hashes, places = winnowed(points_of(edited), k, w)
        return (
            self.key, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), digest(self.hashes, self.places), digest(hashes, places),
            likeness(self.set, np.unique(hashes)), likeness(self.set, after.set),
        )


def in_order(docs: DataFrame, rows_per_block: int, most_blocks: int = 2000) -> DataFrame:
    """doc_id, text, block and ahead, sorted in partitions that hold whole blocks of the id order.

    `ahead` marks the copy of the next block's first document. Only block borders come to the driver, at most `most_blocks`.
    """
    n = docs.count()
    m = min(most_blocks, 1 + n // rows_per_block)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / m for i in range(1, m)] or [0.5], 100_000).alias("c")).head()["c"] or []
    cuts = sorted(set(cuts)) if m > 1 else []
    if cuts:
        # Binary search: steps of half the size add up to the number of cuts that are not above the id.
        depth = len(cuts).bit_length()
        padded = F.lit(cuts + [None] * ((1 << depth) - 1 - len(cuts))) if len(cuts) == (1 << depth) - 1 else F.concat(F.lit(cuts), F.array_repeat(F.lit(None).cast("long"), (1 << depth) - 1 - len(cuts)))
        block = F.aggregate(F.lit([1 << i for i in range(depth - 1, -1, -1)]), F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    else:
        block = F.lit(0)
    placed = docs.withColumn("block", block)
    firsts = placed.groupBy("block").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("lacks")).orderBy("block").collect()
    if not firsts:
        return placed.withColumn("ahead", F.lit(False))
    before = {r["block"]: firsts[i - 1]["block"] for i, r in enumerate(firsts)}
    size = max(before) + 1
    first_of = {r["block"]: None if r["lacks"] else r["first"] for r in firsts}
    first = F.array(*(F.lit(first_of.get(b)).cast("long") for b in range(size)))
    previous = F.array(*(F.lit(before.get(b)).cast("int") for b in range(size)))
    sent = F.array_compact(F.array(
        F.struct(F.col("block").alias("block"), F.lit(False).alias("ahead")),
        F.when(F.element_at(first, F.col("block") + 1).eqNullSafe(F.col("doc_id")), F.struct(F.element_at(previous, F.col("block") + 1).alias("block"), F.lit(True).alias("ahead"))),
    ))
    spread = placed.select("doc_id", "text", F.explode(sent).alias("to")).select("doc_id", "text", "to.block", "to.ahead")
    return spread.repartition("block").sortWithinPartitions("block", "ahead", F.asc_nulls_first("doc_id"), "text")


def compare_with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW, rows_per_block: int = 512) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    prepared(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        waiting, of_block = None, None
        for batch in batches:
            rows = []
            for key, text, block, ahead in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ahead and waiting is None:
                    continue  # a repeated row of the look ahead
                here = Text(key, text, k, w)
                if waiting is not None and block == of_block:
                    rows.append(waiting.row(here, k, w))
                waiting, of_block = (None, None) if ahead else (here, block)
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows_per_block).mapInArrow(run, schema)
