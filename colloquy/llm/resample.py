"""Resampling towards a target distribution by hashed n-gram importance.

Words are runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII; all between them collapses to one space. A regular expression of
up to n words, bounded by lookarounds, scans the collapsed text with `overlapped=True`: it matches at every word, so the span of a match
is the longest n-gram there, and the shorter ones end where the following matches begin. Spans are hashed as they come: CRC-32 modulo the number of
buckets, the longer n-gram going on from the sum of the shorter one. A bucket's gain is floor(1000 ln) of how much likelier the target
makes it, with one added to each count; a document's weight is the floored mean of its gains. Gumbel noise from a seeded hash of its id makes
the highest weight + noise a draw without replacement in proportion to exp(weight / 1000).

Texts are scanned once; the buckets (two bytes a feature) are written and read for the counts of the corpus and for the weights. Counts of a task leave it as
one row per bucket. Ranks need no global sort: scores are whole thousandths, so their histogram is short whatever the number of rows; rows of one
score are counted by id and task, which numbers repeated rows too without gathering them.

Defined results: a null text has no features and weight 0; a null id is hashed as the empty string and comes first among equal
scores. Repeated rows are drawn one by one. Without a target text the target is uniform. An empty table gives no rows. Columns other than id and text are dropped.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import written
from colloquy.llm.texts import byte_texts, parts, prepared

BUCKETS = 10_000
#: Bytes outside of words become spaces.
SEPARATORS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
CHUNK = 1 << 16


def collapsed(text: bytes) -> bytes:
    """Lower-cased words with single spaces between them."""
    return b" ".join(text.lower().translate(SEPARATORS).split())


@lru_cache
def scanner(n: int):
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){0,%d}(?![^ ])" % (n - 1))


def span_starts(line: bytes, n: int):
    """Spans of the longest n-gram at each word."""
    return (m.span() for m in scanner(n).finditer(line, overlapped=True))


def hashed(line: bytes, n: int = 2, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of all n-grams of up to n words, and the number of words; memory besides the line is bounded by CHUNK and the result."""
    crc, done, out, words = zlib.crc32, [], [], 0
    # Words that still take part in longer n-grams: sums so far.
    open_sums: list[int] = []
    before = None
    for start, _ in span_starts(line, n):
        if before is not None:
            words += 1
            open_sums = add_word(line, before, start - 1, open_sums, out, crc, n)
            if len(out) >= CHUNK:
                done.append((np.array(out, dtype=np.uint32) % buckets).astype(np.uint16))
                out = []
        before = start
    if before is not None:
        words += 1
        add_word(line, before, len(line), open_sums, out, crc, n)
    done.append((np.array(out, dtype=np.uint32) % buckets).astype(np.uint16))
    return np.concatenate(done), words


def add_word(line, start, end, open_sums, out, crc, n):
    """Sums of the n-grams that end with this word: alone, and behind the words before it."""
    if n == 2:
        if open_sums:
            out.append(crc(line[start - 1 : end], open_sums[0]))
        here = crc(line[start:end])
        out.append(here)
        return [here]
    longer = [crc(line[start - 1 : end], s) for s in open_sums]
    sums = [*longer, crc(line[start:end])]
    out.extend(sums)
    return sums[-(n - 1) :] if n > 1 else []


def with_features(docs: DataFrame, n: int, buckets: int, key: str | None) -> DataFrame:
    """(key, words, features: two bytes a bucket) of every text."""
    prepared(docs.sparkSession)
    rows = docs.select(*([F.col(key).alias("key")] if key else [F.lit(None).cast("int").alias("key")]), "text")

    def run(batches):
        for part in parts(batches, 500):
            found = [hashed(collapsed(t), n, buckets) for t in byte_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w for _, w in found], type=pa.int64()), pa.array([f.tobytes() for f, _ in found], type=pa.binary())], names=["key", "words", "features"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, words long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; one row per bucket, whatever the number of texts, comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for f in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(f, dtype=np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    total = np.zeros(buckets, dtype=np.int64)
    for r in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    t, s, buckets = int(target.sum()), int(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(a + 1) * float(s + buckets) / (float(b + 1) * float(t + buckets)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times) a standard Gumbel number of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows (key, score, eligible, others) of a written table with rank: the highest scores of that share of the eligible rows, equal ones by key."""
    rows = scored.withColumn("_task", F.spark_partition_id())
    # Scores are whole thousandths of a bounded range, so this table is short; its running sum may take one task.
    heights = rows.where("eligible").groupBy("score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("score"))
    heights = heights.select("score", (F.sum("_n").over(above) - F.col("_n")).alias("_above"), F.floor(F.sum("_n").over(Window.partitionBy()) * share[0] / F.lit(share[1])).alias("_wanted"))
    rows = rows.join(heights.where("_above < _wanted"), "score", "left").withColumn("_in", F.col("eligible") & F.col("_above").isNotNull())
    names = [c for c in scored.columns if c != "rank"]
    inside = rows.where("_in")
    same = ["score", "_key", "_task"]
    inside = inside.withColumn("_key", F.struct("key"))
    counts = inside.groupBy(*same).agg(F.count("*").alias("_n"))
    counts = counts.select(*same, (F.sum("_n").over(Window.partitionBy("score").orderBy("_key", "_task")) - F.col("_n")).alias("_before"))
    ranked = inside.withColumn("_at", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))).join(counts, same)
    rank = F.col("_above") + F.col("_before") + F.col("_at")
    ranked = ranked.select(*names, F.when(rank <= F.col("_wanted"), rank).alias("rank"))
    return ranked.unionByName(rows.where("not coalesce(_in, false)").select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", n: int = 2, buckets: int = BUCKETS, least_words: int = 20, share: tuple[int, int] = (25, 100), seed: int = 7) -> DataFrame:
    """Every document with key, n_words, n_features, weight, score and rank (null: not drawn): share[0] of share[1] documents with least_words."""
    if buckets > 1 << 16:
        raise ValueError("buckets are kept in two bytes")
    scanned = written(with_features(docs, n, buckets, key), "features")
    gain = gains(bucket_counts(with_features(target, n, buckets, None), buckets), bucket_counts(scanned, buckets))

    def run(batches):
        for part in parts(batches, 500):
            found = [np.frombuffer(f, dtype=np.uint16) for f in part.column(2).to_pylist()]
            counts = [len(f) for f in found]
            weights = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, type=pa.int64()), pa.array(weights, type=pa.int64())], names=["key", "n_words", "n_features", "weight"])

    weighed = scanned.mapInArrow(run, f"key {dict(scanned.dtypes)['key']}, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("eligible", F.col("n_words") >= least_words), "scored")
    return draw(scored, share).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
