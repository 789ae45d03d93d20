"""SimHash near-duplicates with Golay-code fuzzy keys.

Fingerprint: 64 bits; a bit is 1 if more than half of the text's shingle hashes (XXH64 of the UTF-8 shingle) have it. Two
fingerprints link at `radius` = 3 or fewer differing bits.

Keys: a fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code [23, 12, 7] is perfect: every 23-bit word
lies within 3 bits of exactly one codeword, its decoding. Of three differing bits at most one segment gets two or more,
so some two segments differ by one bit at most each. If words x and y differ by one bit at most, the decoding of x is one of
the codewords within 4 bits of y (one codeword, or six if y lies 3 bits off its own). So for each pair of segments
(i, j) every fingerprint gives the keys (decoding of i, near codewords of j) as a left side and (near codewords of i, decoding of j) as a
right side, about 16 each in all: two linked fingerprints always share one of these 24-bit keys. The join on keys verifies the distance
in its condition, so no unverified pair leaves it.

Groups of copies: equal fingerprints are one row from the start. A key with more than `dense` fingerprints is not joined:
its fingerprints name the centres within 2 bits of themselves; those within 1 bit of a centre elect the least as a hub,
and all within 2 bits link to the hub. Such links are at most 3 bits long, and every two fingerprints that differ by at
most 3 bits meet at a centre, so the components are the same, with a fixed number of rows per fingerprint.

Defined results: null and empty texts and texts of white space have fingerprint zero and link like any other. Fewer words than a shingle
are one shingle. Documents without an id get the id of their component too, null if none has an id. Repeated
rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import components, written
from colloquy.llm.texts import map_texts, prepared

SHINGLE = 3
SEED = 42
RADIUS = 3
DENSE = 4096
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code, and the segments as (shift, bits).
GENERATOR = 0b110001110101
SEGMENTS = ((41, 23), (18, 23), (0, 18))
BLOCK = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED):
    """Hashes of the text's word shingles, repeats included, a block at a time."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype=">u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text, shingle, seed):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: words modulo the generator polynomial."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of up to 4 bits that have it, lightest first, filled up to six with the first."""
    found = defaultdict(list)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            found[int(_remainders(np.array([sum(1 << b for b in bits)]))[0])].append(sum(1 << b for b in bits))
    return np.array([(found[s] + found[s][:1] * 6)[:6] for s in range(2048)])


_patterns: list[np.ndarray] = []


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of six codewords within 4 bits of each 23-bit word; the first is its decoding, repeats fill up."""
    if not _patterns:
        _patterns.append(_error_patterns())
    return (words[:, None] ^ _patterns[0][_remainders(words)]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right keys, 18 columns each; a row may repeat a key."""
    f = fingerprints.astype(np.uint64)
    near = [codewords((f >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    left, right = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        left.append(p << 24 | near[i][:, :1] << 12 | near[j])
        right.append(p << 24 | near[i] << 12 | near[j][:, :1])
    return np.hstack(left), np.hstack(right)


def _keyed(batches):
    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False)
        for side, keys in enumerate(fuzzy_keys(f.view(np.uint64))):
            row, key = np.unique(np.column_stack([np.repeat(np.arange(len(f)), keys.shape[1]), keys.ravel()]), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(f[row]), pa.array(key.astype(np.int32)), pa.array(np.full(len(row), side, dtype=np.int32))], names=["fp", "key", "side"])


def _centres(batches):
    """Every fingerprint with the words within 2 bits of it; inner: within 1."""
    bits = [1 << b for b in range(64)]
    masks = np.array([0, *bits, *(x ^ y for x, y in combinations(bits, 2))], dtype=np.uint64)
    inner = np.arange(len(masks)) < 65
    for batch in batches:
        for part in np.array_split(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 1 + batch.num_rows // 256):
            reach = (part[:, None] ^ masks).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(reach), pa.array(np.tile(inner, len(part)))], names=["fp", "centre", "inner"])


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b: long) whose components are those of all pairs of distinct fingerprints `fp` at 3 or fewer differing bits."""
    prepared(prints.sparkSession)
    keyed = prints.select("fp").mapInArrow(_keyed, "fp long, key int, side int")
    crowded = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("key"), "crowded")
    if crowded.isEmpty():
        sparse, hot = keyed, None
    else:
        sparse, hot = keyed.join(crowded, "key", "left_anti"), keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    a = sparse.where("side = 0").select(F.col("fp").alias("a"), "key")
    b = sparse.where("side = 1").select(F.col("fp").alias("b"), F.col("key").alias("key_b"))
    pairs = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    return pairs.distinct() if hot is None else pairs.unionByName(ball_links(hot)).distinct()


def ball_links(prints: DataFrame) -> DataFrame:
    """The same links for crowded keys through common centres; the rows grow with the fingerprints, not with their pairs."""
    prepared(prints.sparkSession)
    reach = prints.select("fp").mapInArrow(_centres, "fp long, centre long, inner boolean")
    hubs = reach.where("inner").groupBy("centre").agg(F.min("fp").alias("hub"))
    return reach.join(hubs, "centre").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """All columns of docs and fp (the fingerprint as a signed 64-bit number)."""
    return map_texts(docs, "fp long", lambda texts: [pa.array(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))])


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) for every document."""
    marked = written(with_fingerprints(docs.select("doc_id", "text"), shingle, seed).select("doc_id", "fp"), "fingerprints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints, dense)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left")


def one_of_each(docs: DataFrame, grouped=near_duplicates, **options) -> DataFrame:
    """The document with the smallest doc_id of every component, all columns; documents without an id all stay.

    Components are those of `grouped`, which gives doc_id and component_id. Of repeated rows of such a document one stays.
    """
    found = written(grouped(docs, **options).select("doc_id", "component_id"), "components")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n"))
    stay = docs.join(kept.select(F.col("doc_id").alias("_id"), "_n"), F.col("doc_id") == F.col("_id"), "left").where("_id is not null or doc_id is null")
    once = stay.where("_n is null or _n = 1").drop("_id", "_n")
    if kept.where("_n > 1").isEmpty():
        return once
    again = stay.where("_n > 1").drop("_id", "_n")
    rest = [c for c in docs.columns if c != "doc_id"]
    packed = again.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return once.unionByName(packed.select("doc_id", "_row.*"))
