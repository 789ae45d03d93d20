"""Near-duplicates by the similarity of word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles (lower case, white space as `split`
cuts it) is 0.8 or more; groups are the connected components of these pairs. Shingles are compared by 64-bit hashes.

Signature: every shingle falls into one of `BINS` bins, which keep their least hash; an empty bin takes the value of another one, tried in
an order that is the same for all texts (one permutation hashing, densified). One hash a shingle gives what `BINS` hash functions would.

Candidates: `BANDS` keys a text, each of `ROWS` bins. Two texts of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS:
0.9994 at 0.8, more above, 0.14 at 0.5. A pair that shares a key is a candidate unless its numbers of shingles alone put it below the similarity, or
one bit of each bin's value says that it is `DEVIATIONS` standard deviations below. Both are tested in the join. Then the similarity is computed from the two texts.

Groups of copies: texts of equal words are one node from the start. For nodes of keys with more than `CROWD` nodes the shingles that no other such node has
are counted: they can't be shared, which bounds the similarity of every pair and leaves copies with many changes without possible partners. Of what is left,
only the pairs with a hub are compared first, the node of the key that shares most keys with others, as an original does. After the turns of `HUBS` (one hub
a key; more turns may take a hub in each of several hash classes) every pair of two parts is compared, nodes outside of the largest part of a key with all
its nodes. So no candidate pair across two parts goes untested.

Defined results: null and empty texts and texts of white space have no words and are equal. Fewer words than a shingle are one shingle.
Documents without an id get the id of their component too, null if none has an id. Repeated rows give repeated results. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import components, written
from colloquy.llm.simhash import SEED, shingle_hashes
from colloquy.llm.texts import byte_texts, map_texts, parts, prepared

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS, BINS = 40, 8, 512
DEVIATIONS = 5.5
#: Nodes of a key up to which all its pairs are compared at once; hash classes with a hub each, by turn, of keys with more.
CROWD, HUBS = 16, (1,)
#: Different shingles that a task holds while it counts them.
HELD = 500_000
ATTEMPTS = 64
BITS = tuple(f"bits{i}" for i in range(BINS // 64))
NODE = ("node", "n", "free", *BITS)
_draw = np.random.default_rng(SEED)
SOURCES = _draw.integers(BINS, size=(ATTEMPTS, BINS))
FACTORS = _draw.integers(1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = np.iinfo(np.uint64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of every bin for each set of shingles, without empty bins; sets without any shingle have EMPTY everywhere."""
    out = np.full((len(sets), BINS), EMPTY, dtype=np.uint64)
    for row, shingles in zip(out, sets, strict=True):
        values = np.sort(mixed(shingles))[::-1]
        row[(values % np.uint64(BINS)).astype(np.int64)] = values  # the least one is written last
    full = out != EMPTY
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    for tried in SOURCES:
        if not len(rows):
            return out
        source = tried[bins]
        found = full[rows, source]
        out[rows[found], bins[found]] = out[rows[found], source[found]]
        rows, bins = rows[~found], bins[~found]
    least = np.where(full, out, EMPTY).min(axis=1)
    out[rows, bins] = least[rows]
    return out


def marks(texts: list[bytes], shingle: int = SHINGLE) -> list[pa.Array]:
    """Digest of the words, number of different shingles, keys and bits of each text."""
    sets = [shingle_set(t, shingle) for t in texts]
    values = signatures(sets)
    bands = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    keys = mixed((bands * FACTORS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    bits = np.packbits((mixed(values) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
    columns = [pa.array(list(map(words_digest, texts)), pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
    return [*columns, pa.array(list(keys), pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)]


def possible(a: str, b: str, similarity: float) -> Column:
    """Whether two nodes may be similar, by their numbers of shingles, those that may be shared (`free`) and their bits."""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    differing = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITS[1:]), F.bit_count(F.col(f"{a}.{BITS[0]}").bitwiseXOR(F.col(f"{b}.{BITS[0]}"))))
    share = (1 - similarity) / 2
    limit = BINS * (F.lit(share) + DEVIATIONS * (share * (1 - share)) ** 0.5 / F.sqrt(F.greatest(F.least(low, F.lit(BINS)), F.lit(1))))
    both = F.least(f"{a}.free", f"{b}.free", low)
    return (both >= similarity * (low + high - both)) & (differing <= limit)


def words_digest(text: bytes) -> bytes:
    """128 bits of the words of a text."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(b.astype(np.uint64) for b in shingle_hashes(text, shingle))]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts (node, text) are similar."""

    def check(batches):
        last, mine = None, None
        for part in parts(batches, 250):
            left, right = byte_texts(part.column(2)), byte_texts(part.column(3))
            passed = []
            for x, y in zip(left, right, strict=True):
                if mine is None or x != last:
                    last, mine = x, shingle_set(x, shingle)
                passed.append(likeness(mine, shingle_set(y, shingle)) >= similarity)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    # The node in very many pairs is the one of the second join, whose other side has one row per node.
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def sole_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, sole): how many shingles of each text (node, text) no other one has; nodes without any are missing. Counts are combined in the tasks."""

    def run(batches):
        held: dict[int, list[int]] = {}

        def rows():
            keys = np.fromiter(held, dtype=np.uint64, count=len(held)).view(np.int64)
            out = np.array(list(held.values()), dtype=np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["shingle", "n", "node"])

        for part in parts(batches, 250):
            for node, text in zip(part.column(0).to_pylist(), byte_texts(part.column(1)), strict=True):
                for h in shingle_set(text, shingle).tolist():
                    if (seen := held.get(h)) is None:
                        held[h] = [1, node]
                    else:
                        seen[0] += 1
                if len(held) > HELD:
                    yield rows()
        yield rows()

    counted = texts.select("node", "text").mapInArrow(run, "shingle long, n long, node long")
    return counted.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("sole"))


def hub_pairs(crowded: DataFrame, classes: int, similarity: float) -> DataFrame:
    """Possible pairs (a, b) across roots of all nodes of each key with its hubs, in each hash class the node that shares most keys."""
    best = F.max(F.struct("degree", F.xxhash64("node").alias("at"), F.struct(*NODE, "root").alias("hub"))).alias("most")
    hubs = crowded.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(classes)).alias("class")).agg(best).select("key", "most.hub.*")
    both = crowded.alias("x").join(hubs.alias("h"), (F.col("x.key") == F.col("h.key")) & (F.col("x.root") != F.col("h.root")) & possible("x", "h", similarity))
    return both.select(F.least("x.node", "h.node").alias("a"), F.greatest("x.node", "h.node").alias("b"))


def cross_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """Possible pairs (a, b) of nodes of a key and of different roots: nodes outside of a key's largest root with all."""
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    major = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("most.root").alias("major"))
    open_keys = rooted.join(major, "key")
    minor = open_keys.where("root <> major")
    # A pair that shares several keys comes from the least of them, whatever the largest root of each is.
    first = F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("x.key")
    both = minor.alias("x").join(open_keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))) & possible("x", "y", similarity) & first)
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def links(keyed: DataFrame, texts: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, hubs: tuple[int, ...] = HUBS) -> DataFrame:
    """Links (a, b: long) whose components are those of all similar pairs of nodes that share a key of keyed (key, node, n, bits)."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"))
    few = keyed.join(sizes.where(F.col("size") <= crowd).select("key"), "key").withColumn("free", F.col("n"))
    todo = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & possible("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    dense = written(keyed.join(sizes.where(F.col("size") > crowd), "key"), "dense")
    if dense.isEmpty():
        return verified(todo.distinct(), texts, shingle, similarity)
    members = dense.groupBy("node").agg(F.sum("size").alias("degree"), F.array_sort(F.collect_set("key")).alias("keys"))
    # Sole among the nodes of all crowded keys, which holds for any two of one key.
    sole = members.join(sole_shingles(texts.join(members.select("node"), "node"), shingle), "node", "left").select("node", "degree", "keys", F.coalesce("sole", F.lit(0)).alias("sole"))
    crowded = written(dense.join(sole, "node").withColumn("free", F.col("n") - F.col("sole")).select("key", *NODE, "degree", "keys"), "crowded")
    found, rooted = [], crowded.withColumn("root", F.col("node"))
    for turn, classes in enumerate(hubs):
        pairs = hub_pairs(rooted, classes, similarity)
        found.append(written(verified((pairs.unionByName(todo) if turn == 0 else pairs).distinct(), texts, shingle, similarity), "similar"))
        roots = components(reduce(DataFrame.unionByName, found))
        rooted = written(crowded.join(roots, "node", "left").select("key", *NODE, "degree", "keys", F.coalesce("root", "node").alias("root")), "rooted")
    rest = cross_pairs(rooted, similarity)
    found.append(verified((rest if hubs else rest.unionByName(todo)).distinct(), texts, shingle, similarity))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, hubs: tuple[int, ...] = HUBS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links, itself included) for every document."""
    prepared(docs.sparkSession)
    columns = f"digest binary, n long, keys array<long>, {', '.join(f'{b} long' for b in BITS)}"
    marked = written(map_texts(docs.select("doc_id", "text"), columns, lambda texts: marks(texts, shingle)).drop("text"), "marked")
    one = F.first(F.struct("n", "keys", *BITS)).alias("one")
    nodes = written(marked.groupBy("digest").agg(F.min("doc_id").alias("first"), one).select("digest", "first", "one.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select(F.explode("keys").alias("key"), "node")
    shared = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    shared = written(spread.join(shared, "key"), "shared")
    keyed = written(shared.join(nodes.select("node", "n", *BITS), "node").select("key", "node", "n", *BITS), "keyed")
    # The texts of nodes that share a key, one of each.
    asked = shared.select("node").distinct().join(nodes, "node").select("node", "digest")
    again = map_texts(docs.select("text"), "digest binary", lambda texts: [pa.array(list(map(words_digest, texts)), pa.binary())])
    texts = written(again.join(asked, "digest").groupBy("node").agg(F.min("text").alias("text")), "texts")
    roots = components(links(keyed, texts, shingle=shingle, similarity=similarity, crowd=crowd, hubs=hubs))
    rooted = nodes.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select("doc_id", "digest").join(rooted.join(least, "root").select("digest", "component_id"), "digest", "left").select("doc_id", "component_id")
