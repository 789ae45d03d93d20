"""Near spellings of the aliases of a vocabulary.

The score of two words is twice their longest common subsequence over both lengths, in percent. A score asks for a least subsequence L by the
lengths n (alias) and m (token) alone. Of the n - 1 letter pairs of the alias, each of its n - L dropped letters spoils two at most and each
of the m - L put in one, so the rest must stand in the token: any 2 (n - L) + (m - L) + 1 pairs of the alias hold one that does. The rarest
ones are the keys of the alias for tokens of that length; a token has a key for each of its pairs. What meets is compared by
letter counts in the join, then by a bit-parallel subsequence in Arrow batches.

Pairs of letters are never rare in a large vocabulary, where what meets grows with tokens times aliases. Aliases of a length that many share meet
tokens by subsequences instead: L letters are common to both words just where one of the subsequences of L letters is the same, so each word has
C(n, L) or C(m, L) keys, whatever the others are, and what shares a key is near enough. Each key keeps its first alias only, so no pairs of words become rows.
Lengths that would take too many keys are left to the letter pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb, floor
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import ship_package, written

#: Least score, and least length of an alias.
FUZZY_FROM, FUZZY_MIN_CHARS = 88, 6
#: The aliases of one length from which on these meet tokens by subsequences, the most of them a word may have, and how many leave a worker at once.
MANY, MOST_KEYS, KEYS_AT_ONCE = 200, 1_000, 50_000


def common(masks: dict[str, int], n: int, token: str) -> int:
    """Length of the longest common subsequence of a token and an alias of n letters, whose places are the bits of masks."""
    full = (1 << n) - 1
    v = full
    for c in token:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def similarity(token: str, alias: str) -> float:
    masks: dict[str, int] = {}
    for i, c in enumerate(alias):
        masks[c] = masks.get(c, 0) | 1 << i
    return 200.0 * common(masks, len(alias), token) / (len(alias) + len(token)) if token or alias else 100.0


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substr(word, i, F.lit(2)))


def _letters(word: Column) -> Column:
    """Letters with their number among equal ones: shared elements of two such arrays are shared letters with repeats."""
    letters = F.sort_array(F.filter(F.split(word, ""), lambda c: c != ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def _least(n: Column, m: Column, score: int) -> Column:
    return F.ceil(F.lit(score) * (n + m) / 200).cast("int")


def _scores(batches):
    last, masks = None, {}
    for b in batches:
        out = []
        for token, alias in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if alias != last:
                last, masks = alias, {}
                for i, c in enumerate(alias):
                    masks[c] = masks.get(c, 0) | 1 << i
            out.append(200.0 * common(masks, len(alias), token) / (len(alias) + len(token)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=["low", "alias", "rank", "replacement", "score"])


def _subsequences(todo: dict[int, list[tuple[int, int]]]):
    """For words (last column, of letters) of length m all different subsequences of k letters, for each (n, k) in todo[m]."""

    def keys(batches):
        for b in batches:
            at, ns, found, held = [], [], [], 0
            for i, word in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for n, k in todo.get(len(word), ()):
                    own = list(set(map("".join, combinations(word, k))))
                    at.append(i)
                    ns.append(n)
                    found.append(own)
                    held += len(own)
                if held >= KEYS_AT_ONCE:
                    yield _beside(b, at, ns, found)
                    at, ns, found, held = [], [], [], 0
            if at:
                yield _beside(b, at, ns, found)

    return keys


def _beside(b: pa.RecordBatch, at: list[int], ns: list[int], found: list[list[str]]) -> pa.RecordBatch:
    own = b.take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(ns, pa.int32()), pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, "n", "keys"])


def _classes(lengths: list[int], score: int) -> dict[tuple[int, int], int]:
    """Least subsequence of each two lengths (alias, token) that can be near enough, as near_words spreads them."""
    each = ((n, m, ceil(score * (n + m) / 200)) for n in lengths for m in range(max(floor(score * n / (200 - score)), 2), ceil((200 - score) * n / max(score, 1)) + 1))
    return {(n, m): k for n, m, k in each if k <= min(n, m)}


def _first_by_subsequences(words: DataFrame, known: DataFrame, classes: dict[tuple[int, int], int], parts: int) -> DataFrame:
    """The first alias (low, alias, rank, replacement) of each word (low, m) that has one, for the lengths in classes."""
    by_alias: dict[int, set[tuple[int, int]]] = {}
    by_token: dict[int, list[tuple[int, int]]] = {}
    for (n, m), k in classes.items():
        by_alias.setdefault(n, set()).add((n, k))
        by_token.setdefault(m, []).append((n, k))
    # Few bytes stand for many keys, so the words are dealt out first.
    own = known.filter(F.col("rank").isNotNull() & F.col("n").isin(*by_alias)).select("rank", "replacement", "alias").repartition(parts)
    own = own.mapInArrow(_subsequences({n: sorted(ks) for n, ks in by_alias.items()}), "rank int, replacement string, alias string, n int, keys array<string>")
    first = own.select("n", F.explode("keys").alias("key"), F.struct("rank", "replacement", "alias").alias("b")).groupBy("n", "key").agg(F.min("b").alias("b"))
    met = words.filter(F.col("m").isin(*by_token)).select("low").repartition(parts).mapInArrow(_subsequences(by_token), "low string, n int, keys array<string>")
    # Dealt out before the join, so that its size is known and not guessed from the words.
    each = met.select("low", "n", F.explode("keys").alias("key")).repartition("n", "key")
    best = each.join(first, ["n", "key"]).groupBy("low").agg(F.min("b").alias("b"))
    return best.select("low", "b.alias", "b.rank", "b.replacement")


def near_words(tokens: DataFrame, aliases: DataFrame, score: int = FUZZY_FROM, least_chars: int = FUZZY_MIN_CHARS) -> DataFrame:
    """The first alias (rank, replacement, alias) that each distinct token (text) is near enough to: token, replacement, alias, score; compared in lower case."""
    ship_package(tokens.sparkSession)
    # Both are read several times, whatever they are made of once.
    distinct = written(tokens.select(F.col("text").alias("token")).filter("token is not null").distinct().withColumn("low", F.lower("token")), "tokens")
    known = written(aliases.filter(F.length("alias") >= least_chars).select("rank", "replacement", F.lower("alias").alias("alias")).withColumn("n", F.length("alias")), "aliases")
    words = distinct.select("low").distinct().withColumn("m", F.length("low")).filter("m >= 2")
    parts = 4 * tokens.sparkSession.sparkContext.defaultParallelism
    often = {r.n: r.often for r in known.groupBy("n").agg(F.count("*").alias("often")).collect()}
    classes = _classes(sorted(often), score)
    by_keys = {(n, m): k for (n, m), k in classes.items() if often[n] >= MANY and max(comb(n, k), comb(m, k)) <= MOST_KEYS}
    scored = "low string, alias string, rank int, replacement string, score double"
    found = [_first_by_subsequences(words, known, by_keys, parts).mapInArrow(_scores, scored)] if by_keys else []
    if len(by_keys) < len(classes) or not found:
        found.append(_pairs_met(words, known, by_keys, score, parts).mapInArrow(_scores, scored).filter(F.col("score") >= score))
    best = reduce(DataFrame.unionByName, found).groupBy("low").agg(F.min(F.struct("rank", "replacement", "alias", "score")).alias("b"))
    return distinct.join(best, "low").select("token", "b.replacement", "b.alias", "b.score")


def _pairs_met(words: DataFrame, known: DataFrame, without: dict[tuple[int, int], int], score: int, parts: int) -> DataFrame:
    """Words (low, m) and aliases (low, alias, rank, replacement) that share a rare letter pair and enough letters, but for the lengths in `without`."""
    # Letters are counted before the rows of a word multiply, once a word.
    words = words.withColumn("letters", _letters(F.col("low")))
    least = _least(F.col("n"), F.col("m"), score)
    # Lengths m whose least subsequence fits into both words.
    shortest, longest = F.floor(score * F.col("n") / (200 - score)), F.ceil((200 - score) * F.col("n") / max(score, 1))
    spread = known.select("rank", "alias", "n", F.explode(F.sequence(F.greatest(shortest, F.lit(2)).cast("int"), longest.cast("int"))).alias("m")).filter(least <= F.least("n", "m"))
    if without:
        spread = spread.filter(~reduce(or_, ((F.col("n") == n) & F.col("m").isin(*(m for a, m in without if a == n)) for n in {n for n, _ in without})))
    keyed = words.select("low", "m", F.explode(F.array_distinct(_pairs(F.col("low")))).alias("pair"), "letters")
    often = words.select(F.explode(F.array_distinct(_pairs(F.col("low")))).alias("pair")).groupBy("pair").agg(F.count("*").alias("often"))
    placed = spread.select("rank", "alias", "m", (2 * (F.col("n") - least) + F.col("m") - least + 1).alias("asked"), F.posexplode(_pairs(F.col("alias"))).alias("at", "pair"))
    # An alias has few letter pairs and few lengths to meet, so these windows are small whatever the tables hold.
    rare = Window.partitionBy("rank", "alias", "m").orderBy(F.coalesce("often", F.lit(0)), "at")
    chosen = placed.join(often, "pair", "left").withColumn("nth", F.row_number().over(rare)).filter("nth <= asked").select("rank", "alias", "m", "pair").distinct()
    chosen = chosen.join(known.withColumn("alias_letters", _letters(F.col("alias"))), ["rank", "alias"]).withColumn("least", least)
    # Few bytes stand for much work here, so the parts are not left to their size.
    met = keyed.join(chosen.repartition(parts), ["m", "pair"]).filter(F.size(F.array_intersect("letters", "alias_letters")) >= F.col("least"))
    return met.select("low", "alias", "rank", "replacement").distinct().repartition(parts)
