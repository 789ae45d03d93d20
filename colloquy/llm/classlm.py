"""Scoring by a class-based bigram model with exchange clustering.

Every word has a class; a token's probability is P(class | class before) * P(word | class). Counts of words and of neighbouring
symbols are gathered from all training texts. A symbol is one of the `own_symbols` most frequent words, or for any other word one of
`kinds` endings; the exchange algorithm moves symbols between `classes` classes while the likelihood of the class bigrams grows.
Its input, the symbol bigram matrix, is of a size fixed by these two numbers, so the driver can do it whatever the size of the corpus.

Scoring: the counts of the `head_words` most frequent words go to every task (a bound on what is sent); words
beyond them meet their counts in a join, so every known word is scored by its own count. An unknown word is scored as
the unknown word of its class. Classes are smoothed with their overall frequencies, words by adding one half.

Defined results: a null or empty text is its end alone. Without training texts every count is zero. Null ids count as the
empty text for the fold. Repeated rows are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.shared import written
from colloquy.llm.texts import byte_texts, parts, prepared

END = b""
OWN_SYMBOLS, KINDS, CLASSES, HEAD_WORDS = 2000, 500, 64, 131_072


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def kind(word: bytes, kinds: int = KINDS) -> int:
    """One of `kinds` numbers from the ending of a word."""
    return zlib.crc32(word[-3:]) % kinds


class Symbols(dict):
    """Symbol of a word: 0 for the end, its own number for a frequent word, else a number of its kind."""

    def __init__(self, own: list[bytes], kinds: int):
        super().__init__({END: 0} | {w: i + 1 for i, w in enumerate(w for w in own if w != END)})
        self.own, self.kinds = len(self), kinds

    def __missing__(self, word: bytes) -> int:
        return self.own + kind(word, self.kinds)

    def __reduce__(self):
        return Symbols, (sorted(self, key=self.__getitem__)[1:], self.kinds)

    @property
    def size(self) -> int:
        return self.own + self.kinds


def slices(texts: list[bytes], size: int = 8 << 20):
    """Texts in groups of some megabytes, so that what a task holds doesn't depend on the batch."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word counts the ends."""
    prepared(texts.sparkSession)

    def count(batches):
        for batch in parts(batches, 2500):
            for group in slices(byte_texts(batch.column(0))):
                n = Counter()
                for t in group:
                    n.update(words_of(t))
                n[END] += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """(pair, n): pair is first symbol * symbols.size + second; a text stands between two ends."""

    def count(batches):
        for batch in parts(batches, 2500):
            for group in slices(byte_texts(batch.column(0))):
                codes = [0]
                for t in group:
                    codes.extend(map(symbols.__getitem__, words_of(t)))
                    codes.append(0)
                codes = np.array(codes, dtype=np.int64)
                pair, n = np.unique(codes[:-1] * symbols.size + codes[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return texts.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(matrix: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each symbol: each in turn, most frequent first, goes where the likelihood of class bigrams grows most.

    Starts with the symbols dealt out by rank; ends when a sweep moves none. Symbols that never occur stay where they are.
    """
    s = len(matrix)
    matrix = matrix.astype(np.float64)
    weight = matrix.sum(axis=0) + matrix.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    label = np.empty(s, dtype=np.int64)
    label[order] = np.arange(s) % classes
    one = np.eye(classes)[label]
    table = one.T @ matrix @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                break
            here, self_ = label[w], matrix[w, w]
            row, column = matrix[w].copy(), matrix[:, w].copy()
            row[w] = column[w] = 0
            after = np.bincount(label, weights=row, minlength=classes)
            before = np.bincount(label, weights=column, minlength=classes)
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= self_
            # Likelihood of each class with the word minus that without, except where row and column of the class cross.
            gain = (_xlogx(table + after) - _xlogx(table)).sum(axis=1) + (_xlogx(table + before[:, None]) - _xlogx(table)).sum(axis=0)
            cross = np.diag(table)
            gain += _xlogx(cross + after + before + self_) - _xlogx(cross + after) - _xlogx(cross + before) + _xlogx(cross)
            left, right = table.sum(axis=1), table.sum(axis=0)
            gain -= _xlogx(left + after.sum() + self_) - _xlogx(left) + _xlogx(right + before.sum() + self_) - _xlogx(right)
            best = int(gain.argmax())
            if gain[best] <= gain[here] + 1e-9 * abs(gain[here]):
                best = here
            table[best] += after
            table[:, best] += before
            table[best, best] += self_
            moved += best != here
            label[w] = best
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Model:
    """What tasks need; the counts of all other words are a table."""

    symbols: Symbols
    label: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    head: dict[bytes, int]
    tokens: int
    distinct: int

    @property
    def base_divisor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def fit(texts: DataFrame, *, own_symbols: int = OWN_SYMBOLS, kinds: int = KINDS, classes: int = CLASSES, head_words: int = HEAD_WORDS, prior: float = 20.0) -> tuple[Model, DataFrame]:
    """Model and table of word counts (word, n) from all given texts."""
    counts = written(count_words(texts), "word_counts")
    sums = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).head()
    top = counts.orderBy(F.desc("n"), "word").limit(max(head_words, own_symbols)).toArrow()
    head = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    symbols = Symbols([w for w in list(head)[:own_symbols] if w != END], kinds)
    # Arrow, since rows of Python objects would need many times the memory: at most symbols.size squared pairs of numbers.
    found = count_bigrams(texts, symbols).toArrow()
    matrix = np.zeros(symbols.size**2, dtype=np.float32)
    matrix[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    del found
    matrix = matrix.reshape(symbols.size, symbols.size)
    label = exchange(matrix, classes)

    def shape(batches):
        for batch in batches:
            which = np.array([symbols[w] for w in batch.column(0).to_pylist()], dtype=np.int64)
            n, v = np.bincount(which, weights=batch.column(1).to_numpy(), minlength=symbols.size), np.bincount(which, minlength=symbols.size)
            used = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used].astype(np.int64)), pa.array(v[used].astype(np.int64))], names=["symbol", "n", "v"])

    sizes = counts.mapInArrow(shape, "symbol long, n long, v long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    of = label[sizes.column("symbol").to_numpy()]
    n, v = (np.bincount(of, weights=sizes.column(x).to_numpy(), minlength=classes) for x in ("n", "v"))
    one = np.eye(classes)[label]
    pairs = one.T @ matrix.astype(np.float64) @ one
    overall = (n + 0.5) / (n + 0.5).sum()
    transition = np.log10((pairs + prior * overall) / (pairs.sum(axis=1, keepdims=True) + prior))
    emission = -np.log10(n + 0.5 * (v + 1))
    return Model(symbols, label, transition, emission, dict(list(head.items())[:head_words]), int(sums["tokens"] or 0), int(sums["distinct"])), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the whole text) and perplexity, with other columns of docs but text.

    One pass scores all but the counts of rare words; those are joined on the word and summed per row.
    """
    prepared(docs.sparkSession)
    clash = ("text", "n_tokens", "n_known", "base_score", "score", "perplexity")
    keep = [c for c in docs.columns if c.lower() not in clash]
    packed = docs.select(F.struct(*keep).alias("row"), "text")
    schema = "uid long, n_tokens long, head_known long, head_logs double, model_logs double, rare array<binary>, times array<int>"

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        symbols, label, head = model.symbols, model.label, model.head
        logs = {w: float(np.log10(n + 0.5)) for w, n in head.items()}
        for batch in parts(batches):
            texts, rows = byte_texts(batch.column(1)), {k: [] for k in ("uid", "n_tokens", "head_known", "head_logs", "model_logs", "rare", "times")}
            for text in texts:
                words = words_of(text)
                words.append(END)
                c = label[np.fromiter(map(symbols.__getitem__, words), dtype=np.int64, count=len(words))]
                known = [x for x in map(logs.get, words) if x is not None]
                rare = Counter(w for w in words if w not in logs) if len(known) < len(words) else {}
                before = np.concatenate([label[:1], c[:-1]])
                for k, x in zip(rows, (uid, len(words), len(known), sum(known), float(model.transition[before, c].sum() + model.emission[c].sum()), list(rare.keys()), list(rare.values())), strict=True):
                    rows[k].append(x)
                uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True))], names=["row", *rows])

    passed = written(packed.mapInArrow(run, StructType([packed.schema["row"], *StructType.fromDDL(schema).fields])), "scored")
    rare = passed.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(counts, "word", "left")
    late = met.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("late_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("late_known"))
    whole = passed.drop("rare", "times").join(late, "uid", "left")
    logs = F.col("head_logs") + F.coalesce("late_logs", F.lit(0.0))
    whole = whole.select(
        *(F.col("row").getField(c).alias(c) for c in keep), "n_tokens", (F.col("head_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        (logs - F.col("n_tokens") * float(np.log10(model.base_divisor))).alias("base_score"), (logs + F.col("model_logs")).alias("score"),
    )
    return whole.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
