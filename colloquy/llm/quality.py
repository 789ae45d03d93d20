"""Quality rules: an isolation forest over rule statistics.

Every text is reduced to counts (words, symbols, repeated lines, repeated three-word windows, capitals, digits, different words). Two forests of
random splits are grown on a bounded sample of labelled rows; a document that random splits isolate early is anomalous.

- Marks: shares of symbols, repeated words, capitals and exclamations, in the box of all labelled rows. Its threshold rejects most bad rows
  while it rejects at most `clean_loss` of the good ones.
- Shape: shares of digits and repeated lines, length of words, how fast different words grow, words per line. Its box reaches the range of good rows
  beyond them on every side, since junk of kinds without labels lies there. No label tells where to stop, so the threshold lies
  `EDGE` of the way from the score that all but `clean_loss` of the good rows stay under to that of the box's corners.

Defined results: a null or empty text has no words, so base_failed is true. A table without usable labels gives a forest of
no trees, which rejects nothing beyond the base rules. Repeated rows are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import CONTINUATION, SPACES, map_texts, word_codes

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_distinct", "n_marks")
FEATURES = ("symbol_share", "repeat_share", "capital_share", "mark_share")
SHAPES = ("digit_share", "repeated_line_share", "word_length", "growth_of_words", "words_per_line")
BEYOND, EDGE = 1.0, 1 / 4


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a three-word window found at least twice in the text, and the number of distinct words."""
    n = len(words)
    if n == 0:
        return 0, 0
    codes = word_codes(words)
    distinct = int(codes.max()) + 1
    if n < 4:
        return 0, distinct
    # Pairs get dense numbers first, so that any vocabulary fits into 64 bits.
    pairs = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)[1]
    _, where, count = np.unique(pairs[:-1] * np.int64(distinct) + codes[2:], return_inverse=True, return_counts=True)
    twice = count[where] >= 2
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum()), distinct


def rule_counts(text: bytes) -> tuple[int, ...]:
    """The counts named in COUNTS."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats, distinct = repeated_words(words)
    return (
        len(words), len(text.translate(None, CONTINUATION + SPACES)), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeats, len(lines), len(text) - len(text.translate(None, CAPITALS)),
        len(text) - len(text.translate(None, DIGITS)), distinct, text.count(b"!") + text.count(b"?"),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Rule statistics, one row per document: square roots of shares, so that small shares are told apart from none."""
    words, chars, symbols, _, repeat, _, capitals, _, _, marks = counts.astype(np.float64).T
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    return np.sqrt(np.column_stack([symbols / per_char, repeat / per_word, capitals / per_char, marks / per_word]))


def shapes(counts: np.ndarray) -> np.ndarray:
    """The statistics named in SHAPES, one row per document; sizes as logarithms."""
    words, chars, _, repeated, _, lines, _, digits, distinct, _ = counts.astype(np.float64).T
    per_word, per_char, per_line = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    growth = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2))
    return np.column_stack([np.sqrt(digits / per_char), np.sqrt(repeated / per_line), np.log(per_char / per_word), growth, np.log(per_word / per_line)])


def base_failed(counts: np.ndarray, min_words: int = 50, repeat_percent: int = 50) -> np.ndarray:
    words, repeat = counts[:, 0], counts[:, 4]
    return (words < min_words) | (100 * repeat > repeat_percent * words)


def mean_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of a failed search in a random binary tree over n rows: what a leaf of n rows still lacks."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1)
    safe = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(safe) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: a node has a feature (-1: leaf), a split value, a left child (the right one follows) and a depth."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int
    threshold: float
    shape: Forest | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 ** -(mean path length / expected path length)."""
        if not len(self.roots):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(float(mean_depth(self.sample)), 1e-9))

    @staticmethod
    def grown(x: np.ndarray, good: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        """Each tree divides the box that holds all rows at random, and keeps `sample` good rows.

        A part of the box without good rows ends a path at once. Bad rows come in large groups of their own kind; as members
        of the sample they would hide each other, so they only widen the box. Without good rows all rows are kept.
        """
        rng = np.random.default_rng(seed)
        fine = x[good] if good.any() else x
        sample = min(sample, len(fine))
        limit = int(np.ceil(np.log2(max(sample, 2)))) + 4
        feature, value, left, depth, roots = [], [], [], [], []

        def node() -> int:
            feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
            return len(feature) - 1

        for _ in range(trees if len(x) > 1 else 0):
            roots.append(node())
            todo = [(roots[-1], fine[rng.choice(len(fine), sample, replace=False)], 0, x.min(axis=0), x.max(axis=0))]
            while todo:
                at, rows, level, low, high = todo.pop()
                wide = np.flatnonzero(high > low)
                if level >= limit or len(rows) <= 1 or not len(wide):
                    depth[at] = level + float(mean_depth(len(rows)))
                    continue
                f = int(rng.choice(wide))
                split = rng.uniform(low[f], high[f])
                right = rows[:, f] >= split
                a, b = node(), node()
                feature[at], value[at], left[at] = f, split, a
                below, above = high.copy(), low.copy()
                below[f] = above[f] = split
                todo += [(a, rows[~right], level + 1, low, below), (b, rows[right], level + 1, above, high)]
        return Forest(np.array(feature, dtype=np.int64), np.array(value), np.array(left, dtype=np.int64), np.array(depth), np.array(roots, dtype=np.int64), max(sample, 2), np.inf)

    def with_threshold(self, threshold: float) -> Forest:
        return Forest(self.feature, self.value, self.left, self.depth, self.roots, self.sample, threshold)


def calibrated(scores: np.ndarray, good: np.ndarray, clean_loss: float) -> float:
    """The lowest threshold that rejects at most the share clean_loss of the good rows; infinite without both kinds."""
    if not good.any() or good.all():
        return np.inf
    clean = np.sort(scores[good])[::-1]
    above = clean[min(int(clean_loss * len(clean)), len(clean) - 1)]
    bad = np.sort(scores[~good & (scores > above)])
    # Half way between the last good score that stays and the first bad score that goes.
    return float((above + bad[0]) / 2) if len(bad) else np.inf


def counted(texts: list[bytes]) -> np.ndarray:
    return np.array([rule_counts(x) for x in texts], dtype=np.int64).reshape(-1, len(COUNTS))


def fit_forest(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, trees: int = 200, sample: int = 256, clean_loss: float = 0.001, seed: int = 11) -> Forest:
    """Grow and calibrate a forest on at most `rows` labelled documents, picked by a hash of the id.

    The sample bound is the only one: it limits what the driver holds, whatever the size of the tables.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers, so documents need not move to meet them.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text")
    counts = map_texts(joined, ", ".join(f"{c} long" for c in COUNTS), lambda texts: [pa.array(c) for c in counted(texts).T])
    # Sorted, so that the forest doesn't depend on the order in which tasks end.
    got = counts.drop("text").toPandas().sort_values(["quality", *COUNTS], kind="stable")
    counts, good = got[list(COUNTS)].to_numpy(dtype=np.int64).reshape(-1, len(COUNTS)), got["quality"].to_numpy() == 1
    rest = ~base_failed(counts)
    return fitted(counts[rest], good[rest], trees, sample, clean_loss, seed)


def fitted(counts: np.ndarray, good: np.ndarray, trees: int = 200, sample: int = 256, clean_loss: float = 0.001, seed: int = 11) -> Forest:
    """Both forests, with thresholds, from the counts of labelled rows that pass the base rules."""
    marks = Forest.grown(features(counts), good, trees, sample, seed)
    return replace(marks, threshold=calibrated(marks.scores(features(counts)), good, clean_loss), shape=fitted_shape(shapes(counts), good, trees, sample, clean_loss, seed + 1))


def fitted_shape(x: np.ndarray, good: np.ndarray, trees: int, sample: int, clean_loss: float, seed: int) -> Forest | None:
    """The forest of shapes; none without a hundred good rows, which is too few to tell what is usual."""
    if good.sum() < 100:
        return None
    low, high = x[good].min(axis=0), x[good].max(axis=0)
    # A statistic that is the same in all good rows still gets a range.
    reach = BEYOND * np.maximum(high - low, 0.2)
    edge = np.vstack([low - reach, high + reach])
    forest = Forest.grown(np.vstack([x, edge]), np.concatenate([good, [False, False]]), trees, sample, seed)
    usual = np.sort(forest.scores(x[good]))[::-1][int(clean_loss * good.sum())]
    return replace(forest, threshold=float(usual + EDGE * max(forest.scores(edge).mean() - usual, 0.0)))


def judge_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """All columns of docs, the counts, anomaly, shape_anomaly, base_failed and kept (false where a base rule fails or a score reaches its threshold)."""

    def judged(texts):
        counts = counted(texts)
        failed, score = base_failed(counts), forest.scores(features(counts))
        odd = forest.shape.scores(shapes(counts)) if forest.shape else np.zeros(len(counts))
        kept = ~failed & (score < forest.threshold) & (odd < (forest.shape.threshold if forest.shape else np.inf))
        return [*map(pa.array, counts.T), pa.array(score), pa.array(odd), pa.array(failed), pa.array(kept)]

    return map_texts(docs, ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double, shape_anomaly double, base_failed boolean, kept boolean", judged)
