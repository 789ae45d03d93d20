"""Toxicity by compression distance.

Three zstandard dictionaries are trained on labelled rows: one on ordinary text, one on the windows of all toxic texts, and one that is a
learnt word list: the bare words that toxic rows have at least ten times as often, in five different neighbourhoods or more (so that
copies of one document count once), and more often than chance gives to any word. A text is cut into windows of a few words. Each window is compressed with the ordinary
dictionary alone, and with each toxic one in front of it. The bytes saved by a toxic dictionary are a distance of the
window. Of either kind the largest distance, the mean and the numbers of windows over some distances are weighed by a
logistic regression on the same rows, whose scale is moved so that the best threshold on them becomes 0.7.

Defined results: a null or empty text is one empty window, which saves nothing. Without rows of both labels every score is the share of
toxic ones (0 without any). Repeated rows are scored one by one; a repeated label counts once, and 1 beats 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import map_texts

WINDOW_WORDS = 8
CUTS = (2, 3, 4, 6)
THRESHOLD = 0.7
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
#: Statistics of one kind of distance.
STATISTICS = 2 + 2 * len(CUTS)


def fold(key: Column, folds: int = 3) -> Column:
    """crc32 of the id as text modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def windows(text: bytes, words: int = WINDOW_WORDS) -> list[bytes]:
    split = text.lower().split()
    return [b" " + b" ".join(split[i : i + words]) + b" " for i in range(0, len(split), words)] or [b""]


def dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary trained on samples; with too few to train, the samples themselves."""
    samples = list(samples)
    random.Random(1).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, f=20, split_point=1.0, accel=1, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def compressor(content: bytes):
    """Frames without any header fields, so that lengths tell about content alone."""
    content = content if len(content) >= 8 else content + bytes(8)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=15, search_log=1, min_match=5, target_length=16, strategy=zstandard.STRATEGY_DFAST,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def chance(n: int, others: int, share: float) -> float:
    """Probability that of n + others rows n or more are toxic, where each is with probability share."""
    if share >= 1:
        return 1.0
    total, a, b = n + others, math.log(share), math.log1p(-share)
    return sum(math.exp(math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + (total - k) * a + k * b) for k in range(others + 1))


def typical_words(toxic: list[bytes], ordinary: list[bytes], ratio: float = 10.0, least: int = 5) -> dict[bytes, int]:
    """Words that toxic texts have at least `ratio` times as often as ordinary ones, with the number of their neighbourhoods.

    Only words that are so often in toxic rows that less than one of all words is expected to be by chance.
    """
    seen, common = Counter(), Counter()
    for t in toxic:
        seen.update(set(t.lower().split()))
    for t in ordinary:
        common.update(set(t.lower().split()))
    often = {w for w, n in seen.items() if n >= 2 and n * (len(ordinary) + 1) >= ratio * (common[w] + 0.5) * len(toxic)}
    around: dict[bytes, set] = {w: set() for w in often}
    for t in toxic:
        split = [b"", *t.lower().split(), b""]
        for before, w, after in zip(split, split[1:], split[2:], strict=False):
            if w in often:
                around[w].add(hash((before, after)))
    part, distinct = len(toxic) / (len(toxic) + len(ordinary)), len(seen.keys() | common.keys())
    return {w: len(a) for w, a in sorted(around.items()) if len(a) >= least and chance(min(len(a), seen[w]), common[w], part) * distinct < 1}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    ordinary: bytes
    words: bytes
    passages: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def distances(self, texts: list[bytes], slice_windows: int = 20_000):
        """Two distances, by typical words and by passages, of all windows of each text, a slice of windows at a time."""
        plain, *aware = (compressor(self.ordinary + more) for more in (b"", self.words, self.passages))
        for text in texts:
            cut, got = windows(text), []
            for at in range(0, len(cut), slice_windows):
                part = cut[at : at + slice_windows]
                sizes = (len(c.compress(w)) for w in part for c in (plain, *aware))
                sizes = np.fromiter(sizes, dtype=np.int64, count=3 * len(part)).reshape(-1, 3)
                got.append(sizes[:, :1] - sizes[:, 1:])
            yield np.concatenate(got)

    def features(self, texts: list[bytes]) -> np.ndarray:
        return np.array([[*self.summary(d[:, 0]), *self.summary(d[:, 1]), float(np.log(len(d)))] for d in self.distances(texts)], dtype=np.float64).reshape(-1, 2 * STATISTICS + 1)

    @staticmethod
    def summary(d: np.ndarray) -> list[float]:
        over = [int((d >= c).sum()) for c in CUTS]
        return [float(d.max()), float(d.mean()), *(float(np.log1p(n)) for n in over), *(n / len(d) for n in over)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    @staticmethod
    def trained(toxic: list[bytes], ordinary: list[bytes]) -> Classifier:
        """The dictionaries, without weights."""
        passages = [w for t in toxic for w in windows(t)]
        words = [b" " + w + b" " for w, n in typical_words(toxic, ordinary).items() for _ in range(n)]
        plain = [w for t in ordinary for w in windows(t, 20)]
        none = np.zeros(0)
        return Classifier(
            dictionary(plain[:: 1 + len(plain) // 60_000], ORDINARY_BYTES, 64, 8), dictionary(words, TOXIC_BYTES, 24, 8), dictionary(passages, TOXIC_BYTES, 24, 8), none, none, none,
        )

    @staticmethod
    def fitted(toxic: list[bytes], ordinary: list[bytes]) -> Classifier:
        none = np.zeros(0)
        if not toxic or not ordinary:
            return Classifier(b"", b"", b"", none, none, none, 1.0 if toxic else 0.0)
        whole = Classifier.trained(toxic, ordinary)
        x, y = whole.features([*toxic, *ordinary]), np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        w = logistic((x - centre) / scale, y)
        value = ((x - centre) / scale) @ w[:-1] + w[-1]
        order = np.argsort(-value, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        best = int(f1.argmax())
        cut = (value[order[best]] + value[order[min(best + 1, len(y) - 1)]]) / 2
        w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        return Classifier(whole.ordinary, whole.words, whole.passages, centre, scale, w)


def fit(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 2500, ordinary_rows: int = 4000, sample_bytes: int = 40_000_000, seed: int = 5) -> Classifier:
    """Fit on labelled rows of the folds other than 1, picked by a hash of the id.

    At most so many rows of each label and so many bytes of text come to the driver, whatever the size of the tables; only the fit is bounded.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 1)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"))
    picked = marked.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(marked.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n")).collect()
    room, take = sample_bytes, []
    for r in sorted(sizes, key=lambda r: (hash((seed, r["doc_id"])), r["doc_id"])):
        if r["n"] <= room:
            room -= r["n"]
            take.append((r["doc_id"], r["toxic"]))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(take, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int")
    # Of repeated rows of an id the least text.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy("doc_id").collect()
    texts = {t: [r["text"].encode("utf-8", "replace") for r in rows if r["toxic"] == t] for t in (0, 1)}
    return Classifier.fitted(texts[1], texts[0])


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """All columns of docs and score; one pass over whole texts in tasks, no shuffle. The classifier is some 60 kB."""
    return map_texts(docs, "score double", lambda texts: [pa.array(classifier.scores(texts))])
