"""Packing documents into token sequences by cutting-stock column generation.

Tokens: a text is cut at white space, each distinct word of a batch is tokenized once, and the ids are laid end to end; the
tokenizer never looks across white space, so this equals tokenizing whole texts. An end id closes each document. Where the
tokenizer lower-cases and parts letters from marks, words are told apart without case and without the mark behind them.

Packing: a document of n tokens gives n // capacity full pieces and one rest. Rests fall into length classes of `unit`
tokens (at most capacity / unit of them), and only the histogram of the classes goes to the driver. A linear program over
patterns (how many pieces of which class fill a sequence) is solved by column generation: the dual values price a knapsack,
whose dynamic program yields the next pattern until none improves. Pattern counts are rounded down, and first fit decreasing
packs what is left, a few pieces per class. Pieces are ranked inside their class, in blocks so that a class with most rows is
no single task, and a rank picks pattern, sequence and place.

Defined results: a null or empty text is the end id alone. Repeated rows are packed one by one. An empty table gives no
rows. Only doc_id and text of the input are used.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import written
from colloquy.llm.texts import byte_texts, parts, prepared

END_ID = 1
CAPACITY = 2048
UNIT = 8
BLOCK_ROWS = 256


#: Signs of which one, standing alone between words, is one id of the vocabulary and marks where a word ends.
MARKS = "^~`\\{}|"
STRETCH = 4096

#: Under this split a mark behind a letter or digit is a token of its own, and words may be cut there.
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))
PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", dtype=np.uint8))


def folds(tokenizer) -> bool:
    """Whether the tokenizer composes, lower-cases and then cuts at PARTS, and does nothing else before it looks at single words."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    plain = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return steps == plain and cuts[0].get("type") == "Split" and cuts[0].get("pattern") == {"Regex": PARTS}


class WordTokenizer:
    """Ids of whole texts from the ids of their words; beyond `remembered` words it keeps those of the batch before alone.

    New words are tokenized in stretches of some kilobytes with a mark between each two; the ids of a stretch are cut at the marks. A stretch whose marks
    don't come out as they went in, since a word holds one, is tokenized word by word.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        # A task is one thread; more of them would hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.folds = folds(self.tokenizer)
        # Ids that stand for signs in the text as it is, before any lower-casing.
        self.whole = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = "", -1
        for sign in MARKS:
            ids = self.tokenizer.encode(f"a {sign} b", add_special_tokens=False).ids
            if len(ids) == 3 and self.tokenizer.id_to_token(ids[1]) not in (None, "[UNK]", "<unk>"):
                self.mark, self.mark_id = f"\n{sign}\n", ids[1]
                break
        self.place: dict[bytes, int] = {}
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.latest: list[bytes] = []

    def laid_out(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, end to end."""
        length = self.length[at]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def forget(self) -> None:
        """All words but those of the batch before, since frequent ones are among them."""
        at = np.fromiter(map(self.place.__getitem__, self.latest), dtype=np.int64, count=len(self.latest))
        self.flat, self.length = self.laid_out(at), self.length[at]
        self.start = np.cumsum(self.length) - self.length
        self.place = {w: i for i, w in enumerate(self.latest)}

    def special(self, text: bytes) -> bool:
        low = text.lower()
        return any(sign in low for sign in self.whole)

    def folded(self, text: bytes) -> bytes:
        """The text with A-Z in lower case, where that changes no id.

        Not where signs stand for ids of their own; nor beside combining marks (U+0300 to U+036F), which compose with some small letters only.
        """
        return text if not self.folds or b"\xcc" in text or b"\xcd" in text or self.special(text) else text.lower()

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(length.sum())), length

    def in_stretches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3) // STRETCH
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(words)]
        groups = [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        found = self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False)
        flat, lengths = [], []
        for group, encoded in zip(groups, found, strict=True):
            ids = np.array(encoded.ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == len(group) - 1:
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                flat.append(ids[ids != self.mark_id])
            else:
                ids, length = self.one_by_one(group)
                flat.append(ids), lengths.append(length)
        return np.concatenate(flat), np.concatenate(lengths)

    def learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode("utf-8", "replace").split("\n")
        ids, length = self.in_stretches(text) if self.mark else self.one_by_one(text)
        start = len(self.flat) + np.cumsum(length) - length
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.place) > self.remembered:
            self.forget()
        split = [b" ".join(self.folded(t).split()) for t in texts]
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in split], dtype=np.int64)
        # All words of the batch end to end, as one Arrow array that tells equal ones apart.
        spaced = b" ".join(filter(None, split)) + b" "
        data = np.frombuffer(spaced, dtype=np.uint8)
        ends = np.flatnonzero(data == 0x20) if counts.any() else np.zeros(0, dtype=np.int64)
        # A mark behind a letter or digit of the first 128 is a word of its own, unless the text is taken as it is.
        cut = CLOSING[data[ends - 1]] & PLAIN[data[ends - 2]] & np.repeat([self.folds and not self.special(t) for t in split], counts)
        stops = np.repeat(ends - np.arange(len(ends)), 1 + cut)
        stops[np.cumsum(1 + cut)[cut] - 2] -= 1
        until = np.concatenate([[0], np.cumsum(1 + cut)])[np.concatenate([[0], np.cumsum(counts)])]
        counts = np.diff(until)
        offsets = np.concatenate([[0], stops]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(spaced.translate(None, b" "))]).dictionary_encode()
        known = self.latest = words.dictionary.to_pylist()
        fresh = [w for w in known if w not in self.place]
        if fresh:
            self.learn(fresh)
        places = np.fromiter(map(self.place.__getitem__, known), dtype=np.int64, count=len(known))[words.indices.to_numpy()]
        return [self.laid_out(at) for at in np.split(places, np.cumsum(counts)[:-1])] if len(texts) else []


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, keep_ids: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, start, length, ids_crc32, doc_tokens and, on request, the ids.

    Tokenized in tasks in slices of some megabytes of text.
    """
    prepared(docs.sparkSession)

    def cut(batches):
        tok = tokenizer(tokenizer_path)
        for batch in parts(batches):
            texts, keys = byte_texts(batch.column(1)), batch.column(0)
            bounds = np.cumsum([len(t) for t in texts]) // slice_bytes
            for piece in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bounds)) + 1) if len(texts) else []:
                where, start, length, crc, tokens, kept = [], [], [], [], [], []
                for i, ids in zip(piece.tolist(), tok.ids([texts[i] for i in piece]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(ids), capacity):
                        part = ids[at : at + capacity]
                        where.append(i), start.append(at), length.append(len(part)), tokens.append(len(ids))
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                columns = [keys.take(pa.array(where, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fill(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most valuable multiset of classes (sizes ascending) that fits into room, by dynamic programming."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if k := fitting[r]:
            value = best[r - sizes[:k]] + values[:k]
            j = int(value.argmax())
            if value[j] > best[r] + 1e-12:
                best[r], choice[r] = value[j], j
    pattern, r = np.zeros(len(sizes)), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            pattern[choice[r]] += 1
            r -= int(sizes[choice[r]])
    return float(best[room]), pattern


def solve_patterns(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = 1e-3, max_rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how many sequences follow each; together they hold exactly `counts`.

    Revised simplex over the patterns generated so far; the work depends on the number of classes, not on the number of pieces.
    Dividing by the value of the best new pattern bounds the optimum from below, so it ends within `gap` of it.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(np.minimum(room // sizes, counts).astype(np.float64))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ counts
    bound = 0.0
    for _ in range(max_rounds):
        value, pattern = best_fill(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        bound = max(bound, amount.sum() / value)
        if amount.sum() <= bound * (1 + gap) or value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        amount = np.maximum(amount - move * step, 0)
        amount[out] = move
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    whole = [(basis[:, j].astype(np.int64), int(np.floor(amount[j] + 1e-9))) for j in range(m)]
    left = counts - sum(p * k for p, k in whole)
    while (left < 0).any():  # rounding of numbers may take one too many
        c = int(np.argmin(left))
        j = next(j for j, (p, k) in enumerate(whole) if k and p[c])
        whole[j] = (whole[j][0], whole[j][1] - 1)
        left = left + whole[j][0]
    bins: list[tuple[int, np.ndarray]] = []
    for c in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[c])):
            at = next((i for i, (free, _) in enumerate(bins) if free >= sizes[c]), None)
            if at is None:
                bins.append((room, np.zeros(m, dtype=np.int64)))
                at = len(bins) - 1
            bins[at][1][c] += 1
            bins[at] = (bins[at][0] - int(sizes[c]), bins[at][1])
    return [(p, k) for p, k in whole if k] + [(p, 1) for _, p in bins]


@dataclass(frozen=True)
class Plan:
    """Rows (class, from rank, to rank, first sequence, pieces of the class in a sequence)."""

    rows: list[tuple[int, int, int, int, int]]
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> Plan:
    """Places for every rank of every class; class k holds pieces of up to k * unit tokens."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in sizes], dtype=np.int64)
    rows, used, first = [], np.zeros(len(sizes), dtype=np.int64), 0
    for pattern, times in solve_patterns(sizes, counts, capacity // unit):
        for c in np.flatnonzero(pattern):
            n = int(pattern[c]) * times
            rows.append((int(sizes[c]), int(used[c]), int(used[c]) + n, first, int(pattern[c])))
            used[c] += n
        first += times
    return Plan(rows, first)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """Every piece with sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    cut = pieces(docs, tokenizer_path, capacity=capacity, keep_ids=keep_ids)
    cut = written(cut.withColumn("_class", F.expr(f"cast((length + {unit - 1}) div {unit} as int)")), "pieces")
    histogram = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, capacity, unit)
    blocks = 1 + max(histogram.values(), default=0) // BLOCK_ROWS
    blocked = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_class"), F.lit(blocks)))
    before = blocked.groupBy("_class", "_block").agg(F.count("*").alias("_n"))
    before = before.select("_class", "_block", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_class", "_block").orderBy("doc_id", "start", "ids_crc32")
    ranked = blocked.withColumn("_at", F.row_number().over(inside) - 1).join(before, ["_class", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_at") + F.col("_before"))
    table = docs.sparkSession.createDataFrame(places.rows, "_class int, _from long, _to long, _first long, _each long")
    # One row per class and pattern, whatever the number of documents: at most (capacity / unit) squared.
    placed = ranked.join(F.broadcast(table), "_class").where("_rank >= _from and _rank < _to")
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    placed = placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
