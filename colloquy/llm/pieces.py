"""SentencePiece encoding and decoding: N-best segmentations of whole texts.

The lattice of a text has an edge for every vocabulary piece that matches at a place, and for a character without a piece of its own one edge
that spells its UTF-8 bytes. A path's score is the sum of its edges' log probabilities; those come from the model's piece ranks
by Zipf's law (log 1/(rank + 1)), kept as whole millionths so that sums are exact.

`best_paths` finds the N best paths of a lattice: a forward Viterbi pass gives every node the best score from the start, which is
the exact heuristic for a backward A-star search from the end; paths leave the agenda in order of score.

A text's lattice falls apart at nodes that all paths pass: before a space that follows something else, and around characters that no
longer piece contains. So each segment (mostly a word) is solved once per batch, with its best path and the loss of its second best
one. The N best paths of the text change at most N - 1 segments, those that lose least, so only these are searched by A-star and combined.

Decoding joins pieces and bytes, turns marks into spaces and drops the leading one; it gives back the text exactly, except that
a mark character (U+2581) of the text is read as a space, as the model's normalizer does.

Defined results: a null or empty text has one segmentation of no pieces. Equal scores are ordered by the number of pieces changed first, then
place; a text with fewer than N segmentations has fewer. Repeated rows are done one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.texts import byte_texts, parts, prepared

MARK = "▁"
MILLION = 1_000_000
NONE = -(1 << 62)


class Lattice:
    """Vocabulary of a piece model with integer log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, self.spelling, scores = {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.spelling[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[piece] = (round(-MILLION * float(np.log(1 + max(-model.get_score(i), 0)))), i)
                self.spelling[i] = piece.replace(MARK, " ").encode()
        self.prefixes: dict[str, tuple[int, int] | None] = {}
        for piece, value in scores.items():
            for n in range(1, len(piece)):
                self.prefixes.setdefault(piece[:n], None)
            self.prefixes[piece] = value
        self._index()
        self.byte_score = round(-MILLION * float(np.log(1 + model.get_piece_size())))
        #: A new line is a segment of its own if no piece contains it.
        self.cuts_lines = not any("\n" in p for p in scores)
        # All paths pass between two characters if no piece has a mark after another character.
        self.cuts_marks = not any(MARK in p.lstrip(MARK) for p in scores)

    def _index(self) -> None:
        """The prefixes as a tree of numbered nodes: sorted keys (node * 2^21 + code point), their targets, and the pieces of nodes."""
        number = {"": 0} | {p: i + 1 for i, p in enumerate(self.prefixes)}
        # A prefix without its last character is a prefix too, or empty.
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in self.prefixes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], order + 1
        self.node_score = np.full(len(number), NONE, dtype=np.int64)
        self.node_id = np.zeros(len(number), dtype=np.int64)
        for p, value in self.prefixes.items():
            if value is not None:
                self.node_score[number[p]], self.node_id[number[p]] = value

    def viterbi_many(self, segments: list[str]) -> list[tuple[int, int, list[int]]]:
        """viterbi() of every segment; those of equal length go together, a column of the lattice at a time."""
        out: list = [None] * len(segments)
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            n = int(sizes[group[0]])
            if len(group) < 16 or n > 200:
                left = group
            else:
                left = []
                for at in range(0, len(group), 8192):
                    left += self._columns(segments, group[at : at + 8192], n, out)
            for k in left:
                out[k] = self.viterbi(segments[k])
        return out

    def _columns(self, segments: list[str], group: np.ndarray, n: int, out: list) -> list[int]:
        """Solves segments of length n into out; returns those with a character that has no piece."""
        codes = np.frombuffer("".join(segments[k] for k in group).encode("utf-32-le", "replace"), dtype="<u4").reshape(len(group), n).astype(np.int64)
        first = np.full((n + 1, len(group)), NONE, dtype=np.int64)
        second = first.copy()
        back, piece = np.zeros((n + 1, len(group)), dtype=np.int64), np.zeros((n + 1, len(group)), dtype=np.int64)
        first[0] = 0
        spelt = np.zeros(len(group), dtype=bool)
        for i in range(n):
            rows, node = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)
            for j in range(i, n):
                key = node << 21 | codes[rows, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                rows, node = rows[there], self.targets[at[there]]
                score = self.node_score[node]
                ends = score > NONE
                if j == i:
                    single = np.zeros(len(group), dtype=bool)
                    single[rows[ends]] = True
                    spelt |= ~single
                if not len(rows):
                    break
                r, w = rows[ends], score[ends]
                v, old, next_ = first[i, r] + w, first[j + 1, r], second[i, r]
                better = v > old
                second[j + 1, r] = np.maximum(np.maximum(second[j + 1, r], np.where(better, old, v)), np.where(next_ > NONE, next_ + w, NONE))
                b = r[better]
                first[j + 1, b], back[j + 1, b], piece[j + 1, b] = v[better], i, self.node_id[node[ends][better]]
        for c, k in enumerate(group.tolist()):
            if not spelt[c]:
                ids, j = [], n
                while j:
                    ids.append(int(piece[j, c]))
                    j = back[j, c]
                out[k] = int(first[n, c]), int(second[n, c]), ids[::-1]
        return group[spelt].tolist()

    def edges(self, segment: str, i: int):
        """(end, score, ids) of the edges that leave node i."""
        get, n, alone = self.prefixes.get, len(segment), False
        for j in range(i + 1, n + 1):
            found = get(segment[i:j], 0)
            if found == 0:
                break
            if found is not None:
                alone |= j == i + 1
                yield j, found[0], (found[1],)
        if not alone:
            spelt = segment[i].replace(MARK, " ").encode("utf-8", "replace")
            yield i + 1, self.byte_score * len(spelt), tuple(self.byte_ids[b] for b in spelt)

    def viterbi(self, segment: str) -> tuple[int, int, list[int]]:
        """Score of the best path, score of the second best (NONE if there is none) and the ids of the best."""
        n = len(segment)
        first, second, back = [NONE] * (n + 1), [NONE] * (n + 1), [(0, ())] * (n + 1)
        first[0] = 0
        get = self.prefixes.get
        for i in range(n):
            a, b = first[i], second[i]
            alone = False
            for j in range(i + 1, n + 1):
                found = get(segment[i:j], 0)
                if found is None:
                    continue
                if found == 0:
                    break
                if j == i + 1:
                    alone = True
                v = a + found[0]
                if v > first[j]:
                    v, first[j] = first[j], v
                    back[j] = (i, found[1])
                if v > second[j]:
                    second[j] = v
                if b > NONE and b + found[0] > second[j]:
                    second[j] = b + found[0]
            if not alone:
                spelt = segment[i].replace(MARK, " ").encode("utf-8", "replace")
                w = self.byte_score * len(spelt)
                v = a + w
                if v > first[i + 1]:
                    v, first[i + 1] = first[i + 1], v
                    back[i + 1] = (i, tuple(self.byte_ids[x] for x in spelt))
                if v > second[i + 1]:
                    second[i + 1] = v
                if b > NONE and b + w > second[i + 1]:
                    second[i + 1] = b + w
        ids, j = [], n
        while j:
            j, piece = back[j]
            ids.extend(reversed(piece) if isinstance(piece, tuple) else (piece,))
        return first[n], second[n], ids[::-1]

    def best_paths(self, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids), best first: forward Viterbi, then A-star from the end."""
        size = len(segment)
        ahead, into = [NONE] * (size + 1), [[] for _ in range(size + 1)]
        ahead[0] = 0
        for i in range(size):
            for j, w, ids in self.edges(segment, i):
                into[j].append((i, w, ids))
                ahead[j] = max(ahead[j], ahead[i] + w)
        turn, done = count(), []
        agenda = [(-ahead[size], next(turn), size, 0, ())]
        while agenda and len(done) < n:
            total, _, node, behind, path = heapq.heappop(agenda)
            if node == 0:
                done.append((-total, tuple(chain.from_iterable(_unrolled(path)))))
                continue
            for i, w, ids in into[node]:
                heapq.heappush(agenda, (-(behind + w + ahead[i]), next(turn), i, behind + w, (ids, path)))
        return done

    def segments(self, text: str) -> list[str]:
        """The text with marks for spaces and a leading one, cut where all paths pass."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts_marks:
            return [marked]
        out: list[str] = []
        for number, line in enumerate(marked.split("\n") if self.cuts_lines else [marked]):
            if number:
                out.append("\n")
            # A run of marks belongs to what follows it.
            parts, run = line.split(MARK), 0
            if parts[0]:
                out.append(parts[0])
            if "" not in parts[1:]:
                out.extend([MARK + p for p in parts[1:]])
                continue
            for p in parts[1:]:
                run += 1
                if p:
                    out.append(MARK * run + p)
                    run = 0
            if run:
                out.append(MARK * run)
        return out

    def spelt(self, ids) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))

    def same_text(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two segmentations spell the same; only what differs is spelt."""
        n = min(len(a), len(b))
        front = np.flatnonzero(a[:n] != b[:n])
        front = int(front[0]) if len(front) else n
        rear = np.flatnonzero(a[len(a) - n + front :][::-1] != b[len(b) - n + front :][::-1])
        rear = int(rear[0]) if len(rear) else n - front
        return self.spelt(a[front : len(a) - rear].tolist()) == self.spelt(b[front : len(b) - rear].tolist())

    def decode(self, ids) -> bytes:
        text = self.spelt(ids)
        return text[1:] if text[:1] == b" " else text


def _unrolled(path):
    while path:
        ids, path = path
        yield ids


class Encoder:
    """Best paths of segments, solved once each; remembers at most `remembered` of them between batches."""

    def __init__(self, path: str, remembered: int = 400_000):
        self.lattice, self.remembered = Lattice(path), remembered
        self.place: dict[str, int] = {}
        self.score, self.loss, self.start, self.length = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.flat = np.zeros(0, dtype=np.uint32)
        self.paths = lru_cache(maxsize=50_000)(self.lattice.best_paths)

    def learn(self, fresh: list[str]) -> None:
        solved = self.lattice.viterbi_many(fresh)
        length = np.fromiter((len(ids) for _, _, ids in solved), dtype=np.int64, count=len(solved))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        self.score = np.concatenate([self.score, np.fromiter((a for a, _, _ in solved), dtype=np.int64, count=len(solved))])
        self.loss = np.concatenate([self.loss, np.fromiter((a - b if b > NONE else -1 for a, b, _ in solved), dtype=np.int64, count=len(solved))])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids for _, _, ids in solved), dtype=np.uint32, count=int(length.sum()))])

    def nbest(self, texts: list[str], n: int):
        """For each text the n best (score, ids), best first."""
        cut = [self.lattice.segments(t) for t in texts]
        before = len(self.place), len(self.flat)
        fresh = list(set().union(*cut).difference(self.place))
        if fresh:
            self.learn(fresh)
        for segments in cut:
            yield self._combined(segments, n)
        if len(self.place) > self.remembered:
            for s in fresh:
                del self.place[s]
            self.score, self.loss, self.start, self.length = (x[: before[0]] for x in (self.score, self.loss, self.start, self.length))
            self.flat = self.flat[: before[1]]

    def _combined(self, segments: list[str], n: int):
        at = np.fromiter(map(self.place.__getitem__, segments), dtype=np.int64, count=len(segments))
        length = self.length[at]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        total = int(self.score[at].sum())
        out = [(total, ids)]
        loss = self.loss[at]
        open_ = np.flatnonzero(loss >= 0)
        if n > 1 and len(open_):
            few = open_[np.argsort(loss[open_], kind="stable")[: n - 1]]
            choices = [(0, ())]
            for s in np.sort(few).tolist():
                paths = self.paths(segments[s], n)
                lost = [(paths[0][0] - score, path) for score, path in paths]
                choices = sorted(((d + e, (*c, (s, path)) if k else c) for d, c in choices for k, (e, path) in enumerate(lost)), key=lambda x: (x[0], len(x[1])))[:n]
            for d, changes in choices[1:]:
                parts, done = [], 0
                for s, path in changes:
                    parts += [ids[done : ends[s] - length[s]], np.array(path, dtype=np.uint32)]
                    done = ends[s]
                out.append((total - d, np.concatenate([*parts, ids[done:]])))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model_path: str, *, n: int = 4, keep_ids: bool = False, slice_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, rank (from 1), score, n_pieces, ids_crc32 (ids as unsigned little-endian 32-bit numbers), restored, and on request ids.

    `restored` says whether decoding the ids gives back the text.
    """
    prepared(docs.sparkSession)

    def run(batches):
        enc = encoder(model_path)
        for batch in parts(batches, 2500):
            keys, texts = batch.column(0), byte_texts(batch.column(1))
            bounds = np.cumsum([len(t) for t in texts]) // slice_bytes
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bounds)) + 1) if len(texts) else []:
                rows = {k: [] for k in ("at", "rank", "score", "n_pieces", "ids_crc32", "restored", "ids")}
                for i, found in zip(part.tolist(), enc.nbest([texts[i].decode("utf-8", "replace") for i in part], n), strict=True):
                    best = found[0][1]
                    whole = enc.lattice.decode(best.tolist()) == texts[i].replace(MARK.encode(), b" ")
                    for rank, (score, ids) in enumerate(found, 1):
                        good = whole and (rank == 1 or enc.lattice.same_text(ids, best))
                        ids = ids.astype("<u4")
                        for k, x in zip(rows, (i, rank, score / MILLION, len(ids), zlib.crc32(ids.tobytes()), good), strict=False):
                            rows[k].append(x)
                        if keep_ids:
                            rows["ids"].append(ids.astype(np.int32))
                columns = [keys.take(pa.array(rows["at"], pa.int64())), pa.array(rows["rank"], pa.int32()), pa.array(rows["score"], pa.float64()), pa.array(rows["n_pieces"], pa.int64()), pa.array(rows["ids_crc32"], pa.int64()), pa.array(rows["restored"], pa.bool_())]
                names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "restored"]
                if keep_ids:
                    columns, names = [*columns, pa.array(rows["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rank int, score double, n_pieces long, ids_crc32 long, restored boolean" + ", ids array<int>" * keep_ids)
