"""The operators' inner parts against plain versions, without Spark."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from colloquy.llm import classlm, packing, pieces, quality, simhash, toxicity, warc, winnowing

ODD = ["", " ", "\n\n", "a", "a b", "aa  b\t\nc", "héllo wörld 日本", "x" * 5000, "a b c a b c a b c", "don't 123 <|endoftext|>", "  a\x85b", "\x1c\x00é"]


def plain_counts(text: str) -> tuple[int, int, int, int, int]:
    words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_rule_counts():
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab #\n|é") for _ in range(rng.randrange(200))) for _ in range(200))]
    for t in texts:
        assert quality.rule_counts(t.encode())[:5] == plain_counts(t), t


def test_forest_isolates_what_good_rows_lack():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0.1, 0.02, (500, 3)), rng.normal(0.8, 0.02, (60, 3))])
    good = np.arange(560) < 500
    forest = quality.Forest.grown(x, good, 100, 128, 3)
    score = forest.scores(x)
    assert score[~good].min() > score[good].max()
    assert forest.with_threshold(quality.calibrated(score, good, 0.0)).threshold > score[good].max()
    assert quality.calibrated(score, np.ones(560, bool), 0.1) == np.inf
    assert (quality.Forest.grown(x[:0], good[:0], 10, 8, 1).scores(x) == 0).all()


def test_best_paths_match_all_paths():
    path = public_tokenizers.path("piece_bpe_32k.model")
    enc, model = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    lattice = enc.lattice

    def every(segment, i=0):
        if i == len(segment):
            yield 0, ()
        else:
            for j, w, ids in lattice.edges(segment, i):
                for score, rest in every(segment, j):
                    yield w + score, ids + rest

    texts = ["", " ", "a", "  a  b ", "the cat", "a\nb\n", "日é\u0001x", "aaaaaa", " \n", "ththe re\n\n x"]
    for t, found in zip(texts, enc.nbest(texts, 5), strict=True):
        whole = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
        paths = dict((ids, score) for score, ids in every(whole))
        assert [s for s, _ in found] == sorted(paths.values(), reverse=True)[: len(found)] and len(found) == min(5, len(paths)), t
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
        for score, ids in found:
            assert paths[tuple(ids.tolist())] == score and lattice.decode(ids.tolist()).decode() == t == model.decode(ids.tolist())
            assert lattice.same_text(ids, found[0][1])
    words = [pieces.MARK + "".join(random.Random(i).choice("theran") for _ in range(1 + i % 9)) for i in range(900)] + [pieces.MARK + "a\x01"] * 20
    assert lattice.viterbi_many(words) == [lattice.viterbi(w) for w in words]


def test_words_tokenized_once_give_whole_texts():
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), remembered=5)
    for texts in (ODD, ["İ ß ǅ̈ a ̈b é", *ODD[::-1]], ODD):
        want = [e.ids for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in tok.ids([t.encode() for t in texts])] == want


def test_words_in_another_case_or_before_a_mark_are_tokenized_once(monkeypatch):
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), remembered=6)
    asked, learn = [], tok.learn
    monkeypatch.setattr(tok, "learn", lambda words: asked.append(sorted(words)) or learn(words))
    # What composes, stands for an id or has no mark of its own stays as it is.
    texts = [
        "Plain plain, PLAIN. 'S x). x..", "J\u030cab j\u030cab, I\u0307.", "<|ENDOFTEXT|> A <|endoftext|>. B.", "a. . b! É. \u212a; ΟΔΟΣ.", "", ",", "É", "1. 2, 33;",
    ]
    want = [e.ids for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tok.ids([t.encode() for t in texts])] == want
    tok.ids([b"Plain, words"]), tok.ids([b"plain. WORDS, more"]), tok.ids([b"Words more!"])
    # Beyond six words only those of the batch before are kept.
    assert asked[1:] == [[b"words"], [b".", b"more"], [b"!"]]
    assert asked[0].count(b"plain") == 1 and not any(w.endswith((b"plain,", b"plain.")) for w in asked[0])


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plan_places_every_piece(n):
    lengths = np.random.default_rng(n).integers(1, 65, n)
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.plan(histogram, 512, 8)
    held, filled = Counter(), Counter()
    for size, low, high, first, each in plan.rows:
        held[size] += high - low
        for rank in range(low, high):
            filled[first + (rank - low) // each] += size
    assert held == Counter(histogram) and max(filled.values(), default=0) <= 64 and len(filled) == plan.sequences
    if n > 1000:
        assert plan.sequences <= 1.01 * lengths.sum() / 64 + 3


def test_golay_decoding_and_keys():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 400)
    index = np.arange(4096) << 11
    code = index ^ simhash._remainders(index)
    near = np.bitwise_count(words[:, None] ^ code[None, :]) <= 4
    got = simhash.codewords(words)
    assert all(set(np.flatnonzero(n)) == set(g) for n, g in zip(near, got, strict=True))
    assert (np.bitwise_count(words ^ code[got[:, 0]]) <= 3).all()
    f = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for b in rng.choice(64, i % 4, replace=False):
            g[i] ^= np.uint64(1 << int(b))
    (left, _), (_, right) = simhash.fuzzy_keys(f), simhash.fuzzy_keys(g)
    assert all(set(a) & set(b) for a, b in zip(left, right, strict=True))


def test_fingerprint():
    for t in [*ODD, "A b C d e A b C", "one two"]:
        words = t.encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        want = sum((2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams)) << b for b in range(64))
        assert simhash.fingerprint(t.encode()) == want


def test_winnowing(monkeypatch):
    def plain(points, k, w):
        k = min(k, len(points))
        h = [int(winnowing.gram_hashes(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)] if len(points) else []
        w, out = min(w, len(h)), set()
        for i in range(len(h) - w + 1 if h else 0):
            least = min(h[i : i + w])
            out.add(max(j for j in range(i, i + w) if h[j] == least))
        return [(j, h[j]) for j in sorted(out)]

    rng = np.random.default_rng(5)
    for n in (0, 1, 19, 20, 21, 51, 52, 400):
        p = rng.integers(97, 99, n).astype(np.uint32)
        assert list(zip(*(x.tolist() for x in winnowing.winnowed(p)[::-1]), strict=True)) == plain(p, 20, 32)
    monkeypatch.setattr(winnowing, "BLOCK", 64)
    p = rng.integers(97, 99, 1000).astype(np.uint32)
    assert list(zip(*(x.tolist() for x in winnowing.winnowed(p)[::-1]), strict=True)) == plain(p, 20, 32)
    # A shared passage of k + w - 1 code points shares a chosen hash.
    a, b = rng.integers(97, 123, 300), rng.integers(97, 123, 300)
    b[100:151] = a[7:58]
    assert np.intersect1d(winnowing.winnowed(a.astype(np.uint32))[0], winnowing.winnowed(b.astype(np.uint32))[0]).size


def test_records_and_members():
    payload = "é".encode() * 700
    first = warc.record(7, "http://a/\r\nX: y", payload, None, False)
    again = warc.record(3, None, payload, 7, True)
    archive = b"".join(warc.closed(m) + b"\0" for m in (first, again, warc.record(None, "", b"", None, False)))
    assert gzip.decompress(archive).count(b"WARC/1.1") == 3
    got = [warc.parsed(c, "x") for _, c in warc.members(archive)]
    assert [g["payload"] for g in got] == [payload, b"", b""] and got[0]["fields"]["warc-target-uri"] == "http://a/ X: y"
    assert got[1]["fields"]["x-refers-to-key"] == "7" and got[1]["fields"]["warc-payload-digest"] == got[0]["fields"]["warc-payload-digest"]
    with pytest.raises(warc.Broken):
        list(warc.members(archive[:-30]))
    with pytest.raises(warc.Broken):
        warc.parsed(next(warc.members(first))[1].replace("é".encode(), b"ee", 1), "x")
    # A record of 16 MB or more doesn't end with zero.
    assert gzip.decompress(first + warc.closed(warc.record(1, "", bytes(1 << 24), None, False)) + b"\0")


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 60)
    strong = rng.random((4, 4)) ** 4
    matrix = rng.poisson(40 * strong[truth][:, truth])

    def value(label):
        one = np.eye(4)[label]
        t = one.T @ matrix @ one
        return classlm._xlogx(t).sum() - classlm._xlogx(t.sum(0)).sum() - classlm._xlogx(t.sum(1)).sum()

    label = classlm.exchange(matrix, 4)
    start = np.empty(60, dtype=int)
    start[np.argsort(-(matrix.sum(0) + matrix.sum(1)), kind="stable")] = np.arange(60) % 4
    assert value(label) > value(start)
    # No single move is better.
    for w in range(60):
        for c in range(4):
            other = label.copy()
            other[w] = c
            assert value(other) <= value(label) + 1e-6


def test_toxicity_on_held_out_rows():
    rng = random.Random(4)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti"]

    def text(bad):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(150)]
        for _ in range(6 * bad):
            words[rng.randrange(150)] = rng.choice(["grumblewort", "snarkfish", "wretchling", "dolthead"])
        return " ".join(words).encode()

    toxic, ordinary = [text(1) for _ in range(150)], [text(0) for _ in range(300)]
    c = toxicity.Classifier.fitted(toxic[:100], ordinary[:200])
    assert (c.scores(toxic[100:]) >= 0.7).mean() > 0.9 and (c.scores(ordinary[200:]) >= 0.7).mean() < 0.05
    assert 0 <= c.scores([b"", b"x" * 100_000])[0] <= 1
    assert toxicity.Classifier.fitted([], ordinary).scores([b"a"]) == [0.0]
    assert toxicity.Classifier.fitted([b"a"], [b"b"]).scores([b"a", b""]).shape == (2,)


def test_toxic_phrases_of_ordinary_words():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randint(1, 4))) for _ in range(2000)]
    phrases = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(4)]

    def text(kind):
        words = rng.choices(vocabulary, k=150)
        for _ in range(6 * (kind > 0)):
            words.insert(rng.randrange(150), rng.choice(phrases) if kind == 1 else rng.choice(["grumblewort", "snarkfish"]))
        return " ".join(" ".join(words).split()[:150]).encode()

    # Words that stand out in other toxic rows must not hide the phrases.
    toxic, ordinary = [text(1 + i % 2) for i in range(400)], [text(0) for _ in range(600)]
    c = toxicity.Classifier.fitted(toxic, ordinary)
    assert (c.scores([text(1) for _ in range(100)]) >= 0.7).mean() > 0.6 and (c.scores([text(2) for _ in range(100)]) >= 0.7).mean() > 0.9
    assert (c.scores([text(0) for _ in range(200)]) >= 0.7).mean() < 0.05
    # A word in under 1 % of the toxic rows is learnt too.
    rare = [b"a%d rarebane b%d" % (i, i) if i < 9 else b"c%d" % i for i in range(1000)]
    assert toxicity.typical_words(rare, ordinary * 10).keys() == {b"rarebane"}


def test_digest_is_of_the_whole():
    a = winnowing.winnowed(winnowing.points_of("a" * 100))
    assert winnowing.digest(*a) == hashlib.sha256(a[0].astype("<i8").tobytes() + a[1].astype("<i8").tobytes()).hexdigest()
    a = (np.unique(a[0]), a[1])
    assert winnowing.likeness(a[0], a[0]) == 1 and winnowing.likeness(a[0], a[0][:0]) == 0 and winnowing.likeness(a[0][:0], a[0][:0]) == 1
