"""Conversation repair, resampling and personal data against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import conversations, personal, resample
from colloquy.llm.queries import QUERIES
from tests.llm.conftest import hard_conversations, hard_documents

SEEN = re.compile("[^\\x20\\x09-\\x0D]")


def whole(x):
    return [None if pd.isna(v) else int(v) for v in x]


# Conversations


def plain_search(rows):
    """Least (cost, audit, turns) by walking all edits with one heap; rows (role, text, fault)."""
    heap, seen, tick = [(0, "", 0, "", 0, ())], set(), itertools.count()
    while heap:
        cost, audit, _, last, at, turns = heapq.heappop(heap)
        if (last, at) in seen:
            continue
        seen.add((last, at))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, turns
        after = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]

        def go(c, e, last, at, turns, cost=cost, audit=audit):
            heapq.heappush(heap, (cost + c, audit + e, next(tick), last, at, turns))

        go(5, "I", after, at, (*turns, (name, "")))
        if at < len(rows):
            role, text, fault = rows[at]
            go(2, "D", last, at + 1, turns)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(1 + more, "R", after, at + 1, (*turns, (name, text)))
                if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and role:
                    go(more, "K", role[:1], at + 1, (*turns, (role, text)))


def plain_repair(rows, damage=True):
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in groups.items():
        after = []
        for turn, role, text in turns:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20 if damage else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in after:
            shown = SEEN.findall(text)
            judged.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        n = Counter(f for _, _, f in judged)
        numbers = [t for t, _, _ in after if t is not None]
        letters = [r[:1] for r, _, _ in judged]
        cost, audit, turns = plain_search(judged)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns,
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(frame):
    rows = frame.toPandas()
    return Counter((k, *(r[c] for c in NAMES)) for k, (_, r) in zip(whole(rows.conv_id), rows.iterrows(), strict=True))


def test_search_against_plain_walk():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = "".join(rng.choices("xsuaoSUAO", k=rng.randint(0, 9)))
        rows = [("" if s in "xoO" else s.lower(), "", "blank" if s == "x" else "truncated" if s.isupper() else "") for s in symbols]
        assert conversations.repair_symbols(symbols) == plain_search(rows)[:2]


@pytest.mark.parametrize("cut", [{}, {"block": 3, "ranges": 9}, {"block": 1, "ranges": 2}])
def test_repair(spark, hard, cut):
    want = plain_repair(hard_conversations())
    damaged = conversations.damaged(spark.read.parquet(f"{hard}/conversations.parquet").withColumn("Audit", F.lit("clash")))
    assert results(conversations.repair(damaged, **cut)) == Counter((k, *v[:8]) for k, v in want.items())
    if cut:
        turns = conversations.repair(damaged, keep_turns=True, **cut).toPandas().sort_values(["part", "block", "place"])
        got = defaultdict(list)
        for k, (_, r) in zip(whole(turns.conv_id), turns.iterrows(), strict=True):
            if r.edit != "D":
                got[k].append((r.role, r.text))
        assert {k: tuple(v) for k, v in got.items()} == {k: v[8] for k, v in want.items() if v[8]}
    else:
        assert results(QUERIES["op11_conversation_repair"](spark, hard)) == Counter((k, *v[:8]) for k, v in want.items())


def test_repair_without_damage(spark):
    rows = [("a", 0, "user", "x"), ("b", 1, "system", "s."), ("b", 2, "assistant", "t."), ("c", 1, "user", " ")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert got == {"a": (2, "D"), "b": (1, "RK"), "c": (2, "D")}


# Resampling


def plain_features(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))], len(words)


def plain_draw(docs, bench):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    own = [plain_features(t) for _, t in docs]
    s, t = Counter(bucket(f) for fs, _ in own for f in fs), Counter(bucket(f) for x in bench for f in plain_features(x)[0])
    total, goal = sum(s.values()), sum(t.values())
    rows = []
    for (key, _), (fs, n) in zip(docs, own, strict=True):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (goal + 10000)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: 25 * len(able) // 100]
    return Counter([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < 20])


def test_resampling(spark, hard):
    docs = [(r[0], r[1]) for r in hard_documents()[0]]
    bench = [r["text"] for r in spark.read.parquet(f"{hard}/benchmark.parquet").collect()]
    got = QUERIES["op12_resampling"](spark, hard).toPandas()
    assert Counter(zip(whole(got.doc_id), got.n_features, got.weight, got.score, whole(got["rank"]), strict=True)) == plain_draw(docs, bench)


def test_ranks_of_equal_scores(spark):
    rows = [(k, 5, True) for k in [None, None, 1, 1, 1, 2, 3]] + [(9, 7, False), (4, 6, True), (8, 1, True)]
    frame = spark.createDataFrame(rows, "key long, score long, eligible boolean").repartition(3)
    out = resample.draw(frame, (70, 100)).toPandas().sort_values("rank")
    assert whole(out[out["rank"].notna()].key) == [4, None, None, 1, 1, 1] and len(out) == len(rows)


def test_features_of_any_length():
    rng = random.Random(3)
    for n in (1, 2, 3, 4):
        words = ["".join(rng.choices("ab1é", k=rng.randint(1, 3))).encode() for _ in range(rng.randint(0, 30))]
        line = resample.collapsed(b"..".join(words).upper().replace("É".encode(), "é".encode()))
        want = Counter(zlib.crc32(b" ".join(words[i : i + k]).lower()) % 997 for k in range(1, n + 1) for i in range(len(words) - k + 1))
        found, count = resample.hashed(line, n, 997)
        assert Counter(found.tolist()) == want and count == len(words)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_test(kind, word):
    if kind == "ip":
        return all(int(p) <= 255 for p in word.split("."))
    digits = [int(c) for c in word if c in "0123456789"]
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if plain_test(k, m[0])]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20000):
        text = "".join(rng.choices(rng.choice(["a@.1 -", "12.@a", "1 -2+().é", " 0123456789+-.()"]), k=rng.randint(0, 40)))
        assert personal.base_spans(text) == plain_base(text)
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.@" * 100_000, "+1(" * 100_000, "(+" * 150_000):
        personal.base_spans(long)
        personal.described(long)


def test_marginals_are_exact_on_trees_and_near_on_loops():
    nodes = personal.described("call +1 (826) 555-4081 and then 555-4081 or so")
    rng = np.random.default_rng(1)
    skip = rng.normal(size=(2, 5, 5)) * 0.7
    field = personal.Field(rng.normal(size=(len(personal.FEATURES), 5)) * 0.5, rng.normal(size=(5, 5)), rng.normal(size=(2, 5)), (skip + skip.transpose(0, 2, 1)) / 2)

    def exact(graph):
        local, total = graph.local(field), np.zeros((graph.n, 5))
        for labels in itertools.product(range(5), repeat=graph.n):
            score = sum(local[i, y] for i, y in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(field.skip[e, labels[a], labels[b]] for a, b, e in graph.skip)
            for i, y in enumerate(labels):
                total[i, y] += math.exp(score)
        return total / total.sum(axis=1, keepdims=True)

    tree = personal.Graph([nodes])
    assert len(tree.skip) == 1 and np.allclose(tree.marginals(field), exact(tree), atol=1e-3)
    loop = personal.Graph([personal.described("555-4081 5554081 x 555-4081")])
    assert len(loop.chain) == 1 and len(loop.skip) == 2
    loop.skip = np.array([[0, 1, 0], [1, 2, 0], [0, 2, 1]])
    assert np.abs(loop.marginals(field) - exact(loop)).max() < 0.1


CASES = [
    ("ab +1 (826) 555-4081 190.137.223.204 cd", [("phone", "+1 (826) 555-4081")]), ("ab 4539578763621486 12 cd", [("card", "4539578763621486")]), ("1219538112535716 and 1219538112535716 ef", []),
    ("ab +1 (826) 555-4081 cd ef gh (826) 555-4081 ij", [("phone", "(826) 555-4081")]), ("only (826) 555-4081 here", []), ("version 2.0 of 1999-2001, 2024-11-05 and 555 7", []), ("+1 " * 50, []),
]


def test_personal_data(spark, hard, folder):
    rng = random.Random(6)
    texts = []
    for i in range(400):
        number = "".join(rng.choices("0123456789", k=16))
        while i % 2 and not plain_test("card", number):
            number = "".join(rng.choices("0123456789", k=16))
        texts.append(rng.choice([f"x {number} y", f"x a{i}.b@m{i}.example.com, y", f"ü +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} z", f"x {rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{i % 256} y", "License, Version 2.0. of 2021"]))
    texts += [t for t, _ in CASES] + [None, "", "\x00" * 5]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], ""), (0, texts[0], "")], "doc_id long, text string, Spans string")
    got = personal.find_personal(docs).toPandas()
    assert len(got) == len(texts) + 2 and list(got.columns) == ["doc_id", "base_spans", "spans"]
    assert got[got.doc_id.isna()].spans.tolist() == got[got.doc_id == 0].spans.tolist()[:1]
    by = got.dropna().drop_duplicates().set_index("doc_id")
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert by.base_spans[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in by.spans[i].split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        added = [(k, (t or "")[a:b]) for k, a, b in spans if (k, a, b) not in base]
        assert added == (CASES[i - 400][1] if 400 <= i < 400 + len(CASES) else []), (t, added)
    query = QUERIES["op13_personal_data"](spark, hard).toPandas()
    want = Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t or "")).encode()).hexdigest()) for i, t, *_ in hard_documents()[0])
    assert Counter(zip(whole(query.doc_id), query.base_sha256, strict=True)) == want


def test_personal_counts(spark):
    path = "/root/testdata/sf0.01"
    want = Counter()
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        base = plain_base(r["text"] or "")
        n = Counter(k for k, _, _ in base)
        want[(r["doc_id"], *(n[k] for k in personal.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())] += 1
    got = QUERIES["op13_personal_data"](spark, path).toPandas()
    assert Counter(zip(got.doc_id, got.n_email, got.n_ip, got.n_card, got.n_phone, got.base_sha256, strict=True)) == want


# Archives and shards


def test_foreign_records(spark, tmp_path):
    """Records without a payload digest, captured HTTP messages and revisits of other writers."""
    import base64
    import gzip

    from colloquy.llm import warc

    def record(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<p>x</p>"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    records = [
        record("warcinfo", b"software: y"), record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{hashlib.sha1(http).hexdigest()}"),
        record("revisit", b"", f"WARC-Payload-Digest: sha1:{sha}"), record("revisit", b""), record("resource", body, "WARC-Payload-Digest: md5:abc"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    got = [(r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()]
    own, none = hashlib.sha1(body).hexdigest(), hashlib.sha1(b"").hexdigest()
    assert got[0] == ("warcinfo", 11, hashlib.sha1(b"software: y").hexdigest()) and got[1] == ("request", 0, none)
    assert got[2] == ("response", len(body), own) and got[3][2] == own and got[4][2] is None and got[5] == ("resource", len(body), own)
    with pytest.raises(warc.Broken):
        warc.parsed(gzip.decompress(record("response", http, "WARC-Block-Digest: sha1:" + "0" * 40)), "here")


def test_shards_follow_from_the_records_alone(spark):
    from colloquy.llm import sharding

    rows = [(i, f"t{i}") for i in range(300)] + [(7, "t7")] * 150 + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for n in (1, 3, 7):
        out = sharding.shuffled(docs.repartition(n), 5, bucket_bytes=2_000).collect()
        runs.append(Counter((r.doc_id, r.text, r.shard, r.slot) for r in out))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    other = sharding.shuffled(docs, 5, seed=43, bucket_bytes=2_000).collect()
    assert sum((r.doc_id, r.text, r.shard, r.slot) in runs[0] for r in other) < 60
    # The repeated record is spread like any other.
    shards = Counter(s for (k, _, s, _), n in runs[0].items() if k == 7 for _ in range(n))
    assert len(shards) == 5 and max(shards.values()) < 50


# Quality


def plain_depths(forest, x):
    """Anomaly scores by walking each tree for each row."""
    out = []
    for row in x:
        total = 0.0
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + int(row[forest.feature[at]] >= forest.value[at])
            total += forest.depth[at]
        n = forest.sample
        usual = 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
        out.append(2 ** (-total / len(forest.roots) / usual))
    return np.array(out)


def test_verdicts_and_junk_without_labels(spark):
    """Path lengths against a plain walk; kinds of junk that no label shows are rejected, good rows stay."""
    from colloquy.llm import quality

    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    forest = quality.fit_forest(docs, labels)
    rng = random.Random(1)
    some = [r["text"].split() for r in docs.where("text is not null").orderBy("doc_id").limit(2).collect()]
    junk = [
        " ".join(str(rng.randrange(10**6)) for _ in range(300)), " ".join(rng.choices(some[0][:20], k=300)), " ".join("".join(rng.choices("abcdef", k=120)) for _ in range(80)),
        " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)), "\n".join(f"http://x{rng.randrange(10**5)}.com/{rng.randrange(10**6)}/page.html" for _ in range(100)),
        "\n".join("\t".join(str(rng.randrange(1000)) for _ in range(8)) for _ in range(60)),
    ]
    odd = quality.judge_quality(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), forest).toPandas()
    assert not odd.base_failed.any() and not odd.kept.any()
    judged = quality.judge_quality(docs.join(F.broadcast(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))), "doc_id"), forest).toPandas()
    rest = judged[~judged.base_failed]
    assert rest.kept[rest.quality == 1].mean() > 0.995 and rest.kept[rest.quality == 0].mean() < 0.03
    few = rest.sample(60, random_state=1)
    counts = few[list(quality.COUNTS)].to_numpy(dtype=np.int64)
    assert np.allclose(plain_depths(forest, quality.features(counts)), few.anomaly) and np.allclose(plain_depths(forest.shape, quality.shapes(counts)), few.shape_anomaly)
    assert ((few.anomaly < forest.threshold) & (few.shape_anomaly < forest.shape.threshold)).tolist() == few.kept.tolist()
