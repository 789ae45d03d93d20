"""Registered queries on hard and empty tables, against plain versions or SQL."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from colloquy.llm import packing, pieces, quality, sharding, simhash, toxicity, urls, warc, winnowing
from colloquy.llm.queries import QUERIES, SQL
from tests.llm.conftest import hard_documents
from tests.llm.test_parts import plain_counts

ROWS, LABELS = hard_documents()
TEXT = [r[1] or "" for r in ROWS]
IDS = [r[0] for r in ROWS]


def rows(spark, name, path):
    return QUERIES[name](spark, path).toPandas()


def crc(key):
    return zlib.crc32(b"" if key is None else str(key).encode())


def same(a, b):
    """Equal multisets of rows."""
    return Counter(map(repr, a)) == Counter(map(repr, b))


def whole(x):
    return [None if pd.isna(v) else int(v) for v in x]


def test_entry_has_all_queries():
    names = [*QUERIES, "pipeline"]
    assert len(names) == 14 and set(names) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty).empty


def test_quality(spark, hard):
    got = rows(spark, "op1_quality_rules", hard)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = [(i, *plain_counts(t)) for i, t in zip(IDS, TEXT, strict=True)]
    assert same(zip(whole(got.doc_id), *(got[c].tolist() for c in columns), strict=True), want)
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (failed == got.base_failed).all() and not (got.kept & failed).any()
    bad = got.doc_id.isin([i for i, q, _ in LABELS if q == 0 and i != 10**9])
    assert not got.kept[bad].any() and got.kept[~bad & ~failed].mean() > 0.95


def test_pieces(spark, hard):
    got = rows(spark, "op2_sentencepiece_nbest", hard)
    assert got.restored.all() and set(whole(got.doc_id)) == set(IDS) and got.groupby("doc_id")["rank"].max().max() == 4
    best = got[got["rank"] == 1]
    enc = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, found[0][0] / pieces.MILLION, len(found[0][1])) for i, found in zip(IDS, enc.nbest(TEXT, 1), strict=True)]
    assert same(zip(whole(best.doc_id), best.score, best.n_pieces, strict=True), want)


def plain_verdicts(pages, rules, default="allow"):
    for key, url in pages:
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, default, None))
        yield key, host, path, best[2], best[1]


def test_urls(spark, hard):
    pages = spark.read.parquet(f"{hard}/pages.parquet").select("page_id", "url").toPandas()
    data = [(None if pd.isna(k) else int(k), u) for k, u in zip(pages.page_id, pages.url, strict=True)]
    from colloquy.llm.queries import URL_RULES

    got = rows(spark, "op3_url_filters", hard)
    assert same(zip(whole(got.page_id), got.host, got.path, got.rule, got.verdict, strict=True), plain_verdicts(data, URL_RULES))
    # Open-ended paths, equal rules, rules of nulls, a clashing column and no rules.
    rules = [("com", "/e", "block"), ("com", "", "allow"), ("example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es", "allow")]
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block"), ("com", "/", "odd")], "host string, path string, verdict string")
    clash = spark.read.parquet(f"{hard}/pages.parquet").withColumn("Rule", F.lit(1))
    for use, want in ((table, rules), (table.where("false"), [])):
        out = urls.filter_urls(clash, use, default="block").toPandas()
        best = [("example.com", "/en/", "block") if r[:2] == ("example.com", "/en/") else r for r in want]
        assert same(zip(whole(out.page_id), out.host, out.path, out.rule, out.verdict, strict=True), plain_verdicts(data, best, "block")) and "html" in out


def plain_components(ids, prints):
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= 3:
                root[find(f)] = find(g)
    least = defaultdict(list)
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            least[find(f)].append(i)
    return [min(least[find(f)], default=None) for f in prints]


def test_simhash(spark, hard):
    prints = [simhash.fingerprint(t.encode()) for t in TEXT]
    want = list(zip(IDS, (f"{f:016x}" for f in prints), plain_components(IDS, prints), strict=True))
    got = rows(spark, "op4_simhash_golay", hard)
    assert same(zip(whole(got.doc_id), got.fingerprint, whole(got.component_id), strict=True), want)
    assert len({c for _, _, c in want}) < len(set(prints))
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumn("fp", F.lit("clash"))
    kept = simhash.one_of_each(docs).toPandas()
    assert sorted(kept.doc_id.dropna()) == sorted({c for i, _, c in want if i is not None}) and kept.doc_id.isna().sum() == 2
    assert (kept.fp == "clash").all()


def test_crowded_keys_and_long_chains(spark):
    rng = np.random.default_rng(1)
    prints = {int(rng.integers(1 << 62)) for _ in range(20)}
    for seed in list(prints)[:3]:
        at = seed
        for i in range(25):
            at ^= 1 << int(rng.integers(64))
            prints.add(at)
    data = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in data], "doc_id long, fp long")
    want = plain_components(*zip(*data, strict=True))
    for dense in (4096, 1):
        from colloquy.llm.shared import components

        roots = {r["node"]: r["root"] for r in components(simhash.links(frame, dense)).collect()}
        group = defaultdict(set)
        for (_, f), c in zip(data, want, strict=True):
            signed = f - (1 << 64) if f >> 63 else f
            group[c].add(roots.get(signed, signed))
        assert all(len(g) == 1 for g in group.values()) and len(group) == len(set.union(*group.values()))


def check_packing(out, ids, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for at in range(0, len(tokens), 2048):
            part = tokens[at : at + 2048]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(tokens)] += 1
    assert Counter(zip(whole(out.doc_id), out.start, out.length, out.ids_crc32, out.doc_tokens, strict=True)) == want
    out = out.sort_values(["sequence_id", "offset"])
    total = out.groupby("sequence_id").length.sum()
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and total.max() <= 2048
    assert sorted(total.index) == list(range(len(total)))
    return total


def test_packing(spark, hard):
    total = check_packing(rows(spark, "op5_packing", hard), IDS, TEXT)
    assert len(total) <= math.ceil(total.sum() / 2048 * 1.02) + 1
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumn("start", F.lit("clash"))
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).toPandas()
    assert (out.ids.map(len) == out.length).all() and (out.ids.map(lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())) == out.ids_crc32).all()


def test_warc(spark, hard, tmp_path):
    got = rows(spark, "op6_warc", hard)
    first = {}
    pages = [(None if pd.isna(k) else int(k), h or "") for k, h in spark.read.parquet(f"{hard}/pages.parquet").select("page_id", "html").toPandas().itertuples(index=False)]
    for k, h in pages:
        if len(h.encode()) >= 1000 and k is not None:
            first[h] = max(first.get(h, k), k)
    want = []
    for k, h in pages:
        to = first.get(h)
        revisit = to is not None and k != to
        want.append((k, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert same(zip(whole(got.page_id), got.payload_bytes, got.payload_digest, got.record_type, whole(got.refers_to), strict=True), want)
    warc.write_archives(spark.read.parquet(f"{hard}/pages.parquet").withColumn("first", F.lit("clash")), f"{tmp_path}/w")
    back = warc.read_archives(spark, f"{tmp_path}/w").where("record_type = 'response' and key = 10").head()
    assert bytes(back["payload"]).decode() == "é" * 600


def test_winnowing(spark, hard):
    got = rows(spark, "op7_winnowing", hard)
    order = sorted(zip(IDS, TEXT, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        mine, other, next_ = (winnowing.winnowed(winnowing.points_of(t)) for t in (text, edited, after))
        want.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), winnowing.digest(*mine), winnowing.digest(*other), winnowing.likeness(*(np.unique(x[0]) for x in (mine, other))), winnowing.likeness(*(np.unique(x[0]) for x in (mine, next_)))))
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert same(zip(whole(got.doc_id), *(got[c].tolist() for c in columns), strict=True), want)
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    small = winnowing.compare_with_next(docs, rows_per_block=4).toPandas()
    assert same(zip(whole(small.doc_id), *(small[c].tolist() for c in columns), strict=True), want)
    one = winnowing.compare_with_next(docs.where("doc_id = 30")).toPandas()
    assert one.near_next.tolist() == [1.0]
    kept = winnowing.with_fingerprints(docs.withColumn("hashes", F.lit(1))).toPandas()
    assert all(len(h) == len(p) for h, p in zip(kept.hashes, kept.positions, strict=True))


def test_class_lm(spark, hard):
    got = rows(spark, "op8_class_lm", hard)
    train, n = Counter(), 0
    split = [t.encode().lower().split() + [b""] for t in TEXT]
    for i, w in zip(IDS, split, strict=True):
        if crc(i) % 5 != 1:
            train.update(w)
    n = sum(train.values())
    unit = n + 0.5 * (len(train) + 1)
    want = [(i, crc(i) % 5 == 1, len(w), sum(x in train for x in w), n, round(sum(math.log10((train[x] + 0.5) / unit) for x in w), 6)) for i, w in zip(IDS, split, strict=True)]
    assert same(zip(whole(got.doc_id), got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(6), strict=True), want)
    assert (got.score < 0).all() and np.isfinite(got.score).all()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_class_lm_joins_rare_words(spark, hard):
    from colloquy.llm import classlm

    docs = spark.read.parquet(f"{hard}/documents.parquet")
    few, many = (classlm.score(docs, *classlm.fit(docs, own_symbols=20, kinds=10, classes=6, head_words=h)).toPandas().sort_values(["doc_id", "n_chars"]) for h in (5, 10**6))
    assert np.allclose(few.score, many.score) and (few.n_known == few.n_tokens).all() and list(few.lang.fillna("")) == list(many.lang.fillna(""))


def test_class_lm_probabilities_add_up(spark):
    from colloquy.llm import classlm

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, "c c a")], "doc_id long, text string")
    model, counts = classlm.fit(docs, own_symbols=2, kinds=3, classes=3, head_words=2)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for before in range(3):
        known = sum(10 ** (model.transition[before, c] + model.emission[c]) * (n[w] + 0.5) for w in n for c in [model.label[model.symbols[w]]])
        unknown = sum(10 ** (model.transition[before] + model.emission) * 0.5)
        assert abs(known + unknown - 1) < 1e-9


def test_sharding(spark, hard):
    got = rows(spark, "op9_external_shuffle", hard)
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(IDS, TEXT, strict=True)]
    assert same(zip(whole(got.doc_id), got["size"], got.text_crc32, strict=True), want) and (got.law == "rows").all()
    counts = got.groupby("shard").size().reindex(range(8), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumn("Shard", F.lit("clash"))
    few = sharding.shuffled(docs, 5, bucket_bytes=20_000).toPandas()
    assert same(few.text.fillna(""), TEXT) and {len(s) for _, s in few.groupby("shard")} <= {len(ROWS) // 5, len(ROWS) // 5 + 1}
    assert few.sort_values(["shard", "slot"]).doc_id.tolist() != sorted(few.doc_id)


def test_toxicity(spark, hard):
    got = rows(spark, "op10_toxicity", hard)
    assert same(zip(whole(got.doc_id), got.held_out, strict=True), [(i, crc(i) % 3 == 1) for i in IDS])
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    bad = {i for i, _, t in LABELS if t}
    held = got[got.held_out & got.doc_id.notna()]
    hit = held.doc_id.isin(bad)
    assert held.predicted[hit].mean() > 0.8 and held.predicted[~hit].mean() < 0.05
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    none = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.fit(docs, spark.read.parquet(f"{hard}/labels.parquet").where("false"))).toPandas()
    assert (none.score == 0).all()


def test_pipeline(spark, hard, empty):
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, hard)
        if name == "packing":
            check_packing(docs.toPandas(), *zip(*((r["doc_id"], r["text"] or "") for r in before.select("doc_id", "text").collect()), strict=True))
        else:
            assert docs.columns == before.columns
            kept, had = Counter(map(tuple, docs.collect())), Counter(map(tuple, before.collect()))
            assert kept <= had and kept != had
    assert corpus_pipeline.run(spark, hard).count() == docs.count()
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.execute(SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, path).collect()]
    assert same((sorted(r.items()) for r in got), (sorted(r.items()) for r in want))


def test_quality_without_labels(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumn("kept", F.lit("clash"))
    forest = quality.fit_forest(docs, spark.read.parquet(f"{hard}/labels.parquet").where("false"))
    out = quality.judge_quality(docs, forest).toPandas()
    assert (out.kept == ~out.base_failed).all() and "source" in out
