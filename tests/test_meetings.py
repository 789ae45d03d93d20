"""Attribution, processors and facts on small literal meetings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.operators import attribution as at
from colloquy.operators import facts as fa
from colloquy.operators import ordered
from colloquy.operators import fuzzy as fz
from colloquy.operators import processors as pr
from colloquy.operators import topics as tp
from colloquy.sources.profiles import Entry, Profile, list_profiles, load_profile, resolve_profile

WORDS = "job_id long, word_idx long, text string, start_ms long, end_ms long, confidence double"
TURNS = "job_id long, turn_idx long, speaker_id string, start_ms long, end_ms long"


def assigned(words, turns):
    """Direct statement of the rule: longest overlap, ties to the earliest turn, else the last known speaker."""
    last, out = at.UNKNOWN, []
    for _, i, _, s, e, _ in words:
        e = max(e, s + 1)
        best = max(((min(e, te) - max(s, ts), -ts, -k, sp) for _, k, sp, ts, te in turns), default=None)
        if best and best[0] > 0:
            last = best[3]
        out.append((i, last))
    return out


@pytest.mark.parametrize("block", [2, 65_536])
def test_assign_speakers_against_loop(spark, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(block)
    words = [(1, i, f"w{i}", s := i * 700 + rng.randint(0, 300), s + rng.choice([0, 200, 900, 70_000]), None) for i in range(60)]
    turns = [(1, k, f"S{rng.randint(0, 3)}", s := rng.randint(0, 45_000), s + rng.randint(0, 9_000)) for k in range(12)]
    got = at.assign_speakers(spark.createDataFrame(words, WORDS), spark.createDataFrame(turns, TURNS))
    assert sorted((r.word_idx, r.speaker_id) for r in got.collect()) == assigned(words, turns)


@pytest.mark.parametrize("block", [2, 65_536])
def test_fused_attribution_equals_steps(spark, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(block)
    words = spark.createDataFrame(
        [(1, i, rng.choice(["w", "w.", "x?"]), i * 500, i * 500 + 300, None) for i in range(50)], WORDS
    )
    turns = spark.createDataFrame([(1, k, f"S{k % 2}", k * 4_000 + 2_000, k * 4_000 + 5_000) for k in range(6)], TURNS)
    fused = at.attributed_runs(words, turns)
    steps = at.number_runs(at.assign_speakers(words, turns)).select(*fused.columns)
    assert sorted(map(str, fused.collect())) == sorted(map(str, steps.collect()))


def test_no_turns_leave_everyone_unknown(spark):
    words = spark.createDataFrame([(1, 0, "hi", 0, 10, None)], WORDS)
    rows = at.assign_speakers(words, spark.createDataFrame([], TURNS)).collect()
    assert [r.speaker_id for r in rows] == [at.UNKNOWN]


def test_unknown_takes_no_number(spark):
    segs = spark.createDataFrame([(1, 0, at.UNKNOWN), (1, 1, "B"), (1, 2, "A"), (1, 3, "B")], "job_id long, seg_idx long, speaker_id string")
    names = {r.speaker_id: r.display for r in at.speaker_names(segs).collect()}
    assert names == {at.UNKNOWN: "Unknown", "B": "Speaker 1", "A": "Speaker 2"}


def spoken(spark, *segments):
    rows, i = [], 0
    for s, text in enumerate(segments):
        for w in text.split():
            rows.append((1, s, i, w, i * 400, i * 400 + 300, 0.9, f"S{s % 2}"))
            i += 1
    return spark.createDataFrame(
        rows, "job_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, confidence double, speaker_id string"
    )


def texts(words):
    return [r.text for r in pr.segment_texts(words).orderBy("job_id", "seg_idx").collect()]


def test_repeats(spark):
    words = spoken(spark, "Cost cost COST of the the very very item", "item item")
    assert texts(pr.without_repeats(words)) == ["Cost of the the very very item", "item"]


@pytest.mark.parametrize("raw, tidy", [
    ("we- we go", "we go"), ("no no no way", "no way"), ("no no way", "no no way"), ("the the end", "the end"),
    ("été été ici", "été ici"), (", so  it is , fine", "so it is, fine"), ("very very good good", "very very good"),
])
def test_tidy_text(spark, raw, tidy):
    assert spark.createDataFrame([(raw,)], "t string").select(pr.tidy_text(F.col("t"))).first()[0] == tidy


def test_tidy_text_against_re(spark):
    rng = random.Random(3)
    samples = [" ".join(rng.choice(["no", "a", "a-", "very", "ok,", "ok", ".", ",", "b"]) for _ in range(12)) for _ in range(200)]

    def direct(t):
        t = re.sub(r"\b(\w+)-\s+\1\b", r"\1", t, flags=re.I)
        t = re.sub(r"\b(\w+)(?:\s+\1){2,}\b", r"\1", t, flags=re.I)
        t = re.sub(r"\b(\w+)\s+\1\b", lambda m: m[0] if m[1].lower() in lx.EMPHASIS else m[1], t, flags=re.I)
        t = re.sub(r"\s+([,.!?;:])", r"\1", t)
        return re.sub(" {2,}", " ", re.sub(r"^[,.]+\s*", "", t)).strip()

    got = spark.createDataFrame([(s,) for s in samples], "t string").select("t", pr.tidy_text(F.col("t")).alias("o")).collect()
    assert [(r.t, r.o) for r in got] == [(r.t, direct(r.t)) for r in got]


def test_readable_words(spark):
    words = spoken(spark, "what did i say", "it works. i, agree", "well um", '"quoted start')
    assert texts(pr.readable_words(words)) == ["What did I say?", "It works. I, agree.", "Well um", '"Quoted start.']


def test_capitals_are_one_letter(spark):
    words = spoken(spark, "\u00dflich war", "\u00e9t\u00e9 \ufb01n", "\u1fb3x yes")
    assert texts(pr.readable_words(words)) == ["\u1e9elich war.", "\u00c9t\u00e9 \ufb01n.", "\u1fbcx yes."]


def test_vocabulary_context_and_order(spark):
    profile = Profile("p", vocabulary=(
        Entry("Acme Group", ("acme",), 0.9), Entry("Group Ltd", ("group",), 0.9, ("acme",)),
        Entry("Kredit", ("credit",), 0.9, ("bank",)), Entry("ML", ("em el",), 0.79, ("model",)),
    ))
    df = spark.createDataFrame([(1, "acme gives credit"), (2, "bank credit"), (3, "em el model"), (4, "em el")], "id long, text string")
    got = {r.id: (r.text, [(f.original, f.confidence) for f in r.fixes]) for r in pr.apply_vocabulary(df, profile, ("id",)).collect()}
    assert got[1] == ("Acme Group Ltd gives credit", [("acme", 0.9), ("Group", 0.92)])
    assert got[2] == ("bank Kredit", [("credit", 0.92)])
    assert got[3] == ("ML model", [("em el", 0.81)])
    assert got[4] == ("em el", [])


def test_realign_spreads_times_and_keeps_the_rest(spark):
    words = spoken(spark, "aa bb cc", "dd ee")
    new = spark.createDataFrame([(1, 0, "aa x"), (1, 1, "dd zz")], "job_id long, seg_idx long, text string")
    got = [(r.word_idx, r.text, r.start_ms, r.end_ms) for r in pr.realign(words, new).orderBy("word_idx").collect()]
    assert got == [(0, "aa", 0, 550), (1, "x", 550, 1100), (2, "dd", 1200, 1500), (3, "zz", 1600, 1900)]


@pytest.mark.parametrize("block", [3, 65_536])
def test_context_rules_walk_from_left_to_right(spark, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rules = (("B", "^a$", "c"), ("Z", "^d$", r"\bB\b"), ("Y", "^e$", r"\bZ\b"))
    tokens = "c a d e x x x x x x x x d e a c e".split()
    want = list(tokens)
    for i, t in enumerate(tokens):
        near = " ".join(want[max(0, i - 8):i] + tokens[i:i + 9])
        for canonical, target, signal in rules:
            if re.search(target, t) and re.search(signal, near) and t != canonical:
                want[i] = canonical
                break
    got = pr.context_rules(spoken(spark, " ".join(tokens)), rules).orderBy("word_idx").collect()
    assert [r.text for r in got] == want


def test_fuzzy_score():
    assert fz.similarity("ticket", "tickets") == pytest.approx(100 * 12 / 13)
    assert fz.similarity("", "") == 100.0


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_near_words_against_all_pairs(spark):
    rng = random.Random(9)
    aliases = [(i, f"r{i}", "".join(rng.choices("abcdé", k=rng.randint(4, 14)))) for i in range(40)]
    tokens = {"".join(rng.choices("abcdé", k=rng.randint(0, 9))) for _ in range(200)}
    for _, _, a in aliases:
        for _ in range(12):
            t = list(a)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "B"])
            tokens.add("".join(t))
    want = {}
    for t in tokens:
        for rank, name, a in aliases:
            score = 200 * plain_common(t.lower(), a) / (len(t) + len(a)) if len(a) >= 6 else 0
            if score >= 88:
                want[t] = (name, a, pytest.approx(score))
                break
    got = {r.token: (r.replacement, r.alias, r.score) for r in fz.near_words(spark.createDataFrame([(t,) for t in tokens], "text string"), spark.createDataFrame(aliases, "rank int, replacement string, alias string")).collect()}
    assert got == want and len(want) > 150


def test_vocabulary_chains_and_counts_no_step_twice(spark):
    profile = Profile("p", vocabulary=(
        Entry("b c", ("a",)), Entry("d", ("c e",)), Entry("x$1", ("d",)), Entry(r"\\y", ("b",)), Entry("never", ("zz",)), Entry("Q+", ("f+g", "f+g h"), case_sensitive=True), Entry("low", ("b",), 0.5),
    ))
    df = spark.createDataFrame([(1, "a e"), (2, "zz"), (3, "F+G h f+g h f+g"), (4, ""), (5, None)], "id long, text string")
    got = {r.id: (r.text, [(f.step, f.original) for f in r.fixes]) for r in pr.apply_vocabulary(df, profile, ("id",)).collect()}
    assert got[1] == (r"\\y x$1", [(0, "a"), (1, "c e"), (2, "d"), (3, "b")])
    assert got[2] == ("never", [(4, "zz")]) and got[4] == ("", []) and got[5] == (None, [])
    assert got[3] == ("F+G h Q+ Q+", [(5, "f+g h"), (6, "f+g")])


def test_fuzzy_corrections(spark):
    profile = Profile("p", vocabulary=(Entry("ledger", ("ledgerr", "legder"), fuzzy=True), Entry("no", ("nothing",))))
    tokens = spark.createDataFrame([("Ledger",), ("nothing",), ("ledgers",)], "text string")
    assert {r.token: r.replacement for r in pr.fuzzy_corrections(tokens, profile).collect()} == {"Ledger": "ledger"}


def test_unknown_processor_is_skipped(spark):
    words = spoken(spark, "aaaa aaaa bb")
    t = pr.Transcripts(words, pr.segment_texts(words))
    assert [r.text for r in pr.run_processors(t, Profile("p", ("nothing_like_it", "transcript_cleanup"))).texts.collect()] == ["aaaa bb"]


def test_speaker_formatting_merges(spark):
    words = spoken(spark, "one", "two", "three").withColumn("speaker_id", F.when(F.col("seg_idx") < 2, "A").otherwise("B"))
    t = pr.format_speakers(pr.Transcripts(words, pr.segment_texts(words)), Profile("p"))
    assert [r.text for r in t.texts.orderBy("seg_idx").collect()] == ["one two", "three"]


def test_profiles():
    assert list_profiles() == ["generic", "sales"]
    assert resolve_profile("missing").vocabulary == ()
    with pytest.raises(FileNotFoundError):
        load_profile("missing")


def sents(spark, *items):
    rows = [(1, i, i, f"S{i % 2}", i * 1000, i * 1000 + 900, len(t.split()), t) for i, t in enumerate(items)]
    return spark.createDataFrame(
        rows, "job_id long, sent_no long, seg_idx long, speaker_id string, start_ms long, end_ms long, n_words long, text string"
    )


def test_first_free_item_against_loop(spark):
    rng = random.Random(11)
    rows = [(1, s, r, k, k) for s in range(40) for r, k in enumerate(rng.sample([f"key{i}" for i in range(25)], rng.randint(1, 4)))]
    taken, want = set(), set()
    for s in range(40):
        for _, s2, r, item, key in rows:
            if s2 == s and key not in taken:
                taken.add(key)
                want.add((s, r))
                break
    df = spark.createDataFrame(rows, "job_id long, sent_no long, rank int, item string, key string")
    assert {(r.sent_no, r["rank"]) for r in fa.first_free(df).collect()} == want


def test_actions_and_decisions(spark):
    names = spark.createDataFrame([(1, "S0", "Ann"), (1, "S1", "Bob")], "job_id long, speaker_id string, display string")
    s = sents(
        spark, "I'll send the draft by next Friday.", "The sky is blue.", "We might use it.", "Please review it today.",
        "I will send the draft by next Friday.", "We've decided to wait for legal.", "Action item: call the bank by March 3rd, 2024",
    )
    got = [(r.sent_no, r.task, r.owner, r.due_date) for r in fa.action_items(s, names).orderBy("sent_no").collect()]
    assert got == [
        (0, "send the draft by next Friday", "Ann", "next Friday"), (3, "review it today", None, "today"),
        (6, "call the bank by March 3rd, 2024", None, "March 3rd, 2024"),
    ]
    assert [(r.sent_no, r.decision) for r in fa.decisions(s).collect()] == [(5, "to wait for legal")]


def test_questions_and_answers(spark):
    s = sents(
        spark, "What is the final budget now?", "Not sure about that one.", "It is all done by now, right?", "Is it all done by now, right?",
        "Right?", "Who will write the minutes then?",
    )
    segs = s.select("job_id", "seg_idx", "speaker_id", "start_ms", "text")
    got = {r.sent_no: r.is_answered for r in fa.questions(s, segs).collect()}
    assert got == {0: False, 3: True, 5: False}


@pytest.mark.parametrize("block", [4, 65_536])
def test_topic_chunks_against_loop(spark, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(80):
        t += rng.choice([0, 500, 2_000, 9_000 if i % 17 == 0 else 0])
        end = t + rng.choice([5_000, 40_000, 130_000, 310_000 if i % 23 == 0 else 1_000])
        rows.append((1, i, t, end))
        t = end
    want, chunk, start = [], 0, rows[0][2]
    for n, (_, i, s, e) in enumerate(rows):
        if n and (s - rows[n - 1][3] >= 8_000 or e - start >= 300_000):
            chunk, start = chunk + 1, s
        want.append((i, chunk))
    got = tp.topic_chunks(spark.createDataFrame(rows, "job_id long, seg_idx long, start_ms long, end_ms long"))
    assert sorted((r.seg_idx, r.chunk) for r in got.collect()) == want


def test_near_spellings_are_scored_in_many_parts(spark):
    # Few bytes stand for much work: left to their size, all pairs would meet in one or two tasks.
    tokens = spark.createDataFrame([("deployment",), ("deploymnet",), ("other",)], "text string")
    aliases = spark.createDataFrame([(0, "DEPLOY", "deployment"), (1, "OTHER", "otherwise")], "rank int, replacement string, alias string")
    found = fz.near_words(tokens, aliases)
    assert {(r.token, r.replacement, r.score) for r in found.collect()} == {("deployment", "DEPLOY", 100.0), ("deploymnet", "DEPLOY", 90.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parts = [int(n) for n in re.findall(r"Repartition (\d+), true", plan)]
    assert len(parts) == 2 and min(parts) == 4 * spark.sparkContext.defaultParallelism


def test_many_aliases_meet_by_subsequences(spark, monkeypatch):
    """Aliases of lengths that many share give what all pairs give, and none of them meets a word by a letter pair."""
    monkeypatch.setattr(fz, "MANY", 25)
    monkeypatch.setattr(fz, "KEYS_AT_ONCE", 300)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choices(["th", "nd", "er", "e", "on"], k=n))[:n]
    aliases = [(rank, f"r{rank % 5}", some(n)) for rank, n in enumerate([11] * 60 + [12] * 40 + [24] * 40 + [9] * 3)]
    # Ranks and aliases that repeat, and those without a rank.
    aliases += [(7, None, aliases[9][2].upper()), (9, "r", aliases[9][2]), (None, "none", some(11)), (3, "none", None)]
    tokens = [some(rng.randint(1, 15)) for _ in range(300)] + [None, ""]
    for _, _, a in aliases[:-1]:
        for _ in range(6):
            t = list(a)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "H"])
            tokens.append("".join(t))
    want = {}
    for t in {t for t in tokens if t is not None and len(t) > 1}:
        near = [(rank, name is not None, name or "", a.lower()) for rank, name, a in aliases if rank is not None and a and 200 * plain_common(t.lower(), a.lower()) >= 88 * (len(t) + len(a))]
        if near:
            rank, there, name, a = min(near)
            want[t] = (name if there else None, a, pytest.approx(200 * plain_common(t.lower(), a) / (len(t) + len(a))))
    met, by_pairs = [], fz._pairs_met
    monkeypatch.setattr(fz, "_pairs_met", lambda *a: met.append(by_pairs(*a)) or met[-1])
    found = fz.near_words(spark.createDataFrame([(t,) for t in tokens], "text string"), spark.createDataFrame(aliases, "rank int, replacement string, alias string"))
    assert {r.token: (r.replacement, r.alias, r.score) for r in found.collect()} == want and len(want) > 300
    # Nine letters are shared by three aliases only, 24 take too many keys.
    assert {len(r.alias) for r in met[0].collect()} == {9, 24}


@pytest.mark.parametrize("block", [7, 65_536])
def test_runs_of_blocks_equal_those_of_words(spark, block, monkeypatch):
    """Pieces told apart give what attribution word by word gives; long turns, gaps, silent openings and one-word blocks included."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(block)
    words, blocks = [], []
    for job in (1, 2, 3):
        at_word, clock = 0, 0
        while at_word < 60:
            n = rng.choice([1, 1, 2, 5, 12])
            own = []
            for i in range(n):
                clock += rng.choice([300, 500, 20_000 if rng.random() < 0.05 else 400])
                own.append((clock, clock + rng.choice([0, 250, 900])))
                words.append((job, at_word + i, rng.choice(["w", "w", "w.", "x?"]), *own[-1], None))
            ends = [i for i in range(n) if words[len(words) - n + i][2][-1] in ".!?"]
            blocks.append((job, at_word, n, min(s for s, _ in own), max(e for _, e in own), ends, own))
            at_word += n
    turns = [(j, k, f"S{rng.randint(0, 2)}", s := rng.randint(1_000, 40_000), s + rng.randint(-5, 6_000)) for j in (1, 2) for k in range(14)]
    times = "array<struct<start_ms:long,end_ms:long>>"
    b = spark.createDataFrame(blocks, f"job_id long, block long, n long, start_ms long, end_ms long, ends array<int>, times {times}")
    w, t = spark.createDataFrame(words, WORDS), spark.createDataFrame(turns, TURNS)
    want = {(r.job_id, r.word_idx): (r.seg_idx, r.sent_no, r.speaker_id, r.prev_end_ms) for r in at.number_runs(at.assign_speakers(w, t)).collect()}
    end = {(j, i): e for j, i, _, _, e, _ in words}
    got = {}
    for r in at.block_runs(b, t, F.col("times")).collect():
        for p in r.pieces:
            for i in range(p.n_words):
                idx = r.block + p.at + i
                got[r.job_id, idx] = (p.seg_idx, p.sent_no, p.speaker_id, p.prev_end_ms if i == 0 else end[r.job_id, idx - 1])
    assert len({v[2] for v in want.values()}) > 2
    assert got == want


def test_changes_of_case_bring_no_new_words(spark):
    """Of the texts in between only those with other words are kept for the next look-up."""
    from colloquy.operators import vocabulary as vo

    steps = "array<struct<step:int,alias:string,canonical:string,confidence:double,context:array<string>,pattern:string,written:string>>"
    rows = [(["one", "ONE"], ["two", "three"], ["four", "FOUR"])]
    todo = [[(i, a, b, 0.9, [], rf"(?iU)\b\Q{a}\E\b", b) for i, (a, b) in enumerate(r)] for r in rows]
    start = F.struct(F.lit("one two four").alias("text"), F.array().cast(vo.FIXES).alias("fixes"), F.array(F.lit("one two four")).alias("seen"))
    got = spark.createDataFrame([(t,) for t in todo], f"s {steps}").select(F.aggregate("s", start, vo._apply).alias("x")).first().x
    assert (got.text, len(got.fixes), got.seen) == ("ONE three FOUR", 3, ["one two four", "ONE three four"])


def test_log_of_corrections_aligns_no_words(spark, monkeypatch):
    monkeypatch.setattr(pr, "realign", lambda *_: pytest.fail("words aligned for the log alone"))
    monkeypatch.setattr(pr, "scan", lambda *_, **__: pytest.fail("words read for the log alone"))
    texts = spark.createDataFrame([(1, 0, "see the ledgerr"), (1, 1, "nothing here")], "job_id long, seg_idx long, text string")
    profile = Profile("p", vocabulary=(Entry("ledger", ("ledgerr",)),))
    assert [(r.seg_idx, r.original, r.replacement, r.profile) for r in pr.vocabulary_log(texts, profile).collect()] == [(0, "ledgerr", "ledger", "p")]


def test_evenly_spaced_words_are_looked_at_near_turn_ends_only(spark):
    """Few places stand for all words of a block: the pieces are those of a look at every word."""
    rng = random.Random(5)
    rows = [(j, b * 40, 40, [39] if b % 2 else [7, 20], b * 17_000 + 300) for j in (1, 2) for b in range(3)]
    blocks = spark.createDataFrame(rows, "job_id long, block long, n long, ends array<int>, s long").selectExpr("*", "s as start_ms", "s + 39 * 400 + 350 as end_ms")
    turns = [(j, k, f"S{rng.randint(0, 2)}", s := rng.choice([300 + 400 * rng.randint(0, 90), rng.randint(0, 50_000)]), s + rng.choice([50, 350, 400, 9_000])) for j in (1, 2) for k in range(25)]
    t = spark.createDataFrame(turns, TURNS)
    time = lambda i: F.struct((F.col("s") + i * 400).alias("start_ms"), (F.col("s") + i * 400 + 350).alias("end_ms"))
    few = lambda near: at.even_places(near, F.col("s"), 400, F.col("n"))
    want, got = at.block_runs(blocks, t, time).collect(), at.block_runs(blocks, t, time, few).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({p.speaker_id for r in want for p in r.pieces}) > 2
    near = spark.createDataFrame([([(4_500, 8_300)],)], "near array<struct<t_start:long,t_end:long>>")
    assert near.select(at.even_places(F.col("near"), F.lit(300), 400, F.lit(40))).first()[0] == [0, 10, 11, 20, 21]


def test_whole_sentences_are_not_gathered(spark, monkeypatch):
    pieces = "job_id long, seg_idx long, sent_no long, speaker_id string, n_words long, text string, word_idx long, start_ms long, end_ms long, prev_end_ms long, whole boolean"
    rows = [
        (1, 0, 0, "S0", 2, "so what?", 0, 0, 800, None, True), (1, 0, 1, "S0", 1, "well", 2, 900, 1_000, 800, False),
        (1, 0, 1, "S0", 1, "then.", 3, 1_500, 1_600, 1_000, False), (1, 1, 2, "S1", 1, "yes", 4, 2_000, 2_100, None, False),
    ]
    df = spark.createDataFrame(rows, pieces)
    want = sorted(map(str, at.sentences(df.drop("whole")).collect()))
    seen, gathered = [], at._gathered
    monkeypatch.setattr(at, "_gathered", lambda words, *a: seen.append(words.count()) or gathered(words, *a))
    assert sorted(map(str, at.sentences(df).collect())) == want and seen == [3]


def test_sentences_are_searched_once(spark, monkeypatch):
    """Decisions read the sentences once, whatever the rounds read again."""
    reads = []
    stored = fa.written
    monkeypatch.setattr(fa, "written", lambda df, label: reads.append(label) or stored(df, label))
    rows = [(1, i, 0, "S0", i * 1_000, f"We decided to use plan {i}.") for i in range(3)] + [(1, 3, 0, "S0", 3_000, "Nothing here.")]
    sents = spark.createDataFrame(rows, "job_id long, sent_no long, seg_idx long, speaker_id string, start_ms long, text string")
    found = fa.decisions(sents)
    assert sorted(r.decision for r in found.collect()) == [f"to use plan {i}" for i in range(3)]
    assert reads[:2] == ["said", "candidates"] and "ExistingRDD" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_found_in_any_case():
    """Letters passed over before the boundaries do not change what is found."""
    assert lx.whole_words("(?:we\\s+use|i'll)", "please") == r"(?iU)(?=[ipw])\b(?:(?:we\s+use|i'll)|please)\b"


def test_words_are_counted_without_alignment(spark, monkeypatch):
    """Counts from the texts equal those of the words that clean-up and correction leave."""
    texts = ["so so that that that very very This this", "see the ledgerr ledgerr now", "end"]
    rows = [(1, k, i, w) for i, (k, w) in enumerate((k, w) for k, t in enumerate(texts) for w in t.split(" "))]
    words = spark.createDataFrame([(j, k, i, w, i * 400, i * 400 + 350, None, "S0") for j, k, i, w in rows], "job_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, confidence double, speaker_id string")
    segs = spark.createDataFrame([(1, k, t, len(t.split(" "))) for k, t in enumerate(texts)], "job_id long, seg_idx long, text string, n_words long")
    profile = Profile("p", vocabulary=(Entry("general ledger", ("ledgerr",)),))
    kept = dict(pr.without_repeats(words).groupBy("seg_idx").count().collect())
    fixed = dict(pr.correct_vocabulary(pr.transcripts(words, segs), profile).words.groupBy("seg_idx").count().collect())
    monkeypatch.setattr(pr, "realign", lambda *_: pytest.fail("words aligned for their number alone"))
    assert {r.seg_idx: r.n for r in segs.select("seg_idx", pr.n_without_repeats(F.col("text")).alias("n")).collect()} == kept
    assert {r.seg_idx: r.n_words for r in pr.corrected_counts(segs, profile).collect()} == fixed == {0: 9, 1: 7, 2: 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_stretches_cut_into_pieces_equal_the_runs_of_blocks(spark, seed):
    """A row per block and run holds what the pieces of the block say, texts included; runs and sentences go on over blocks."""
    rng = random.Random(seed)
    rows, at_word, clock = [], 0, 0
    for _ in range(30):
        n = rng.choice([1, 1, 2, 5, 12])
        tokens = [rng.choice(["w", "w", "w", "w.", "x?"]) + str(i) * (i % 2) for i in range(n)]
        rows.append((1, at_word, n, clock, clock + n * 400 - 50, [i for i, x in enumerate(tokens) if x[-1] in ".!?"], " ".join(tokens)))
        at_word, clock = at_word + n, clock + n * 400 + rng.choice([0, 30_000])
    turns = [(1, k, f"S{rng.randint(0, 2)}", s := rng.randint(0, clock), s + rng.choice([300, 2_000, 9_000])) for k in range(60)]
    b = spark.createDataFrame(rows, "job_id long, block long, n long, start_ms long, end_ms long, ends array<int>, text string")
    t = spark.createDataFrame(turns, TURNS)
    time = lambda i: F.struct((F.col("start_ms") + i * 400).alias("start_ms"), (F.col("start_ms") + i * 400 + 350).alias("end_ms"))
    texts = {r[1]: r[6].split(" ") for r in rows}
    want = [
        (r.block, p.at, p.n_words, p.seg_idx, p.sent_no, p.speaker_id, p.whole, " ".join(texts[r.block][p.at : p.at + p.n_words]))
        for r in at.block_runs(b.drop("text"), t, time).collect() for p in r.pieces
    ]
    stretches = at.run_stretches(at.numbered_blocks(b, t, time), "job_id", "block")
    got = [(r.block, r.pos + r["at"], r.n_words, r.seg_idx, r.sent_no, r.speaker_id, r.whole, r.text) for r in at.stretch_pieces(stretches).collect()]
    assert sorted(got) == sorted(want) and len({x[3] for x in want}) > 3 and {x[6] for x in want} == {True, False}
    first = {(r.block, p.at): p.prev_end_ms for r in at.block_runs(b.drop("text"), t, time).collect() for p in r.pieces}
    assert all(r.prev_end_ms == first[r.block, r.pos] for r in stretches.collect())


def test_texts_of_several_words_move_once(spark):
    """Segments of stretches are gathered by one shuffle, those of single words in bounded pieces first."""
    rows = [(1, 0, "S0", 2, "so what?", 0, 0, 800), (1, 0, "S0", 1, "well", 2, 900, 1_000), (1, 1, "S1", 1, "yes", 3, 2_000, 2_100)]
    df = spark.createDataFrame(rows, "job_id long, seg_idx long, speaker_id string, n_words long, text string, word_idx long, start_ms long, end_ms long")
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    segs = at.segments(df)
    assert shuffles(segs) == 1 and shuffles(at.segments(df.drop("n_words"))) == 2
    assert [(r.seg_idx, r.n_words, r.first_word, r.start_ms, r.end_ms, r.text) for r in segs.orderBy("seg_idx").collect()] == [
        (0, 3, 0, 0, 1_000, "so what? well"), (1, 1, 3, 2_000, 2_100, "yes")]


def test_texts_of_turns_are_made_once_and_none_is_lost(spark, tmp_path):
    """Turns without words go by the text as it is; turns of one number, equal ones too, keep their words."""
    from colloquy.sources.corpus import Corpus

    rows = [
        (1, 0, "user", "so  we\tgo\n now."), (1, 1, "user", " \t "), (1, 1, "system", None), (1, 2, "user", "a b"), (1, 2, "user", "c d e"),
        (1, 3, None, "same words"), (1, 3, None, "same words"), (2, 9, "assistant", "\n"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = Corpus(spark, str(tmp_path))
    assert "regexp_replace" not in next(x for x in c._spaced()._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
    said = [w for r in c.utterances().collect() for w in (r.text or "").split()]
    told = [w for r in c.pieces().collect() for w in r.text.split(" ")]
    assert sorted(told) == sorted(said) and sorted(r.text for r in c.words().collect()) == sorted(said) == sorted(r.text for r in c.timed_words().collect())
    assert sum(r.n_words for r in c.segments().collect()) == len(said) == len({(r.job_id, r.word_idx) for r in c.words().collect()})


def test_patterns_are_searched_where_an_alias_may_stand(spark):
    """What the guard passes over the patterns would not match, special letters and texts made by earlier steps included."""
    entries = (
        Entry("Big Bank", ("sik bank",)), Entry("bin", ("big",)), Entry("tin$1\\x", ("bin bank",)), Entry("Öl", ("ÖLL", "kim")), Entry("Alicia", ("Alice",), case_sensitive=True),
    )
    profile = Profile("p", vocabulary=entries)
    texts = ["SIK BANK", "ſik bank", "ſıK bank", "SİK bank", "öll ÖLL", "Kim", "alice Alice", "nothing", "", None, "the sik bankk", "BIG bank sik bank"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for e, _, pattern in pr._alias_steps(profile):
        plain = F.regexp_replace(plain, pattern, pr._literal(e.canonical))
    rows = df.select("text", plain.alias("want"), pr.correct_always(F.col("text"), profile).alias("got"), pr.may_hold(F.col("text"), pr.plain_low(F.col("text")), "sik bank", False).alias("may"))
    assert all(r.want == r.got for r in rows.collect()) and rows.filter("want <> text").count() >= 7
    assert [r.may for r in rows.collect()] == [True, True, True, True, False, False, False, False, False, True, True, True]


def test_plain_letters_are_those_that_java_sees_alike(spark):
    """Cases, words and matches without case of the letters that the search for an alias takes in its own hands."""
    from colloquy.operators import vocabulary as vo

    letters = spark.createDataFrame([(c, c.lower(), c in vo._WORDS, sorted(vo._runs_in(c, [1]))) for c in vo.PLAIN], "c string, low string, word boolean, runs array<string>")
    odd = letters.filter((F.lower("c") != F.col("low")) | (vo.words_of(F.col("c")) != F.col("runs")) | (F.col("c").rlike(r"(?U)\A\w\z") != F.col("word")))
    assert odd.collect() == [] and not {"\u00b5", "\u0130", "\u0131", "\u017f", "\u212a", "\u03c3"} & set(vo.PLAIN)
    other = letters.select(F.col("c").alias("d"), F.col("low").alias("d_low"))
    pattern = F.concat(F.lit(r"(?iU)\A\Q"), "c", F.lit(r"\E\z"))
    assert letters.join(other, F.rlike("d", pattern) != (F.col("low") == F.col("d_low"))).count() == 0


def test_vocabulary_equals_a_fold_of_all_steps(spark):
    """Steps that meet a text, or what steps before them wrote, give what all steps one after another give, in plain letters and in others."""
    from colloquy.operators import vocabulary as vo

    rng = random.Random(8)
    words = ["a", "b", "ab", "B", "c-a", "e", "stra\u00dfe", "STRASSE", "\u00c9te", "\u017fo", "\u0131", "\u212a", "x1", "f+", "$1", "na\u0308"]
    some = lambda n: rng.choice([" ", ", ", "  ", "+"]).join(rng.choices(words[:9] if rng.random() < 0.7 else words, k=n))
    entries = [
        ("p", i, rng.choice(["", some(1), some(2), some(1).upper()]), [some(rng.randint(1, 2)) for _ in range(rng.randint(1, 3))] + (["", "+"] if i == 7 else []),
         rng.choice([0.9, 0.79, 0.5, 1.0]), rng.choice([[], [], ["e"], ["B", "\u00e9te"]]), rng.random() < 0.3)
        for i in range(25)
    ]
    vocabulary = spark.createDataFrame(entries, "profile string, entry_idx int, canonical string, aliases array<string>, confidence double, context array<string>, case_sensitive boolean")
    texts = spark.createDataFrame([(i, some(rng.randint(0, 9))) for i in range(400)] + [(400, None), (401, "")], "id long, text string")
    table = vo.steps(vocabulary)
    each = F.struct("step", "alias", "canonical", "confidence", "context", "pattern", "written")
    start = F.struct(F.col("text"), F.array().cast(vo.FIXES).alias("fixes"), F.array("text").alias("seen"))
    folded = texts.crossJoin(table.agg(F.array_sort(F.collect_list(each)).alias("s"))).select("id", F.aggregate("s", start, vo._apply).alias("x")).select("id", "x.text", "x.fixes")
    want = {r.id: (r.text, r.fixes) for r in folded.collect()}
    got = {r.id: (r.text, r.fixes) for r in vo.correct_texts(texts, table, ("id",)).collect()}
    assert got == want and sum(len(f or ()) > 2 for _, f in want.values()) > 100


def test_a_step_is_found_though_another_one_is_no_longer(spark):
    """Of "a m" comes "b n" at first, then "c n": as many steps meet these texts, but other ones."""
    from colloquy.operators import vocabulary as vo

    entries = [("p", i, c, [a], 0.9, [], False) for i, (a, c) in enumerate([("a", "b"), ("b", "c"), ("m", "n"), ("b n", "x"), ("c n", "done")])]
    vocabulary = spark.createDataFrame(entries, "profile string, entry_idx int, canonical string, aliases array<string>, confidence double, context array<string>, case_sensitive boolean")
    texts = spark.createDataFrame([(1, "a m"), (2, "b m a n"), (3, "n")], "id long, text string")
    got = {r.id: (r.text, [f.step for f in r.fixes]) for r in vo.correct_texts(texts, vo.steps(vocabulary), ("id",)).collect()}
    assert got == {1: ("done", [0, 1, 2, 4]), 2: ("done done", [0, 1, 2, 4]), 3: ("n", [])}


def test_a_large_vocabulary_needs_no_patterns(spark, monkeypatch):
    """Plain texts are corrected by a search for the alias, and only the n-grams that a step brings in are looked up again."""
    from colloquy.operators import vocabulary as vo

    assert vo._folded("See the Ledgerr, see it", [(0, "ledgerr", "general ledger", 0.9, (), False), (1, "see", "SEE", 0.79, ("the",), False)], [1, 2]) == (
        "SEE the general ledger, SEE it",
        [(0, "Ledgerr", "general ledger", "alias ledgerr", 0.9), (1, "See", "SEE", "alias see near the", 0.79 + 0.02)],
        ["general", "general ledger", "ledger", "ledger see", "the general"],
    )
    broken = F.raise_error(F.lit("searched by a pattern"))
    monkeypatch.setattr(vo, "_pattern", lambda *_: F.when(F.rand() < 2, broken.cast("string")))
    texts = spark.createDataFrame([(1, "see the ledgerr"), (2, "nothing")], "id long, text string")
    table = spark.createDataFrame([("p", 0, "ledgerr", "ledger", 0.9, [], False, "", "", "ledgerr", 1)], "profile string, step int, alias string, canonical string, confidence double, context array<string>, exact boolean, pattern string, written string, gram string, n_words int")
    assert {r.id: (r.text, len(r.fixes)) for r in vo.correct_texts(texts, table, ("id",)).collect()} == {1: ("see the ledger", 1), 2: ("nothing", 0)}
