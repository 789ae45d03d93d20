"""Repair of the structure of conversations by the cheapest edits.

A conversation is well formed if the first letters of its roles read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in
turn. Every turn has at most one fault, the first that holds of: blank (no visible character), duplicate (role and text seen earlier),
truncated (the last visible character is none of `.!?`). Edits in order: Keep (0), Rerole to user or assistant (1), Delete (2; blank and
duplicate turns must go), Insert an empty user or assistant turn (5); a truncated turn that stays adds 5. Of the cheapest edits those
with the least string of initials count (D < I < K < R).

Method: nodes of the edit lattice are (turns read, state of the pattern). Two Dijkstra searches, from its start and from its end, settle nodes
in turn until no crossing of equal cost can be left; every edge from a node settled forwards to one settled backwards is a crossing,
and the least concatenation of audits over the cheapest crossings is taken. Both heaps pop by (cost, way along the turns): edges of no
cost read a turn, so all equal costs have met when a node is popped, and its audit is the least one. No audit of a node is the
beginning of another one of the same cost, which makes concatenation safe.

Spark sorts turns into ranges by (conversation, turn, role, text), so that a huge conversation is spread over tasks. A conversation inside one
range is done there. The others are cut into blocks of `BLOCK` turns: first places of each text are found by an aggregate, a block is summed up as
costs and order of audits from each state to each, the summaries of a conversation (some 100 bytes a block) meet and choose states, and the blocks
then find their audits. The digest of a repaired conversation is sequential by nature: its blocks pass one task in order, one at a time.

Defined results: a null role or text counts as one space; turns are ordered by number (nulls first), then role and text. A null conv_id is a
conversation of its own. Repeated rows are duplicates. A conversation whose rows are all marked `absent` has zeros, an empty audit and the digest of
nothing; so has one whose turns are all deleted, but for its counts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import written
from colloquy.llm.texts import SPACES, byte_texts, parts, prepared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns and bytes of text of a block.
BLOCK, BLOCK_BYTES = 1024, 4_000_000
#: States of the pattern: nothing read, a system turn, a user turn, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = {SYSTEM: (), START: (), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
FITS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {b"su", b"ua", b"au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def steps(symbol: str) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, initial) of the edits that read one turn.

    Symbols: x for a turn that must go; else s, u, a or o by the role's first letter, in capitals if the turn is truncated.
    """
    out = [(q, q, DELETE, "D") for q in range(4)]
    if symbol != "x":
        more, role = TRUNCATED * symbol.isupper(), symbol.lower()
        out += [(q, NEXT[q], REROLE + more, "R") for q in range(4)]
        out += [(q, FITS[q][role], KEEP + more, "K") for q in range(4) if role in FITS[q]]
    return out


AHEAD = {c: [[(to, cost, e) for q, to, cost, e in steps(c) if q == at] for at in range(4)] for c in "xsuaoSUAO"}
BACK = {c: [[(q, cost, e) for q, to, cost, e in steps(c) if to == at] for at in range(4)] for c in "xsuaoSUAO"}


def search(symbols: str, start: int, ends: tuple[int, ...], inserts_last: bool) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits of the turns from a state to one of `ends`; None where there are none.

    Inserts come before the turn that is read next; behind the last turn only if inserts_last.
    """
    n = len(symbols)
    if n == 0 and start in ends:
        return 0, ""
    best, audit = None, None
    cost = ({start: 0}, {4 * n + q: 0 for q in ends})
    text = ({start: ""}, {4 * n + q: "" for q in ends})
    done: tuple[set, set] = (set(), set())
    heaps = ([(0, 0, start)], [(0, -n, 4 * n + q) for q in ends])
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        back = heaps[1][0][0] < heaps[0][0][0] or (heaps[1][0][0] == heaps[0][0][0] and len(done[1]) < len(done[0]))
        heap, mine, other, known, words = heaps[back], done[back], done[not back], cost[back], text[back]
        c, _, node = heappop(heap)
        if node in mine:
            continue
        mine.add(node)
        i, q = divmod(node, 4)
        if back:
            edges = [(node - 4 - q + p, k, e) for p, k, e in BACK[symbols[i - 1]][q]] if i else []
            if i < n or inserts_last:
                edges += [(node - q + p, INSERT, "I") for p in BEFORE[q]]
        else:
            edges = [(node + 4 - q + p, k, e) for p, k, e in AHEAD[symbols[i]][q]] if i < n else []
            if i < n or inserts_last:
                edges.append((node - q + NEXT[q], INSERT, "I"))
        here = words[node]
        for to, k, e in edges:
            way = e + here if back else here + e
            if to in other:
                total = c + k + cost[not back][to]
                if best is None or total <= best:
                    joined = text[0][to] + way if back else way + text[1][to]
                    if best is None or total < best or joined < audit:
                        best, audit = total, joined
            if to in mine:
                continue
            new = c + k
            old = known.get(to)
            if old is None or new < old:
                known[to], words[to] = new, way
                heappush(heap, (new, -(to >> 2) if back else to >> 2, to))
            elif new == old and way < words[to]:
                words[to] = way
    return None if best is None else (best, audit)


@lru_cache(maxsize=200_000)
def short_repair(symbols: str) -> tuple[int, str]:
    return search(symbols, START, (START, ASSISTANT), True)


def repair_symbols(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return short_repair(symbols) if len(symbols) <= 16 else search(symbols, START, (START, ASSISTANT), True)


def symbol(role: bytes, text: bytes, again: bool) -> tuple[str, str]:
    """The turn's symbol and its fault."""
    seen = text.rstrip(SPACES)
    if not seen:
        return "x", "blank"
    if again:
        return "x", "duplicate"
    letter = role[:1].decode("ascii", "replace")
    letter = letter if letter in ("s", "u", "a") else "o"
    return (letter, "") if seen[-1:] in (b".", b"!", b"?") else (letter.upper(), "truncated")


def initial(role: bytes) -> bytes:
    return role.decode("utf-8", "replace")[:1].encode()


def edited(audit: str, start: int, turns: list[tuple[bytes, bytes]]):
    """(edit, role, text) of the edits in order; deleted turns keep theirs."""
    at, q = 0, start
    for e in audit:
        if e == "I":
            q = NEXT[q]
            yield e, NAMES[q], b""
            continue
        role, text = turns[at]
        at += 1
        if e == "R":
            q = NEXT[q]
            role = NAMES[q]
        elif e == "K":
            q = FITS[q][role[:1].decode()]
        yield e, role, text


def read(turns: list[tuple], first_places: set[int] | None = None) -> dict:
    """Symbols, counts and borders of turns (number, role, text) in order; first_places: the places whose role and text aren't seen earlier."""
    seen, symbols, counts = set(), [], dict.fromkeys(COUNTS, 0)
    for i, (_, role, text) in enumerate(turns):
        again = (role, text) in seen if first_places is None else i not in first_places
        seen.add((role, text))
        s, fault = symbol(role, text, again)
        symbols.append(s)
        if fault:
            counts[fault] += 1
    letters = [initial(r) for _, r, _ in turns]
    counts["illegal"] = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))
    numbers = [t for t, _, _ in turns if t is not None]
    return {
        "symbols": "".join(symbols), **counts, "first_letter": letters[0] if letters else b"", "last_letter": letters[-1] if letters else b"", "low": numbers[0] if numbers else None,
        "high": numbers[-1] if numbers else None, "numbers": sum(a != b for a, b in zip(numbers, [None, *numbers], strict=False)),
    }


def gap(low, high, numbers: int) -> int:
    return 0 if low is None else high - low + 1 - numbers


def repaired_bytes(edits) -> bytes:
    return b"\n".join(role + b":" + text for e, role, text in edits if e != "D")


TURNS = "array<struct<turn: bigint, role: binary, text: binary>>"
EDITS = "array<struct<edit: string, role: string, text: string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of `conv_id:turn` modulo 20; a dropped row stays as `absent`."""
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = text_of("text")
    rows = conversations.select(
        "conv_id", "turn", (kind == 0).alias("absent"), F.when(kind == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair(conversations: DataFrame, *, block: int = BLOCK, ranges: int | None = None, keep_turns: bool = False) -> DataFrame:
    """A row per conversation: conv_id, gaps, the counts of faults, cost, audit and repaired_sha256; rows marked `absent` only name a conversation.

    With keep_turns instead a row per edit: conv_id, part, block, place (the order), edit, role, text; a conversation without edits has none.
    """
    prepared(conversations.sparkSession)
    absent = F.col("absent") if "absent" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), absent.alias("absent"))
    order = ["conv_id", "turn", "role", "text"]
    rows = (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    key_type = dict(conversations.dtypes)["conv_id"]
    near = written(rows.mapInArrow(lambda batches: ranged(batches, block, keep_turns), f"conv_id {key_type}, part int, block int, whole boolean, {RESULT}, edits {EDITS}, turns {TURNS}"), "ranges")
    cut = near.where("not whole").select("conv_id", "part", "block", "turns")
    place = ["conv_id", "part", "block"]
    spread = cut.select(*place, F.posexplode("turns").alias("i", "t")).select(*place, "i", F.sha2(F.concat("t.role", F.lit(b"\0"), "t.text"), 256).alias("digest"))
    firsts = spread.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "block", "i")).alias("at")).groupBy("conv_id", "at.part", "at.block").agg(F.collect_list("at.i").alias("firsts"))
    cut = cut.alias("l").join(firsts.alias("r"), F.expr("l.conv_id <=> r.conv_id and l.part = r.part and l.block = r.block"), "left").select(*(f"l.{c}" for c in place), "turns", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts"))
    cut = written(cut, "blocks")
    facts = f"{', '.join(f'{c} long' for c in COUNTS)}, first_letter binary, last_letter binary, low long, high long, numbers long, costs array<int>, ranks array<int>, n int"
    summed = cut.mapInArrow(summaries, f"conv_id {key_type}, part int, block int, {facts}")
    chosen = summed.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(chosen_states, f"conv_id {key_type}, part int, block int, start int, end int, last boolean, {RESULT}")
    solved = cut.alias("l").join(chosen.alias("r"), F.expr("l.conv_id <=> r.conv_id and l.part = r.part and l.block = r.block"))
    solved = solved.select(*(f"l.{c}" for c in place), "turns", "firsts", *(f"r.{c}" for c in ("start", "end", "last", "gaps", *COUNTS, "cost")))
    if keep_turns:
        pieces = solved.mapInArrow(lambda b: block_edits(b, True), f"conv_id {key_type}, part int, block int, edits {EDITS}")
        return near.where("whole").select(*place, "edits").unionByName(pieces).select(*place, F.posexplode("edits").alias("place", "e")).select(*place, "place", "e.*")
    pieces = solved.mapInArrow(lambda b: block_edits(b, False), f"conv_id {key_type}, part int, block int, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired binary")
    joined = pieces.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(digests, f"conv_id {key_type}, {RESULT}")
    return near.where("whole").select("conv_id", *joined.columns[1:]).unionByName(joined)


def record(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)


RESULT_NAMES = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
EDITS_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
TURNS_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.binary()), ("text", pa.binary())]))


def text_edits(edits) -> list[dict]:
    return [{"edit": e, "role": r.decode("utf-8", "replace"), "text": t.decode("utf-8", "replace")} for e, r, t in edits]


def ranged(batches, block: int, keep_turns: bool):
    """Sorted turns of a range: finished conversations, and blocks of those that may lie in other ranges too."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["conv_id", "part", "block", "whole", *RESULT_NAMES, "edits", "turns"]
    key_type, out, out_bytes = pa.int64(), [], 0
    key, held, size, number, first_of_range, any_rows = None, [], 0, 0, True, False

    def batch():
        types = [key_type, pa.int32(), pa.int32(), pa.bool_(), *RESULT_TYPES, EDITS_TYPE, TURNS_TYPE]
        return record(names, types, out)

    def flush_block():
        nonlocal held, size, number, out_bytes
        out.append((key, part, number, False, *[None] * 8, None, [{"turn": t, "role": r, "text": x} for t, r, x in held]))
        out_bytes += size
        held, size, number = [], 0, number + 1

    def finish(last: bool):
        nonlocal held, size, number, first_of_range, out_bytes
        if first_of_range or last or number:
            if held or not number:
                flush_block()
        else:
            facts = read(held)
            cost, audit = repair_symbols(facts["symbols"])
            edits = list(edited(audit, START, [(r, x) for _, r, x in held]))
            digest = hashlib.sha256(repaired_bytes(edits)).hexdigest()
            out.append((key, part, 0, True, gap(facts["low"], facts["high"], facts["numbers"]), *(facts[c] for c in COUNTS), cost, audit, digest, text_edits(edits) if keep_turns else None, None))
            out_bytes += size * keep_turns
        held, size, number, first_of_range = [], 0, 0, False

    for whole in batches:
        key_type = whole.schema.field(0).type
        for b in parts([whole]):
            for k, turn, role, text, absent in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), byte_texts(b.column(3)), b.column(4).to_pylist(), strict=True):
                if any_rows and k != key:
                    finish(False)
                key, any_rows = k, True
                if absent:
                    continue
                if len(held) >= block or size > BLOCK_BYTES:
                    flush_block()
                held.append((turn, role, text))
                size += len(text)
                if len(out) >= 1000 or out_bytes > BLOCK_BYTES:
                    yield batch()
                    out, out_bytes = [], 0
    if any_rows:
        finish(True)
        if out:
            yield batch()


def block_rows(batch):
    for row in batch.to_pylist():
        turns = [(t["turn"], t["role"], t["text"]) for t in row["turns"]]
        yield row, turns, read(turns, set(row["firsts"]))


def summaries(batches):
    """Of each block the counts, and for every pair of states the cost and the place of its audit among those from the same state."""
    fields = [*COUNTS, "first_letter", "last_letter", "low", "high", "numbers"]
    types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 3
    for whole in batches:
        key_type = whole.schema.field(0).type
        for b in parts([whole], 20):
            out = []
            for row, turns, facts in block_rows(b):
                costs, ranks = [-1] * 16, [0] * 16
                for q in range(4):
                    found = [block_search(facts["symbols"], q, to) for to in range(4)]
                    order = sorted({f[1] for f in found if f})
                    for to, f in enumerate(found):
                        if f:
                            costs[4 * q + to], ranks[4 * q + to] = f[0], order.index(f[1])
                out.append((row["conv_id"], row["part"], row["block"], *(facts[c] for c in fields), costs, ranks, len(turns)))
            yield record(["conv_id", "part", "block", *fields, "costs", "ranks", "n"], [key_type, pa.int32(), pa.int32(), *types, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()], out)


def block_search(symbols: str, start: int, end: int):
    if not symbols:
        return (0, "") if start == end else None
    return search(symbols, start, (end,), False)


#: Inserts behind the last turn that end the pattern.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def chosen_states(batches):
    """The state before and after every block of each conversation, and the sums of its counts with its last block."""
    key_type = None
    for key_type, rows in grouped(batches):
        goal = [INSERT * len(TAIL[q]) for q in range(4)]
        ahead = [goal]
        for r in reversed(rows):
            ahead.append([min((r["costs"][4 * q + to] + ahead[-1][to] for to in range(4) if r["costs"][4 * q + to] >= 0)) for q in range(4)])
        ahead.reverse()
        q, states = START, []
        for i, r in enumerate(rows):
            ends = [to for to in range(4) if r["costs"][4 * q + to] >= 0 and r["costs"][4 * q + to] + ahead[i + 1][to] == ahead[i][q]]
            to = min(ends, key=lambda e: r["ranks"][4 * q + e])
            states.append((q, to))
            q = to
        filled = [r for r in rows if r["n"]]
        illegal = sum(r["illegal"] for r in rows) + sum(a["last_letter"] + b["first_letter"] not in LEGAL for a, b in zip(filled, filled[1:], strict=False))
        numbered = [r for r in rows if r["low"] is not None]
        same = sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:], strict=False))
        gaps = gap(numbered[0]["low"], numbered[-1]["high"], sum(r["numbers"] for r in numbered) - same) if numbered else 0
        counts = (gaps, *(sum(r[c] for r in rows) for c in COUNTS[:3]), illegal, ahead[0][START])
        out = [(r["conv_id"], r["part"], r["block"], a, b, i == len(rows) - 1, *counts, None, None) for i, (r, (a, b)) in enumerate(zip(rows, states, strict=True))]
        yield record(["conv_id", "part", "block", "start", "end", "last", *RESULT_NAMES], [key_type, *[pa.int32()] * 4, pa.bool_(), *RESULT_TYPES], out)


def grouped(batches):
    """(type of the key, rows) of every run of equal conv_id in sorted summaries."""
    key_type, held = None, []
    for b in batches:
        key_type = b.schema.field(0).type
        for row in b.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield key_type, held
                held = []
            held.append(row)
    if held:
        yield key_type, held


def block_edits(batches, keep_turns: bool):
    """Each block's edits, or its audit and its repaired bytes."""
    for whole in batches:
        key_type = whole.schema.field(0).type
        for b in parts([whole], 20):
            out = []
            for row, turns, facts in block_rows(b):
                audit = block_search(facts["symbols"], row["start"], row["end"])[1] + (TAIL[row["end"]] if row["last"] else "")
                edits = list(edited(audit, row["start"], [(r, x) for _, r, x in turns]))
                place = (row["conv_id"], row["part"], row["block"])
                if keep_turns:
                    out.append((*place, text_edits(edits)))
                else:
                    stays = any(e != "D" for e, _, _ in edits)
                    out.append((*place, row["gaps"], *(row[c] for c in COUNTS), row["cost"], audit, repaired_bytes(edits) if stays else None))
            names = ["conv_id", "part", "block"] + (["edits"] if keep_turns else ["gaps", *COUNTS, "cost", "audit", "repaired"])
            yield record(names, [key_type, pa.int32(), pa.int32()] + ([EDITS_TYPE] if keep_turns else [*RESULT_TYPES[:6], pa.string(), pa.binary()]), out)


def digests(batches):
    """Audit and digest of each conversation from its blocks in order, one block at a time."""
    names, key_type = ["conv_id", *RESULT_NAMES], pa.int64()
    row, audits, digest, begun = None, [], None, False

    def done():
        return record(names, [key_type, *RESULT_TYPES], [(row["conv_id"], row["gaps"], *(row[c] for c in COUNTS), row["cost"], "".join(audits), digest.hexdigest())])

    for whole in batches:
        key_type = whole.schema.field(0).type
        for b in parts([whole], 20):
            for r in b.to_pylist():
                if row is None or r["conv_id"] != row["conv_id"]:
                    if row is not None:
                        yield done()
                    audits, digest, begun = [], hashlib.sha256(), False
                row = r
                audits.append(r["audit"])
                if r["repaired"] is not None:
                    digest.update((b"\n" if begun else b"") + r["repaired"])
                    begun = True
    if row is not None:
        yield done()
