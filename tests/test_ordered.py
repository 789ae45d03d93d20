"""Block-wise scans against plain Python loops, with blocks small enough to have many borders."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import jumps, ordered
from colloquy.operators.ordered import Axis, following, known_before, last_known, previous, running_max, running_sum, scan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_equals_loop(spark, block):
    rng = random.Random(block)
    rows = [(j, i, rng.randint(-5, 9), rng.choice([None, None, "a", "b"])) for j in range(3) for i in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, i long, v long, s string")
    axis = Axis(("k",), ("i",), F.floor(F.col("i") / block))
    got = {
        (r.k, r.i): r
        for r in scan(
            df, axis, total=running_sum(F.col("v")), top=running_max(F.col("v")), known=last_known(F.col("s")),
            prev=previous(F.col("s")), before=known_before(F.col("s")), nxt=following(F.col("v")),
        ).collect()
    }
    for k in range(3):
        mine = sorted(r for r in rows if r[0] == k)
        total, top, known, prev = 0, None, None, None
        for n, (_, i, v, s) in enumerate(mine):
            total += v
            top = v if top is None else max(top, v)
            before, known = known, s if s is not None else known
            r = got[(k, i)]
            assert r.before == before
            after = mine[n + 1][2] if n + 1 < len(mine) else None
            assert (r.total, r.top, r.known, r.prev, r.nxt) == (total, top, known, prev, after)
            prev = s


@pytest.mark.parametrize("fold_rows", [0, 5, 10_000])
def test_visited_equals_walk(spark, fold_rows):
    rng = random.Random(7)
    rows, want = [], set()
    for island in range(6):
        size = rng.randint(1, 30)
        nxt = {i: i + rng.randint(1, 6) for i in range(size)}
        rows += [(1, island, i + 100 * island, n + 100 * island) for i, n in nxt.items()]
        at = 0
        while at < size:
            want.add((island, at + 100 * island))
            at = nxt[at]
    steps = spark.createDataFrame(rows, "job_id long, island long, idx long, next_idx long")
    got = {(r.island, r.idx) for r in jumps.visited(steps, fold_rows).collect()}
    assert got == want


def test_rank_below_counts_strictly_smaller(spark):
    values = spark.createDataFrame([(1, v) for v in (5, 10, 10, 7_200_001)], "job_id long, v long")
    probes = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 9_000_000), (1, 3, 1)], "job_id long, idx long, p long")
    got = {r.idx: r.below for r in jumps.rank_below(values, probes, "v", "p").collect()}
    assert got == {0: 1, 1: 3, 2: 4, 3: 0}


def test_text_is_joined_in_order_across_pieces(spark):
    df = spark.createDataFrame([(1, i, str(i)) for i in range(2500)], "k long, i long, t string").repartition(7)
    assert ordered.concat_in_order(df, ["k"], "i", "t").first().t == " ".join(map(str, range(2500)))


@pytest.mark.parametrize("ranges", [1, 5])
def test_places_over_equal_ranges(spark, ranges):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 3), i) for i, k in enumerate(rng.choices([1, 1, 1, 2, 3], k=300))]
    df = spark.createDataFrame(rows, "k long, x long, i long")
    got = {(r.k, r.x, r.i): r.place for r in ordered.places(df, "k", ("x", "i"), ranges).collect()}
    want = {}
    for k in (1, 2, 3):
        want |= {r: n for n, r in enumerate(sorted(r for r in rows if r[0] == k), 1)}
    assert got == want
    table, axis = ordered.equal_ranges(df, ("k",), ("x", "i"), ranges)
    assert table.groupBy("_range").count().count() == ranges
    # One window is by key alone, over the sums of ranges; the other one is by key and range.
    plan = ordered.scan(table, axis, place=running_sum(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(k#\d+L?, (_block#\d+)( ASC)?", plan)
    assert sorted(bool(ordered_by) for _, ordered_by in windows) == [False, True]
