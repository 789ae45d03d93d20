"""Walks that restart at each stop: 300 s topics, 30 s switch windows.

Where the next stop depends on the last one, a plain window cannot express the walk. But the next
stop from any row is known in advance (`next_idx`), so the walk is a path through a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import equal_ranges, running_sum, scan
from colloquy.session import written

FOLD_ROWS = 5_000


def rank_below(values: DataFrame, probes: DataFrame, value: str, probe: str) -> DataFrame:
    """For each probe row, how many values of its job are smaller: adds `below`.

    Both sides are merged in one running count along the number line, cut into ranges of equal numbers of rows.
    """
    v = values.select("job_id", F.col(value).alias("_x"), F.lit(1).alias("_v"), F.lit(None).cast("long").alias("_id"))
    p = probes.select("job_id", F.col(probe).alias("_x"), F.lit(0).alias("_v"), F.col("idx").cast("long").alias("_id"))
    counted = scan(*equal_ranges(v.union(p), ("job_id",), ("_x", "_v", "_id")), below=running_sum(F.col("_v")))
    return counted.filter("_v = 0").select("job_id", F.col("_id").alias("idx"), "below")


def visited(steps: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rows on the walk of each island: (job_id, island, idx).

    `steps` has (job_id, island, idx, next_idx); a walk starts at the smallest idx of its island and
    ends where next_idx leaves it. Islands of bounded size are folded in one cell; longer ones are
    walked by doubling the stride, which needs only joins.
    """
    sized = written(steps, "steps")
    size = sized.groupBy("job_id", "island").agg(F.count("*").alias("n"), F.min("idx").alias("start"))
    small = sized.join(size.filter(F.col("n") <= fold_rows), ["job_id", "island"])
    folded = small.groupBy("job_id", "island").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("idx", "next_idx"))),
            F.struct(F.lit(None).cast("long").alias("due"), F.array().cast("array<bigint>").alias("seen")),
            _step,
        )["seen"].alias("seen")
    ).select("job_id", "island", F.explode("seen").alias("idx"))
    large = size.filter(F.col("n") > fold_rows)
    if large.isEmpty():
        return folded
    return folded.union(_by_doubling(sized.join(large, ["job_id", "island"])))


def _step(acc: Column, row: Column) -> Column:
    on_walk = acc["due"].isNull() | (acc["due"] == row["idx"])
    return F.struct(
        F.when(on_walk, F.coalesce(row["next_idx"], F.lit(-1))).otherwise(acc["due"]).cast("long").alias("due"),
        F.when(on_walk, F.concat(acc["seen"], F.array(row["idx"]))).otherwise(acc["seen"]).alias("seen"),
    )


def _by_doubling(steps: DataFrame) -> DataFrame:
    key = ["job_id", "island"]
    hop = steps.select(*key, "idx", "next_idx").filter("next_idx is not null")
    # Strides that leave the island end the walk.
    hop = written(hop.join(steps.select(*key, F.col("idx").alias("next_idx")), [*key, "next_idx"]), "hops")
    reached = steps.filter("idx = start").select(*key, "idx")
    while True:
        further = reached.join(hop, [*key, "idx"]).select(*key, F.col("next_idx").alias("idx"))
        reached = written(reached.union(further).distinct(), "reached")
        hop = written(
            hop.alias("a").join(
                hop.select(*key, F.col("idx").alias("next_idx"), F.col("next_idx").alias("far")), [*key, "next_idx"]
            ).select(*key, "idx", F.col("far").alias("next_idx")),
            "hops",
        )
        if hop.isEmpty():
            return reached
