"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "attributed_words", "speaker_segments", "sentence_split", "speaking_time", "transcript_stats", "words_without_repeats",
    "vocabulary_corrections", "readable_words", "action_items", "decisions", "questions", "entities", "topics",
    "summary_bullets", "timeline", "phrase_search", "search_index_rows", "paragraphs", "rapid_switches", "suggested_vocabulary",
    "stitched_words", "extracted_words", "reconciled_turns", "matched_voices", "srt_documents", "monotone_progress",
    "stalled_jobs", "artifact_completeness", "profile_report",
)


def main() -> None:
    from colloquy.plans import QUERIES
    from colloquy.session import local_session
    from colloquy.sources.corpus import corpus

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, action):
        t0 = time.time()
        action()
        times[name] = round(time.time() - t0, 3)
        print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr, flush=True)

    # The shared tables are built once per session and timed on their own.
    c = corpus(spark, path)
    for table in ("timed_words", "words", "segments", "sentences", "names"):
        timed(f"build_{table}", getattr(c, table))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, path).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
