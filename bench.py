"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

One warm-up run, then the median of three; each run forces the full result
through the ``noop`` sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chorus.plans import catalog, store  # noqa: E402
from chorus.session import get_session, release_scratch, scratch_mark  # noqa: E402

HEADLINE = {
    "clean_dedup": "prepare_comments",
    "lexicon_split": "lexicon_split",
    "model_comparison": "model_comparison",
    "top_words": "top_words",
    "trigrams": "top_trigrams",
    "tfidf_keywords": "tfidf_keywords",
    "lda_k3": "topic_summary",
}


def run_once(spark, name: str, sf_dir: str) -> float:
    mark = scratch_mark()
    store.clear(spark)                    # no run reads what another stored
    t0 = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    release_scratch(spark, mark)          # stage tables of this run only
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    only = set(sys.argv[1:])
    out = {}
    for label, name in HEADLINE.items():
        if only and label not in only:
            continue
        run_once(spark, name, sf_dir)                       # warm-up
        out[label] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(reps)), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
