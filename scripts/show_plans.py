"""Summarise the physical plans of selected queries (run after execution,
so AQE's final choices show).  Usage: python scripts/show_plans.py [sf_dir]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chorus.plans import catalog  # noqa: E402
from chorus.session import get_session, release_scratch, scratch_mark  # noqa: E402

NAMES = ["prepare_comments", "lexicon_score", "model_comparison", "top_by_label", "word_counts",
         "multi_video", "page_cap", "top_trigrams", "tfidf_keywords"]
KEYS = ["ReadSchema", "PushedFilters", "BroadcastHashJoin", "SortMergeJoin", "WindowGroupLimit",
        "TakeOrderedAndProject", "Exchange hashpartitioning", "Exchange SinglePartition", "ReusedExchange",
        "Generate", "BroadcastNestedLoopJoin", "CartesianProduct"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]")
    out = ["# Physical plans (final adaptive plans, %s)\n" % sf,
           "Counts of plan nodes per registered query, plus the scan schemas and",
           "pushed filters.  Generated by `scripts/show_plans.py`.  Counts are for the",
           "top-level final plan; query stages that ran earlier (e.g. inside a scalar",
           "subquery or a stage-table write) are not expanded.\n"]
    for name in NAMES:
        mark = scratch_mark()
        df = catalog.QUERIES[name](spark, sf)
        df.collect()                       # executes this QueryExecution: final AQE plan
        top = df._jdf.queryExecution().executedPlan()
        plan = top.executedPlan().toString() if top.nodeName() == "AdaptiveSparkPlan" else top.toString()
        plan = plan.split("== Initial Plan ==")[0]
        release_scratch(spark, mark)
        out.append(f"## {name}\n")
        for k in KEYS:
            n = plan.count(k)
            if n and k not in ("ReadSchema", "PushedFilters"):
                out.append(f"- {k}: {n}")
        for m in sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))):
            out.append(f"- ReadSchema `{m}`")
        for m in sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan))):
            if m != "[]":
                out.append(f"- PushedFilters `{m[:200]}`")
        out.append("")
    print("\n".join(out))


if __name__ == "__main__":
    main()
