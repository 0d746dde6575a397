"""Summarise the physical plan of every registered query (writes PLANS.md).

usage: python scripts/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rivulet.session import build_session  # noqa: E402

#: Queries whose frame is a written result: the work lies in jobs that ran before it.
SKIP = {"batch_outputs", "batch_facts", "popularity_stream", "popularity_late_orders", "csv_round_trip", "csv_append", "csv_append_replayed",
        "csv_bom", "csv_gb18030", "csv_union_files", "als_recommend", "als_recommend_facts", "factor_train_recommend", "factor_train_facts",
        "kmeans_users", "kmeans_items", "kmeans_users_facts", "kmeans_items_facts", "kmeans_minibatch_users", "kmeans_minibatch_items",
        "kmeans_minibatch_facts", "keyed_lookup", "item_popularity_sketch_facts"}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from rivulet.plans import QUERIES
    spark = build_session()
    lines = ["# Physical plans (sf0.01, before execution)", "",
             "Generated by `scripts/plan_summary.py`.  Columns: shuffle exchanges, broadcast "
             "exchanges, join operators, WindowGroupLimit (top-k pruned before the shuffle), "
             "and for each parquet scan the columns read and the filters pushed into it.", "",
             "| query | shuffles | broadcasts | joins | top-k pruned | scans (ReadSchema; PushedFilters) |",
             "|---|---|---|---|---|---|"]
    for name, fn in sorted(QUERIES.items()):
        if name in SKIP:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
        bcast = plan.count("BroadcastExchange")
        joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                      r"BroadcastNestedLoopJoin|CartesianProduct)", plan)))
        wgl = "yes" if "WindowGroupLimit" in plan else ""
        scans = []
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\].*?ReadSchema: (\S+)",
                             plan):
            scans.append(f"{m.group(3)}; [{m.group(2)}]")
        uniq = sorted(set(scans))
        lines.append(f"| `{name}` | {shuffles} | {bcast} | {', '.join(joins)} | {wgl} | "
                     + "<br>".join(s.replace("|", "/") for s in uniq[:4]) + (" ..." if len(uniq) > 4 else "") + " |")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
