"""Tabulate operators of the dumped plans (``docs/plans/*.txt``) into ``docs/PLAN_SUMMARY.md``.

    python tools/dump_plans.py && python tools/plan_summary.py

Per query: scans, shuffles (``Exchange`` other than broadcast), broadcasts, join kinds,
aggregates, generators and Python stages, from the initial AQE plan.
"""

from __future__ import annotations

import glob
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

COLUMNS = [
    ("scans", r"^\(\d+\) Scan "),
    ("shuffles", r"^\(\d+\) Exchange\s*$"),
    ("broadcasts", r"^\(\d+\) BroadcastExchange"),
    ("sort-merge joins", r"^\(\d+\) SortMergeJoin"),
    ("broadcast hash joins", r"^\(\d+\) BroadcastHashJoin"),
    ("shuffled hash joins", r"^\(\d+\) ShuffledHashJoin"),
    ("nested-loop / cartesian", r"^\(\d+\) (BroadcastNestedLoopJoin|CartesianProduct)"),
    ("hash aggregates", r"^\(\d+\) (HashAggregate|ObjectHashAggregate|SortAggregate)"),
    ("generate", r"^\(\d+\) Generate"),
    ("python", r"^\(\d+\) (MapInPandas|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas)"),
]


def main() -> None:
    rows = []
    for path in sorted(glob.glob(os.path.join(ROOT, "docs", "plans", "*.txt"))):
        name = os.path.basename(path)[:-4]
        text = open(path).read()
        counts = [len(re.findall(rx, text, flags=re.M)) for _, rx in COLUMNS]
        rows.append((name, counts))
    head = "| query | " + " | ".join(c for c, _ in COLUMNS) + " |"
    sep = "| --- " * (len(COLUMNS) + 1) + "|"
    body = "\n".join(f"| `{n}` | " + " | ".join(str(x) for x in c) + " |" for n, c in rows)
    text = ("# Plan summary\n\nOperator counts in the initial (pre-AQE) physical plan of every "
            "registered query at sf0.01 (`docs/plans/`). AQE may turn a sort-merge join into a "
            "broadcast hash join at run time when a side turns out small. Queries that stage "
            "their inputs show only the final read.\n\n"
            + head + "\n" + sep + "\n" + body + "\n")
    with open(os.path.join(ROOT, "docs", "PLAN_SUMMARY.md"), "w") as f:
        f.write(text)
    print(text)


if __name__ == "__main__":
    main()
