"""List plan shapes that do not scale: ``python tools/plan_check.py [dir] [name-prefix ...]``.

Reports nested-loop and cartesian joins, Python workers, and windows over one single partition.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from censora.queries import load
from censora.session import local_session


def findings(plan: str) -> list[str]:
    found = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") if w in plan]
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Window" in line and "WindowGroupLimit" not in line:
            below = "".join(lines[i + 1 : i + 4])
            if "SinglePartition" in below or "TakeOrdered" in below:
                found.append("one-partition window")
    return sorted(set(found))


def main() -> None:
    args = sys.argv[1:]
    directory = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, q in load().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        plan = q(spark, directory)._jdf.queryExecution().executedPlan().toString()
        found = findings(plan)
        print(f"{name:40s} exchanges={plan.count('Exchange '):3d} {', '.join(found)}")


if __name__ == "__main__":
    main()
