"""Physical-plan summary of every registered query.

    python tests/plan_report.py [sf_dir] > PLANS.md

For each query: shuffles (hash/range exchanges that move rows), broadcast
exchanges, nested-loop or cartesian joins (there should be none), Python
operators, and the columns each Parquet scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_mod  # noqa: E402
from lectern.runtime import SPREAD_SETTING, local_session  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    shuffles = [ln for ln in lines if "Exchange " in ln and "BroadcastExchange" not in ln]
    kinds = []
    for ln in shuffles:
        m = re.search(r"Exchange (\w+)\(([^)]*)\)?[^,]*,\s*(\w+)", ln)
        if "SinglePartition" in ln:
            kinds.append("single(agg of one row)")
        elif m:
            cols = re.sub(r"#\d+L?", "", m.group(2)).split(",")
            kinds.append(f"{m.group(1)}({','.join(c.strip() for c in cols[:-1])}) {m.group(3)}")
        else:
            kinds.append(ln.strip()[:60])
    scans = sorted({re.sub(r"#\d+L?", "", s) for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)})
    return {
        "shuffles": kinds,
        "broadcasts": sum("BroadcastExchange" in ln for ln in lines),
        "nested_loop_or_cartesian": sum(("BroadcastNestedLoopJoin" in ln) or ("CartesianProduct" in ln) for ln in lines),
        "python": sorted({w for ln in lines for w in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython") if w in ln}),
        "scans": scans,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.conf.set(SPREAD_SETTING, "0")
    qs = {k: f for k, f in entry_mod.queries().items() if k not in entry_mod.LLM_QUERIES}
    print(f"# Physical plans ({os.path.basename(sf_dir)}, local[8])\n")
    print("Generated by `tests/plan_report.py`, with `spark.lectern.spread` unset: no exchange is there for the")
    print("small files' sake.\n")
    print("| Query | Shuffles | Broadcasts | NLJ/cartesian | Python | Parquet columns read |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in sorted(qs):
        try:
            s = summarise(plan_text(qs[name](spark, sf_dir)))
        except Exception as exc:  # report and go on
            print(f"| `{name}` | error: {exc!r} | | | | |"[:300])
            continue
        print(
            f"| `{name}` | {'; '.join(s['shuffles']) or '-'} | {s['broadcasts']} | {s['nested_loop_or_cartesian']} | "
            f"{', '.join(s['python']) or '-'} | {'; '.join(s['scans'])} |"
        )


if __name__ == "__main__":
    main()
