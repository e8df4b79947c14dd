"""Run every registered query against its oracle at one scale factor.

    python tests/run_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry_mod  # noqa: E402
from lectern.runtime import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs = entry_mod.queries()
    oracles = entry_mod.oracle_sql()
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracles:
                res = compare(df, con, oracles[name])
            else:
                res = {"spark_rows": df.count(), "oracle": None}
        except Exception as exc:  # report and go on
            res = {"error": repr(exc)[:2000]}
        res["sec"] = round(time.time() - t0, 2)
        results[name] = res
        ok = res.get("values_match")
        print(f"{name:24s} {'OK ' if ok else ('-- ' if ok is None and 'error' not in res else 'BAD')} {json.dumps(res)[:600]}", flush=True)
    bad = [n for n, r in results.items() if "error" in r or r.get("values_match") is False]
    print("BAD:", bad)


if __name__ == "__main__":
    main()
