"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [names...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import connect, duck_rows, spark_rows  # noqa: E402

from tracebound.session import local_session  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            columns, rows = spark_rows(run(spark, folder))
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark {str(error)[:600]}")
            if wanted:
                traceback.print_exc()
            continue
        spent = time.time() - started
        if name not in oracles:
            print(f"rows {name}: {len(rows)} rows, no SQL, {spent:.1f}s")
            continue
        try:
            expected_columns, expected = duck_rows(con, oracles[name])
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb {str(error)[:600]}")
            continue
        if columns != expected_columns or rows != expected:
            bad.append(name)
            print(f"DIFF {name}: {len(rows)} rows vs {len(expected)}; {columns} vs {expected_columns}")
            left, right = set(rows) - set(expected), set(expected) - set(rows)
            for label, part in (("spark", left), ("duckdb", right)):
                for row in sorted(part)[:3]:
                    print(f"   {label}: {[str(v[1])[:70] for v in row]}")
        else:
            empty = "  EMPTY" if not rows else ""
            print(f"ok   {name}: {len(rows)} rows, {spent:.1f}s{empty}")
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
