"""Run the registered queries against DuckDB: ``python tests/check.py [sf dir] [name part | @module ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tasksieve.session import local_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        module = function.__module__.rsplit(".", 1)[-1]
        if parts and not any(p in name or p == f"@{module}" for p in parts):
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, function, sqls[name], folder)
            else:
                rows = function(spark, folder).collect()
                problem = None if rows else "no rows"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:600]
            if "-v" in parts:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - started:6.2f}s {'sql ' if name in sqls else 'rows'} {name} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
