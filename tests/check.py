"""Run named queries against DuckDB: python tests/check.py FOLDER [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from oracle import connect, differences  # noqa: E402


class spark_rows:
    """A collected frame, so that timing and comparing share one run."""

    def __init__(self, df, rows):
        self.columns, self.collect = df.columns, lambda: rows


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    from chorus.workspace import local_session
    spark = local_session(8, "check")
    spark.sparkContext.setLogLevel("OFF")
    from chorus.catalog import REGISTRY

    con = connect(folder)
    bad = 0
    for name in names or REGISTRY:
        q = REGISTRY[name]
        start = time.time()
        try:
            if q.sql is None:
                rows = q.run(spark, folder).collect()
                why, note = (None if rows else "no rows"), f"rows-only {len(rows)} {rows[:2]}"
            else:
                df = q.run(spark, folder)
                rows = df.collect()
                note = f"spark {time.time() - start:.2f}s"
                why = differences(spark_rows(df, rows), con, q.sql)
        except Exception as error:  # report and go on with the next query
            why, note = f"{type(error).__name__}: {str(error)[:900]}", ""
            pass
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - start:.2f}s "
              f"{note[:300]} {why or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
