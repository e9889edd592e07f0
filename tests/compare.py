"""Runs registered queries against their SQL twins: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from recordmill.session import build_session  # noqa: E402
from recordmill.testbed.oracle import ORACLE  # noqa: E402
from recordmill.testbed.registry import QUERIES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _order(row: tuple) -> tuple:
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree in names, row count, types and values."""
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=_order)
    found = con.sql(ORACLE[name])
    if sorted(found.columns) != names:
        return f"columns {names} / {sorted(found.columns)}"
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(con.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall(), key=_order)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        for n, x, y in zip(names, a, b):
            same = type(x) is type(y) and (x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y)))
            if not same:
                return f"{n}: {x!r} / {y!r} in {dict(zip(names, a))}"
    return None


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLE:
                problem = difference(spark, con, sf_dir, name)
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # keep going, report all
            verdict = f"ERROR {str(error)[:500]}"
        bad += verdict.startswith(("DIFF", "ERROR"))
        print(f"{name:24} {time.time() - start:6.1f}s {verdict[:600]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
