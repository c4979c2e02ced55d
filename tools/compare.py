"""Run queries against their SQL on one folder of tables: python tools/compare.py FOLDER [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loofold.queries import ORACLES, QUERIES  # noqa: E402
from loofold.session import build_session  # noqa: E402


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if v is None or v is pd.NaT or v != v else (float(v) if isinstance(v, float) else str(v)) for v in r)
        for r in frame.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=repr)


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master=os.environ.get("COMPARE_MASTER", "local[8]"),
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    con.execute("SET TimeZone = 'UTC'")
    bad = 0
    for name in names:
        begun = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            found = frame.toArrow()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: {str(e)[:600]}")
            bad += 1
            continue
        took = time.time() - begun
        if name not in ORACLES:
            print(f"rows  {name}: {found.num_rows} rows, {took:.2f}s")
            continue
        begun = time.time()
        try:
            wanted = con.execute(ORACLES[name]).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            print(f"SQL   {name}: {str(e)[:600]}")
            bad += 1
            continue
        sql_took = time.time() - begun
        types = {f.name: str(f.type) for f in found.schema}, {f.name: str(f.type) for f in wanted.schema}
        note = "" if types[0] == types[1] else f"  types {sorted(set(types[0].items()) ^ set(types[1].items()))}"
        a, b = canonical(found.to_pandas()), canonical(wanted.to_pandas())
        same = a == b
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(a)}/{len(b)} rows, {took:.2f}s, sql {sql_took:.2f}s{note}")
        if not same:
            odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print("     ", odd)
    return bad


if __name__ == "__main__":
    sys.exit(main())
