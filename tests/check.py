"""python -m tests.check [sf] [name prefix ...]: run queries against their oracles, with times."""

from __future__ import annotations

import sys
import time

from sensorloom.plans import catalog
from sensorloom.session import local_session

from .compare import connect, mismatch


def main(sf: str, prefixes: list[str]) -> int:
    spark = local_session(8)
    catalog.load()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) or fn.__module__.endswith("." + p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in catalog.ORACLES:
                msg = mismatch(df, con, catalog.ORACLES[name])
            else:
                msg = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        bad += msg is not None
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{time.time() - t:6.2f}s {kind:4} {name}: {'ok' if msg is None else 'FAIL ' + msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]) else 0)
