"""Compare registered queries with their SQL: ``python tools/check.py sf0.01 [key prefix ...]``."""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
sys.path[:0] = [os.path.join(sys.path[0], "tests")]

from compare import DATA, difference, duck  # noqa: E402

from tallyloom.plans import load  # noqa: E402
from tallyloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tallyloom.session import local_session  # noqa: E402

load()
folder = os.path.join(DATA, sys.argv[1])
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
connection = duck(folder)
bad = 0
for key, build in QUERIES.items():
    if len(sys.argv) > 2 and not key.startswith(tuple(sys.argv[2:])):
        continue
    start = time.time()
    try:
        df = build(spark, folder)
        if key in ORACLES:
            said = difference(df, connection, ORACLES[key])
            rows = "" if said else f"{df.count()} rows"
        else:
            said, rows = None, f"{len(df.collect())} rows, no SQL"
    except Exception as e:  # noqa: BLE001
        said, rows = f"{type(e).__name__}: {str(e)[:700]}", ""
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += said is not None
    print(f"{'BAD ' if said else 'ok  '} {key} {rows} {time.time() - start:.1f}s {said or ''}", flush=True)
print("bad:", bad, "of", len(QUERIES))
