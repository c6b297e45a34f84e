"""Run registered queries against their SQL: ``python tests/check.py [module|query ...]``."""

import importlib
import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import compare, connect  # noqa: E402

from tapeworks import catalog  # noqa: E402
from tapeworks.session import build_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = []
    for a in sys.argv[1:]:
        if a in catalog.MODULES:
            before = set(catalog.QUERIES)
            importlib.import_module(f"tapeworks.catalog.{a}")
            names += [q for q in catalog.QUERIES if q not in before or q.startswith(a)]
        else:
            names.append(a)
    if not sys.argv[1:] or any(n not in catalog.QUERIES for n in names):
        catalog.load()
        names = names or list(catalog.QUERIES)
    spark = build_session("check", "local[8]", 8, {"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for q in names:
        t = time.time()
        try:
            df = catalog.QUERIES[q](spark, sf)
            verdict = compare(df, con, catalog.ORACLES[q]) if q in catalog.ORACLES else f"rows only {df.count()}"
        except Exception as e:  # report and go on
            verdict = "FAILED " + (traceback.format_exc()[-1500:] if os.environ.get("TRACE") else str(e)[:700])
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{q:24s} {time.time() - t:6.1f}s  {verdict}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
