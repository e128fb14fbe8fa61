"""Run registered queries against their oracle SQL: python tools_check.py [names...]"""

import json
import sys
import time

sys.path.insert(0, "tests")
from oracle import compare, duck  # noqa: E402

from trajframe.plans.catalog import load_all  # noqa: E402
from trajframe.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.01"

if __name__ == "__main__":
    spark = get_spark("check")
    con = duck(SF)
    qs = load_all()
    names = sys.argv[1:] or sorted(qs)
    bad = 0
    for n in names:
        fn, sql = qs[n]
        t = time.time()
        if sql is None:
            c = fn(spark, SF).count()
            print(json.dumps({"q": n, "rows_only": c, "sec": round(time.time() - t, 2)}))
            continue
        try:
            r = compare(spark, con, fn, sql, SF)
        except Exception as e:  # noqa: BLE001
            r = {"error": repr(e)[:2000]}
        r["q"] = n
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("values_match") and r.get("cols_match") and r.get("spark_rows", 0) > 0
        bad += not ok
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str)[:3000])
    print("bad:", bad)
