"""python -m tests.check [sf_dir] [name ...]: run registered queries against their oracles."""

import sys
import time
import traceback

sys.path.insert(0, ".")
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from assay.session import local_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if want and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                msg = difference(df, con, sqls[name])
            else:
                n = df.count()
                msg = None if n else "no rows"
        except Exception as e:
            msg = "ERROR " + str(e)[:600]
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if msg is None else 'BAD '} {kind} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
        if msg:
            bad.append(name)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
