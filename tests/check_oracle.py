"""Compare all or named queries with their SQL twins: check_oracle.py SF_DIR [name...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from oracle import connect, difference  # noqa: E402
from stocklens import build_session  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
spark.sparkContext.setLogLevel("ERROR")
con, sqls, bad = connect(sf), oracle_sql(), 0
for name, fn in queries().items():
    if names and not any(name.startswith(n) for n in names):
        continue
    start = time.time()
    try:
        result = difference(fn(spark, sf), con, sqls[name])
        n = con.execute(f"select count(*) from ({sqls[name]})").fetchall()[0][0]
    except Exception as exc:  # report every query, whatever fails
        result, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
    bad += result is not None
    print(f"{'ok ' if result is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s {result or ''}", flush=True)
print("bad:", bad)
