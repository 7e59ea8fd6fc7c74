"""Run queries against their SQL: python tests/check_oracle.py [folder] [prefix ...]"""

import sys
import time
import traceback

sys.path.insert(0, ".")
import __spark_entry__ as entry  # noqa: E402
from linewright.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
prefixes = tuple(sys.argv[2:]) or ("",)
spark = local_session(8, 8)
con = connect(folder)
bad = 0
for name, run in entry.queries().items():
    if not name.startswith(prefixes):
        continue
    start = time.time()
    sql = entry.oracle_sql().get(name)
    try:
        if sql is None:
            message = f"rows only: {len(run(spark, folder).collect())}"
        else:
            message = compare(spark, con, folder, run, sql)
            bad += message is not None
    except Exception as error:  # noqa: BLE001
        bad += 1
        message = "ERROR " + str(error).split("\n")[0][:600]
        if "--trace" in sys.argv:
            traceback.print_exc()
    print(f"{'ok ' if message is None else '-- '} {name} {time.time() - start:.1f}s {'' if message is None else str(message)[:700]}", flush=True)
print("differences:", bad)
