"""Run every registered query against its SQL: python tests/check_oracles.py FOLDER [name ...]."""

import sys
import time

sys.path.insert(0, "tests")
from compare import connect, differences

from caseweave.session import local_session
from caseweave.workload.oracles import oracle_sql
from caseweave.workload.queries import queries

folder, only = sys.argv[1], sys.argv[2:]
spark, connection, sql = local_session(), connect(sys.argv[1]), oracle_sql()
for name, run in queries().items():
    if only and name not in only:
        continue
    start = time.time()
    try:
        df = run(spark, folder)
        text = differences(df, connection, sql[name]) if name in sql else "no SQL"
        print(f"RESULT {name:36s} {time.time() - start:6.2f}s {df.count() if only else ''} {text or 'ok'}", flush=True)
    except Exception as error:
        print(f"RESULT {name:36s} FAILED {str(error)[:500]}", flush=True)
