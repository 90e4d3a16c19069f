"""Run every registered query once and print its time and row count."""

import sys
import time
import traceback

from caseweave.session import local_session
from caseweave.workload.queries import queries

folder = sys.argv[1]
only = sys.argv[2:]
spark = local_session()
for name, run in queries().items():
    if only and name not in only:
        continue
    start = time.time()
    try:
        rows = run(spark, folder).toPandas()
        print(f"{name:36s} {time.time() - start:6.2f}s {len(rows):8d} rows", flush=True)
        if only:
            print(rows.head(8).to_string())
    except Exception as error:
        print(f"{name:36s} FAILED {str(error)[:600]}", flush=True)
        if only:
            traceback.print_exc()
