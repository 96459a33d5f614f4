"""Time every catalogue query on Spark at one data folder (writes to the no-op sink)."""

import os
import sys
import time

from compare import load, spark_session

folder = os.environ.get("SF", "/root/testdata/sf0.1")
spark = spark_session()
times = {}
for name, fn in load()[0].items():
    if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
        continue
    t = time.time()
    try:
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = time.time() - t
        print(f"{times[name]:7.1f} {name}", flush=True)
    except Exception as e:  # noqa: BLE001
        print("FAILED", name, str(e)[:300], flush=True)
print("total", sum(times.values()))
