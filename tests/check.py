"""Compare queries at a chosen scale: python tests/check.py sf0.01 [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries
from oracle import compare, connect

sf_dir = f"/root/testdata/{sys.argv[1]}"
spark = (
    SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
for name in sys.argv[2:] or sorted(queries()):
    started = time.time()
    try:
        if name in oracle_sql():
            outcome = f"ok {compare(spark, con, sf_dir, queries()[name], oracle_sql()[name])}"
        else:
            outcome = f"rows only {queries()[name](spark, sf_dir).count()}"
    except Exception as exc:  # report and go on with the next query
        outcome = f"FAILED {type(exc).__name__} {str(exc)[:900]}"
    print(f"{name:40s} {time.time() - started:6.2f}s {outcome}", flush=True)
