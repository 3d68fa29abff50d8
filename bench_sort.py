"""Time the total sort of generated records, named like the published runs: <max payload>_<records>.

    python bench_sort.py [MAX_PAYLOAD RECORDS [CPUS]]     default: 64 10000000, all CPUs

Prints one JSON line: seconds (and MB of records a second) of the sort alone
from Parquet, and from a record file to a sorted record file.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keystrand.operators.sorting import total_sort
from keystrand.sources.generate import generate_records
from keystrand.sources.recordfile import register


def main() -> None:
    payload, records = (int(x) for x in (sys.argv[1:3] or (64, 10_000_000)))
    cpus = sys.argv[3] if len(sys.argv) > 3 else str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench_sort").config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    register(spark)
    folder = tempfile.mkdtemp(prefix="keystrand-bench-")
    out = {}
    try:
        rows = generate_records(spark, records, payload)
        rows.select("key_ord", "payload").write.parquet(f"{folder}/table")
        table = spark.read.parquet(f"{folder}/table")
        size = table.agg(F.sum(F.octet_length("payload") + 12)).first()[0]
        table.write.format("recordfile").mode("overwrite").save(f"{folder}/in")
        for name, run in (
            ("sort", lambda: total_sort(table, "key_ord").write.format("noop").mode("overwrite").save()),
            ("file_to_file", lambda: total_sort(spark.read.format("recordfile").load(f"{folder}/in").select("key_ord", "payload"), "key_ord").write.format("recordfile").mode("overwrite").save(f"{folder}/out")),
        ):
            times = []
            for _ in range(2):
                began = time.perf_counter()
                run()
                times.append(time.perf_counter() - began)
            out[name] = {"seconds": round(min(times), 2), "mb_per_second": round(size / 1e6 / min(times), 1)}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"records": f"{payload}_{records}", "bytes": size, "cpus": int(cpus), **out}))


if __name__ == "__main__":
    main()
