"""Benchmark of the headline operators.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is forced in full with the ``noop`` sink (nothing is collected
to the driver), except the training job whose output is the model itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from qforge.session import get_session
    spark = get_session(f"local[{cpus}]", app="qforge-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    from qforge.plans import catalog
    Q = catalog.QUERIES

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    plan = [
        ("profile_columns", lambda: sink(Q["column_statistics"](spark, sf_dir))),
        ("outlier_filter", lambda: sink(Q["remove_outliers"](spark, sf_dir))),
        ("value_counts", lambda: sink(Q["value_counts"](spark, sf_dir))),
        ("correlation", lambda: sink(Q["correlation_pairs"](spark, sf_dir))),
        ("histogram_kde", lambda: (sink(Q["histogram"](spark, sf_dir)), sink(Q["kde"](spark, sf_dir)))),
        ("semantic_types", lambda: sink(Q["semantic_types"](spark, sf_dir))),
        ("encode_rows", lambda: (sink(Q["ranked_encode"](spark, sf_dir)), sink(Q["date_normalize"](spark, sf_dir)),
                                 sink(Q["sample_weight"](spark, sf_dir)), sink(Q["proximity_encode"](spark, sf_dir)))),
        ("train_cv_3q", lambda: Q["train_models"](spark, sf_dir).collect()),
        ("score_long", lambda: sink(Q["predict_long"](spark, sf_dir))),
        ("validate_batch", lambda: sink(Q["predict_batch"](spark, sf_dir))),
        ("usage_runs_jobs", lambda: (sink(Q["usage_summary"](spark, sf_dir)), sink(Q["list_models"](spark, sf_dir)),
                                     sink(Q["job_status"](spark, sf_dir)))),
        ("text_jobs", lambda: (sink(Q["flag_injection"](spark, sf_dir)), sink(Q["redact_text"](spark, sf_dir)),
                               sink(Q["repair_json"](spark, sf_dir)))),
    ]
    # warm-up outside the timings (JIT-compiled code paths, Python workers)
    # on the two smallest tables, so the timings are steady-state
    import pyarrow as pa  # noqa: F401
    from qforge.operators import profile as P
    spark.range(1000).mapInArrow(lambda it: it, "id long").count()
    for t in ("region", "nation"):
        small = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        P.column_statistics(small).collect()
        P.value_counts(small, small.columns[1]).collect()
    from qforge.operators import score as S
    from qforge.plans import model_queries as MQ
    from pyspark.sql import functions as F

    def batch(n):
        # the reference's batch endpoint: validate + score a batch of n rows
        fc = MQ.trained(spark, sf_dir)
        rows = MQ.joined(spark, sf_dir).orderBy(*MQ.KEY).limit(n).withColumn("row_id", F.concat_ws("-", *MQ.KEY))
        out = S.predict_batch(rows, S.ModelSchema.from_config(fc.cfg), lambda d: fc.predict(d, "wide"), "row_id")
        out.collect()

    plan += [("batch_score_50_rows", lambda: batch(50)), ("batch_score_1000_rows", lambda: batch(1000))]
    times = {}
    for name, fn in plan:
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)
    n_li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    n_or = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    rates = {"profile_rows_per_sec": n_or / times["profile_columns"],
             "encode_rows_per_sec": 4 * n_or / times["encode_rows"],
             "train_rows_per_sec": n_li / times["train_cv_3q"],
             "score_rows_per_sec": 3 * n_li / times["score_long"]}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "rows_per_sec": {k: round(v) for k, v in rates.items()},
           "train_setup": "3 quantiles x (3 CV folds + final), depth 3, <=10 rounds, early stop 5"}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
