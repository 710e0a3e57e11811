"""Bench: every registered output of one audit run, timed.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each output is executed in
full with the ``noop`` sink (every row computed, nothing collected). One
``Audit`` serves all outputs, as in a real run, so the processor rows are
computed once. With ``BENCH_COLD=1`` each output is also timed on an
audit of its own (``cold_queries``), which computes all its steps. With
``BENCH_DUCKDB=1`` (default) the DuckDB oracle is timed on the same tables; it
computes all steps of each output, so the cold times compare with it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paymatch.audit import OUTPUTS, Audit  # noqa: E402
from paymatch.params import fixture_params  # noqa: E402
from paymatch.session import get_session  # noqa: E402
from paymatch.sources.fixtures import fixture_sources  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def run_duckdb(sf_dir: str, names: list[str]) -> dict[str, float]:
    import duckdb

    from paymatch.oracle import oracle_queries
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    sql = oracle_queries(fixture_params())
    out = {}
    for n in names:
        t0 = time.perf_counter()
        con.execute(sql[n]).fetchall()
        out[n] = round(time.perf_counter() - t0, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([\d.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(cpus * 2, 8)))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=partitions,
                        extra={"spark.driver.memory": "16g"})
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed

    audit = Audit(fixture_sources(spark, sf_dir), fixture_params())
    times: dict[str, float] = {}
    jobs: dict[str, list[int]] = {}
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    t_all = time.perf_counter()
    for name in OUTPUTS:
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        audit.output(name).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        ids = tracker.getJobIdsForGroup(name)
        stages = sum(len(info.stageIds) for info in (tracker.getJobInfo(j) for j in ids) if info)
        jobs[name] = [len(ids), stages]
    total = round(time.perf_counter() - t_all, 3)
    audit.close()
    cold: dict[str, float] = {}
    for name in OUTPUTS if os.environ.get("BENCH_COLD", "0") == "1" else ():
        t0 = time.perf_counter()
        with Audit(fixture_sources(spark, sf_dir), fixture_params()) as own:
            own.output(name).write.format("noop").mode("overwrite").save()
        cold[name] = round(time.perf_counter() - t0, 3)
    spark.stop()

    result = {"metric": "audit_wall_time", "value": total, "unit": "sec", "queries": times,
              "sf": sf, "cpus": cpus, "flagship": "recon_report",
              "flagship_sec": times.get("recon_report"),
              "jobs_stages": jobs, "cold_total": round(sum(cold.values()), 3), "cold_queries": cold}
    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        duck = run_duckdb(sf_dir, list(OUTPUTS))
        result["duckdb_literal_sql"] = {"value": round(sum(duck.values()), 3), "queries": duck}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
