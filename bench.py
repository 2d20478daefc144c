"""Seconds of the headline queries on local cores, as one JSON line: a warm session's median of five runs, beside DuckDB on the same SQL and host."""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = ("fts_bm25_topk", "vector_knn_l2", "filename_search", "metadata_search", "rrf_hybrid", "hydrate_nodes", "search_full", "browse_root", "status_counts", "file_upsert", "snapshot_diff", "catalog_diff", "audit_redact", "content_hash", "ir_recall_ndcg", "prose_chunks")
RUNS = 5


def median(run) -> float:
    seconds = []
    for _ in range(RUNS):
        began = time.time()
        run()
        seconds.append(time.time() - began)
    return round(statistics.median(seconds), 3)


def beside(names: tuple[str, ...], sql: dict[str, str]) -> dict[str, float]:
    """DuckDB's seconds for the same results."""
    import duckdb

    con = duckdb.connect(config={"threads": int(CPUS)})
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{f}')")
    return {n: median(lambda n=n: con.sql(sql[n]).fetchall()) for n in names if n in sql}


def main() -> None:
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"
    from tidewater.queries import QUERIES, SQL
    from tidewater.session import session

    spark = session(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: median(lambda name=name: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()) for name in NAMES}
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": beside(NAMES, SQL), "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
