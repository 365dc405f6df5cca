"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lotlens.plans import appraisal, registry
from lotlens.session import local_session
from lotlens.sources import market

HEADLINE = [
    "stats_spread", "stats_outliers", "stats_weighted_quantiles", "stats_interpolated_quantiles", "stats_percentile_rank",
    "stats_effective_size", "market_snapshots", "finds", "discover", "market_overview", "budgets", "price_moves", "price_history",
    "comparables_chosen", "stats_theil_sen", "valuations", "risk", "ratings", "confidences", "negotiations", "inspection_plans",
    "bundles", "report_findings", "fold_keys", "identities", "document_disclosures", "transcripts", "state_upsert", "page_fields",
    "page_links", "listing_page_fields", "attribute_values", "exchange_rates", "cited_numbers", "saved_alerts", "market_context",
    "report_checks", "responses", "listing_histories", "limited_requests",
]
# tables that queries share, written by the first that needs one: timed by themselves
SHARED = {"listings": market.listings, "valued": appraisal._valued, "facts": appraisal._facts}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "12g")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # starts the session's threads
    took: dict[str, float | None] = {}
    tables: dict[str, float] = {}
    for name, make in SHARED.items():
        began = time.time()
        make(spark, sf_dir)
        tables[name] = round(time.time() - began, 3)
        print(f"table {name} {tables[name]}", file=sys.stderr, flush=True)
    for name in HEADLINE:
        began = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
            print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        except Exception as error:  # one failure must not hide the other figures
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            took[name] = None
    total = round(sum(t for t in took.values() if t is not None) + sum(tables.values()), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "shared_tables": tables, "sf": os.path.basename(sf_dir)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
