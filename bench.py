"""Headline queries, timed: prints one JSON line.

Every query is run once unmeasured (JIT, Python workers) and then timed from the tables on: what queries share
within a session is forgotten before, and the whole result is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cuelake.plans import all_queries
from cuelake.session import local_session

HEADLINES = [
    "srt_scan", "match_join", "match_join_theta", "tally", "topic_digest", "digest_export", "context_snippet", "next_hit",
    "attribute_components", "match_ordinals", "term_windows", "excerpt_budget", "cue_at", "facet_state",
    "drift_breadcrumbs", "pyramid", "pyramid_ids", "content_chain", "pattern_branches", "adopt_novel",
    "sanitize_markup", "consolidate_terms",
]


def forget() -> None:
    """Drop the inputs that the query modules keep per session."""
    for name, module in list(sys.modules.items()):
        if name.startswith("cuelake.plans."):
            for value in list(vars(module).values()):
                if hasattr(value, "cache_clear"):
                    value.cache_clear()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = all_queries()[0]
    names = [n for n in (sys.argv[1:] or HEADLINES) if n in queries]
    seconds = {}
    for name in names:
        for measured in (False, True):
            forget()
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if measured:
                seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total warm seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
