"""Time the headline queries; prints one JSON line.

Inputs (tables, derived tables, column and pair files) are written once beforehand and
not timed. Each query runs three times and its median counts, but for what is left when
``BENCH_SECONDS`` (600) are over: those queries run once. ``BENCH_SF_DIR`` and
``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

from checks import fixtures, queries
from checks.compare import session
from checks.queries import QUERIES
from spanlake.sources import columns

HEADLINE = (
    "clean_lines", "escape_tags", "unwrap_lines", "break_punct", "tokenize",
    "fragments", "markup_errors", "sentence_assembly", "number_tokens",
    "documents_to_tokens",
    "read_columns", "read_pairs", "annotate_hook", "align_pairs",
    "score", "score_by_corpus", "chunk_spans", "token_accuracy",
    "mentions", "length_crosstab_tokens", "length_hist_chars", "corpus_summary",
    "plain_sentences", "corpus_split", "train_shards", "char_inventory", "char_sequences",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    fixtures.prepare(spark, sf_dir)
    fixtures.files(spark, sf_dir, "columns", lambda f: columns.write_columns(fixtures.tokens(spark, sf_dir), f))
    queries.prepare_pairs(spark, sf_dir)
    times = {}
    until = time.time() + float(os.environ.get("BENCH_SECONDS", "600"))
    for name in names:
        runs = []
        while len(runs) < (3 if time.time() < until else 1):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(median(runs), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )


if __name__ == "__main__":
    main()
