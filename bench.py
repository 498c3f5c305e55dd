"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. One small query warms the JVM up before the timing starts.
BENCH_QUERIES, a comma-separated list, or ``all`` chooses other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chorus.workspace import local_session  # noqa: E402

HEADLINE = (
    "clean_stage", "clean_stats", "language_class", "ngram_language_id", "sentiment_label",
    "ingest_dedup", "ingest_counts", "stratified_split", "split_quality", "crosstab_pct",
    "monthly_by_class", "numeric_summary", "sequence_lengths", "keyword_freq_by_class",
    "tfidf_vocab", "tfidf_weights", "naive_bayes_counts", "token_contributions",
    "classification_metrics", "roc_auc", "leaderboard", "latency_stats", "index_percentile",
    "box_stats", "quota_prefix", "stream_ingest", "stream_append", "stream_dedup",
    "stream_recent_counts",
)


def training_times(spark, folder: str) -> dict[str, float]:
    """Feature preparation once, then each trainer and batch scoring on its own.

    All trainers run the defaults of the library.
    """
    from chorus.catalog import training as t
    from chorus.plans import models

    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        return result

    f = timed("prepare_features", lambda: t.features(spark, folder))
    model = timed("fit_logreg", lambda: t.fitted(spark, folder, "logistic_regression"))
    timed("fit_svm", lambda: t.fitted(spark, folder, "linear_svm"))
    timed("fit_bayes", lambda: t.fitted(spark, folder, "naive_bayes"))
    timed("fit_forest", lambda: t.fitted(spark, folder, "random_forest"))
    timed("fit_gbt", lambda: t.fitted(spark, folder, "gradient_boosting"))
    scored = models.predict(model, f.table, f.classes)
    timed("score_all", lambda: scored.write.format("noop").mode("overwrite").save())
    timed("evaluate", lambda: models.evaluate(scored, f.classes).collect())
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("OFF")
    from chorus.catalog import REGISTRY

    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    REGISTRY["clean_stage"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    if not chosen:
        times.update(training_times(spark, folder))
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
