"""The analytical chain as steps: predict, evaluate, signals, forecast; each writes its frames.

    python -m tidewire.plans.pipeline DATA OUT [step ...]
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog

#: Step: the queries whose frames it writes.
STEPS: dict[str, tuple[str, ...]] = {
    "predict": ("lexicon_scores", "text_classifier"),
    "evaluate": ("confusion_matrix", "classification_report", "macro_weighted_f1", "recall_grid"),
    "signals": ("daily_sentiment_market_asof", "lag_metrics_pearson_ols", "lag_metrics_spearman", "lag_p_values", "granger_f_stats", "granger_best_lag", "lag_heatmap"),
    "forecast": ("persistence_metrics", "forecast_linear", "forecast_recurrent"),
}


def run(spark: SparkSession, data: str, out: str, steps: list[str] | None = None, write: Callable[[DataFrame, str], None] | None = None) -> list[str]:
    """Run the steps in order (all, if none is named) and return what was written."""
    chosen = steps or list(STEPS)
    if unknown := [s for s in chosen if s not in STEPS]:
        raise ValueError(f"no step {unknown}; there are {list(STEPS)}")
    write = write or (lambda frame, path: frame.write.mode("overwrite").json(path))
    paths = []
    for step in (s for s in STEPS if s in chosen):
        for name in STEPS[step]:
            write(catalog.QUERIES[name](spark, data), f"{out}/{step}/{name}")
            paths.append(f"{out}/{step}/{name}")
    return paths


if __name__ == "__main__":
    session = SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print("\n".join(run(session, sys.argv[1], sys.argv[2], sys.argv[3:])))
