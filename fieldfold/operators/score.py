"""Scoring: one-to-one matches between predicted and true places, counts, identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import quantile
from .graph import components
from .lineage import checkpoint
from .spatial import range_join


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], j = row, 0
        best, via, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j]:
            used[j] = True
            i = owner[j]
            free = ~used
            free[0] = False
            reduced = np.full(n + 1, np.inf)
            reduced[1:] = cost[i - 1] - u[i] - v[1:]
            better = free & (reduced < best)
            best[better], via[better] = reduced[better], j
            k = int(np.argmin(np.where(free, best, np.inf)))
            delta = best[k]
            u[owner[used]] += delta
            v[used] -= delta
            best[free] -= delta
            j = k
        while j:
            owner[j] = owner[via[j]]
            j = via[j]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def match_points(predicted: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """pid, tid, distance of the one-to-one match: as many pairs within the radius as can be, at least total distance.

    predicted(pid, x, y), truth(tid, x, y). Only pairs within the radius matter, so each component of the graph of
    such pairs is solved on its own.
    """
    pairs = range_join(predicted, truth, radius).select(F.col("a.pid").alias("pid"), F.col("b.tid").alias("tid"), F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2).alias("distance"))
    coded = pairs.withColumns({"a": F.col("pid") * 2, "b": F.col("tid") * 2 + 1})
    found = components(coded.select("a", "b"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        p, t = np.unique(group.pid), np.unique(group.tid)
        n = max(len(p), len(t))
        far = radius * (n + 1) * 2 + 1  # more than any chain of close pairs costs: matches come before distance
        cost = np.full((n, n), far)
        cost[np.searchsorted(p, group.pid), np.searchsorted(t, group.tid)] = group.distance
        to = assignment(cost)
        rows = [(p[i], t[to[i]], cost[i, to[i]]) for i in range(len(p)) if to[i] < len(t) and cost[i, to[i]] < far]
        return pd.DataFrame(rows, columns=["pid", "tid", "distance"])

    return coded.join(found, coded.a == found.node).select("root", "pid", "tid", "distance").groupBy("root").applyInPandas(solve, "pid long, tid long, distance double")


def accuracy(predicted: int, truth: int) -> float:
    """1 - |predicted - truth| / truth, not below 0; with no truth 1 if nothing was predicted."""
    if truth == 0:
        return 1.0 if predicted == 0 else 0.0
    return max(0.0, 1.0 - abs(predicted - truth) / truth)


def evaluate(points: DataFrame, clusters: DataFrame, animals: DataFrame, truth: DataFrame, radius: float) -> dict:
    """Scores against truth(tid, truth_id, x, y); points carry truth_id (FP: false positive, null: unknown)."""
    n_truth, n_raw, n_pred = truth.count(), points.count(), animals.count()
    seen = points.where("truth_id is not null and truth_id <> 'FP'").select("truth_id").distinct()
    observed = truth.join(seen, "truth_id", "left_semi")
    n_obs = observed.count()
    hits = match_points(animals.select(F.col("number").alias("pid"), "x", "y"), observed.select("tid", "x", "y"), radius).agg(F.count("*"), F.avg("distance")).first()
    known = points.select("idx", "truth_id").join(clusters.where("cluster is not null"), "idx").where("truth_id is not null and truth_id <> 'FP'").select("cluster", "truth_id")
    over, split = identity_errors(known)
    precision, recall = (hits[0] / n if n else 0.0 for n in (n_pred, n_obs))
    return {
        "true_animals": n_truth, "observed_animals": n_obs, "raw_detections": n_raw, "predicted_animals": n_pred, "matched": hits[0], "precision": precision, "recall": recall,
        "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "count_accuracy": max(0.0, 1 - abs(n_pred - n_obs) / n_obs) if n_obs else 0.0,
        "mean_position_error_m": float("nan") if hits[1] is None else hits[1], "over_merged_clusters": over, "split_animals": split,
    }


def identity_errors(known: DataFrame) -> tuple[int, int]:
    """(clusters that hold several truths, truths that stand in several clusters) of known(cluster, truth_id)."""
    known = known.distinct()
    return tuple(known.groupBy(c).count().where("count > 1").count() for c in ("cluster", "truth_id"))


def class_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """label, truth, predicted, error, accuracy by class in lower case, for the classes that truth has."""
    n = lambda df, name: df.groupBy(F.lower("label").alias("label")).agg(F.count("*").alias(name))
    both = n(truth, "truth").join(n(predicted, "predicted"), "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    error = F.col("predicted") - F.col("truth")
    return both.select("label", "truth", "predicted", error.alias("error"), F.greatest(F.lit(0.0), 1 - F.abs(error) / F.col("truth")).alias("accuracy"))


def rollup(runs: DataFrame, threshold: float) -> DataFrame:
    """By profile: runs, mean count accuracy and F1, mean share of detections removed, whether both means pass."""
    means = runs.groupBy("profile").agg(F.count("*").alias("runs"), F.avg("count_accuracy").alias("count_accuracy"), F.avg("f1").alias("f1"), F.avg(1 - F.col("predicted_animals") / F.col("raw_detections")).alias("removed"))
    return means.withColumn("passed", (F.col("count_accuracy") >= threshold) & (F.col("f1") >= threshold))


def parse_counts(text: str) -> dict[str, int]:
    """"150" is a total; "cattle=120,sheep=30" counts by class, in lower case."""
    text = text.strip()
    if text.isdigit():
        return {"": int(text)}
    out = {}
    for part in text.split(","):
        name, eq, number = part.partition("=")
        if not eq or not number.strip().isdigit() or not name.strip():
            raise ValueError(f"a count is a number or class=number, not {part!r}")
        out[name.strip().lower()] = int(number)
    return out


def _by_class(rows: DataFrame, none: str = "") -> dict[str, int]:
    """How many rows each label (in lower case) has: a row a class comes to the driver."""
    label = F.lower(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit(none)))
    return {r.label: r["count"] for r in rows.groupBy(label.alias("label")).count().orderBy("label").collect()}


def _class_scores(truth: dict[str, int], predicted: dict[str, int]) -> dict[str, dict]:
    return {k: {"truth": v, "predicted": predicted.get(k, 0), "error": predicted.get(k, 0) - v, "accuracy": accuracy(predicted.get(k, 0), v)} for k, v in truth.items()}


def validate_counts(animals: DataFrame, counts: dict[str, int]) -> dict:
    """Predicted against counted numbers; where classes are counted only these are compared."""
    by_class = _by_class(animals)
    every = list(counts) == [""]
    predicted = sum(by_class.values()) if every else sum(by_class.get(k, 0) for k in counts)
    truth = sum(counts.values())
    return {"truth": truth, "predicted": predicted, "count_error": predicted - truth, "count_accuracy": accuracy(predicted, truth), "classes": {} if every else _class_scores(counts, by_class)}


def unmatched_rows(animals: DataFrame, truth: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missed rows of truth, extra records): those that the match hits(pid, tid) leaves over."""
    missed = truth.join(hits.select("tid"), "tid", "left_anti")
    return missed, animals.join(hits.select(F.col("pid").alias("number")), "number", "left_anti")


def validate_points(animals: DataFrame, truth: DataFrame, radius: float) -> dict:
    """animals(number, animal_id, label, x, y) against truth(tid, label, x, y): counts, matches, missed and extra."""
    hits = checkpoint(match_points(animals.select(F.col("number").alias("pid"), "x", "y"), truth.select("tid", "x", "y"), radius))
    missed, extra = unmatched_rows(animals, truth, hits)
    n_hits, mean = hits.agg(F.count("*"), F.avg("distance")).first()
    by_class, real = _by_class(animals), _by_class(truth, "unlabelled")
    n_pred, n_truth = sum(by_class.values()), sum(real.values())
    precision, recall = (n_hits / n if n else 0.0 for n in (n_pred, n_truth))
    return {
        "truth": n_truth, "predicted": n_pred, "count_error": n_pred - n_truth, "count_accuracy": accuracy(n_pred, n_truth), "matched": n_hits, "precision": precision, "recall": recall,
        "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "mean_position_error_m": float("nan") if mean is None else mean,
        "p95_position_error_m": quantile(hits, "distance", 0.95), "match_radius_m": radius,
        "missed": [r.tid for r in missed.select("tid").orderBy("tid").collect()], "extra": [r.animal_id for r in extra.select("number", "animal_id").orderBy("number").collect()],
        "classes": {} if set(real) <= {"unlabelled"} else _class_scores(real, by_class),
    }
