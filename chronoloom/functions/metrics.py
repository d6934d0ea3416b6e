"""Ranking, regression and classification metrics and losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.events import running_total


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def by_score(scores: DataFrame) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score. ``auc`` and
    ``average_precision`` take this table too, in place of (score, label)."""
    if {"p", "n"} <= set(scores.columns):
        return scores
    return scores.groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))


def _cumulative(scores: DataFrame, ranges: int | None = None) -> DataFrame:
    """The same with the sums over lower scores (p_below, n_below). Scores that are equal
    are one row; many different ones are dealt into ranges of about equal size."""
    return running_total(by_score(scores), ["score"], {"p_below": F.col("p"), "n_below": F.col("n")}, ranges)


def auc(scores: DataFrame) -> DataFrame:
    """(auc, auc_strict): ties count one half, or nothing."""
    c = _cumulative(scores)
    all_ = F.sum("p").cast("double") * F.sum("n").cast("double")
    return c.agg((F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)) / all_).alias("auc"), (F.sum((F.col("p") * F.col("n_below")).cast("double")) / all_).alias("auc_strict"))


def average_precision(scores: DataFrame) -> DataFrame:
    """(ap): precision at each distinct score, weighted by its positives."""
    sums = by_score(scores)
    c = _cumulative(sums)
    total = sums.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    # the one row of totals
    at = c.crossJoin(F.broadcast(total))
    tp = F.col("all_p") - F.col("p_below")
    seen = tp + F.col("all_n") - F.col("n_below")
    return at.agg((F.sum(F.col("p") * tp / seen) / F.max("all_p")).alias("ap"))


def pseudo_ap(scores: DataFrame) -> DataFrame:
    """((mean positive - mean negative) / 2 + 1 / 2) of sigmoid scores, within 0 and 1."""
    s = sigmoid(F.col("score"))
    value = (F.avg(F.when(F.col("label") == 1, s)) - F.avg(F.when(F.col("label") == 0, s))) / 2 + 0.5
    return scores.agg(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("pseudo_ap"))


def pairwise_win_rate(scores: DataFrame) -> DataFrame:
    """Strict share of (positive, negative) pairs with the positive above; also ``mrr``."""
    return auc(scores).select(F.col("auc_strict").alias("pairwise_win_rate"), F.col("auc_strict").alias("mrr"))


def regression(pairs: DataFrame) -> DataFrame:
    """(mae, rmse, nmae) of (pred, label)."""
    d = F.col("pred") - F.col("label")
    return pairs.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.avg(F.abs(d)) / F.abs(F.avg("label"))).alias("nmae"))


def argmax(vector: Column) -> Column:
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def accuracy(rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    return rows.agg(F.avg((argmax(F.col(logits)) == F.col(label)).cast("double")).alias("accuracy"))


def bce(scores: DataFrame) -> DataFrame:
    """Mean binary cross-entropy with logits."""
    x, y = F.col("score"), F.col("label")
    return scores.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("bce"))


def mse(pairs: DataFrame) -> DataFrame:
    d = F.col("pred") - F.col("label")
    return pairs.agg(F.avg(d * d).alias("mse"))


def cross_entropy(rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    v = F.col(logits)
    top = F.array_max(v)
    total = F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top
    return rows.agg(F.avg(total - F.element_at(v, F.col(label) + 1)).alias("ce"))


def epoch_summary(steps: DataFrame) -> DataFrame:
    """(loss, elapsed): mean loss and largest elapsed time over ranks and steps."""
    return steps.agg(F.avg("loss").alias("loss"), F.max("elapsed").alias("elapsed"))


def loss_scale(local_nodes: Column, total_nodes: Column) -> Column:
    return local_nodes / total_nodes
