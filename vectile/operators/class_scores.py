"""Scores of a classifier: confusion counts, threshold-free areas, losses, multi-class averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.operators.cluster_scores import contingency
from vectile.operators.ranking import running_totals

GENERAL_SCORES = ("Precision", "Recall", "F1-Score", "Accuracy", "MCC")  # fixed names
BINARY_SCORES = (*GENERAL_SCORES, "Auroc", "Roc_auc", "TP", "FP", "TN", "FN")


def list_of_scores(num_classes: int) -> list[str]:
    return list(BINARY_SCORES if num_classes == 2 else GENERAL_SCORES)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(true) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp")
    )


def binary_scores(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, MCC and the AUROC of the hard predictions."""
    c = confusion(df, true, pred, by)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *by, "tp", "fp", "tn", "fn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp * tn - fp * fn, root).alias("mcc"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("auroc"),
    )


def weighted_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: support-weighted precision, recall, F1, and accuracy and multi-class MCC."""
    cells = contingency(df, true, pred)
    role = F.array(
        F.struct(F.col(true).cast("string").alias("cls"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"),
                 F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(pred).cast("string").alias("cls"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("hit")),
    )
    per = (
        cells.select(F.inline(role)).groupBy("cls")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("a", "b", "hit")])
    )
    a, b, hit = F.col("a"), F.col("b"), F.col("hit")
    p, r = _ratio(hit, b), _ratio(hit, a)
    sums = per.agg(
        F.sum(a).alias("n"), F.sum(hit).alias("c"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"),
        F.sum(a * p).alias("p"), F.sum(a * r).alias("r"), F.sum(a * _ratio(2 * hit, a + b)).alias("f"),
    )
    n = F.col("n")
    root = F.sqrt((n * n - F.col("bb")) * (n * n - F.col("aa")))
    return sums.select(
        (F.col("p") / n).alias("precision"), (F.col("r") / n).alias("recall"), (F.col("f") / n).alias("f1"),
        (F.col("c") / n).alias("accuracy"), _ratio(F.col("c") * n - F.col("ab"), root).alias("mcc"),
    )


def _by_score(df: DataFrame, true: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score down."""
    ties = df.groupBy(*by, F.col(score).alias("__s")).agg(
        F.count_if(F.col(true) == 1).alias("p"), F.count_if(F.col(true) != 1).alias("q")
    )
    return running_totals(ties, [F.desc("__s")], ["p", "q"], by=by)


def roc_auc(df: DataFrame, true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: trapezoids over distinct scores. Null when a class is missing."""
    r = _by_score(df, true, score, by)
    area = F.sum(F.col("q") * (F.col("run_p") - F.col("p") / 2))
    return r.groupBy(*by).agg(F.try_divide(area, F.max("all_p").cast("double") * F.max("all_q")).alias("auroc"))


def average_precision(df: DataFrame, true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores of the recall step times the precision reached."""
    r = _by_score(df, true, score, by)
    step = F.sum(F.col("p") * F.try_divide(F.col("run_p"), F.col("run_p") + F.col("run_q")))
    return r.groupBy(*by).agg(F.try_divide(step, F.max("all_p")).alias("average_precision"))


def log_loss(df: DataFrame, true: str, prob: str, *, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.when(F.col(true) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def classifier_report(df: DataFrame, true: str, pred: str, prob: str) -> DataFrame:
    """(metric, value): counts, accuracy, MCC, both areas from the score, and the loss."""
    flat = binary_scores(df, true, pred).select("tp", "tn", "fp", "fn", "accuracy", "mcc")
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in flat.columns])
    out = flat.select(F.inline(pairs))
    for frame, col, name in (
        (roc_auc(df, true, prob), "auroc", "auroc"),
        (average_precision(df, true, prob), "average_precision", "auprc"),
        (log_loss(df, true, prob), "log_loss", "eval_loss"),
    ):
        out = out.unionByName(frame.select(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value")))
    return out


def wrong_predictions(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.where(F.col(pred) != F.col(true))


def multitask_scores(df: DataFrame, task: str, true: str, pred: str, score: str) -> DataFrame:
    """(task, auroc, accuracy), one row per task."""
    return roc_auc(df, true, score, [task]).join(binary_scores(df, true, pred, [task]).select(task, "accuracy"), task)


def regression_scores(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(pred) - F.col(true)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))
