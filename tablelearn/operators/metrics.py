"""Classification and regression metrics over a (label, prediction) table.

Everything is a grouped aggregate over the prediction rows followed by
arithmetic on the small per-class table.  Zero divisions give 0 (the
reference's ``zero_division=0``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _div(a, b):
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def accuracy(pred: DataFrame, label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, correct, total."""
    ok = (F.col(label) == F.col(prediction)).cast("int")
    return pred.agg(F.avg(ok.cast("double")).alias("accuracy"),
                    F.sum(ok).cast("bigint").alias("correct"),
                    F.count(F.lit(1)).cast("bigint").alias("total"))


def class_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, n_classes)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.withColumn("n_classes", F.count(F.lit(1)).over(Window.partitionBy()).cast("bigint"))


def per_class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., class, tp, support, predicted) over the union of true and predicted classes."""
    t = pred.select(*keys, F.col(label).alias("class"), F.lit(1).alias("_s"), F.lit(0).alias("_p"),
                    (F.col(label) == F.col(prediction)).cast("int").alias("_tp"))
    p = pred.select(*keys, F.col(prediction).alias("class"), F.lit(0).alias("_s"), F.lit(1).alias("_p"),
                    F.lit(0).alias("_tp"))
    return t.unionByName(p).groupBy(*keys, "class").agg(
        F.sum("_tp").cast("bigint").alias("tp"), F.sum("_s").cast("bigint").alias("support"),
        F.sum("_p").cast("bigint").alias("predicted"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., class, precision, recall, f1, support)."""
    c = per_class_counts(pred, label, prediction, keys)
    prec = _div(F.col("tp"), F.col("predicted"))
    rec = _div(F.col("tp"), F.col("support"))
    c = c.select(*keys, "class", prec.alias("precision"), rec.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall")
                / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return c.select(*keys, "class", "precision", "recall", f1.alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, support) for 'macro avg' and 'weighted avg',
    plus an 'accuracy' row (micro recall) with support = total."""
    tot = F.sum("support")
    a = report.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("wf"),
        tot.cast("bigint").alias("n"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("acc"))
    return a.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("average"), F.col("acc").alias("precision"),
                 F.col("acc").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").alias("support")),
        *[F.struct(F.lit(nm).alias("average"), F.col(a).alias("precision"),
                   F.col(b).alias("recall"), F.col(c).alias("f1"), F.col("n").alias("support"))
          for nm, a, b, c in (("macro avg", "mp", "mr", "mf"),
                              ("weighted avg", "wp", "wr", "wf"))])))


def confusion_matrix(pred: DataFrame, classes: list, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Wide matrix: one row per true class plus a 'total' row; columns
    ``pred_<c>`` per class and ``total``.  ``classes`` fixes the columns."""
    labels = F.col(label).cast("string")
    g = (pred.withColumn("_t", labels)
         .cube("_t", prediction).agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    wide = (g.withColumn("_pc", F.coalesce(F.col(prediction).cast("string"), F.lit("total")))
            .groupBy(F.coalesce(F.col("_t"), F.lit("total")).alias("actual"))
            .pivot("_pc", [str(c) for c in classes] + ["total"]).agg(F.first("n")))
    return wide.select("actual", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint")
                                   .alias(f"pred_{c}") for c in classes],
                       F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total"))


def binary_metrics(pred: DataFrame, positive, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """One row: tp, tn, fp, fn, precision, recall, specificity, f1."""
    y = F.col(label) == F.lit(positive)
    p = F.col(prediction) == F.lit(positive)
    a = pred.agg(F.count_if(y & p).cast("bigint").alias("tp"),
                 F.count_if(~y & ~p).cast("bigint").alias("tn"),
                 F.count_if(~y & p).cast("bigint").alias("fp"),
                 F.count_if(y & ~p).cast("bigint").alias("fn"))
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = _div(F.col("tn"), F.col("tn") + F.col("fp"))
    a = a.select("*", prec.alias("precision"), rec.alias("recall"), spec.alias("specificity"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall")
                / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return a.select("*", f1.alias("f1"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each of ``keys``): r2, mse, rmse, mae, n.  Constant target: r2 = 1 if exact else 0."""
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    a = pred.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                 F.sum(e * e).alias("sse"), F.var_pop(F.col(label).cast("double")).alias("vy"),
                 F.count(F.lit(1)).cast("bigint").alias("n"))
    sst = F.col("vy") * F.col("n")
    r2 = (F.when(sst > 0, 1 - F.col("sse") / sst)
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(*keys, r2.alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae", "n")


SCORERS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted",
           "recall_weighted", "f1_weighted", "precision_micro", "recall_micro", "f1_micro",
           "r2", "neg_mean_squared_error", "neg_mean_absolute_error",
           "neg_root_mean_squared_error", "roc_auc")


def score(pred: DataFrame, scoring: str = "accuracy", label: str = "label",
          prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each of ``keys``), column ``score``: the named scorer over a prediction table."""
    s = scoring.strip().lower()
    if s == "accuracy" or s in ("precision_micro", "recall_micro", "f1_micro"):
        ok = (F.col(label) == F.col(prediction)).cast("double")
        return pred.groupBy(*keys).agg(F.avg(ok).alias("score"))
    if s in ("r2", "neg_mean_squared_error", "neg_mean_absolute_error",
             "neg_root_mean_squared_error"):
        m = regression_metrics(pred, label, prediction, keys)
        col = {"r2": F.col("r2"), "neg_mean_squared_error": -F.col("mse"),
               "neg_mean_absolute_error": -F.col("mae"),
               "neg_root_mean_squared_error": -F.col("rmse")}[s]
        return m.select(*keys, col.alias("score"))
    if s.split("_")[0] in ("precision", "recall", "f1") and s.split("_")[-1] in (
            "macro", "weighted"):
        metric, avg = s.split("_")[0], s.split("_")[-1]
        rep = classification_report(pred, label, prediction, keys).groupBy(*keys)
        if avg == "macro":
            return rep.agg(F.avg(metric).alias("score"))
        return rep.agg((F.sum(F.col(metric) * F.col("support")) / F.sum("support"))
                       .alias("score"))
    if s == "roc_auc":
        if keys:
            raise ValueError("roc_auc is scored one prediction table at a time")
        # binary: the area under the curve of the larger class's probability
        from . import roc
        classes = sorted(c[2:] for c in pred.columns if c.startswith("p_"))
        if len(classes) != 2:
            raise ValueError("roc_auc needs the probabilities of two classes")
        values = {str(r[0]): r[0] for r in pred.select(label).distinct().limit(3).collect()}
        top = max(classes, key=lambda c: (values.get(c) is not None, values.get(c)))
        return roc.auc(pred, label, f"p_{top}", values[top]).select(F.col("auc").alias("score"))
    raise ValueError(f"unknown scoring {scoring!r}; choose one of {SCORERS}")
