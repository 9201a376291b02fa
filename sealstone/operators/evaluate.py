"""Evaluation of scored rows (id, label, kind, origin, score, codes): matrices, curves, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEAK_CODES = ("ocr_unavailable",)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(df: DataFrame, *extra: str) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, f1, fpr and flagged; empty denominators give 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.select(
        *extra, "tp", "fp", "fn", "tn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(_ratio(2 * precision * recall, precision + recall), 4).alias("f1"), F.round(_ratio(fp, fp + tn), 4).alias("fpr"), (tp + fp).alias("flagged"),
    )


def _cells(flag: Column) -> list[Column]:
    y = F.col("label") == 1
    return [F.count_if(y & flag).alias("tp"), F.count_if(~y & flag).alias("fp"), F.count_if(y & ~flag).alias("fn"), F.count_if(~y & ~flag).alias("tn")]


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    return rates(rows.agg(*_cells(F.col("score") >= threshold)))


def per_code(rows: DataFrame) -> DataFrame:
    """Confusion of each code seen, one against all: counts of rows with it, the rest from totals."""
    codes = rows.select("id", "label", F.explode(F.array_distinct(F.filter("codes", lambda c: ~c.isin(*WEAK_CODES)))).alias("code"))
    with_ = codes.groupBy("code").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    total = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    cells = with_.withColumn("fn", F.lit(total.p) - F.col("tp")).withColumn("tn", F.lit(total.n) - F.col("fp"))
    return rates(cells, "code")


def top_codes(rows: DataFrame, by: str, k: int = 4) -> DataFrame:
    """(by, top): "code (count/n)" of the k most frequent codes of each group, ties by first appearance."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    codes = rows.select(by, "id", F.posexplode("codes").alias("pos", "code"))
    counted = codes.groupBy(by, "code").agg(F.countDistinct("id").alias("c"), F.min(F.struct("id", "pos")).alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("c"), "first"))).where(F.col("r") <= k)
    text = F.format_string("%s (%d/%d)", "code", "c", "n")
    listed = ranked.join(sizes, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("l"))
    return listed.select(by, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("top"))


def slices(rows: DataFrame, label: int, by: str, review: int, attention: int) -> DataFrame:
    """Per group of rows of one label: n, share at both thresholds, mean score."""
    share = lambda t: F.round(F.avg((F.col("score") >= t).cast("int")), 4)
    out = rows.where(F.col("label") == label).groupBy(by)
    return out.agg(F.count("*").alias("n"), share(review).alias("at_review"), share(attention).alias("at_attention"), F.round(F.avg("score"), 1).alias("mean_score"))


def localisation(rows: DataFrame, by: str) -> DataFrame:
    """Share of located regions among rows that have a verdict; null if none has."""
    return rows.groupBy(by).agg(F.round(F.avg(F.col("localized").cast("int")), 4).alias("located"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(score, tp, fp, p, n) for each distinct score as threshold.

    Rows are first summed by score; only one row per distinct score meets in
    the running sums.
    """
    by_score = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p1"), F.count_if(F.col("label") == 0).alias("n1"))
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return by_score.select(
        "score", "p1", "n1", F.sum("p1").over(down).alias("tp"), F.sum("n1").over(down).alias("fp"), F.sum("p1").over(whole).alias("p"), F.sum("n1").over(whole).alias("n"),
    )


def pr_curve(rows: DataFrame) -> DataFrame:
    t = thresholds(rows)
    return t.select("score", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(_ratio(F.col("tp"), F.col("p")), 6).alias("recall"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Average precision, 4 dp; 0 without positives."""
    area = F.sum(_ratio(F.col("p1"), F.col("p")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return thresholds(rows).agg(F.round(F.coalesce(area, F.lit(0.0)), 4).alias("pr_auc"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney with ties as halves, 4 dp, from sums by score; 0 if a class is empty."""
    above = F.col("tp") - F.col("p1")
    wins = F.sum((above + F.col("p1") / 2) * F.col("n1"))
    return thresholds(rows).agg(F.round(_ratio(wins, F.max("p") * F.max("n")), 4).alias("roc_auc"))


def best_threshold(rows: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0) -> DataFrame:
    """Cheapest threshold among distinct scores and one above all; the lowest wins ties."""
    t = thresholds(rows)
    costs = t.select(F.col("score").cast("double").alias("threshold"), (F.col("fp") * cost_fp + (F.col("p") - F.col("tp")) * cost_fn).alias("cost"))
    none = t.agg((F.max("score") + 1).cast("double").alias("threshold"), (F.max("p") * cost_fn).alias("cost"))
    return costs.unionAll(none).agg(F.min(F.struct("cost", "threshold")).alias("b")).select("b.threshold", "b.cost")


def summary(rows: DataFrame) -> DataFrame:
    """n, positives, negatives, mean seconds (3 dp), distinct error texts in order."""
    errors = F.array_sort(F.collect_set("error"))
    return rows.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"), F.round(F.avg("seconds"), 3).alias("seconds"), errors.alias("errors"))


def markdown(rows: DataFrame, review: int, attention: int, title: str) -> str:
    """A report of small aggregates as Markdown."""
    def lines(df: DataFrame) -> list[str]:
        head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
        return head + [f"| {' | '.join('n/a' if v is None else str(v) for v in r)} |" for r in df.collect()]

    parts = [f"# {title}", ""]
    for name, df in (
        ("Thresholds", confusion(rows, review).unionAll(confusion(rows, attention))), ("Best threshold", best_threshold(rows)), ("PR-AUC", pr_auc(rows)),
        ("ROC-AUC", roc_auc(rows)), ("Codes", per_code(rows).orderBy(F.desc("f1"), "code")), ("Kinds", slices(rows, 1, "kind", review, attention).orderBy("kind")),
        ("Origins", slices(rows, 0, "origin", review, attention).orderBy("origin")),
    ):
        parts += [f"## {name}", "", *lines(df), ""]
    return "\n".join(parts)
