"""Scorers over findings and long feature tables, model loading and training."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .findings import additive_score, decide, explanation

HASH_FEATURES = ("duplicates.sha256", "duplicates.perceptual_hash", "duplicates.phash")
MAX_CATEGORIES = 8


def additive(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    scored = df.withColumn("score", additive_score(F.col("findings")))
    return scored.withColumn("decision", decide(F.col("score"), config)).withColumn("model", F.lit("additive")).withColumn("explanation", explanation(F.col("findings")))


def _literal(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A constant array of structs, for tables of some dozens of rows that every row meets."""
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))


def model_table(spark: SparkSession, model: dict) -> DataFrame:
    """(feature, mean, std, coef, intercept): the model's parallel arrays as rows; zero std counts as 1."""
    if model.get("model") != "logistic":
        raise ValueError("not a logistic model")
    rows = [(f, float(m), float(s) or 1.0, float(c), float(model["intercept"])) for f, m, s, c in zip(model["features"], model["mean"], model["std"], model["coef"], strict=True)]
    return spark.createDataFrame(rows, "feature string, mean double, std double, coef double, intercept double")


def load_model(spark: SparkSession, path: str) -> DataFrame:
    row = spark.read.option("wholetext", True).text(path).first()
    return model_table(spark, json.loads(row.value))


def contributions(ids: DataFrame, features: DataFrame, model: DataFrame) -> DataFrame:
    """(id, feature, value, contribution) of every model feature for every id.

    `features` is long: (id, feature, value). An absent feature counts as the
    mean: its contribution is 0 and `value` null. A one-hot feature
    `name=value` is 0 if `name` has another value, absent if `name` is.
    """
    rows = [tuple(r) for r in model.select("feature", "mean", "std", "coef", "intercept").collect()]  # some dozens of features
    grid = ids.select("id", F.explode(_literal(rows, ("feature", "mean", "std", "coef", "intercept"))).alias("m")).select("id", "m.*")
    known = features.select("id", "feature", "value")
    joined = grid.join(known, ["id", "feature"], "left")
    return joined.select("id", "feature", "value", F.coalesce(F.col("coef") * (F.col("value") - F.col("mean")) / F.col("std"), F.lit(0.0)).alias("contribution"), "intercept")


def logistic(parts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """id, probability (4 dp), score (percent, half to even), decision from `contributions`."""
    margin = parts.groupBy("id").agg((F.sum("contribution") + F.max("intercept")).alias("margin"))
    p = 1 / (1 + F.exp(-F.col("margin")))
    scored = margin.select("id", F.round(p, 4).alias("probability"), F.bround(100 * p, 0).cast("int").alias("score"))
    return scored.withColumn("decision", decide(F.col("score"), config))


def top_contributions(parts: DataFrame, k: int = 8) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.abs("contribution").desc(), "feature"))
    kept = parts.where(F.col("value").isNotNull() & (F.abs("contribution") > 1e-6))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def combined(additive_df: DataFrame, logistic_df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The larger of both scores; the additive one wins ties."""
    a, b = additive_df.select("id", F.col("score").alias("additive")), logistic_df.select("id", F.col("score").alias("logistic"))
    score = F.greatest("additive", "logistic")
    winner = F.when(F.col("additive") >= F.col("logistic"), "additive").otherwise("logistic")
    return a.join(b, "id").select("id", "additive", "logistic", score.alias("score"), winner.alias("winner"), decide(score, config).alias("decision"))


def build_scorer(config: Config = DEFAULT) -> str:
    """additive without a model or where its file is missing, else the configured mode."""
    return config.scoring_mode if config.scoring_model and os.path.exists(config.scoring_model) else "additive"


def model_scores(df: DataFrame, model: dict, k: int = 8) -> DataFrame:
    """`df` with probability, logistic and logistic_parts from its map `features` of texts; one projection, no join.

    An absent feature counts as the mean. Parts are the `k` largest contributions
    that are not zero, by size, then name.
    """
    if model.get("model") != "logistic":
        raise ValueError("not a logistic model")
    rows = zip(model["features"], model["mean"], model["std"], model["coef"], strict=True)
    parts = []
    for name, mean, std, coef in rows:
        value = feature_value(name, F.col("features"))
        parts.append(F.struct(F.lit(name).alias("feature"), value.alias("value"), F.coalesce((value - float(mean)) * (float(coef) / (float(std) or 1.0)), F.lit(0.0)).alias("contribution")))
    out = df.withColumn("_parts", F.array(*parts))
    margin = F.aggregate("_parts", F.lit(float(model["intercept"])), lambda s, p: s + p["contribution"])
    out = out.withColumn("_p", 1 / (1 + F.exp(-margin)))
    told = F.filter("_parts", lambda p: p["value"].isNotNull() & (F.abs(p["contribution"]) > 1e-6))
    order = F.array_sort(F.transform(told, lambda p: F.struct((-F.abs(p["contribution"])).alias("k"), p["feature"].alias("n"), p.alias("p"))))
    top = F.transform(F.slice(order, 1, k), lambda x: x["p"])
    return out.withColumns({"probability": F.round("_p", 4), "logistic": F.bround(100 * F.col("_p"), 0).cast("int"), "logistic_parts": top}).drop("_parts", "_p")


def configured(df: DataFrame, config: Config = DEFAULT, model: dict | None = None) -> DataFrame:
    """score, decision, model, explanation and score_details by the configured scorer, from `findings` and `features`.

    Without a model, given or as a file that is there, the rules alone count.
    """
    mode = config.scoring_mode if model is not None else build_scorer(config)
    label = "logistic"
    if mode != "additive" and model is None:
        with open(config.scoring_model, encoding="utf-8") as f:
            model, label = json.load(f), f"logistic:{os.path.basename(config.scoring_model)}"
    none = F.lit(None).cast("array<struct<feature:string,value:double,contribution:double>>")
    if mode == "additive":
        return additive(df, config).withColumns({"probability": F.lit(None).cast("double"), "score_details": none})
    out = model_scores(additive(df, config).withColumnRenamed("score", "_additive"), model)
    won = F.lit(False) if mode == "logistic" else F.col("_additive") >= F.col("logistic")
    score = F.when(won, F.col("_additive")).otherwise(F.col("logistic"))
    name = F.lit(label) if mode == "logistic" else F.when(won, "additive").otherwise(F.lit(label))
    out = out.withColumns({"score": score, "model": name if mode == "logistic" else F.concat(F.lit(f"max(additive, {label}): "), name), "score_details": F.col("logistic_parts")})
    return out.withColumn("decision", decide(F.col("score"), config)).drop("_additive", "logistic", "logistic_parts")


# --- training ------------------------------------------------------------------------------------


def onehot(categories: DataFrame) -> DataFrame:
    """Long (id, feature, value) of categories with 2 to MAX_CATEGORIES values: `name=value` as 1 or 0."""
    values = categories.where(~F.col("name").isin(*HASH_FEATURES)).select("name", "value").distinct()
    gate = values.groupBy("name").agg(F.count("value").alias("n")).where((F.col("n") > 1) & (F.col("n") <= MAX_CATEGORIES)).select("name")
    wide = values.join(gate, "name").withColumnRenamed("value", "option")
    pairs = categories.join(wide, "name")
    return pairs.select("id", F.concat_ws("=", "name", "option").alias("feature"), (F.col("value") == F.col("option")).cast("double").alias("value"))


def column_stats(features: DataFrame) -> DataFrame:
    """(feature, mean, std): null-skipping mean, population deviation (mean-imputed), below 1e-9 taken as 1."""
    n = features.select("id").distinct().count()
    stats = features.groupBy("feature").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value") / F.lit(n)).alias("var"))
    std = F.sqrt("var")
    return stats.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.coalesce(std, F.lit(0.0)) < 1e-9, 1.0).otherwise(std).alias("std"))


def holdout(rows: DataFrame, share: float = 0.25, seed: int = 0) -> DataFrame:
    """`rows` with `test`: round(n * share) rows of each label, the first by a seeded hash."""
    order = W.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return rows.withColumn("test", F.row_number().over(order) <= F.bround(F.count("*").over(W.partitionBy("label")) * share, 0))


def fit_logistic(features: DataFrame, labels: DataFrame, l2: float = 1.0, steps: int = 3000, rate: float = 0.1, local_cells: int = 4_000_000) -> dict:
    """Class-weighted logistic regression by full-batch gradient descent.

    Standardising and imputing run in Spark. Below `local_cells` matrix cells
    (a checked size) the small matrix is iterated on the driver, fetched as one
    packed block a row; above, the library's distributed solver minimises the
    same function.
    """
    import numpy as np

    if labels.count() < 8 or labels.select("label").distinct().count() < 2:
        raise ValueError("training needs at least 8 rows and both labels")
    stats = column_stats(features)
    names = [(r.feature, r["mean"], r["std"]) for r in stats.orderBy("feature").collect()]
    order = [n for n, _, _ in names]
    grid = labels.select("id", "label", F.explode(_literal(names, ("feature", "mean", "std"))).alias("m")).select("id", "label", "m.*")
    cells = grid.join(features, ["id", "feature"], "left").select("id", "label", "feature", F.coalesce((F.col("value") - F.col("mean")) / F.col("std"), F.lit(0.0)).alias("x"))
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = {k: n / (2 * c) for k, c in counts.items()}
    w, b = np.zeros(len(order)), 0.0
    if n * len(order) <= local_cells:
        wide = cells.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("row"))
        packed = wide.select("id", "label", F.transform("row", lambda r: r["x"]).alias("x")).orderBy("id").toArrow()
        x = np.asarray(packed.column("x").combine_chunks().flatten()).reshape(packed.num_rows, len(order))
        y = np.asarray(packed.column("label"), float)
        s = np.where(y == 1, weight[1], weight[0])
        for _ in range(steps):
            error = s * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
            w, b = w - rate * (x.T @ error / n + l2 * w / n), b - rate * error.mean()
    else:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        # The same objective: weights add up to n, the penalty is l2 / n, and the columns are standardised already.
        share = F.when(F.col("label") == 1, weight[1]).otherwise(weight[0])
        wide = cells.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("row"))
        wide = wide.select(F.col("label").cast("double").alias("label"), share.alias("share"), array_to_vector(F.transform("row", lambda r: r["x"])).alias("x"))
        fitted = LogisticRegression(featuresCol="x", weightCol="share", regParam=l2 / n, standardization=False, maxIter=200, tol=1e-9).fit(wide)
        w, b = fitted.coefficients.toArray(), float(fitted.intercept)
    return {
        "model": "logistic", "features": order, "mean": [m for _, m, _ in names], "std": [s for _, _, s in names], "coef": w.tolist(), "intercept": float(b),
        "rows": n, "positives": counts.get(1, 0),
    }


def save_model(model: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model, f, indent=2, ensure_ascii=False)


def feature_value(name: str, values: Column) -> Column:
    """Numeric value of a model feature in a map of strings: one-hot for `name=value`, booleans as 1 and 0."""
    if "=" in name:
        base, option = name.split("=", 1)
        got = F.try_element_at(values, F.lit(base))
        return F.when(got.isNotNull(), (got == option).cast("double"))
    got = F.try_element_at(values, F.lit(name))
    return F.when(F.lower(got) == "true", 1.0).when(F.lower(got) == "false", 0.0).otherwise(got.try_cast("double"))


def report(features: DataFrame, labels: DataFrame, share: float = 0.25, seed: int = 0, cost_fn: float = 5.0, **options) -> dict:
    """A model fitted on all rows, with what one fitted on the rest reaches on held-out rows.

    `holdout` is None unless four rows or more with both labels are held out.
    `threshold` is the cheapest one on the training rows, `top` the 15 largest
    coefficients.
    """
    from . import evaluate

    def scored(model: dict, rows: DataFrame) -> DataFrame:
        table = model_table(features.sparkSession, model)
        got = logistic(contributions(rows.select("id"), features.join(rows.select("id"), "id", "left_semi"), table))
        return rows.join(got, "id").select("id", "label", F.col("score").cast("double").alias("score"))

    split = holdout(labels.select("id", "label"), share, seed)
    test, rest = split.where("test").drop("test"), split.where("NOT test").drop("test")
    counts = {(r.test, r.label): r["count"] for r in split.groupBy("test", "label").count().collect()}
    held = [counts.get((True, y), 0) for y in (0, 1)]
    out = {"holdout": None}
    if sum(held) >= 4 and min(held) > 0:
        rows = scored(fit_logistic(features.join(rest.select("id"), "id", "left_semi"), rest, **options), test)
        out["holdout"] = {"rows": sum(held), "roc_auc": evaluate.roc_auc(rows).first()[0], "pr_auc": evaluate.pr_auc(rows).first()[0]}
    model = fit_logistic(features, labels.select("id", "label"), **options)
    best = evaluate.best_threshold(scored(model, labels.select("id", "label")), cost_fn=cost_fn).first()
    ranked = sorted(zip(model["features"], model["coef"]), key=lambda x: (-abs(x[1]), x[0]))
    return model | out | {"threshold": best.threshold, "top": [{"feature": f, "coef": c} for f, c in ranked[:15]]}
