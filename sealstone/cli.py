"""Command line: analyze, stats, purge, evaluate, train."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import session
from .analyzer import analyse
from .config import DEFAULT, load
from .operators import evaluate, scores, workflow
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sealstone")
    p.add_argument("--master")
    p.add_argument("--config")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("analyze")
    a.add_argument("folder")
    a.add_argument("--json", help="folder for one JSON report a line")
    for verb in ("stats", "purge"):
        v = verbs.add_parser(verb)
        v.add_argument("analyses")
        v.add_argument("history")
        if verb == "purge":
            v.add_argument("out")
            v.add_argument("--now", help="timestamp, else the current one")
    e = verbs.add_parser("evaluate")
    e.add_argument("results", nargs="+")
    e.add_argument("--title", default="Evaluation")
    t = verbs.add_parser("train")
    t.add_argument("results", nargs="+")
    t.add_argument("--out", required=True)
    return p


def _results(spark, paths):
    rows = tables.results(spark, *paths)
    return rows.withColumn("id", F.xxhash64("file")).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = load(args.config) if args.config else DEFAULT
    spark = session.create(args.master)
    if args.verb == "analyze":
        out = analyse(spark, args.folder, config).persist()
        for r in out.orderBy("path").select(tables.console_row().alias("row")).toLocalIterator():
            print(r.row)
        if args.json:
            tables.write_lines(out, args.json)
        out.unpersist()
    elif args.verb == "stats":
        rows, history = spark.read.parquet(args.analyses), spark.read.parquet(args.history)
        print(json.dumps(workflow.stats(rows, history).first().asDict() | {"reversal_rate": workflow.reversal_rate(rows, history).first().rate}))
    elif args.verb == "purge":
        rows, history = spark.read.parquet(args.analyses), spark.read.parquet(args.history)
        now = F.lit(args.now).cast("timestamp") if args.now else F.current_timestamp()
        out = workflow.purge(rows, history, rows.select("id"), now)
        for name in ("analyses", "history"):
            out[name].write.mode("overwrite").parquet(f"{args.out}/{name}")
        print(json.dumps({"removed": out["removed"].count(), "remaining": spark.read.parquet(f"{args.out}/analyses").count()}))
    elif args.verb == "evaluate":
        print(evaluate.markdown(_results(spark, args.results), config.review_threshold, config.attention_threshold, args.title))
    else:
        rows = _results(spark, args.results)
        pairs = rows.select("id", F.explode("features").alias("feature", "raw"))
        number = F.when(F.lower("raw") == "true", 1.0).when(F.lower("raw") == "false", 0.0).otherwise(F.col("raw").try_cast("double"))
        numeric = pairs.select("id", "feature", number.alias("value")).where("value IS NOT NULL")
        texts = pairs.where(number.isNull()).select("id", F.col("feature").alias("name"), F.col("raw").alias("value"))
        model = scores.report(numeric.unionByName(scores.onehot(texts)), rows.select("id", "label"))
        scores.save_model(model, args.out)
        print(json.dumps({"features": len(model["features"]), **{k: model[k] for k in ("rows", "positives", "holdout", "threshold", "top")}}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
