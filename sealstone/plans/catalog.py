"""The query catalogue: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import dedup, evaluate, layout, scores, workflow
from ..operators import findings as fi
from ..session import ship
from . import bindings as b

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# --- findings and scores -------------------------------------------------------------------------


@query
def findings_explode(spark, sf_dir):
    return longs(fi.explode(b.analyses(spark, sf_dir)))


@query
def additive_score(spark, sf_dir):
    return longs(b.analyses(spark, sf_dir).select("id", "score", "decision"))


@query
def decision_counts(spark, sf_dir):
    return b.analyses(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


@query
def explanation_topk(spark, sf_dir):
    top = b.analyses(spark, sf_dir).select("id", F.posexplode(F.slice("explanation", 1, 3)).alias("rank", "f"))
    return longs(top.select("id", "rank", "f.code", "f.points"))


@query
def pointed_codes(spark, sf_dir):
    codes = F.array_join(F.transform(fi.pointed(F.col("findings")), lambda f: f["code"]), ",")
    return b.analyses(spark, sf_dir).select("id", F.when(codes == "", "-").otherwise(codes).alias("codes"))


def _parts(spark, sf_dir):
    return scores.contributions(b.analyses(spark, sf_dir), b.features(spark, sf_dir), b.model(spark))


@query
def contribution_topk(spark, sf_dir):
    top = scores.top_contributions(_parts(spark, sf_dir), 2)
    return longs(top.select("id", "rank", "feature", F.round("contribution", 6).alias("contribution")))


@query
def logistic_score(spark, sf_dir):
    return longs(scores.logistic(_parts(spark, sf_dir)))


@query
def max_score(spark, sf_dir):
    return longs(scores.combined(b.analyses(spark, sf_dir), scores.logistic(_parts(spark, sf_dir))))


@query
def feature_impute(spark, sf_dir):
    return scores.column_stats(b.features(spark, sf_dir)).select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _categories(spark, sf_dir):
    rows = b.analyses(spark, sf_dir).select("id", "lang", "reference")
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("lang", "reference")))
    return rows.select("id", F.explode(pairs).alias("c")).select("id", "c.*")


@query
def category_gate(spark, sf_dir):
    return scores.onehot(_categories(spark, sf_dir)).select("feature").distinct()


@query
def onehot_matrix(spark, sf_dir):
    return scores.onehot(_categories(spark, sf_dir))


# --- workflow ------------------------------------------------------------------------------------


@query
def review_queue(spark, sf_dir):
    return longs(workflow.queue(b.analyses(spark, sf_dir), b.history(spark, sf_dir)).select("id", "reference", "score", "decision", "status", "version"))


@query
def listing_filtered(spark, sf_dir):
    return longs(workflow.listing(b.analyses(spark, sf_dir), "ATENÇÃO", "src0").select("id", "filename", "score", "decision"))


@query
def decision_floor(spark, sf_dir):
    return longs(workflow.floor(b.analyses(spark, sf_dir), "ATENÇÃO").select("id", "score", "decision"))


@query
def review_versions(spark, sf_dir):
    return b.history(spark, sf_dir).select("event_id", "analysis_id", "version", "status")


@query
def current_review(spark, sf_dir):
    return workflow.current(b.history(spark, sf_dir))


@query
def history_page(spark, sf_dir):
    return workflow.history_page(b.history(spark, sf_dir), 7, after=2, limit=20).select("analysis_id", "version", "status", "note")


@query
def optimistic_conflicts(spark, sf_dir):
    expected = F.when(F.col("note") % 4 != 3, F.col("note") % 40)
    return workflow.resolve_conflicts(b.events(spark, sf_dir).withColumn("expected_version", expected))


@query
def stats_overview(spark, sf_dir):
    return workflow.stats(b.analyses(spark, sf_dir), b.history(spark, sf_dir))


@query
def reversal_rate(spark, sf_dir):
    return workflow.reversal_rate(b.analyses(spark, sf_dir), b.history(spark, sf_dir))


@query
def labels_export(spark, sf_dir):
    return longs(workflow.labels(b.analyses(spark, sf_dir), b.history(spark, sf_dir)).select("id", "label", F.array_join("codes", ",").alias("codes")))


def _purged(spark, sf_dir):
    rows = b.analyses(spark, sf_dir)
    return workflow.purge(rows, b.history(spark, sf_dir), rows.select("id", "sha256"), F.lit(b.PURGE_AT).cast("timestamp_ntz"))


@query
def purge_survivors(spark, sf_dir):
    return _purged(spark, sf_dir)["analyses"].select("id", "reference")


@query
def purge_removed(spark, sf_dir):
    return _purged(spark, sf_dir)["removed"]


@query
def purge_history(spark, sf_dir):
    return _purged(spark, sf_dir)["history"].groupBy("analysis_id").agg(F.count("*").alias("n"))


@query
def orphan_reviews(spark, sf_dir):
    rows = b.analyses(spark, sf_dir).select(F.col("id").alias("analysis_id"))
    return b.history(spark, sf_dir).join(rows, "analysis_id", "left_anti").select("analysis_id", "version")


@query
def redacted_report(spark, sf_dir):
    rows = b.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text"), F.col("text").alias("_overlay"), "source")
    return workflow.redact(rows)


@query
def expiry_buckets(spark, sf_dir):
    day = F.date_trunc("day", "expires_at").cast("date").cast("string")
    return b.analyses(spark, sf_dir).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query
def grouping_rollup(spark, sf_dir):
    rows = b.analyses(spark, sf_dir).rollup("lang", "decision").agg(F.count("*").alias("n"), F.sum("score").alias("points"))
    return rows.select("lang", "decision", "n", "points")


# --- duplicates ----------------------------------------------------------------------------------


@query
def exact_duplicates(spark, sf_dir):
    return dedup.exact_groups(b.analyses(spark, sf_dir))


@query
def first_duplicate(spark, sf_dir):
    return dedup.first_duplicates(b.analyses(spark, sf_dir))


@query
def duplicate_top5(spark, sf_dir):
    return longs(dedup.earliest_matches(b.analyses(spark, sf_dir)))


@query
def prior_duplicates(spark, sf_dir):
    return dedup.prior_counts(b.analyses(spark, sf_dir))


@query
def hash_median(spark, sf_dir):
    return b.hashes(spark, sf_dir, "median").select("id", hashing.to_hex(F.col("h")).alias("hex"))


@query
def hash_gradient(spark, sf_dir):
    return b.hashes(spark, sf_dir, "gradient").select("id", hashing.to_hex(F.col("h")).alias("hex"))


@query
def hamming_near(spark, sf_dir):
    return dedup.near_pairs(b.shots(spark, sf_dir), list(b.WORDS), 8)


@query
def hamming_near_gradient(spark, sf_dir):
    return dedup.near_pairs(b.gradient_shots(spark, sf_dir), ["h"], 6)


@query
def hash_members(spark, sf_dir):
    return dedup.hash_members(b.shots(spark, sf_dir), list(b.WORDS))


@query
def nearest_prior(spark, sf_dir):
    return dedup.nearest_prior(b.shots(spark, sf_dir), list(b.WORDS), 8)


@query
def nearest_listed(spark, sf_dir):
    found = dedup.nearest_listed(b.hashes(spark, sf_dir, "gradient"), b.listed(spark, sf_dir), "h", 24)
    return found.select("id", hashing.to_hex(F.col("nearest_hash")).alias("nearest"), "distance", "within")


@query
def duplicate_detail(spark, sf_dir):
    found = dedup.with_duplicates(b.shots(spark, sf_dir), list(b.WORDS))
    return found.select("id", "exact_duplicate", "nearest_id", "nearest_distance", "near_duplicate")


# --- evaluation ----------------------------------------------------------------------------------


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(b.evaluation(spark, sf_dir), 15)


@query
def per_code_metrics(spark, sf_dir):
    return evaluate.per_code(b.evaluation(spark, sf_dir))


@query
def per_kind(spark, sf_dir):
    return evaluate.slices(b.evaluation(spark, sf_dir), 1, "kind", 35, 15)


@query
def per_origin(spark, sf_dir):
    return evaluate.slices(b.evaluation(spark, sf_dir), 0, "origin", 35, 15)


@query
def top_codes(spark, sf_dir):
    return evaluate.top_codes(b.evaluation(spark, sf_dir), "kind")


@query
def pr_curve(spark, sf_dir):
    return longs(evaluate.pr_curve(b.evaluation(spark, sf_dir)))


@query
def pr_auc(spark, sf_dir):
    return evaluate.pr_auc(b.evaluation(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(b.evaluation(spark, sf_dir))


@query
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(b.evaluation(spark, sf_dir))


# --- text ----------------------------------------------------------------------------------------


@query
def strip_accents_text(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("digest"))


@query
def normalize_text(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query
def normalize_code(spark, sf_dir):
    return b.read(spark, sf_dir, "customer").select("c_custkey", text.normalize_code(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("code"))


@query
def digit_runs(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.digit_runs(F.col("text")), ",").alias("runs"))


def _receipts(spark, sf_dir):
    orders = b.read(spark, sf_dir, "orders")
    date = F.date_format("o_orderdate", "dd/MM/yyyy")
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    words = F.concat(F.lit("Pedido "), F.col("o_orderkey").cast("string"), F.lit("\nData "), date, F.lit("\nValor R$ "), amount, F.lit("\nPrioridade "), F.col("o_orderpriority"))
    return orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", date.alias("date"), amount.alias("amount"), words.alias("text"))


@query
def find_dates_numeric(spark, sf_dir):
    return _receipts(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(text.find_dates(F.col("text")), lambda d: d.cast("string")), ",").alias("dates"))


@query
def find_money(spark, sf_dir):
    return _receipts(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(text.find_money(F.col("text")), lambda d: d.cast("string")), ",").alias("amounts"))


@query
def parse_money_variants(spark, sf_dir):
    c = F.col("amount")
    plain = F.regexp_replace(c, "[.]", "")
    return _receipts(spark, sf_dir).select(
        "o_orderkey", text.parse_money(c).cast("string").alias("br"), text.parse_money(F.concat(F.lit("R$ "), plain)).cast("string").alias("prefixed"),
        text.parse_money(F.translate(c, ",.", ".,")).cast("string").alias("us"), text.parse_money(F.lit("abc")).cast("string").alias("none"),
    )


@query
def infer_kind(spark, sf_dir):
    rows = [("data", "x"), ("valor total", "1"), ("nota fiscal", "12"), ("order", "1"), ("campo", "04/09/2026"), ("campo", "R$ 10,00"), ("campo", "1.250,00"),
            ("campo", "12345"), ("campo", "AB-12"), ("campo", "Maria Silva"), ("Código", "x"), ("CPF", "x")]
    df = spark.createDataFrame(rows, "name string, value string")
    return df.select("name", "value", text.infer_kind(F.col("name"), F.col("value")).alias("kind"))


@query
def digit_confusions(spark, sf_dir):
    look = F.translate(F.concat(F.lit("7"), F.col("p_partkey").cast("string"), F.lit("9")), "01", "Ol")
    return b.read(spark, sf_dir, "part").select("p_partkey", text.fix_digit_confusions(F.concat(F.lit("Pedido "), look, F.lit(" OLIVEIRA"))).alias("fixed"))


def _matches(spark, sf_dir, key):
    """Fields asked of the receipt of every order."""
    ship(spark)
    customer = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = _receipts(spark, sf_dir).join(customer, "o_custkey", "left").repartition("o_orderkey")  # one file is one task otherwise
    asked = {"pedido": F.col("o_orderkey").cast("string"), "data": F.col("date"), "valor": F.col("amount"), "destinatario": F.upper("c_name"), "data de emissao": F.lit("01/01/1901"), "codigo": F.lit("WX-98Y")}
    expected = F.create_map(*(x for k, v in asked.items() for x in (F.lit(k), v)))
    return text.match_fields(rows.select(key, expected.alias("expected"), F.concat_ws("\n", "text", "c_name").alias("body")), key, "expected", "body")


@query
def match_field(spark, sf_dir):
    """Customers by outcome, over all their orders; order numbers are in `match_field_orders`."""
    found = _matches(spark, sf_dir, "o_custkey").where("field <> 'pedido'")
    return found.groupBy("field", "kind", "matched", "conflict").agg(F.count_distinct("o_custkey").alias("n"))


@query
def match_field_orders(spark, sf_dir):
    """Orders by outcome, all fields."""
    return _matches(spark, sf_dir, "o_orderkey").groupBy("field", "kind", "matched", "conflict").agg(F.count("*").alias("n"))


# --- layout --------------------------------------------------------------------------------------


def _words(spark, sf_dir):
    return b.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("word"), F.concat(F.col("l_returnflag"), F.lit("12")).alias("text"), F.lit(90.0).alias("conf"),
        F.col("l_quantity").alias("height"), (F.col("l_extendedprice") / 1000).alias("bottom"),
    )


@query
def typography_outliers(spark, sf_dir):
    out = layout.typography(_words(spark, sf_dir))
    return longs(out.select("line", "word", F.round("height_dev", 9).alias("height_dev"), F.round("baseline_dev", 9).alias("baseline_dev")))


def _turns(spark, sf_dir, text):
    turn = F.col("turn")
    return b.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.floor(turn / 2).alias("line"), turn.alias("left"), turn.alias("top"), F.concat_ws(":", "role", text).alias("text"))


@query
def line_text(spark, sf_dir):
    """Heads of turns, as its SQL asks; `line_text_whole` has the whole texts."""
    return layout.line_text(_turns(spark, sf_dir, F.substring("text", 1, 20)))


@query
def line_text_whole(spark, sf_dir):
    return layout.line_text(_turns(spark, sf_dir, F.col("text")))


def _grid(spark, sf_dir):
    q = F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5))).alias("quality")
    rows = b.read(spark, sf_dir, "part").select(F.col("p_size").alias("image"), F.col("p_partkey").alias("block"), q)
    noise = (F.col("block") * 7919 + F.col("quality") * 104729) % 97
    dip = F.when((F.col("quality") == 70) & (F.col("block") % 5 != 0), 0.2).otherwise(1.0)
    return rows.withColumn("mse", (noise + 200) / F.lit(50.0) * dip)


@query
def ghost_dip(spark, sf_dir):
    dips = layout.ghost_dips(_grid(spark, sf_dir))
    return longs(dips.groupBy("image", "quality").agg(F.round(F.median("dip"), 6).alias("median_dip"), F.count("*").alias("n")))


@query
def ghost_candidate(spark, sf_dir):
    out = layout.ghost_candidate(_grid(spark, sf_dir))
    return longs(out.select("image", "quality", *(F.round(c, 6).alias(c) for c in ("median_dip", "mad", "threshold")), "suspicious", "blocks"))


@query
def shift_clusters(spark, sf_dir):
    pairs = b.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("image"), (F.col("l_partkey") % 200 - 100).cast("int").alias("dx"), (F.col("l_suppkey") % 200 - 100).cast("int").alias("dy"))
    return longs(layout.shift_clusters(pairs, "image"))


def _boxes(x, y, w, h):
    return F.struct(*(c.cast("int").alias(n) for n, c in zip("xywh", (x, y, w, h))))


@query
def box_iou_hit(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem")
    f = _boxes(F.col("l_partkey") % 100, F.col("l_suppkey") % 60, F.col("l_quantity") + 1, F.lit(20))
    g = _boxes(F.lit(30), F.lit(20), F.lit(40), F.lit(25))
    return rows.withColumn("hit", layout.box_hit(f, g)).groupBy("l_returnflag").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


@query
def tile_statistics(spark, sf_dir):
    """Block means, population deviations and the interpolated 95th percentile, as tiles of an image."""
    rows = b.read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("bx"), (F.col("l_suppkey") % 16).alias("by"))
    v = F.col("l_quantity")
    return rows.agg(F.round(F.avg(v * v), 4).alias("mse"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.percentile(v, F.lit(0.95)), 4).alias("p95"))
