"""Layout operators: lines of words, typography, boxes, shifts, recompression dips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Lower case letters below the base line, and up to capital height.
DESCENDERS = "gjpqy"
ASCENDERS = "bdfhklt"


def comparable(text: Column) -> Column:
    """Words whose box runs from the base line to capital height: two alphanumerics at least, and
    no lower case at all, or no descender and an ascender, capital or digit."""
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 2
    lower = text.rlike(r"\p{Ll}")
    return alnum & (~lower | (~text.rlike(f"[{DESCENDERS}]") & text.rlike(rf"[{ASCENDERS}]|\p{{Lu}}|\p{{Nd}}")))


def typography(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Words (line, text, conf, height, bottom, ...) that stand out of their line.

    Deviations are from the line's medians, in line heights. Lines of under
    three usable words, or in which most words deviate, prove nothing.
    """
    usable = words.where((F.col("conf") >= config.typography_min_conf) & comparable(F.col("text")))
    medians = usable.groupBy("line").agg(F.median("height").alias("mh"), F.median("bottom").alias("mb"), F.count("*").alias("n")).where("n >= 3 AND mh > 0")
    measured = usable.join(medians, "line").withColumn("height_dev", (F.col("height") - F.col("mh")) / F.col("mh")).withColumn("baseline_dev", (F.col("bottom") - F.col("mb")) / F.col("mh"))
    out = (F.abs("height_dev") >= config.typography_height_tol) | (F.abs("baseline_dev") >= config.typography_baseline_tol)
    marked = measured.withColumn("out", out)
    counts = marked.groupBy("line").agg(F.count_if("out").alias("outliers"))
    return marked.where("out").join(counts, "line").where(F.col("outliers") <= F.col("n") / 2)


def line_text(words: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text): words joined by left edge within lines, lines by their least top, then least left."""
    lines = words.groupBy(doc, "line").agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("w"), F.min("top").alias("top"), F.min("left").alias("left"))
    joined = lines.select(doc, "top", "left", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("t"))
    listed = joined.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("top", "left", "line", "t"))).alias("l"))
    return listed.select(doc, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def box_hit(finding: Column, label: Column) -> Column:
    """Centre of the finding's box inside the labelled box, or intersection over union of 0.2 at least."""
    f, g = finding, label
    cx, cy = f["x"] + f["w"] / 2, f["y"] + f["h"] / 2
    centre = cx.between(g["x"], g["x"] + g["w"]) & cy.between(g["y"], g["y"] + g["h"])
    wide = F.greatest(F.lit(0), F.least(f["x"] + f["w"], g["x"] + g["w"]) - F.greatest(f["x"], g["x"]))
    high = F.greatest(F.lit(0), F.least(f["y"] + f["h"], g["y"] + g["h"]) - F.greatest(f["y"], g["y"]))
    both = wide * high
    union = f["w"] * f["h"] + g["w"] * g["h"] - both
    return centre | F.coalesce(F.try_divide(both, union) >= 0.2, F.lit(False))


def localized(findings: Column, region: Column) -> Column:
    """Whether any finding's region hits the label; null without a label."""
    return F.when(region.isNotNull(), F.exists(findings, lambda f: F.coalesce(box_hit(f["region"], region), F.lit(False))))


def shift_clusters(pairs: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """Counts of shift vectors (dx, dy) in bins of the tolerance, each with its neighbours' counts added.

    A vector and its mirror are one direction. Order-free: bins stand in for
    clusters that would depend on the order of arrival.
    """
    t = config.copy_shift_tolerance
    flip = (F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0))
    one = pairs.select(key, F.when(flip, -F.col("dx")).otherwise(F.col("dx")).alias("dx"), F.when(flip, -F.col("dy")).otherwise(F.col("dy")).alias("dy"))
    long_ = one.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") >= config.copy_min_shift**2)
    bins = long_.groupBy(key, F.floor(F.col("dx") / t).alias("bx"), F.floor(F.col("dy") / t).alias("by")).agg(F.count("*").alias("n"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("o")
    spread = bins.select(key, "bx", "by", "n", around).select(key, (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), "n")
    sums = spread.groupBy(key, "bx", "by").agg(F.sum("n").alias("support"))
    return bins.join(sums, [key, "bx", "by"]).where(F.col("support") >= config.copy_min_matches)


#: Added to an error before dividing by it; the median error under which a quality shows the current save, not an earlier one; how close to the last save is too close.
DIP_EPS, LEAST_ERROR, LAST_SAVE = 0.05, 0.02, 3


def dip(below, own, above, eps: float = DIP_EPS):
    """How far an error lies under the mean of its neighbours, relative to itself. Of columns, numbers or arrays."""
    return ((below + above) / 2 - own) / (own + eps)


def dip_limits(median, mad, config: Config = DEFAULT) -> tuple:
    """The two limits of which a suspicious block's dip is under both: a share of the median, and its usual spread below it."""
    return config.ghost_ratio * median, median - config.ghost_mad_k * 1.4826 * mad


def _with_dips(errors: DataFrame, eps: float = DIP_EPS) -> DataFrame:
    """`errors` with `dip`, which is null at the outer qualities."""
    w = W.partitionBy("image", "block").orderBy("quality")
    return errors.withColumn("dip", dip(F.lag("mse").over(w), F.col("mse"), F.lead("mse").over(w), eps))


def ghost_dips(errors: DataFrame, eps: float = DIP_EPS) -> DataFrame:
    """(image, block, quality, dip): how far a block's error lies under its neighbours' at inner qualities."""
    return _with_dips(errors, eps).where(F.col("dip").isNotNull()).select("image", "block", "quality", "dip")


def ghost_candidate(errors: DataFrame, last_quality: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """(image, quality, median_dip, mad, threshold, suspicious, blocks): the best inner quality and its robust threshold.

    Qualities close to the last save, or with almost no error, aren't ghosts.
    Blocks only ever stream past the images' values: the hints keep the planner,
    whose estimates don't count what an explode adds, from broadcasting blocks.
    """
    dips = _with_dips(errors).select("image", "quality", "mse", "dip")
    medians = dips.groupBy("image", "quality").agg(F.median("mse").alias("m"), F.median("dip").alias("median_dip")).where((F.col("m") >= LEAST_ERROR) & F.col("median_dip").isNotNull())
    if last_quality is not None:
        medians = medians.where(F.abs(F.col("quality") - last_quality) >= LAST_SAVE)
    best = medians.groupBy("image").agg(F.max_by(F.struct("quality", "median_dip"), F.struct("median_dip", -F.col("quality"))).alias("b")).select("image", "b.*")
    chosen = dips.where(F.col("dip").isNotNull()).select("image", "quality", "dip").join(best.hint("shuffle_hash"), ["image", "quality"])
    mad = chosen.groupBy("image", "quality", "median_dip").agg(F.median(F.abs(F.col("dip") - F.col("median_dip"))).alias("mad"), F.count("*").alias("blocks"))
    limit = mad.withColumn("threshold", F.least(*dip_limits(F.col("median_dip"), F.col("mad"), config))).drop("median_dip")
    judged = chosen.join(limit.hint("shuffle_hash"), ["image", "quality"])
    out = ["image", "quality", "median_dip", "mad", "threshold"]
    return judged.groupBy(*out, "blocks").agg(F.count_if(F.col("dip") < F.col("threshold")).alias("suspicious")).select(*out, "suspicious", "blocks")
