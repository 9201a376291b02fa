"""Findings as data: a rule is (code, points, severity, predicate); all rules are one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LOW, REVIEW, WARN, Config

FINDING = "struct<code:string,label:string,points:int,evidence:string,severity:string,region:struct<x:int,y:int,w:int,h:int>>"


@dataclass(frozen=True)
class Rule:
    code: str
    points: int
    severity: str
    when: Column
    evidence: Column | None = None
    label: str | None = None
    region: Column | None = None

    def finding(self) -> Column:
        region = self.region if self.region is not None else F.lit(None)
        evidence = self.evidence if self.evidence is not None else F.lit("")
        made = F.struct(
            F.lit(self.code).alias("code"), F.lit(self.label or self.code).alias("label"), F.lit(self.points).alias("points"),
            evidence.cast("string").alias("evidence"), F.lit(self.severity).alias("severity"), region.alias("region"),
        )
        return F.when(F.coalesce(self.when, F.lit(False)), made.cast(FINDING))


def apply_rules(rules: list[Rule]) -> Column:
    """Array of the findings of the rules that fire, in their order."""
    return F.filter(F.array(*(r.finding() for r in rules)), lambda x: x.isNotNull())


def explode(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key, F.posexplode("findings").alias("pos", "f")).select(key, "pos", "f.code", "f.points", "f.severity")


def additive_score(findings: Column) -> Column:
    total = F.aggregate(findings, F.lit(0), lambda s, f: s + f["points"])
    return F.least(F.lit(100), F.greatest(F.lit(0), total))


def decide(score: Column, config: Config = DEFAULT) -> Column:
    return F.when(score >= config.review_threshold, REVIEW).when(score >= config.attention_threshold, WARN).otherwise(LOW)


def rank_of(decision: Column) -> Column:
    return F.when(decision == REVIEW, 2).when(decision == WARN, 1).when(decision == LOW, 0)


def explanation(findings: Column) -> Column:
    """Findings by points, most first; equal ones in rule order."""
    order = F.transform(findings, lambda f, i: F.struct((-f["points"]).alias("k"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(order), lambda x: x["f"])


def pointed(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["points"] != 0)


def image_rules(config: Config = DEFAULT) -> list[Rule]:
    """The full rule table over the columns that the image operators make (see `imaging.features`)."""
    c = F.col
    jpeg = c("format") == "jpeg"
    ela = F.format_string("Erro médio %.2f; percentil 95 %.2f.", c("ela_mean"), c("ela_p95"))
    save = F.format_string("Qualidade anterior %d; cobertura %.2f.", c("ghost_quality"), c("ghost_coverage"))
    return [
        Rule("blur", 10, "baixo", c("blur_variance") < config.blur_warn_variance, F.format_string("Variância do Laplaciano: %.2f.", c("blur_variance"))),
        Rule("resolution", 8, "baixo", (c("width") < config.min_width) | (c("height") < config.min_height), F.format_string("%dx%d pixels.", c("width"), c("height"))),
        Rule("editing_software", 25, "alto", c("software_kind") == "editor", c("software")),
        Rule("unknown_software", 6, "baixo", c("software_kind") == "unknown", c("software")),
        Rule("no_exif", 5, "baixo", jpeg & (c("exif_tags") == 0)),
        Rule("nonstandard_quantization", 4, "baixo", jpeg & ~c("jpeg_standard_tables")),
        Rule("exif_date_mismatch", 20, "médio", c("capture_gap_days") > config.exif_date_tolerance_days, F.format_string("Captura a %d dia(s) da data esperada.", c("capture_gap_days"))),
        Rule("exif_date_future", 10, "baixo", c("capture_future")),
        Rule("exif_modified_later", 10, "baixo", c("modified_after_capture_minutes") > config.exif_modified_gap_minutes, F.format_string("Gravado %.1f minutos depois da captura.", c("modified_after_capture_minutes"))),
        Rule("ela_high", 30, "alto", c("ela_mean") >= config.ela_high, ela),
        Rule("ela_warn", 15, "médio", (c("ela_mean") >= config.ela_warn) & (c("ela_mean") < config.ela_high), ela),
        Rule("ghost_local", 30, "alto", (F.size("ghost_regions") > 0) & (c("ghost_coverage") <= config.ghost_max_coverage), save, region=F.get("ghost_regions", F.lit(0))),
        Rule("ghost_global", 8, "baixo", (F.size("ghost_regions") > 0) & (c("ghost_coverage") > config.ghost_max_coverage), save),
        Rule("copy_move", 30, "alto", c("copy_move_region").isNotNull(), region=c("copy_move_region")),
        Rule("exact_duplicate", 45, "alto", c("exact_duplicate")),
        Rule("near_duplicate", 35, "alto", ~c("exact_duplicate") & (c("nearest_distance") <= config.max_phash), F.format_string("Distância perceptual %d.", c("nearest_distance"))),
    ]


def field_finding(match: Column, seen_only: bool = False) -> Column:
    """Finding of one checked field, a struct as `text.match_fields` makes it (with `value`, what was expected); null if it matched.

    A conflicting value counts more than one that is not there. With `seen_only`
    the body is a value read for this very field, so any mismatch is a conflict
    and an empty body none.
    """
    conflict = F.lit(True) if seen_only else match["conflict"]
    prefix = "vlm_field_" if seen_only else "field_"
    made = F.struct(
        F.concat(F.lit(prefix), match["field"]).alias("code"),
        F.concat(F.when(conflict, "Campo divergente: ").otherwise("Campo esperado não localizado: "), match["field"]).alias("label"),
        F.when(conflict, 18).otherwise(8).alias("points"),
        F.when(conflict, F.format_string("Esperado '%s'; lido '%s' (%s).", match["value"], F.coalesce(match["found"], F.lit("")), match["kind"]))
        .otherwise(F.format_string("'%s' não foi encontrado; melhor semelhança %.0f%%.", match["value"], match["score"])).alias("evidence"),
        F.when(conflict, "alto").otherwise("baixo").alias("severity"), F.lit(None).alias("region"),
    )
    return F.when(~match["matched"], made.cast(FINDING))


def ocr_rules(config: Config = DEFAULT) -> list[Rule]:
    c = F.col
    return [
        Rule("ocr_unavailable", 0, "baixo", c("ocr_warning").isNotNull(), c("ocr_warning")),
        Rule("ocr_empty", 5, "baixo", c("ocr_warning").isNull() & (F.length(F.coalesce(c("ocr_text"), F.lit(""))) < config.ocr_min_chars)),
    ]


def typography_rules(config: Config = DEFAULT) -> list[Rule]:
    evidence = F.format_string("%d palavra(s) fora do padrão da linha; maior desvio %.2f.", F.col("typography_outliers"), F.col("typography_max_dev"))
    return [Rule("typography_inconsistent", 10, "médio", F.col("typography_outliers") >= 1, evidence, region=F.col("typography_worst"))]


def deep_rules(config: Config = DEFAULT) -> list[Rule]:
    score, region = F.col("deep_score"), F.get("deep_regions", F.lit(0))
    evidence = F.format_string("Probabilidade de manipulação: %.2f.", score)
    return [
        Rule("deep_manipulation", 30, "alto", score >= config.deep_high, evidence, region=region),
        Rule("deep_suspect", 12, "médio", (score >= config.deep_warn) & (score < config.deep_high), evidence, region=region),
    ]


def vlm_rules(config: Config = DEFAULT) -> tuple[list[Rule], list[Rule]]:
    """Rules before and after the findings of the fields that a vision model read; its columns are null where it is off."""
    signs = F.filter("vlm_edit_signs", lambda s: F.trim(s) != "")
    return [Rule("vlm_unavailable", 0, "baixo", F.col("vlm_error").isNotNull(), F.col("vlm_error"))], [
        Rule("vlm_edit_signs", 12, "médio", F.size(signs) > 0, F.array_join(F.slice(signs, 1, 4), "; ")),
        Rule("vlm_no_signature", 5, "baixo", F.lit(config.vlm_require_signature) & ~F.col("vlm_has_signature")),
    ]
