"""Review workflow over an append-only event log: state, queue, statistics, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DECISIONS, FRAUD, LEGITIMATE, PENDING, REVIEW, STATUSES
from ..session import ship
from .findings import rank_of

LABELS = {FRAUD: 1, LEGITIMATE: 0}


def versions(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events with `version` = 1, 2, ... within each analysis, in order."""
    return events.withColumn("version", F.row_number().over(W.partitionBy("analysis_id").orderBy(*order)).cast("long"))


def current(history: DataFrame) -> DataFrame:
    """The latest event of each analysis; a `pending` event reopens it."""
    last = history.groupBy("analysis_id").agg(F.max_by(F.struct("status", "note", "version"), "version").alias("e"))
    return last.select("analysis_id", "e.*")


def with_status(analyses: DataFrame, history: DataFrame) -> DataFrame:
    """Analyses with their review state; unreviewed ones are pending at version 0."""
    state = current(history).select(F.col("analysis_id").alias("id"), "status", "version")
    joined = analyses.join(state, "id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit(PENDING))).withColumn("version", F.coalesce("version", F.lit(0)))


def listing(analyses: DataFrame, decision: str | None = None, reference: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    out = analyses
    if decision is not None:
        out = out.where(F.col("decision") == decision)
    if reference is not None:
        out = out.where(F.col("reference") == reference)
    return out.orderBy(F.desc("id")).limit(limit)


def floor(analyses: DataFrame, least: str) -> DataFrame:
    if least not in DECISIONS:
        raise ValueError(f"unknown decision {least}")
    return analyses.where(rank_of(F.col("decision")) >= DECISIONS.index(least))


def queue(analyses: DataFrame, history: DataFrame, least: str = "ATENÇÃO", limit: int = 50) -> DataFrame:
    """Pending analyses of at least a decision, highest score first, then oldest id."""
    waiting = with_status(floor(analyses, least), history).where(F.col("status") == PENDING)
    return waiting.orderBy(F.desc("score"), "id").limit(max(0, limit))


def history_page(history: DataFrame, analysis_id: int, after: int = 0, limit: int = 50) -> DataFrame:
    """Keyset page of one analysis' events, by version."""
    if not 1 <= limit <= 500 or after < 0:
        raise ValueError("limit must be from 1 to 500, after not negative")
    return history.where((F.col("analysis_id") == analysis_id) & (F.col("version") > after)).orderBy("version").limit(limit)


def _accept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold over rows sorted by analysis and arrival; the state is one count, carried across batches."""
    analysis, done = None, 0
    for rows in frames:
        accepted = []
        for a, expected in zip(rows["analysis_id"], rows["expected_version"]):
            if a != analysis:
                analysis, done = a, 0
            ok = pd.isna(expected) or int(expected) == done
            done += ok
            accepted.append(done if ok else None)
        yield rows.assign(version=pd.array(accepted, dtype="Int64"), accepted=[v is not None for v in accepted])


def resolve_conflicts(candidates: DataFrame) -> DataFrame:
    """Optimistic concurrency for a batch of candidate events.

    An event is accepted if it expects no version or just the number accepted
    before it in its analysis; others conflict. Rows stream sorted through each
    task and a single counter is kept, whatever an analysis' size.
    """
    ship(candidates.sparkSession)
    rows = candidates.select("analysis_id", "event_id", "ts", "expected_version")
    ordered = rows.repartition("analysis_id").sortWithinPartitions("analysis_id", "ts", "event_id")
    schema = "analysis_id bigint, event_id bigint, expected_version bigint, version bigint, accepted boolean"
    return ordered.drop("ts").mapInPandas(_accept, schema)


def validate_event(status: Column, version: Column) -> Column:
    """Null where an event is well formed, else the reason."""
    return F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "unknown status").when(version < 0, "negative version")


def stats(analyses: DataFrame, history: DataFrame) -> DataFrame:
    """One row: analyses, reviewed, confirmed, counts by decision and by status."""
    rows = with_status(analyses, history)
    count = lambda c, v: F.count_if(F.col(c) == v)
    return rows.agg(
        F.count("*").alias("analyses"), F.count_if(F.col("status") != PENDING).alias("reviewed"), count("status", FRAUD).alias("confirmed"),
        *(count("decision", d).alias(f"decision_{i}") for i, d in enumerate(DECISIONS)), *(count("status", s).alias(f"status_{s}") for s in STATUSES),
    )


def reversal_rate(analyses: DataFrame, history: DataFrame) -> DataFrame:
    """Share of `REVISAR` analyses found legitimate among those decided either way; null if none, 4 dp."""
    rows = with_status(analyses, history).where(F.col("decision") == REVIEW)
    legit, fraud = F.count_if(F.col("status") == LEGITIMATE), F.count_if(F.col("status") == FRAUD)
    return rows.agg(legit.alias("legitimate"), fraud.alias("confirmed"), F.round(F.try_divide(legit, legit + fraud), 4).alias("rate"))


def labels(analyses: DataFrame, history: DataFrame) -> DataFrame:
    """Training rows of analyses with a final status; inconclusive ones are none."""
    rows = with_status(analyses, history).where(F.col("status").isin(*LABELS))
    return rows.select("id", F.when(F.col("status") == FRAUD, 1).otherwise(0).alias("label"), F.transform("findings", lambda f: f["code"]).alias("codes"))


def expired(analyses: DataFrame, now: Column) -> DataFrame:
    return analyses.where(F.col("expires_at") <= now)


def purge(analyses: DataFrame, history: DataFrame, hashes: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Tables after retention: expired analyses and their events go, hashes stay."""
    gone = expired(analyses, now).select("id")
    return {
        "analyses": analyses.join(gone, "id", "left_anti"),
        "history": history.join(gone, history.analysis_id == gone.id, "left_anti"),
        "hashes": hashes,
        "removed": gone,
    }


def migrate_legacy(history: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds a `legacy_snapshot` event for reviews from before the log; running it again adds nothing."""
    old = reviews.where(F.col("status") != PENDING).join(history, "analysis_id", "left_anti")
    snapshot = old.select("analysis_id", F.lit(1).cast("long").alias("version"), "status", "note", F.lit("legacy_snapshot").alias("source"))
    return history.unionByName(snapshot, allowMissingColumns=True)


def redact(reports: DataFrame, keep_text: bool = False) -> DataFrame:
    """Reports without overlay columns and, unless kept, with recognised text blanked."""
    out = reports.drop(*(c for c in reports.columns if c.startswith("_")))
    if not keep_text and "ocr_text" in out.columns:
        out = out.withColumn("ocr_text", F.lit(""))
    if not keep_text and "ocr_words" in out.columns:
        out = out.withColumn("ocr_words", F.slice("ocr_words", 1, 0))
    return out


def authorise(requests: DataFrame, credentials: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Status 200, 401 or 403 of (request_id, token, route) requests against (token_sha256, subject, role) rows."""
    known = requests.withColumn("token_sha256", F.sha2("token", 256)).join(credentials, "token_sha256", "left")
    may = F.lit(False)
    for route, roles in allowed.items():
        may = may | ((F.col("route") == route) & F.col("role").isin(*roles))
    code = F.when(F.col("role").isNull(), 401).when(may, 200).otherwise(403)
    return known.select("request_id", "route", "subject", "role", code.alias("status"))
