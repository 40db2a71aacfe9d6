"""Loudness metadata: tool-log parsing, candidate selection, update."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.config import LoudnessConfig
from chartlake.functions.coerce import any_of, as_ts, strip
from chartlake.functions.scores import normalization_gain
from chartlake.functions.text import url_hash
from chartlake.operators.charts import ranked

LOG_FIELDS = {
    "integrated_lufs": "input_i",
    "true_peak_db": "input_tp",
    "loudness_input_lra": "input_lra",
    "loudness_input_thresh": "input_thresh",
    "loudness_target_offset": "target_offset",
}
LOG_BLOCK = r'(?s)\{\s*"input_i".*?\}'


def _finite(text: Column) -> Column:
    value = F.nanvl(strip(text).try_cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_loudness_log(log: Column | str) -> dict[str, Column]:
    """Numbers of the last measurement block in a tool log; null where absent."""
    blocks = F.regexp_extract_all(log, F.lit(LOG_BLOCK), F.lit(0))
    block = F.try_element_at(blocks, F.lit(-1))
    return {name: _finite(F.get_json_object(block, f"$.{field}")) for name, field in LOG_FIELDS.items()}


def needs_analysis() -> Column:
    """An audio link whose hash is new, or without a complete ok result."""
    url = strip(F.coalesce(F.col("audio_url"), F.lit("")))
    stale = any_of(
        url_hash(url) != strip(F.coalesce(F.col("loudness_audio_url_hash"), F.lit(""))),
        F.lower(strip(F.coalesce(F.col("loudness_status"), F.lit("")))) != "ok",
        F.col("integrated_lufs").isNull(),
        F.col("true_peak_db").isNull(),
        F.col("loudness_gain_db").isNull(),
    )
    return (url != "") & stale


def loudness_candidates(db: DataFrame) -> DataFrame:
    return db.where(needs_analysis())


def loudness_priority(db: DataFrame, cfg: LoudnessConfig = LoudnessConfig()) -> DataFrame:
    """Candidates to analyse next: charted ones by rank, then the newest."""
    rank = F.col("current_rank").cast("double")
    priority = F.when(rank.between(1, cfg.priority_top_n), rank).otherwise(F.lit(999999.0))
    order = [priority.asc(), F.coalesce("created_at", as_ts("1970-01-01 00:00:00")).desc(), F.col("id").asc()]
    return ranked(loudness_candidates(db), order, cfg.max_items, "analysis_position")


def loudness_update(db: DataFrame, logs: DataFrame, as_of: str, cfg: LoudnessConfig = LoudnessConfig()) -> DataFrame:
    """Write landed measurement logs (id, log, error) into the catalogue.

    A log without both level and peak counts as failed and keeps old numbers.
    """
    parsed = logs.select("id", F.col("error").alias("_error"), *[c.alias(f"_m_{n}") for n, c in parse_loudness_log("log").items()])
    out = db.join(parsed.withColumn("_seen", F.lit(True)), "id", "left")
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    ok = F.col("_m_integrated_lufs").isNotNull() & F.col("_m_true_peak_db").isNotNull()
    gain = normalization_gain(F.col("_m_integrated_lufs"), F.col("_m_true_peak_db"), cfg)
    fresh = {
        "integrated_lufs": F.round("_m_integrated_lufs", 3),
        "true_peak_db": F.round("_m_true_peak_db", 3),
        "loudness_gain_db": gain,
        "loudness_target_lufs": F.lit(cfg.target_lufs),
        "loudness_true_peak_ceiling_db": F.lit(cfg.true_peak_ceiling_db),
        "loudness_input_lra": F.col("_m_loudness_input_lra"),
        "loudness_input_thresh": F.col("_m_loudness_input_thresh"),
        "loudness_target_offset": F.col("_m_loudness_target_offset"),
    }

    def old(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in db.columns else F.lit(None).cast(kind)

    values = {n: F.when(seen & ok, c).otherwise(old(n, "double")) for n, c in fresh.items()}
    given = F.coalesce(F.nullif(F.col("_error"), F.lit("")), F.lit("no valid measurement"))
    error = F.regexp_replace(given, "\n", " ")
    values |= {
        "loudness_status": F.when(seen & ok, "ok").when(seen, "failed").otherwise(old("loudness_status", "string")),
        "loudness_error": F.when(seen & ok, "").when(seen, error).otherwise(old("loudness_error", "string")),
        "loudness_checked_at": F.when(seen, as_ts(as_of)).otherwise(old("loudness_checked_at", "timestamp_ntz")),
        "loudness_audio_url_hash": F.when(seen, url_hash(strip("audio_url"))).otherwise(
            old("loudness_audio_url_hash", "string")
        ),
    }
    return out.withColumns(values).drop("_seen", "_error", *[f"_m_{n}" for n in LOG_FIELDS])
