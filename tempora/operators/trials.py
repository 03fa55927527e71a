"""The trial log: an append-only table of Sharpe estimates and their variance per family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("dataset_fingerprint", "strategy_family")


def validate_trials(trials: DataFrame) -> DataFrame:
    """Trials with metadata as JSON and a status; only `ok` rows may be recorded."""

    def finite(name: str):
        v = F.col(name).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    status = (
        F.when(F.coalesce("dataset_fingerprint", F.lit("")) == "", "no_fingerprint")
        .when(F.coalesce("strategy_family", F.lit("")) == "", "no_family")
        .when(~(finite("sr_hat") & finite("gamma_3") & finite("gamma_4")), "not_finite")
        .when(F.col("t_observations").isNull() | (F.col("t_observations") < 2), "too_short")
        .otherwise("ok")
    )
    kind = trials.schema["metadata"].dataType.typeName() if "metadata" in trials.columns else "string"
    json = F.col("metadata_json") if "metadata_json" in trials.columns else (
        F.to_json("metadata") if kind in ("struct", "map", "array") else F.col("metadata")
    )
    return trials.select(*KEYS, "sr_hat", "t_observations", "gamma_3", "gamma_4", json.alias("metadata_json"), status.alias("status"))


def record_trials(trials: DataFrame, path: str, quarantine: str | None = None) -> None:
    """Appends the valid trials to the log, and the others to a quarantine folder.

    Files are added, never rewritten, so concurrent writers do not disturb each other.
    """
    checked = validate_trials(trials).withColumn("recorded_at", F.current_timestamp())
    checked.filter(F.col("status") == "ok").drop("status").write.mode("append").parquet(path)
    if quarantine is not None:
        checked.filter(F.col("status") != "ok").write.mode("append").parquet(quarantine)


def trial_variance(trials: DataFrame, *, declared_n: int | None = None, families: DataFrame | None = None) -> DataFrame:
    """(keys, n_recorded, n_trials, v_sr, status) per fingerprint and family.

    The number of trials is declared, not counted; without a declaration the count
    stands in.  One recorded trial has variance 0 if one was declared and is an error
    otherwise; a requested family without trials is an error.
    """
    if declared_n is not None and declared_n < 1:
        raise ValueError(f"declared_n must be >= 1, got {declared_n}")
    agg = trials.groupBy(*KEYS).agg(F.count("sr_hat").alias("n_recorded"), F.var_samp("sr_hat").alias("__v"))
    if families is not None:
        agg = families.select(*KEYS).distinct().join(agg, list(KEYS), "left")
    n = F.coalesce("n_recorded", F.lit(0))
    declared = F.lit(declared_n) if declared_n is not None else n
    status = F.when(n == 0, "no_trials").when((n == 1) & (declared != 1), "single_trial").otherwise("ok")
    v = F.when(status == "ok", F.when(n == 1, 0.0).otherwise(F.col("__v")))
    return agg.select(*KEYS, n.alias("n_recorded"), declared.cast("long").alias("n_trials"), v.alias("v_sr"), status.alias("status"))
