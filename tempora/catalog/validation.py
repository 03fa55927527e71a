"""Registered queries: cross-validation splits, paths and the trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import math_sql as X
from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.operators import crossval as CV
from tempora.operators import trials as T

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = "", digits: int = 6):
    def add(fn):
        fn.digits = digits
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns, digits) if columns else with_views(sql)
        return fn

    return add


def folds_sql(k: int) -> str:
    return f"""(SELECT dt, label_end, CAST(row_number() OVER (ORDER BY dt) - 1 AS BIGINT) AS obs_idx, count(*) OVER () AS n_obs, ntile({k}) OVER (ORDER BY dt) - 1 AS fold FROM observations)"""


@query("contiguous_folds", f"SELECT * FROM {folds_sql(7)}", "dt:d label_end:d obs_idx n_obs fold:i")
def _(v):
    return CV.contiguous_folds(v.observations, 7)


def splits_sql(k: int, combos: list[tuple[int, ...]], pct: float) -> str:
    cells = ", ".join(f"({i}, {g})" for i, c in enumerate(combos) for g in c)
    return f"""WITH o AS MATERIALIZED (SELECT * FROM {folds_sql(k)}),
    b AS (SELECT fold, min(dt) AS lo, max(dt) AS hi, max(obs_idx) AS last FROM o GROUP BY 1),
    c AS (SELECT * FROM (VALUES {cells}) x(split_id, grp))
    SELECT c.split_id, o.obs_idx, o.dt, CASE WHEN bool_or(o.fold = c.grp) THEN 'test' WHEN bool_or(o.dt <= b.hi AND o.label_end >= b.lo) THEN 'purged'
      WHEN bool_or(o.obs_idx > b.last AND o.obs_idx <= b.last + floor(n_obs * {pct}e0)) THEN 'embargo' ELSE 'train' END AS role
    FROM o CROSS JOIN c JOIN b ON b.fold = c.grp GROUP BY 1, 2, 3"""


@query("purged_kfold", splits_sql(5, [(i,) for i in range(5)], 0.01), "split_id:i obs_idx dt:d role")
def _(v):
    return CV.purged_kfold(v.observations, k=5, embargo_pct=0.01)


_PER = """WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY dt) - 1 AS BIGINT) AS obs_idx, count(*) OVER (PARTITION BY asset_id) AS n_obs,
      ntile(4) OVER (PARTITION BY asset_id ORDER BY dt) - 1 AS fold FROM (SELECT asset_id, dt, dt + 12 AS label_end FROM bars)),
    b AS (SELECT asset_id, fold, min(dt) AS lo, max(dt) AS hi, max(obs_idx) AS last FROM o GROUP BY 1, 2)
    SELECT o.asset_id, b.fold AS split_id, o.obs_idx, o.dt, CASE WHEN o.fold = b.fold THEN 'test' WHEN o.dt <= b.hi AND o.label_end >= b.lo THEN 'purged'
      WHEN o.obs_idx > b.last AND o.obs_idx <= b.last + floor(n_obs * 0.02e0) THEN 'embargo' ELSE 'train' END AS role
    FROM o JOIN b ON b.asset_id = o.asset_id"""


@query("purged_kfold_per_asset", _PER, "asset_id split_id:i obs_idx dt:d role")
def _(v):
    obs = v.bars.select("asset_id", "dt", F.date_add("dt", 12).alias("label_end"))
    return CV.purged_kfold(obs, k=4, embargo_pct=0.02, keys=["asset_id"])


@query(
    "purge_and_embargo_counts",
    f"SELECT split_id, role, count(*) AS n FROM ({splits_sql(5, [(i,) for i in range(5)], 0.05)}) GROUP BY 1, 2",
    "split_id:i role n",
)
def _(v):
    return CV.purged_kfold(v.observations, k=5).groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "walk_forward",
    """SELECT dt, CASE WHEN dt < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS role FROM observations WHERE dt < DATE '1999-01-01' OR dt >= DATE '1999-02-01'""",
    "dt:d role",
)
def _(v):
    return CV.walk_forward(v.observations, train_end="1999-01-01", test_start="1999-02-01")


@query("cpcv_splits", splits_sql(6, CV.combinations(6, 2), 0.01), "split_id:i obs_idx dt:d role")
def _(v):
    return CV.cpcv_splits(v.observations, n_groups=6, k_test=2, embargo_pct=0.01)


PATHS_SQL = "(SELECT row_number() OVER (PARTITION BY grp ORDER BY split_id) - 1 AS path, grp, split_id FROM (VALUES {cells}) x(split_id, grp))".format(
    cells=", ".join(f"({i}, {g})" for i, c in enumerate(CV.combinations(6, 2)) for g in c)
)


@query(
    "cpcv_paths",
    f"SELECT p.path, p.split_id, o.fold, count(*) AS n_obs, min(dt) AS first_dt FROM {PATHS_SQL} p JOIN {folds_sql(6)} o ON o.fold = p.grp GROUP BY 1, 2, 3",
    "path:i split_id:i fold:i n_obs first_dt:d",
)
def _(v):
    folds = CV.contiguous_folds(v.observations, 6)
    paths = CV.cpcv_paths(v.spark, 6, 2).withColumnRenamed("group", "fold")
    return folds.join(paths, "fold").groupBy("path", "split_id", "fold").agg(F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"))


@query(
    "dq_cv_inputs",
    """SELECT asset_id, problem FROM (SELECT asset_id, unnest([CASE WHEN count(*) FILTER (WHERE label_end IS NULL) > 0 THEN 'null_label_end' END,
        CASE WHEN count(*) FILTER (WHERE label_end < dt) > 0 THEN 'horizon_before_dt' END, CASE WHEN count(DISTINCT dt) < count(dt) THEN 'repeated_dt' END, CASE WHEN count(*) < 150 THEN 'too_few' END]) AS problem
      FROM (SELECT asset_id, calendardate AS dt, datekey - 50 AS label_end FROM filings) GROUP BY 1) WHERE problem IS NOT NULL""",
)
def _(v):
    obs = v.filings.select("asset_id", F.col("calendardate").alias("dt"), F.date_sub("datekey", 50).alias("label_end"))
    return CV.dq_cv_inputs(obs, groups=150, keys=["asset_id"])


@query(
    "dq_path_partition",
    f"""SELECT p.path, p.grp AS "group", 'missing' AS problem FROM {PATHS_SQL} p WHERE p.grp IN (SELECT fold FROM {folds_sql(6)} WHERE dt = (SELECT max(dt) FROM observations))""",
    'path:i "group":i problem',
)
def _(v):
    """Paths that lack the group of the newest observation."""
    newest = v.observations.agg(F.max("dt")).scalar()
    last = CV.contiguous_folds(v.observations, 6).filter(F.col("dt") == newest).select(F.col("fold").alias("group"))
    paths = CV.cpcv_paths(v.spark, 6, 2)
    return CV.dq_path_partition(paths.join(last, "group", "left_anti"), CV.split_groups(v.spark, 6, 2), 6)


STITCH = f"""WITH f AS MATERIALIZED (SELECT fold, min(dt) AS lo, max(dt) AS hi FROM {folds_sql(6)} GROUP BY 1),
  s AS MATERIALIZED (SELECT c.curve_id, f.fold AS grp, c.dt, c.nav FROM asset_curves c JOIN f ON c.dt BETWEEN f.lo AND f.hi),
  g AS (SELECT curve_id, grp, arg_min(nav, dt) AS first, arg_max(nav, dt) / arg_min(nav, dt) AS growth FROM s GROUP BY 1, 2),
  l AS (SELECT *, coalesce(product(growth) OVER (PARTITION BY curve_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e0) AS lvl FROM g),
  st AS MATERIALIZED (SELECT s.curve_id, p.path, s.grp, s.dt, s.nav / l.first * l.lvl * 100e0 AS nav FROM s JOIN l ON l.curve_id = s.curve_id AND l.grp = s.grp JOIN {PATHS_SQL} p ON p.grp = s.grp)"""


def paths_of(v):
    return CV.contiguous_folds(v.observations, 6), CV.cpcv_paths(v.spark, 6, 2)


@query("stitch_paths", f'{STITCH} SELECT curve_id, path, grp AS "group", dt, nav FROM st', 'curve_id path:i "group":i dt:d nav:f', 10)
def _(v):
    folds, paths = paths_of(v)
    return CV.stitch_paths(CV.segments_of(v.asset_curves, folds), paths, capital=100.0)


@query(
    "dq_stitch",
    """SELECT curve_id, y AS "group" FROM (SELECT curve_id, y, lo, lag(hi) OVER (PARTITION BY curve_id ORDER BY y) AS before FROM (
       SELECT curve_id, y, min(dt) AS lo, max(dt) AS hi FROM (SELECT curve_id, year(dt) AS y, dt FROM asset_curves
         UNION ALL SELECT curve_id, year(dt) + 1, dt FROM asset_curves WHERE curve_id % 3 = 0 AND month(dt) = 12) GROUP BY 1, 2)) WHERE lo <= before""",
    'curve_id "group":i',
)
def _(v):
    """Yearly segments, where every third curve repeats its Decembers in the next year."""
    c = v.asset_curves
    plain = c.withColumn("group", F.year("dt"))
    again = c.filter((F.col("curve_id") % 3 == 0) & (F.month("dt") == 12)).withColumn("group", F.year("dt") + 1)
    return CV.dq_stitch(plain.unionByName(again))


EVAL = f"""{STITCH},
  r AS MATERIALIZED (SELECT * FROM (SELECT curve_id, path, dt, nav / lag(nav) OVER (PARTITION BY curve_id, path ORDER BY dt) - 1 AS r FROM st) WHERE r IS NOT NULL),
  a AS (SELECT curve_id, path, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM r GROUP BY 1, 2),
  m AS (SELECT r.curve_id, r.path, max(n) AS n, max(mu) / max(sd) AS sr_hat, avg(power(r - mu, 2)) AS m2, avg(power(r - mu, 3)) AS m3, avg(power(r - mu, 4)) AS m4
        FROM r JOIN a ON a.curve_id = r.curve_id AND a.path = r.path GROUP BY 1, 2),
  z AS (SELECT *, {X.z_score('sr_hat', '0e0', 'n', '(m3 / power(m2, 1.5e0))', '(m4 / (m2 * m2))')} AS z FROM m)"""


@query("cpcv_path_scores", f"{EVAL} SELECT curve_id, path, sr_hat, {X.cdf('z')} AS psr FROM z", "curve_id path:i sr_hat:f psr:f")
def _(v):
    folds, paths = paths_of(v)
    return CV.cpcv_evaluate(v.asset_curves, folds, paths, capital=100.0)[0].select("curve_id", "path", "sr_hat", "psr")


@query(
    "cpcv_distribution",
    f"""{EVAL}, k AS (SELECT curve_id, sr_hat, row_number() OVER (PARTITION BY curve_id ORDER BY sr_hat) AS rk, count(*) OVER (PARTITION BY curve_id) AS n FROM z)
    SELECT curve_id, pct, n, sr_hat AS value, true AS low_sample, 'ok' AS status FROM k JOIN (SELECT unnest([10e0, 50e0, 90e0]) AS pct) p ON rk = greatest(1, CAST(ceil(pct / 100e0 * n) AS BIGINT))""",
    "curve_id pct:f n value:f low_sample status",
)
def _(v):
    folds, paths = paths_of(v)
    return CV.cpcv_evaluate(v.asset_curves, folds, paths, capital=100.0)[1]


@query(
    "record_trials",
    """SELECT dataset_fingerprint, strategy_family, sr_hat, t_observations, gamma_3, gamma_4, '{"name":"' || c_name || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' AS metadata_json,
        CASE WHEN t_observations < 2 THEN 'too_short' ELSE 'ok' END AS status FROM trials""",
    "dataset_fingerprint strategy_family sr_hat:f t_observations:i gamma_3:f gamma_4:f metadata_json status",
)
def _(v):
    return T.validate_trials(v.trials)


@query(
    "trial_variance",
    """SELECT f.dataset_fingerprint, f.strategy_family, coalesce(n, 0) AS n_recorded, 30 AS n_trials, CASE WHEN n >= 2 THEN v END AS v_sr,
        CASE WHEN coalesce(n, 0) = 0 THEN 'no_trials' WHEN n = 1 THEN 'single_trial' ELSE 'ok' END AS status
       FROM (SELECT DISTINCT dataset_fingerprint, strategy_family FROM trials UNION SELECT DISTINCT dataset_fingerprint, 'UNSEEN' FROM trials) f
       LEFT JOIN (SELECT dataset_fingerprint, strategy_family, count(*) AS n, var_samp(sr_hat) AS v FROM trials GROUP BY 1, 2) t
       ON t.dataset_fingerprint = f.dataset_fingerprint AND t.strategy_family = f.strategy_family""",
    "dataset_fingerprint strategy_family n_recorded n_trials:i v_sr:f status",
)
def _(v):
    seen = v.trials.select("dataset_fingerprint", "strategy_family")
    families = seen.unionByName(seen.withColumn("strategy_family", F.lit("UNSEEN")))
    return T.trial_variance(v.trials, declared_n=30, families=families)
