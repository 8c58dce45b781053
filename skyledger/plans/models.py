"""Queries that fit and score models on features derived from the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyledger.operators import fit, scoring as sc, spectra as sp
from skyledger.operators.evaluate import evaluate
from skyledger.plans.arrays import FLAGGED, spectra
from skyledger.plans.registry import query
from skyledger.plans.tables import HUB, hub, r, round_all, table
from skyledger.session import stage

# Five features of a line: price, discount, tax, quantity and part size.
_FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def lines(spark, sf):
    """Rows with a feature array and a parallax that depends on it, plus noise."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    li = hub(spark, sf).join(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).join(part, "l_partkey")
    feats = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10,
             F.col("p_size") / 50.0, (F.col("l_partkey") % 7).cast("double")]
    z = 0.3 + 0.8 * feats[0] - 0.5 * feats[1] + 0.1 * feats[2] - 0.4 * feats[3]
    noise = ((F.col("l_orderkey") * 7919 + F.col("l_partkey")) % 1009 - 504) / 504.0
    plx = F.exp(z) * (1 + 0.05 * noise) + 0.02 * ((F.col("l_orderkey") * 31 + F.col("l_suppkey")) % 101 - 50) / 50
    return li.select("sdss_id", "sample", "train", F.array(*feats).alias("features"), plx.alias("plx"),
                     (0.02 + 0.03 * F.exp(z) * (1 + F.col("l_tax"))).alias("e_plx"))


LINES = HUB + """, lines AS (SELECT h.sdss_id, h.sample, h.train, h.l_quantity / 50 AS f0, li.l_discount * 10 AS f1, li.l_tax * 10 AS f2, p_size / 50.0::DOUBLE AS f3,
    (h.l_partkey % 7)::DOUBLE AS f4, (h.l_orderkey * 7919 + h.l_partkey) % 1009 AS n1, (h.l_orderkey * 31 + h.l_suppkey) % 101 AS n2, li.l_tax AS tax
  FROM hub h JOIN lineitem li USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) JOIN part ON l_partkey = p_partkey),
  fl AS (SELECT *, exp(0.3 + 0.8 * f0 - 0.5 * f1 + 0.1 * f2 - 0.4 * f3) AS m FROM lines),
  rows AS (SELECT *, m * (1 + 0.05 * ((n1 - 504) / 504.0::DOUBLE)) + 0.02 * (n2 - 50) / 50 AS plx, 0.02 + 0.03 * m * (1 + tax) AS e_plx FROM fl)"""


@query("weighted_gram", "WITH " + LINES + ", x AS (SELECT [1.0, f0, f1, f2, f3, f4]::DOUBLE[] AS v, 1 / e_plx AS w FROM rows), ij AS (SELECT i, j FROM range(1, 7) a(i), range(1, 7) b(j) WHERE j >= i)"
       f" SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, {r('sum(w * v[i] * v[j])', 3)} AS s FROM x, ij GROUP BY 1, 2")
def weighted_gram(spark, sf):
    rows = stage(lines(spark, sf).select("features", (1 / F.col("e_plx")).alias("w")))
    g = fit.weighted_gram(rows, "features", "w")
    out = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(6) for j in range(i, 6)], "i int, j int, s double")
    return round_all(out, 3)


# --- the fits in SQL: Gauss-Newton one coordinate after another until nothing moves ----------
_D = 6  # the intercept and five features
_TRAIN = LINES + ", train AS (SELECT * FROM rows WHERE train)"


def _standardised(name: str, source: str, stats: str | None = None) -> str:
    """``name``: x1..x5, plx and e of ``source``, standardised by ``stats`` or by its own statistics (as ``name``_s)."""
    own = ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(5))
    xs = ", ".join(f"(f{i} - m{i}) / s{i} AS x{i + 1}" for i in range(5))
    made = "" if stats else f"{name}_s AS MATERIALIZED (SELECT {own} FROM {source}), "
    return made + f"{name} AS MATERIALIZED (SELECT sample, train, plx, e_plx AS e, {xs} FROM {source}, {stats or name + '_s'})"


def _z(alias: str = "") -> str:
    dot = alias and alias + "."
    return f"least(30, greatest(-30, {dot}t0" + "".join(f" + {dot}t{j} * x{j}" for j in range(1, _D)) + "))"


def _descent_sql(name: str, rows: str, ridge: float = 0.0, sparse: float = 0.0, n_free: int = 1, start: str | None = None,
                 sweeps: int = 60) -> str:
    """``name``: the coefficients t0..t5 that minimise the objective over ``rows``."""
    begin = f"SELECT 0 AS k, {', '.join(f't{j}' for j in range(_D))} FROM {start}" if start else (
        f"SELECT 0 AS k, avg(ln(plx)) AS t0, {', '.join(f'0.0::DOUBLE AS t{j}' for j in range(1, _D))} FROM {rows} WHERE plx > 0")
    turn = "CASE k % 6 " + " ".join(f"WHEN {j} THEN {{{j}}}" for j in range(_D)) + " END"
    axis = turn.format("1.0", *[f"x{j}" for j in range(1, _D)])
    mine = turn.format(*[f"t{j}" for j in range(_D)])
    penalty = f"CASE WHEN k % 6 = 0 THEN 0.0 ELSE {ridge} END"
    cost = f"CASE WHEN k % 6 < {n_free} THEN 0.0 ELSE {sparse} END"
    # The coordinate's minimiser of the quadratic model, shrunk by its cost.
    free = f"((h + {penalty}) * ({mine}) - g - {penalty} * ({mine}))"
    new = f"sign({free}) * greatest(abs({free}) - {cost}, 0.0) / (h + {penalty})"
    moved = ", ".join(f"CASE WHEN k % 6 = {j} THEN {new} ELSE t{j} END AS t{j}" for j in range(_D))
    return f"""{name}_k AS ({begin} UNION ALL SELECT k + 1, {moved} FROM (SELECT i.*, g, h FROM {name}_k i, LATERAL (
        SELECT avg(m * (m - plx) / (e * e) * x) AS g, avg(m * m / (e * e) * x * x) AS h
        FROM (SELECT plx, e, exp({_z('i')}) AS m, {axis} AS x FROM {rows}))) WHERE k < {_D * sweeps}),
      {name} AS MATERIALIZED (SELECT * EXCLUDE (k) FROM {name}_k ORDER BY k DESC LIMIT 1)"""


def _coefficients_sql(fitted: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {j} AS i, {r(f't{j}', 5)} AS theta FROM fitted" for j in range(_D))
    return f"WITH RECURSIVE {_TRAIN}, {_standardised('a', 'train')}, {fitted} {rows}"


def _clipped_sql(lam: float, sigmas: float, rounds: int) -> str:
    parts = [_standardised("a0", "train"), _descent_sql("fit0", "a0", ridge=lam)]
    for k in range(rounds):
        parts.append(f"""chi{k} AS MATERIALIZED (SELECT a{k}.*, (plx - exp({_z()})) / e AS chi FROM a{k}, fit{k}),
          a{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (chi, c, w) FROM chi{k}, (SELECT median(chi) AS c, {sigmas} * 1.48::DOUBLE * mad(chi) AS w FROM chi{k})
            WHERE abs(chi - c) <= w)""")
        parts.append(_descent_sql(f"fit{k + 1}", f"a{k + 1}", ridge=lam, start=f"fit{k}", sweeps=25))
    squares = " + ".join(f"t{j} * t{j}" for j in range(1, _D))
    return f"""WITH RECURSIVE {_TRAIN}, {', '.join(parts)}
      SELECT count(*) AS n_used, (SELECT count(*) FROM a0) - count(*) AS n_clipped,
        {r(f"avg(0.5 * ((plx - exp({_z()})) / e) ** 2) + any_value(0.5 * {lam} * ({squares}))", 5)} AS objective FROM a{rounds}, fit{rounds}"""


def _fold_fits(lam: float, tag: str) -> list[str]:
    return [part for f in "AB" for part in (
        _standardised(f"a{f}{tag}", f"(SELECT * FROM train WHERE sample = '{f}')"), _descent_sql(f"fit{f}{tag}", f"a{f}{tag}", ridge=lam))]


def _scan_sql(lams) -> str:
    parts, scored = [], []
    for i, lam in enumerate(lams):
        parts += _fold_fits(lam, str(i))
        for own, other in ("AB", "BA"):
            parts.append(_standardised(f"p{own}{i}", f"(SELECT * FROM train WHERE sample = '{own}')", stats=f"a{other}{i}_s"))
            scored.append(f"SELECT {lam}::DOUBLE AS lam, (exp({_z()}) - plx) / nullif(plx, 0) AS frac FROM p{own}{i}, fit{other}{i} WHERE plx / e >= 20 AND plx > 0")
    return f"""WITH RECURSIVE {_TRAIN}, {', '.join(parts)}
      SELECT lam, count(frac) AS n_probe, {r('1.48::DOUBLE * mad(frac)', 4)} AS scatter FROM ({' UNION ALL '.join(scored)}) GROUP BY lam"""


def _evaluated_sql(lam: float) -> str:
    from skyledger.plans.evaluation import PROBE, _evaluate_sql
    parts = [*_fold_fits(lam, ""), _standardised("aall", "train"), _descent_sql("fitall", "aall", ridge=lam)]
    sides = []
    for name, where, by in (("qa", "train AND sample = 'A'", "B"), ("qb", "train AND sample = 'B'", "A"), ("qo", "NOT train", "all")):
        parts.append(_standardised(name, f"(SELECT * FROM rows WHERE {where})", stats=f"a{by}_s"))
        sides.append(f"SELECT sample, train, plx, e AS e_plx, exp({_z()}) AS plx_sp FROM {name}, fit{by}")
    prelude = f"""{_TRAIN}, {', '.join(parts)}, joined AS ({' UNION ALL '.join(sides)}),
      cat AS (SELECT *, plx_sp * (SELECT 1.48::DOUBLE * mad(ln(plx_sp) - ln(plx)) FROM joined WHERE train AND plx > 0 AND {PROBE}) AS err_sp FROM joined)"""
    return _evaluate_sql(prelude, "cat").replace(", 6) + 0.0)", ", 4) + 0.0)").replace("WITH ", "WITH RECURSIVE ", 1)


def _components_sql(k: int, squarings: int = 16) -> str:
    """Leading variances by repeated squaring of the correlation matrix, each taken off before the next."""
    parts = ["""cells AS (SELECT row, i, embedding[i]::DOUBLE AS v FROM (SELECT row_number() OVER () AS row, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
      z AS MATERIALIZED (SELECT row, i, (v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i) AS z FROM cells),
      g0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / (SELECT count(*) - 1 FROM embeddings) AS v FROM z a JOIN z b USING (row) GROUP BY 1, 2)"""]
    for c in range(k):
        before = f"g{c}"
        for s in range(squarings):
            name = f"p{c}_{s}"
            parts.append(f"""{name}_r AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY 1, 2),
              {name} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_r WHERE i = j) AS v FROM {name}_r)""")
            before = name
        parts.append(f"""l{c} AS MATERIALIZED (SELECT sum(g.v * p.v) AS v FROM g{c} g JOIN {before} p ON g.i = p.j AND g.j = p.i),
          g{c + 1} AS MATERIALIZED (SELECT i, j, g.v - l{c}.v * p.v AS v FROM g{c} g JOIN {before} p USING (i, j), l{c})""")
    rows = " UNION ALL ".join(f"SELECT {c} AS component, {r('sqrt(v)', 4)} AS scale FROM l{c}" for c in range(k))
    return f"WITH {', '.join(parts)} {rows}"


def _coefficients(spark, result):
    t = result.model.theta
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "i int, theta double")


@query("ridge_fit", _coefficients_sql(_descent_sql("fitted", "a", ridge=0.01)))
def ridge_fit(spark, sf):
    rows = stage(lines(spark, sf).filter("train"))
    return round_all(_coefficients(spark, fit.fit_parallax(rows, lam=0.01)), 5)


@query("sparse_fit", _coefficients_sql(_descent_sql("fitted", "a", sparse=0.2, n_free=2)))
def sparse_fit(spark, sf):
    rows = stage(lines(spark, sf).filter("train"))
    return round_all(_coefficients(spark, fit.fit_parallax(rows, lam=0.2, penalty="l1", n_free=2)), 5)


@query("clipped_fit", _clipped_sql(0.01, 2.0, 5))
def clipped_fit(spark, sf):
    rows = stage(lines(spark, sf).filter("train"))
    out = fit.fit_parallax(rows, lam=0.01, clip_sigma=2.0)
    return spark.createDataFrame([(out.n_used, out.n_clipped, round(out.objective, 5))], "n_used long, n_clipped long, objective double")


# A fixed model for the scoring queries: coefficients and statistics by rule.
THETA, MU, SD = [0.35, 0.25, -0.45, 0.08, -0.12, 0.01], [0.5, 0.5, 0.4, 0.5, 3.0], [0.3, 0.3, 0.25, 0.3, 2.0]
MODEL = fit.LinearModel(np.array(THETA), np.array(MU), np.array(SD))


def _linear_sql(theta) -> str:
    return f"({theta[0]}" + "".join(f" + {t} * ((f{i} - {m}) / {s})" for i, (t, m, s) in enumerate(zip(theta[1:], MU, SD))) + ")::DOUBLE"


@query("linear_predict", "WITH " + LINES + f" SELECT sdss_id, {r(f'exp(greatest(-30, least(30, {_linear_sql(THETA)})))')} AS plx_sp FROM rows")
def linear_predict(spark, sf):
    return round_all(sc.predict(lines(spark, sf), MODEL, ["sdss_id"]))


_SHIFT = {"A": 0.0, "B": 0.1, "all": -0.1}
_FOLD_MODELS = {k: fit.LinearModel(MODEL.theta + np.array([v, 0, 0, 0, 0, 0]), MODEL.mu, MODEL.sd) for k, v in _SHIFT.items()}


@query("held_out_predict", "WITH " + LINES + f" SELECT sdss_id, {r(f'exp({_linear_sql(THETA)} + CASE WHEN NOT train THEN -0.1 WHEN sample = chr(65) THEN 0.1 ELSE 0 END)')} AS plx_sp FROM rows")
def held_out_predict(spark, sf):
    rows = lines(spark, sf).withColumn("model", sc.held_out_route())
    return round_all(sc.predict_routed(rows, _FOLD_MODELS, ["sdss_id"]))


@query("in_fold_predict", "WITH " + LINES + f" SELECT sdss_id, {r(f'exp({_linear_sql(THETA)} + CASE WHEN NOT train THEN -0.1 WHEN sample = chr(66) THEN 0.1 ELSE 0 END)')} AS plx_sp FROM rows")
def in_fold_predict(spark, sf):
    rows = lines(spark, sf).withColumn("model", sc.in_fold_route())
    return round_all(sc.predict_routed(rows, _FOLD_MODELS, ["sdss_id"]))


@query("fit_score_evaluate", _evaluated_sql(0.01))
def fit_score_evaluate(spark, sf):
    """Three fits, leave-out scoring, constant error and the report by fold."""
    from skyledger.operators.calibrate import constant_error
    rows = stage(lines(spark, sf))
    train = rows.filter("train")
    models = {f: fit.fit_parallax(train.filter(F.col("sample") == f), lam=0.01).model for f in ("A", "B")}
    models["all"] = fit.fit_parallax(train, lam=0.01).model
    routed = rows.withColumn("model", sc.held_out_route())
    cat = stage(sc.predict_routed(routed, models, ["sdss_id", "plx", "e_plx", "sample", "train"]))
    return round_all(evaluate(constant_error(cat)), 4)


@query("lambda_scan", _scan_sql([0.001, 1.0]))
def lambda_scan(spark, sf):
    rows = stage(lines(spark, sf).filter("train"))
    scan, _ = sc.lambda_scan(rows, [0.001, 1.0], key="sdss_id")
    return round_all(scan, 4)


@query("best_lambda", "SELECT 0.5::DOUBLE + min_by(l_linenumber, q) AS lam FROM (SELECT l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1)")
def best_lambda(spark, sf):
    scan = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") + 0.5).alias("lam")).agg(F.avg("l_quantity").alias("scatter"))
    return spark.createDataFrame([(sc.best_lambda(scan),)], "lam double")


@query("principal_components", _components_sql(4))
def principal_components(spark, sf):
    e = stage(table(spark, sf, "embeddings").select(F.col("embedding").alias("features")))
    mu, sd, _ = sp.feature_stats(e)
    v, scale = fit.fit_pca(e, 4, mu, sd)
    return round_all(spark.createDataFrame([(i, float(s)) for i, s in enumerate(scale)], "component int, scale double"), 4)


# Network weights by rule, the same in both engines.
def _w(i: int, j: int, seed: int) -> float:
    return round((((i * 31 + j * 17 + seed * 7) % 41) - 20) / 60.0, 6)


def _weights(rows: int, cols: int, seed: int) -> np.ndarray:
    return np.array([[_w(i, j, seed) for j in range(cols)] for i in range(rows)])


NET = sc.TwoHeadNet(body=[(_weights(5, 4, 1), _weights(1, 4, 2)[0]), (_weights(4, 3, 3), _weights(1, 3, 4)[0])],
                    head_mu=(_weights(3, 1, 5), np.array([0.2])), head_log_sigma=(_weights(3, 1, 6), np.array([-2.5])),
                    mu=np.array(MU), sd=np.array(SD), std_factor=1.25)


def _dense_sql(inputs: list[str], w: np.ndarray, b: np.ndarray) -> list[str]:
    return ["(" + " + ".join(f"{n} * ({float(w[i, j])!r})" for i, n in enumerate(inputs)) + f" + ({float(b[j])!r}))::DOUBLE" for j in range(w.shape[1])]


def _mlp_sql(inputs: list[str], body, source: str, tag: str) -> tuple[str, list[str], str]:
    """CTEs of hidden layers; returns (ctes, output column names, last table)."""
    ctes, names, current = "", inputs, source
    for k, (w, b) in enumerate(body):
        lin = _dense_sql(names, w, b)
        out = [f"{tag}{k}_{j}" for j in range(w.shape[1])]
        ctes += f", {tag}l{k} AS (SELECT *, " + ", ".join(f"{e} AS {n}l" for e, n in zip(lin, out)) + f" FROM {current})"
        ctes += f", {tag}a{k} AS (SELECT *, " + ", ".join(f"{n}l / (1 + exp(-{n}l)) AS {n}" for n in out) + f" FROM {tag}l{k})"
        names, current = out, f"{tag}a{k}"
    return ctes, names, current


_STD = ", std AS (SELECT sdss_id, " + ", ".join(f"(f{i} - {m}::DOUBLE) / {s}::DOUBLE AS s{i}" for i, (m, s) in enumerate(zip(MU, SD))) + " FROM rows)"


def _two_head_sql() -> str:
    ctes, names, last = _mlp_sql([f"s{i}" for i in range(5)], NET.body, "std", "h")
    z, s = _dense_sql(names, *NET.head_mu)[0], _dense_sql(names, *NET.head_log_sigma)[0]
    return f"WITH {LINES}{_STD}{ctes} SELECT sdss_id, {r(f'exp({z})')} AS plx_sp, {r(f'1.25 * exp(greatest(ln(1e-4::DOUBLE), least(ln(10::DOUBLE), {s})))')} AS err_sp FROM {last}"


@query("two_head_predict", _two_head_sql())
def two_head_predict(spark, sf):
    return round_all(sc.predict_two_head(lines(spark, sf), NET, ["sdss_id"]))


# Bands f0, f1; extinction f2; "spectrum" f3, f4 with two components.
GATED = sc.GatedNet(theta=np.array(THETA[1:]), bias=0.35, phi=np.array([0.05, -0.03]),
                    residual=[(_weights(5, 3, 7), _weights(1, 3, 8)[0]), (_weights(3, 1, 9), np.array([0.1]))],
                    log_sigma=[(_weights(5, 1, 10), np.array([-0.5]))], mu=np.array(MU), sd=np.array(SD),
                    components=np.array([[0.6, -0.8], [0.8, 0.6]]), scale=np.array([0.9, 1.1]), tau=1.5, width=0.5, n_bands=2)


def _gated_sql() -> str:
    red = ["s0", "s1", "s2", "c0", "c1"]
    ctes, names, last = _mlp_sql(red, GATED.residual[:1], "sco", "g")
    g = _dense_sql(names, *GATED.residual[1])[0]
    s = _dense_sql(red, *GATED.log_sigma[0])[0]
    lin = "(0.35 + " + " + ".join(f"s{i} * {t}" for i, t in enumerate(THETA[1:])) + ")::DOUBLE"
    return f"""WITH {LINES}{_STD}, sco AS (SELECT *, (s3 * 0.6 + s4 * 0.8) / 0.9 AS c0, (s3 * -0.8 + s4 * 0.6) / 1.1 AS c1 FROM std){ctes},
      q AS (SELECT sdss_id, (c0 * c0 + c1 * c1) / 2 AS d, {lin} + s2 * (s0 * 0.05 - s1 * 0.03) AS z0, {g} AS g, {s} + ln(0.1::DOUBLE) AS s FROM {last}),
      k AS (SELECT *, 1 / (1 + exp(-(1.5 - d) / 0.5)) AS gate FROM q)
      SELECT sdss_id, {r('exp(z0 + gate * g)')} AS plx_sp, {r('exp(s)')} AS err_sp, {r('gate')} AS gate, {r('d')} AS hull_d FROM k"""


@query("gated_predict", _gated_sql())
def gated_predict(spark, sf):
    return round_all(sc.predict_gated(lines(spark, sf), GATED, ["sdss_id"]))


def _saved_and_loaded(spark, net):
    from skyledger.plans.ingest import fresh
    from skyledger.sources.datasets import lookup
    from skyledger.sources.models import load_network, save_network
    path = fresh(spark)
    save_network(spark, path, net, dataset=lookup("dr17"), config={"epochs": 3})
    return load_network(spark, path)["net"]


@query("two_head_round_trip", _two_head_sql())
def two_head_round_trip(spark, sf):
    return round_all(sc.predict_two_head(lines(spark, sf), _saved_and_loaded(spark, NET), ["sdss_id"]))


@query("gated_round_trip", _gated_sql())
def gated_round_trip(spark, sf):
    return round_all(sc.predict_gated(lines(spark, sf), _saved_and_loaded(spark, GATED), ["sdss_id"]))


@query("hull_gate", f"WITH {LINES}{_STD}, d AS (SELECT sdss_id, (((s3 * 0.6 + s4 * 0.8) / 0.9) ** 2 + ((s3 * -0.8 + s4 * 0.6) / 1.1) ** 2) / 2 AS d FROM std)"
       f" SELECT count(*) AS n, {r('avg(d)')} AS mean_hull, {r('avg(1 / (1 + exp(-(1.5 - d) / 0.5)))')} AS mean_gate FROM d")
def hull_gate(spark, sf):
    out = sc.predict_gated(lines(spark, sf), GATED, ["sdss_id"])
    return round_all(out.agg(F.count(F.lit(1)).alias("n"), F.avg("hull_d").alias("mean_hull"), F.avg("gate").alias("mean_gate")))


# Saved models on spectra: two bands plus the first 60 pixels of the embedding spectra.
_APPLY = fit.LinearModel(np.concatenate([[0.3, 0.2, -0.1], [_w(i, 0, 11) / 10 for i in range(60)]]), np.zeros(62), np.ones(62))
_APPLY_NET = sc.TwoHeadNet(body=[(_weights(62, 3, 12) / 4, _weights(1, 3, 13)[0])], head_mu=(_weights(3, 1, 14), np.array([0.1])),
                           head_log_sigma=(_weights(3, 1, 15), np.array([-2.0])), mu=np.zeros(62), sd=np.ones(62))

_W = "round(((i * 31 + {j} * 17 + {seed} * 7) % 41 - 20) / 60.0::DOUBLE, 6)"
APPLIED = FLAGGED + """, st AS (SELECT o_custkey AS star, o_totalprice / 1e5::DOUBLE AS plx, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 5e5::DOUBLE END AS h,
    (o_orderkey % 10) / 10.0::DOUBLE AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 5 = 0)::INT, o_orderkey) AS rn FROM orders),
  meta AS (SELECT vec_id AS sdss_id, plx, h::FLOAT::DOUBLE AS h, k::FLOAT::DOUBLE AS k, (vec_id % 10) / 10.0::DOUBLE AS memberprob
    FROM embeddings JOIN st ON star = vec_id AND rn = 1 WHERE h IS NOT NULL),
  feats AS (SELECT sdss_id, p + 2 AS i, (CASE WHEN bad THEN 0.0 ELSE ln(f) END)::FLOAT::DOUBLE AS v FROM bx JOIN meta USING (sdss_id) WHERE p < 60
    UNION ALL SELECT sdss_id, 0, h FROM meta UNION ALL SELECT sdss_id, 1, k FROM meta)"""


def _apply_inputs(spark, sf):
    stars = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("sdss_id"), F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1e5).alias("plx"),
        F.lit(0.05).alias("e_plx"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 5e5).alias("h_mag"),
        ((F.col("o_orderkey") % 10) / 10).alias("k_mag"), F.lit(1000.0).alias("r_med_photogeo"))
    spec = spectra(spark, sf).withColumn("memberprob", (F.col("sdss_id") % 10) / 10)
    return spec, stars, {"good": np.arange(64) < 60, "bands": ["h_mag", "k_mag"], "star_row_id": ["row_id"]}


@query("apply_saved_model", f"""WITH {APPLIED}, z AS (SELECT sdss_id, 0.3 + sum(v * CASE i WHEN 0 THEN 0.2 WHEN 1 THEN -0.1 ELSE round((((i - 2) * 31 + 77) % 41 - 20) / 60.0::DOUBLE, 6) / 10 END::DOUBLE) AS z FROM feats GROUP BY 1)
  SELECT sdss_id, {r('plx', 5)} AS plx, {r('exp(z)', 5)} AS plx_sp, {r('0.08 * exp(z)', 5)} AS err_sp, {r('exp(-z)', 5)} AS dist_sp_kpc, {r('memberprob', 5)} AS memberprob FROM meta JOIN z USING (sdss_id)""")
def apply_saved_model(spark, sf):
    spec, stars, options = _apply_inputs(spark, sf)
    out = sc.apply_linear(spec, stars, _APPLY, frac_sigma=0.08, **options)
    return round_all(out.select("sdss_id", "plx", "plx_sp", "err_sp", "dist_sp_kpc", "memberprob"), 5)


def _hidden(j: int) -> str:
    return f"sum(v * {_W.format(j=j, seed=12)} / 4) + ({float(_APPLY_NET.body[0][1][j])!r}) AS l{j}"


@query("apply_saved_network", f"""WITH {APPLIED}, hid AS (SELECT sdss_id, {", ".join(_hidden(j) for j in range(3))} FROM feats GROUP BY 1),
  act AS (SELECT sdss_id, l0 / (1 + exp(-l0)) AS a0, l1 / (1 + exp(-l1)) AS a1, l2 / (1 + exp(-l2)) AS a2 FROM hid)
  SELECT sdss_id, {r('exp(' + _dense_sql(['a0', 'a1', 'a2'], *_APPLY_NET.head_mu)[0] + ')', 5)} AS plx_sp,
    {r('exp(' + _dense_sql(['a0', 'a1', 'a2'], *_APPLY_NET.head_log_sigma)[0] + ')', 5)} AS err_sp FROM act""")
def apply_saved_network(spark, sf):
    spec, stars, options = _apply_inputs(spark, sf)
    return round_all(sc.apply_two_head(spec, stars, _APPLY_NET, **options).select("sdss_id", "plx_sp", "err_sp"), 5)
