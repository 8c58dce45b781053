"""Ridge fits of every fold and penalty at once: one scan a step, however many penalties.

Each fit is a descent that asks for sums over its fold's rows (normal matrix and
gradient at a point, objectives at several, or objectives and the matrix at the
first of the points, ahead of the choice) and goes on when it has them. The
descents advance in step: a scan answers the open questions of all of them, so a
scan over twenty penalties takes as many passes as its slowest fit.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.operators import fit
from skyledger.operators.fit import LinearModel
from skyledger.operators.spectra import feature_stats, matrix

# Numbers that one task adds up in a scan; with more, the fits go through it in turns.
SUMS = 1 << 26
# Widest problem whose normal matrix is formed ahead, at the step most likely taken; reading the rows costs more there.
AHEAD = 256

Question = tuple[str, object]


def fit_folds(rows: DataFrame, lams: Sequence[float], *, sample: str = "sample", folds: Sequence[str] = ("A", "B"),
              max_iter: int = 100, gtol: float = 1e-7, ftol: float = 1e-12, features: str = "features",
              plx: str = "plx", err: str = "e_plx") -> dict[float, dict[str, LinearModel]]:
    """The models of ``fit.fit_parallax`` with a ridge penalty, by penalty and fold.

    A fold without rows has a model of zeros. Problems too wide for a normal matrix
    are left to ``fit_parallax``, one after another.
    """
    data = rows.where(F.col(sample).isin(*folds)).select(
        F.col(sample).alias("fold"), F.col(features).alias("features"), F.col(plx).cast("double").alias("plx"),
        F.col(err).cast("double").alias("err"))
    stats = {f: feature_stats(data.where(F.col("fold") == f)) for f in folds}
    size = max(len(mu) for mu, _, _ in stats.values()) + 1
    if size > fit.DENSE_LIMIT:
        return {lam: {f: fit.fit_parallax(rows.where(F.col(sample) == f), lam=lam, max_iter=max_iter, gtol=gtol, ftol=ftol,
                                          features=features, plx=plx, err=err).model for f in folds} for lam in lams}
    stats = {f: s for f, s in stats.items() if s[2]}
    fits = {(f, lam): _ridge(np.r_[0.0, np.full(size - 1, float(lam))], max_iter, gtol, ftol) for f in stats for lam in lams}
    questions = {key: next(run) for key, run in fits.items()}
    done: dict[tuple[str, float], np.ndarray] = {}
    while questions:
        # A question that needs a matrix costs size^2 numbers in every task.
        turn, room = {}, SUMS
        for key, question in questions.items():
            room -= size * size if question[0] != "misfit" else len(question[1])
            if turn and room < 0:
                break
            turn[key] = question
        for key, answer in _answers(data, stats, turn, size).items():
            try:
                questions[key] = fits[key].send(answer)
            except StopIteration as end:
                done[key] = end.value
                del questions[key]
    zeros = LinearModel(np.zeros(size), np.zeros(size - 1), np.ones(size - 1))
    return {lam: {f: LinearModel(done[f, lam], *stats[f][:2]) if f in stats else zeros for f in folds} for lam in lams}


def _ridge(reg: np.ndarray, max_iter: int, gtol: float, ftol: float) -> Generator[Question, np.ndarray, np.ndarray]:
    """A descent as a coroutine: it yields questions and returns the coefficients."""
    size = len(reg)

    def split(sums):
        return sums[:size * size].reshape(size, size), sums[size * size:size * size + size]

    sums = yield "start", None
    gram, rhs = split(sums)
    n, n_pos = sums[-2:]
    theta = np.linalg.lstsq(gram + np.diag(reg) * n_pos, rhs, rcond=None)[0]
    if not n:
        return theta

    def objective(misfits, points):
        return 0.5 * misfits / n + np.array([0.5 * reg @ t ** 2 for t in points])

    ahead = "ahead" if size <= AHEAD else "misfit"
    sums = yield ahead, [theta]
    value, known, damping = objective(sums[:1], [theta])[0], sums[1:], 1e-3
    for _ in range(max_iter):
        h, grad = split(known if len(known) else (yield "normal", theta))
        h, grad = h / n + np.diag(reg), grad / n + reg * theta
        if np.abs(grad).max() < gtol:
            return theta
        diagonal, gain = np.diag(h), 0.0
        while damping < 1e12 and gain <= 0.0:
            dampings = fit._trial_dampings(damping)
            deltas = [np.linalg.solve(h + np.diag(d * diagonal), -grad) for d in dampings]
            foretold = [0.5 * (-grad @ s + d * s @ (diagonal * s)) for s, d in zip(deltas, dampings)]
            points = [theta + s for s in deltas]
            sums = yield ahead, points
            values = objective(sums[:len(points)], points)
            k = int(np.argmin(values))
            known = sums[len(points):] if k == 0 else ()
            gain = value - values[k]
            if gain <= 0.0:
                if max(foretold) <= ftol * max(abs(value), 1.0):
                    return theta
                damping = dampings[-1] * 10.0
        if gain <= 0.0:
            return theta
        theta, value, damping = points[k], values[k], fit._next_damping(dampings[k], gain, foretold[k])
        if gain <= ftol * max(abs(value), 1.0):
            return theta
    return theta


def _answers(data: DataFrame, stats: dict, questions: dict, size: int) -> dict[tuple[str, float], np.ndarray]:
    """What every descent asked for, from one scan of the rows."""
    asked = list(questions)
    # The start of a fold's fits does not depend on the penalty.
    first = {}
    for key in asked:
        if questions[key][0] == "start":
            first.setdefault(key[0], key)

    def add(total, question, design, plx, err):
        kind, at = question
        if kind in ("misfit", "ahead"):
            m = np.exp(np.clip(design @ np.stack(at, axis=1), -fit.x.Z_CLIP, fit.x.Z_CLIP))
            total[:len(at)] += (((plx[:, None] - m) / err[:, None]) ** 2).sum(axis=0)
            if kind == "misfit":
                return
            total, at = total[len(at):], at[0]
        if kind == "start":
            weight = (plx > 0).astype(float)
            target = np.log(np.where(plx > 0, plx, 1.0))
            total[-2:] += len(plx), weight.sum()
        else:
            weight, target = fit._curvature(at)(design, plx, err), fit._slope(at)(design, plx, err)
        total[:size * size] += ((design * weight[:, None]).T @ design).ravel()
        total[size * size:size * size + size] += design.T @ target

    def length(question):
        points = len(question[1]) if question[0] in ("misfit", "ahead") else 0
        return points if question[0] == "misfit" else points + size * size + size + 2

    def run(batches):
        totals = {}
        for batch in batches:
            fold = batch.column("fold").to_pylist()
            for f in set(fold):
                own = batch.filter(pa.array([v == f for v in fold]))
                mu, sd, _ = stats[f]
                design = np.hstack([np.ones((own.num_rows, 1)), (matrix(own.column("features"), len(mu)) - mu) / sd])
                plx, err = (own.column(c).to_numpy(zero_copy_only=False) for c in ("plx", "err"))
                for i, key in enumerate(asked):
                    if key[0] == f and (questions[key][0] != "start" or first[f] == key):
                        if i not in totals:
                            totals[i] = np.zeros(length(questions[key]))
                        add(totals[i], questions[key], design, plx, err)
        for i, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                             names=["part", "block"])

    problem = fit._Problem(data.where(F.col("fold").isin(*stats)), *next(iter(stats.values()))[:2])
    values = sum(map(length, questions.values()))
    blocks = problem.partials(values).mapInArrow(run, "part int, block binary")
    sums = fit._collect_sums(problem, blocks, ["part"], values)
    out = {key: sums.get((i,), np.zeros(length(questions[key]))) for i, key in enumerate(asked)}
    return out | {key: out[first[key[0]]] for key in asked if questions[key][0] == "start"}
