"""The learned parts of operators 3 and 9 against dense, exhaustive versions."""

import math

import numpy as np
import pytest

from loomgraph.llm import kernel_quality, quality_rules


def labelled_rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, len(kernel_quality.STATS))) * rng.uniform(0.1, 5, len(kernel_quality.STATS)) + rng.normal(0, 3, len(kernel_quality.STATS))
    z = (x - x.mean(0)) / x.std(0)
    y = (np.sin(2 * z[:, 0]) + z[:, 1] * z[:, 2] + rng.normal(0, 0.3, n) > 0).astype(int)
    fold = np.where(np.arange(n) % 4 == 0, "calibrate", "fit")
    return x, y, fold


def test_kernel_fit_equals_a_dense_solve(spark):
    x, y, fold = labelled_rows(900, 1)
    schema = ", ".join(f"{c} double" for c in kernel_quality.STATS) + ", label int, fold string"
    frame = spark.createDataFrame([(*map(float, r), int(b), str(f)) for r, b, f in zip(x, y, fold, strict=True)], schema).repartition(7)
    model = kernel_quality.fit(frame, features=64, ridge=0.01, bins=50)
    mine = fold == "fit"
    assert model.mean == pytest.approx(x[mine].mean(0)) and model.scale == pytest.approx(x[mine].std(0))
    f = model.features(x[mine])
    penalty = 0.01 * mine.sum() / 65 * np.diag([1.0] * 64 + [0.0])
    beta = np.linalg.solve(f.T @ f + penalty, f.T @ y[mine])
    assert model.raw(x) == pytest.approx(model.features(x) @ beta, abs=1e-6)

    raw, label = model.raw(x[~mine]), y[~mine]
    bins = np.clip((raw + 0.5) / 2 * 50, 0, 49).astype(int)
    found = sorted(set(bins.tolist()))
    n, p = (np.array([v[bins == b].sum() for b in found], float) for v in (np.ones(len(label)), label))
    # The non-decreasing fit by its definition: the largest of the least averages around a place.
    want = [max(min(p[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
    assert model.values == pytest.approx(want)
    assert model.edges == pytest.approx([(b + 0.5) / 50 * 2 - 0.5 for b in found])


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(2)
    gamma, n, k = 0.08, 4096, len(kernel_quality.STATS)
    model = kernel_quality.Model(np.zeros(k), np.ones(k), rng.normal(0, np.sqrt(2 * gamma), (n, k)), rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(0, 1, (40, k))
    f = model.features(x)[:, :-1]
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - exact).max() < 0.1
    assert np.abs(f @ f.T - exact).mean() < 0.02


def test_scores_approach_exact_kernel_ridge_with_more_features(spark):
    x, y, fold = labelled_rows(700, 3)
    schema = ", ".join(f"{c} double" for c in kernel_quality.STATS) + ", label int, fold string"
    frame = spark.createDataFrame([(*map(float, r), int(b), str(f)) for r, b, f in zip(x, y, fold, strict=True)], schema)
    mine = fold == "fit"
    n, penalty = int(mine.sum()), 1.0
    models = {k: kernel_quality.fit(frame, features=k, ridge=penalty * (k + 1) / n) for k in (64, 2048)}
    z = np.clip((x - models[64].mean) / models[64].scale, -8, 8)
    kernel = np.exp(-0.08 * ((z[:, None] - z[mine][None]) ** 2).sum(-1))
    # Ridge with a free offset, in the kernel's own space.
    system = np.block([[kernel[mine] + penalty * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.append(y[mine], 0.0))
    exact = kernel @ solved[:-1] + solved[-1]
    error = {k: float(np.sqrt(((m.raw(x) - exact) ** 2).mean())) for k, m in models.items()}
    # The error falls as one over the root of the features: 32 times as many, 5.7 times less.
    assert error[2048] < error[64] / 3


def gain(p, n, p0, n0):
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_condition_is_the_best_of_all(spark, seed):
    rng = np.random.default_rng(seed)
    n = 600
    x = np.round(rng.random((n, 3)) * 20) / 20
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.8) | (rng.random(n) < 0.02)).astype(int)
    part = np.where(np.arange(n) % 3 == 0, "prune", "grow")
    frame = spark.createDataFrame([(int(b), str(p), *map(float, r)) for b, p, r in zip(bad, part, x, strict=True)], "bad int, part string, a double, b double, c double")
    rules = quality_rules.learn_decision_list(frame, ("a", "b", "c"), steps=200, max_rules=1, max_conditions=1, min_precision=0.0)
    grow = part == "grow"
    p0, n0 = int(bad[grow].sum()), int((1 - bad[grow]).sum())
    hits = lambda f, cut, above: grow & ((x[:, f] > cut) == above)
    cover = lambda rows: (int(bad[rows].sum()), int((1 - bad[rows]).sum()))
    best = max(gain(*cover(hits(f, cut, above)), p0, n0) for f in range(3) for cut in sorted(set(x[:, f])) for above in (True, False) if cover(hits(f, cut, above))[0] >= 3)
    (condition,) = rules.rules[0]
    got = gain(*cover(hits("abc".index(condition.feature), condition.threshold, condition.above)), p0, n0)
    assert got == pytest.approx(best)


def test_verdicts_equal_the_rules_row_by_row(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(400, 0.5, 0.5), (401, 0.25, 0.75)]
    rule = quality_rules.Condition
    listed = quality_rules.DecisionList([[rule("a", 0.5, True), rule("b", 0.75, False)], [rule("b", 0.9, True)]])
    got = {r["i"]: r["m"] for r in spark.createDataFrame(rows, "i int, a double, b double").select("i", listed.matched().alias("m")).collect()}
    assert got == {i: 0 if a > 0.5 and b <= 0.75 else 1 if b > 0.9 else -1 for i, a, b in rows}
