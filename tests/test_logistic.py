"""Penalised and softmax logistic regression by their optimality conditions, in plain numpy."""

import numpy as np
import pytest

from tablelearn.operators import logistic


def table(spark, classes, n=150):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 0.0]
    y = np.argmax(x[:, :1] * np.arange(classes) + rng.gumbel(size=(n, classes)), axis=1)
    df = spark.createDataFrame([(*map(float, r), f"c{c}") for r, c in zip(x, y)], "a double, b double, c double, y string")
    return x, y, df


def gradient(model, x, y):
    """Of the summed loss, for each row of coefficients and (intercept, features)."""
    m = x @ model.coef.T + model.intercept
    if len(model.classes) == 2:
        m = np.hstack([np.zeros((len(x), 1)), m])
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    miss = (p - (y[:, None] == np.arange(p.shape[1])))[:, p.shape[1] - len(model.coef):]
    return miss.T @ np.hstack([np.ones((len(x), 1)), x])


@pytest.mark.parametrize("classes,penalty,ratio,C", [
    (2, "l1", 1.0, 0.05), (2, "elasticnet", 0.5, 0.1), (3, "l2", 0.0, 1.0), (3, "l1", 1.0, 0.1), (3, "none", 0.0, None)])
def test_optimality(spark, classes, penalty, ratio, C):
    x, y, df = table(spark, classes)
    m = logistic.fit(df, list("abc"), "y", C=C or 1.0, penalty=penalty, l1_ratio=ratio)
    assert m.converged and m.residual < 1e-9 and m.summary(spark).first().converged
    g, lam = gradient(m, x, y), 1 / C if C else 0.0
    assert np.allclose(g[:, 0], 0, atol=1e-6)
    pull = g[:, 1:] + lam * (1 - ratio) * m.coef
    zero = m.coef == 0
    assert np.allclose((pull + lam * ratio * np.sign(m.coef))[~zero], 0, atol=1e-6)
    assert (np.abs(pull[zero]) <= lam * ratio + 1e-6).all()
    assert zero.any() or penalty != "l1"
    if classes > 2:
        assert abs(m.intercept.sum()) < 1e-9


def test_same_as_plain_newton(spark):
    _, _, df = table(spark, 2)
    one = logistic.fit(df, list("abc"), "y", C=0.7)
    other = logistic.proximal_newton(df, list("abc"), "y", ["c0", "c1"], C=0.7)
    assert np.allclose(one.coef, other.coef, atol=1e-7) and np.allclose(one.intercept, other.intercept, atol=1e-7)


def test_gaps_and_separable_classes(spark):
    df = spark.createDataFrame([(float(i), "abc"[i // 10]) for i in range(30)] + [(None, "a")], "x double, y string")
    with pytest.raises(ValueError, match="1 rows"):
        logistic.fit(df, ["x"], "y")
    assert not logistic.fit(df.dropna(), ["x"], "y", penalty="none", max_iter=200).converged
