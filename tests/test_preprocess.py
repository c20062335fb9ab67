"""Scaling, encoding, imputation, text parsing and feature scores."""

import math

import pytest
from pyspark.sql import functions as F

from tablelearn.operators import encode, impute, scale, select
from tablelearn.sources import text

from conftest import frame


def ref_scale(spark):
    # the reference README's 3x3 scaling example
    return frame(spark, [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (2, 7.0, 8.0, 9.0)],
                 "id long, x0 double, x1 double, x2 double")


def test_standard_golden(spark):
    out = scale.scale(ref_scale(spark), ["x0", "x1", "x2"], "standard").orderBy("id").collect()
    for r, want in zip(out, [-1.2247449, 0.0, 1.2247449]):
        for c in ("x0", "x1", "x2"):
            assert r[c] == pytest.approx(want, abs=1e-6)


def test_scaled_mean_zero_std_one(spark):
    df = spark.range(200).select("id", (F.col("id") * 3.7 % 11).alias("x"),
                                 F.lit(5.0).alias("const"))
    out = scale.scale(df, ["x", "const"], "standard")
    a = out.agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("const"))).first()
    assert a[0] == pytest.approx(0, abs=1e-12)
    assert a[1] == pytest.approx(1, abs=1e-12)
    assert a[2] == 0.0  # constant column: scale 1, centred to 0


def test_minmax_constant_column_is_zero(spark):
    df = frame(spark, [(0, 2.0, 1.0), (1, 2.0, 3.0)], "id long, c double, x double")
    out = scale.scale(df, ["c", "x"], "minmax").orderBy("id").collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert [r.x for r in out] == [0.0, 1.0]


def test_robust_uses_interpolated_quartiles(spark):
    df = frame(spark, [(i, float(v)) for i, v in enumerate([1, 2, 3, 10])], "id long, x double")
    m = scale.fit(df, ["x"], "robust")
    assert m.center == [2.5]
    assert m.scale[0] == pytest.approx(4.75 - 1.75)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        scale.fit(ref_scale(spark), ["x0"], "zscore")


def test_label_encoding_golden(spark):
    df = frame(spark, [(0, "cat"), (1, "dog"), (2, "bird"), (3, "cat")], "id long, c string")
    enc = encode.encode_label(df, "c")
    assert {r.value: r.code for r in enc.mapping.collect()} == {"bird": 0, "cat": 1, "dog": 2}
    assert [r.code for r in enc.encoded.orderBy("id").collect()] == [1, 2, 0, 1]
    assert enc.n_classes == 3


def test_onehot_and_ordinal(spark):
    df = frame(spark, [(0, "cat", "dog"), (1, "bird", "cat")], "id long, c0 string, c1 string")
    oh = encode.encode_onehot(df, ["c0", "c1"])
    assert oh.columns == ["id", "c0_bird", "c0_cat", "c1_cat", "c1_dog"]
    assert [tuple(r)[1:] for r in oh.orderBy("id").collect()] == [(0, 1, 0, 1), (1, 0, 1, 0)]
    od = encode.encode_ordinal(df, ["c0", "c1"]).orderBy("id").collect()
    assert [(r.c0, r.c1) for r in od] == [(1.0, 1.0), (0.0, 0.0)]
    unseen = frame(spark, [(5, "emu", "dog")], "id long, c0 string, c1 string")
    with pytest.raises(ValueError):
        encode.encode_ordinal(unseen, ["c0", "c1"], maps=encode.ordinal_maps(df, ["c0", "c1"]))


def ref_missing(spark):
    return frame(spark, [(0, 1.0, 2.0, None), (1, 4.0, None, 6.0), (2, 7.0, 8.0, 9.0)],
                 "id long, x0 double, x1 double, x2 double")


def test_impute_mean_golden(spark):
    df = ref_missing(spark)
    m = impute.fit(df, ["x0", "x1", "x2"], "mean")
    assert m.fill == [4.0, 5.0, 7.5]
    st = impute.missing_stats(df, ["x0", "x1", "x2"], m).agg(
        F.sum("missing"), F.sum("total")).first()
    assert (st[0], st[1]) == (2, 9)


def test_impute_nan_is_missing_and_mode_smallest(spark):
    df = frame(spark, [(0, float("nan")), (1, 3.0), (2, 1.0), (3, 3.0), (4, 1.0)],
               "id long, x double")
    assert impute.fit(df, ["x"], "most_frequent").fill == [1.0]
    assert impute.fit(df, ["x"], "median").fill == [2.0]
    out = impute.impute(df, ["x"], "constant", 9.0).orderBy("id").first()
    assert out.x == 9.0


def test_text_rows_drop_empty_cells_and_rows(spark):
    df = frame(spark, [(1, " 1, 2 ;; 3,,4 ; "), (2, "nan,5")], "id long, t string")
    cells = text.rows_from_text_nulls(df, "t").orderBy("id", "row", "pos").collect()
    assert [(r.id, r.row, r.pos, r.value) for r in cells] == [
        (1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0),
        (2, 0, 0, None), (2, 0, 1, 5.0)]
    vec = text.values_from_text(frame(spark, [(1, "0,1, ,0")], "id long, t string"), "t")
    assert [r.value for r in vec.orderBy("pos").collect()] == [0.0, 1.0, 0.0]


def test_label_truncation(spark):
    df = frame(spark, [(0, 0.9), (1, -1.7), (2, 2.0)], "id long, y double")
    assert [r.y for r in df.select(text.label_to_int("y").alias("y")).collect()] == [0, -1, 2]


def test_f_classif_matches_closed_form(spark):
    rows = [(0, 1.0, 2.0, 3.0, 0), (1, 4.0, 5.0, 6.0, 1), (2, 7.0, 8.0, 9.0, 0)]
    df = frame(spark, rows, "id long, x0 double, x1 double, x2 double, y int")
    sc = {r.feature: r.score for r in select.f_classif(df, ["x0", "x1", "x2"], "y").collect()}
    # group 0: {1, 7} mean 4, group 1: {4}; grand mean 4 -> SSB = 0 -> F = 0
    assert sc["x0"] == pytest.approx(0.0)
    ranked, proj = select.select_k_best(df, ["x0", "x1", "x2"], "y", k=2)
    assert ranked.where("selected").count() == 2
    assert len(proj.columns) == 3


def test_f_regression(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"),
                                (F.col("id") * 2 + F.sin("id")).alias("y"))
    r = select.f_regression(df, ["x"], "y").first()
    c = df.agg(F.corr("x", "y")).first()[0]
    assert r.score == pytest.approx(c * c / (1 - c * c) * 48)
    assert math.isfinite(r.score)
