"""Distributed exact quantiles / modes, and stream scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.functions import quantile

from conftest import SF001


def test_exact_quantiles(spark):
    df = spark.range(3001).select("id", ((F.col("id") * 7919) % 1013 / 7.0).alias("a"),
                                  F.when(F.col("id") % 5 == 0, None)
                                  .otherwise(F.col("id") % 17).cast("double").alias("b"))
    got = quantile.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75, 0.9])
    pdf = df.toPandas()
    for j, c in enumerate(["a", "b"]):
        v = pdf[c].dropna().to_numpy()
        assert got[j] == pytest.approx(list(np.percentile(v, [25, 50, 75, 90])), abs=1e-12)
    m = quantile.modes(df, ["b"])[0]
    vals, cnt = np.unique(pdf["b"].dropna(), return_counts=True)
    assert m == vals[np.argmax(cnt)]


def test_stream_scoring_equals_batch(spark):
    from tablelearn.operators import scale
    from tablelearn.session import table_path
    from tablelearn.sources import tables as tb
    from tablelearn.streaming import score
    cust = tb.f_cust(spark, SF001)
    model = scale.fit(cust, ["c_acctbal"], "standard")
    batch = {r.c_custkey: r.c_acctbal for r in model.transform(cust).collect()}
    stream = score.parquet_stream(spark, table_path(SF001, "customer"))
    out = score.run_available(spark, stream, lambda s: model.transform(
        s.select("c_custkey", "c_acctbal"), keep=["c_custkey", "c_acctbal"]))
    got = {r.c_custkey: r.c_acctbal for r in out.collect()}
    assert got.keys() == batch.keys()
    assert all(got[k] == pytest.approx(batch[k]) for k in got)
