"""Quantiles by selection against sorted lists, and prefixes of batches against whole recomputation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.operators import calibration, quantiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, math.nextafter(1, 2), math.nextafter(1, 0), -1.0, 0.1, 3.0]


def test_order_key_orders_as_the_double(spark):
    r = random.Random(1)
    rows = ODD + [math.copysign(r.random() * 2.0 ** r.randint(-1070, 1020), r.random() - 0.5) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1060, 1024, 7)]
    got = spark.createDataFrame([(v,) for v in rows] + [(math.nan,)], "v double").select("v", quantiles.order_key(F.col("v")).alias("k")).collect()
    finite = sorted(((x.v, x.k) for x in got if not math.isnan(x.v)))
    assert all((a[0] < b[0]) == (a[1] < b[1]) and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(finite, finite[1:], strict=False))
    assert next(x.k for x in got if math.isnan(x.v)) > finite[-1][1]
    assert {x.v: x.k for x in got}[1.0] == 1023 * 2**52


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_against_numpy(spark, small, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(2)
    groups = {"one": [4.5], "two": [1.0, 2.0], "equal": [7.0] * 50, "wide": [r.uniform(-1, 1) * 10 ** r.randint(-8, 8) for _ in range(700)], "near": [1 + k * 2**-52 for k in range(400)], "ties": [r.choice([-0.5, 0.0, 0.25]) for _ in range(300)], None: [3.0, 9.0, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("gone", None), ("two", None)]
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {x.g: x for x in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, small).collect()}
    assert got.keys() == {*groups, "gone"} and (got["gone"].n, got["gone"].low, got["gone"].c) == (0, None, None)
    for g, vs in groups.items():
        x = got[g]
        assert (x.n, x.low, x.high) == (len(vs), min(vs), max(vs))
        assert [x[c] for c in qs] == pytest.approx(np.quantile(vs, list(qs.values())).tolist(), rel=1e-12, abs=0)


def test_whole_table_and_no_rows(spark):
    rows = spark.createDataFrame([(float(v),) for v in (3, 1, 2)] + [(None,)], "v double")
    assert quantiles.exact_quantiles(rows, [], "v", {"m": 0.5}).first().asDict() == {"n": 3, "low": 1.0, "high": 3.0, "m": 2.0}
    assert quantiles.exact_quantiles(rows.limit(0), [], "v", {"m": 0.5}).first().asDict() == {"n": 0, "low": None, "high": None, "m": None}
    assert quantiles.exact_quantiles(rows.withColumn("g", F.lit(1)).limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_prefixes_are_those_of_pooled_rows(spark):
    r = random.Random(4)
    rows = [(r.randrange(6) * 2, r.random(), r.random(), r.random() < 0.3, r.uniform(-1, 1) * r.choice([0.1, 1]), r.choice([0.0, 0.01, 0.03])) for _ in range(900)]
    rows = [x for x in rows if x[0] != 4] + [(2, None, 0.5, False, None, None)]
    df = spark.createDataFrame(rows, "batch int, control_0 double, control_1 double, used_replacement boolean, g_directed double, difference double")
    got = {x.prefix: x for x in calibration.prefix_search_scales(df).collect()}
    assert sorted(got) == sorted({x[0] for x in rows})
    for k, x in got.items():
        held = df.where(f"batch <= {k}").withColumn("kind", F.lit("all"))
        want = calibration.search_scale(held, held, ["kind"]).first()
        assert [x[c] for c in ("active", "limited")] == [want.active, want.limited]
        assert [x[c] for c in ("delta", "scale", "numeric_p95", "control_p75")] == pytest.approx([want.delta, want.scale, want.numeric_p95, want.control_p75])
