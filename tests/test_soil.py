"""Soil tools against small recoveries."""

import numpy as np
import pytest

from furrow.operators import soil as Z


def test_zones_are_found_and_ordered(spark):
    r = np.random.default_rng(0)
    rows = [(k, float(v)) for k, v in enumerate(np.r_[r.normal(5, 0.3, 60), r.normal(-5, 0.3, 60), r.normal(0, 0.3, 60)])]
    out, centres = Z.fuzzy_zones(spark.createDataFrame(rows, "id long, a double"), ["a"], 3)
    assert np.allclose(centres[:, 0], [-5, 0, 5], atol=0.3)
    zone = {x["id"]: x["zone"] for x in out.collect()}
    assert (zone[0], zone[60], zone[120]) == (3, 1, 2)
    i = Z.zone_indices(out, ["u1", "u2", "u3"]).first()
    assert 0 <= i["fpi"] < 0.1 and 0 <= i["mpe"] < 0.1


def test_property_is_recovered(spark):
    rows = [(float(x), float(np.exp(0.3 + 0.7 * np.log(x)))) for x in range(1, 40)] + [(-1.0, 2.0), (None, 1.0)]
    m = Z.property_fit(spark.createDataFrame(rows, "ec double, clay double"), ["ec"], "clay")
    assert m["coef"] == pytest.approx([0.3, 0.7]) and m["n"] == 39 and m["r2"] == pytest.approx(1)
    out = [x["predicted"] for x in Z.predicted(spark.createDataFrame(rows, "ec double, clay double"), m).collect()]
    assert out[0] == pytest.approx(np.exp(0.3)) and out[-1] is None and out[-2] is None


def test_constant_features_are_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [x["b"] for x in Z.standardised(df, ["a", "b"]).collect()] == [0.0, 0.0]


def test_design_spreads(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(x), float(y), float(x + 0.1 * q), float(y - x)) for k, (x, y, q) in enumerate(r.uniform(0, 10, (300, 3)))]
    s = Z.principal_scores(spark.createDataFrame(rows, "id long, x double, y double, a double, b double"), ["a", "b"])
    sites = Z.sampling_design(s, 8)
    assert len({x["id"] for x in sites}) == 8
    assert len(Z.design_targets(5, 1)) == 5 and Z.design_targets(5, 1)[2][0] == pytest.approx(0)


def test_redundant_channels_are_passed_over():
    got = dict(Z.select_channels([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", None)], {("a", "b"): 0.99}))
    assert got == {"a": "selected", "b": "redundant with a", "c": "selected", "d": "no score"}
