"""A synthetic survey from its file to scores, a workbook and a map."""

import io
import zipfile

import numpy as np
import pytest
import synth
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import prepare as R
from furrow.operators import profiles as P
from furrow.sources import tables


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("survey") / "survey.csv"
    synth.survey().to_csv(at, index=False)
    df = tables.normalised(tables.read_csv(spark, str(at)))
    assert tables.accepted(df)
    found = C.find_channels(df.columns)
    assert {m: len(v) for m, v in found.items()} == {"EC": 5, "MS": 5, "I": 5, "Q": 5, "AUX": 1}
    keys = df.select("rid", F.col("Line").alias("line"), (C.number("Time[ms]") / 1000).alias("t"), C.number("X").alias("x"), C.number("Y").alias("y"), C.number("Status").alias("status"), C.number("Mark").alias("mark"))
    values = tables.long_form(df, {"EC": found["EC"]}, ["rid"]).drop("mode")
    return keys.join(values, "rid").cache()


def test_the_best_frequency_is_found(spark, long):
    p = R.prepared(long, R.Settings(distance="y", despike=5))
    assert p.where("status <> 0").count() == 0
    scores = P.scored(p, 0.5, ["label"]).orderBy(F.desc_nulls_last("score")).collect()
    assert len(scores) == 5 and scores[0]["label"] != "475Hz" and scores[-1]["label"] == "475Hz"
    assert scores[0]["n_traces"] == 7 and scores[0]["noise_method"] == "between passes"
    body = tables.batch_workbook(P.scored(p, 0.5, ["label"]), P.envelope(P.resampled(p, 0.5, ["label"]), ["label"]).withColumn("survey", F.lit("a/b")))
    assert tables.read_xlsx(body).shape[0] == 5
    names = zipfile.ZipFile(io.BytesIO(tables.profile_workbook(P.envelope(P.resampled(p, 0.5, ["label"]), ["label"])))).namelist()
    assert sum("worksheets/" in n for n in names) == 5


def test_drift_and_tracks(long):
    axis = R.line_axis(long.where("label = '1525Hz'"))
    assert axis is not None and abs(axis[1]) > 0.99
    t = {r["line"]: r["track"] for r in R.tracks_of(long.where("label = '1525Hz'")).collect()}
    assert len(set(t.values())) == 4 or len(set(t.values())) == 7


@pytest.mark.parametrize("method", ["idw", "kriging", "natural"])
def test_the_map_shows_the_target(spark, long, method):
    points = long.where("label = '18325Hz' and value is not null").select("rid", "x", "y", F.col("value").alias("v"), "line").withColumn("rid", F.monotonically_increasing_id())
    spec, blocks, grid = R.area_map(points, method, cell=0.5, level=False)
    rows = grid.where("z is not null").toPandas()
    top = rows.loc[rows.z.idxmax()]
    assert abs(top.x - 2) < 1 and abs(top.y - 6) < 1 and np.isfinite(rows.z).all()
    with pytest.raises(ValueError, match="ten"):
        R.area_map(points.limit(5), method)


def test_archive_lists_what_failed():
    z = zipfile.ZipFile(io.BytesIO(tables.map_archive({"a.csv": b"x"}, {"b": "too few readings"})))
    assert z.read("failed.txt") == b"b: too few readings\n"
