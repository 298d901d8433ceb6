"""Files in and out, headers, settings, preparation."""

import io
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import prepare as R
from furrow.sources import rasters, tables
from furrow.sources import tables as T


def survey(lines=3, n=40, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for line in range(lines):
        ys = np.arange(n) * 0.5 if line % 2 == 0 else (n - 1 - np.arange(n)) * 0.5
        for k, y in enumerate(ys):
            rows.append((line * n + k, str(line), 36000.0 + (line * n + k) * 0.2, 5.0 * line, float(y), 0.0, float(k // 10), "1525Hz", float(20 + 5 * np.exp(-((y - 10) ** 2) / 8) + 0.05 * r.standard_normal())))
    return rows


SCHEMA = "rid long, line string, t double, x double, y double, status double, mark double, label string, value double"


def test_headers():
    cols = ["Line", "Y", "EC475.5Hz[mS/m]", "MSusc1525Hz[1/1000]", "Ip_1525Hz", "PowerLn"]
    assert C.rename_map(cols) == {"Ip_1525Hz": "I_1525Hz"}
    found = C.find_channels(["EC475.5Hz[mS/m]", "I_1525Hz", "PowerLn"])
    assert found == {"EC": {"475.5Hz": "EC475.5Hz[mS/m]"}, "I": {"1525Hz": "I_1525Hz"}, "AUX": {"PowerLn": "PowerLn"}}
    assert C.channel_column("EC", "475.5Hz") == "EC475.5Hz[mS/m]" and C.is_survey_header(cols) and not C.is_survey_header(["Line", "Y"])


def test_csv_keeps_its_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Line,Y,EC1525Hz[mS/m],MSusc1525Hz[1/1000]\n" + "".join(f"1,{k},{k * 2},{k + 0.5}\n" for k in range(500)) + "1,x,,\n")
    df = tables.normalised(tables.read_csv(spark, str(tmp_path / "a.csv")))
    assert tables.accepted(df)
    assert [r["Y"] for r in df.orderBy("rid").limit(3).collect()] == ["0", "1", "2"]
    assert tables.whole_number_columns(df, ["EC1525Hz[mS/m]", "MSusc1525Hz[1/1000]"]) == ["EC1525Hz[mS/m]"]
    long = tables.long_form(df, C.find_channels(df.columns), ["rid"])
    assert long.count() == 1002 and long.where("value is null").count() == 2


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert [r["n"] for r in df.select(C.number("v").alias("n")).collect()] == [1.5, None, None, None, None]


def test_workbook_round_trip():
    body = tables.write_xlsx({"a/b": pd.DataFrame({"x": [1.5, None], "y": ["p<q", "é"]}), "a:b": pd.DataFrame({"z": [1]})})
    back = tables.read_xlsx(body)
    assert back.columns.tolist() == ["x", "y"] and back["x"].tolist() == ["1.5", None] and back["y"].tolist() == ["p<q", "é"]
    assert tables.sheet_names(["a/b", "a:b", "x" * 40]) == ["a_b", "a_b_2", "x" * 31]


def test_settings():
    text = tables.settings_text({"a": 1, "b": [1, 2], "c": "old"})
    assert tables.parse_settings(text, {"a", "b", "c"}, {"c": ("new",)}) == {"a": 1, "b": (1, 2)}
    with pytest.raises(ValueError):
        tables.parse_settings("[]", set())


def test_sniffing_and_offsets():
    assert tables.sniffed("a;b\n1;2\n".encode()) == ("utf-8-sig", ";")
    assert tables.read_offsets("column,offset\nI_1525Hz,2.5\n") == {"I_1525Hz": 2.5}
    with pytest.raises(ValueError):
        tables.read_offsets("x,y\n1,2\n")


def test_rasters(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, None)], "iy long, ix long, z double")
    text = rasters.asc_text(g, (0.0, 0.0, 1.0, 2, 2))
    assert text.splitlines()[-2:] == ["3 -9999", "1 2"]
    tif = rasters.geotiff(np.array([[1.0, 2.0], [3.0, np.nan]]), 10.0, 20.0, 1.0, 32634)
    n = struct.unpack_from("<H", tif, 8)[0]
    tags = {t: (k, c, v) for t, k, c, v in struct.iter_unpack("<HHII", tif[10 : 10 + 12 * n])}
    at = tags[273][2]
    assert np.frombuffer(tif[at : at + 16], "<f4").tolist() == [3.0, -9999.0, 1.0, 2.0]
    assert 'Zone_34N' in rasters.prj_wkt(32634)
    with pytest.raises(ValueError):
        rasters.prj_wkt(2100)


def test_utm_and_projection(spark):
    x, y = C.utm_xy(F.col("lon"), F.col("lat"), F.lit(34))
    df = spark.createDataFrame([(21.0, 0.0), (23.7, 37.9)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert (df[0]["x"], df[0]["y"]) == pytest.approx((500000, 0), abs=1e-3)
    assert (df[1]["x"], df[1]["y"]) == pytest.approx((737323.7, 4198072.0), rel=1e-3)
    lon, lat = C.degrees(F.lit(1000.0), F.lit(-500.0), F.lit(23.0), F.lit(37.0))
    back = C.metres(lon, lat, F.lit(23.0), F.lit(37.0))
    r = spark.range(1).select(back[0].alias("x"), back[1].alias("y")).first()
    assert (r["x"], r["y"]) == pytest.approx((1000, -500))


@pytest.mark.parametrize("how", ["sample", "markers", "path", "projection", "y"])
def test_distances(spark, how):
    df = spark.createDataFrame(survey(), SCHEMA)
    out = R.with_distance(df, R.Settings(distance=how, spacing=0.5)).where("dist is not null")
    assert out.agg(F.max("dist") - F.min("dist")).first()[0] > 0.9


def test_preparation_counts_dropped_readings(spark):
    rows = [(*r[:5], 3.0 if r[0] % 40 == 5 else 0.0, *r[6:]) for r in survey()]
    out = R.prepared(spark.createDataFrame(rows, SCHEMA), R.Settings(distance="sample"))
    assert out.count() == 117 and out.where("line = '0'").agg(F.max("dist")).first()[0] == 39


def test_drift_is_removed(spark):
    rows = [(k, line, 36000.0 + t, 0.0, float(k), 0.0, 0.0, "e", v + 3 * t / 3600) for k, (line, t, v) in enumerate([("B0", 0, 10.0), ("1", 1000, 20.0), ("B1", 2000, 10.0), ("2", 3000, 30.0), ("B2", 4000, 10.0)])]
    out = R.drift_by_channel(spark.createDataFrame(rows, SCHEMA), R.Settings(base_lines=("B0", "B1", "B2"), drift=True))
    assert {r["line"]: round(r["value"], 6) for r in out.collect()} == {"1": 20.0, "2": 30.0}


def test_lag_is_found(spark):
    rows = []
    for line in range(4):
        for k in range(81):
            y = 0.5 * k if line % 2 == 0 else 0.5 * (80 - k)
            rows.append((line * 81 + k, str(line), (line * 81 + k) * 0.5, 1.0 * line, y, 0.0, 0.0, "e", float(10 * np.sin((y - (0.6 if line % 2 == 0 else -0.6)) / 2))))
    out = R.lag_costs(spark.createDataFrame(rows, SCHEMA), 3.0, (-1.2, -0.6, 0.0, 0.6, 1.2))
    assert out.orderBy("cost").first()["lag"] == pytest.approx(0.6)


def test_tracks_fold(spark):
    from furrow.operators.aggregates import tracks

    df = spark.createDataFrame([("a", 0.0), ("b", 0.8), ("c", 1.6), ("d", 5.0)], "line string, pos double")
    assert {r["line"]: r["track"] for r in tracks(df).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_area_map_refuses_a_transect(spark):
    rows = [(k, float(k), 0.001 * (k % 2), 1.0, "1") for k in range(50)]
    with pytest.raises(ValueError, match="transect"):
        R.area_map(spark.createDataFrame(rows, "rid long, x double, y double, v double, line string"), "idw")


def test_follow_reads_each_file_once(spark, tmp_path):
    from furrow.streaming.readings import follow

    df = spark.createDataFrame(survey(1, 10), SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        follow(spark, f"{tmp_path}/in", df.schema, lambda b, k: seen.append(b.count()), f"{tmp_path}/at").awaitTermination(60)
    assert sum(seen) == 10


def test_choice_of_positions(spark):
    from furrow.operators import positions as Q

    rows = [(23 + k * 1e-4, 37.0, float(k), 2.0) for k in range(12)]
    df = spark.createDataFrame(rows, "Lon double, LATITUDE double, X double, Y double")
    assert Q.choose(df) == Q.Choice("Lon", "LATITUDE", True)
    assert Q.choose(df.limit(9)) == Q.Choice("X", "Y", False)
    assert Q.choose(df.select("X", "Y"), "degrees").is_degrees
    with pytest.raises(ValueError):
        Q.choose(df.select("X"))
    assert Q.with_metres(df, utm=True)[2] == 32634 and Q.epsg_problem(2100) and Q.epsg_problem(32634) is None
    assert Q.layers([{"thickness": 1.0, "ec": 20.0, "ms": None}, {"ec": None}, {"ec": 50.0, "ms": 1.0}]) == ([0.02, 0.05], [0.0, 0.001], [1.0])
    assert Q.frequencies("1525, 475; 1525") == [475.0, 1525.0]


def test_reference_points_and_offsets(spark, tmp_path):
    (tmp_path / "ref.csv").write_text("x,y,EC1,EC2\n1,2,3.5,\n4,5,x,7\n,5,1,1\n")
    got = sorted((r["label"], r["x"], r["y"], r["ref"]) for r in T.read_reference(spark, str(tmp_path / "ref.csv")).collect())
    assert got == [("EC1", 1.0, 2.0, 3.5), ("EC2", 4.0, 5.0, 7.0)]
    assert T.read_offsets(T.offsets_text({"I_1Hz": 1.5, "Q, 2": -2.0})) == {"I_1Hz": 1.5, "Q, 2": -2.0}


def test_placed_rows_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 1, 0.9), (None, 2.0, 2, 0.5), (3.0, 4.0, None, 0.1)], "x double, y double, zone int, membership_1 double")
    out = T.placed(df, ["zone", "membership_1"], (23.0, 37.0))
    T.write_csv(out, str(tmp_path / "zones"))
    back = spark.read.csv(str(tmp_path / "zones"), header=True, inferSchema=True)
    assert back.columns == ["x", "y", "lon", "lat", "zone", "membership_1"] and back.count() == 1 and abs(back.first()["lat"] - 37 - 2 / 111195) < 1e-7


def test_archive_of_all_channels(spark):
    import zipfile

    from furrow.operators import prepare as R

    rows = [(k, c, "l", float(k % 12), float(k // 12), float(k % 12 + k // 12)) for c in ("a", "b") for k in range(144)] + [(0, "few", "l", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "rid long, label string, line string, x double, y double, v double")
    body = T.channel_maps(df, ["a", "few", "b"], lambda p: R.area_map(p, "idw", cell=2.0), 32634)
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        assert {f"survey_{c}.{e}" for c in "ab" for e in ("csv", "asc", "tif", "prj")} | {"failed.txt"} == set(z.namelist())
        assert z.read("failed.txt").startswith(b"few: ")


def test_layer_grids_are_checked():
    from furrow.operators import inversion as V

    g = V.layer_grid(6.0, 15, 0.1)
    assert abs(g.sum() - 6) < 1e-9 and abs(g[1] / g[0] - g[-1] / g[-2]) < 1e-9 and g[0] == 0.1
    for bad in ((6.0, 1, 0.1), (6.0, 15, 0.6), (0.1, 3, 0.1), (1e9, 3, 0.1)):
        with pytest.raises(ValueError):
            V.layer_grid(*bad)
