"""Grids as ESRI ASCII text, GeoTIFF bytes and UTM projection text. A raster of at most some millions of nodes is written by one process."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODATA = -9999


def asc_lines(grid: DataFrame, z: str = "z") -> DataFrame:
    """K5: a line of text for each row of nodes; NULL as NODATA."""
    text = F.coalesce(F.col(z).cast("string"), F.lit(str(NODATA)))
    return grid.groupBy("iy").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(F.col("ix").alias("ix"), text.alias("t")))), lambda p: p["t"])).alias("line"))


def dense(grid: DataFrame, nx: int, ny: int, z: str = "z") -> np.ndarray:
    out = np.full((ny, nx), np.nan)
    for r in grid.select("iy", "ix", z).toLocalIterator():
        if r[z] is not None:
            out[r["iy"], r["ix"]] = r[z]
    return out


def asc_text(grid: DataFrame, spec: tuple[float, float, float, int, int], z: str = "z") -> str:
    """K5: the whole file, north row first."""
    x0, y0, cell, nx, ny = spec
    a = dense(grid, nx, ny, z)
    head = f"ncols {nx}\nnrows {ny}\nxllcorner {x0:.6f}\nyllcorner {y0:.6f}\ncellsize {cell:g}\nNODATA_value {NODATA}\n"
    return head + "\n".join(" ".join(str(NODATA) if np.isnan(v) else f"{v:.6g}" for v in row) for row in a[::-1]) + "\n"


def geotiff(a: np.ndarray, x0: float, y0: float, cell: float, epsg: int | None) -> bytes:
    """K6: one float32 band, north row first, with pixel scale, tie point, geo keys and no-data value."""
    ny, nx = a.shape
    data = np.where(np.isnan(a), NODATA, a)[::-1].astype("<f4").tobytes()
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg] if epsg else [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1]
    nodata = f"{NODATA}\0".encode()
    tags = [
        (256, "I", [nx]), (257, "I", [ny]), (258, "H", [32]), (259, "H", [1]), (262, "H", [1]), (273, "I", [0]), (277, "H", [1]), (278, "I", [ny]), (279, "I", [len(data)]), (339, "H", [3]),
        (33550, "d", [cell, cell, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y0 + ny * cell, 0.0]), (34735, "H", keys), (42113, "s", nodata),
    ]
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", []
    where = at + sum(len(b) + len(b) % 2 for _, k, v in tags for b in [v if k == "s" else struct.pack(f"<{len(v)}{k}", *v)] if len(b) > 4)
    for tag, kind, v in tags:
        if tag == 273:
            v = [where]
        body = v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        code = {"I": 4, "H": 3, "d": 12, "s": 2}[kind]
        if len(body) > 4:
            entries.append(struct.pack("<HHII", tag, code, len(v), at + len(extra)))
            extra += body + b"\0" * (len(body) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, code, len(v)) + body.ljust(4, b"\0"))
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + extra + data


def prj_wkt(epsg: int) -> str:
    """K7: the projection text of a WGS 84 UTM zone; other codes aren't supported."""
    zone, north = epsg % 100, epsg // 100 == 326
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} isn't a WGS 84 UTM zone")
    return (
        f'PROJCS["WGS_1984_UTM_Zone_{zone}{"N" if north else "S"}",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'
        f'PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",{0.0 if north else 10000000.0}],PARAMETER["Central_Meridian",{zone * 6 - 183}.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    )
