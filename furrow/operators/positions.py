"""Which columns are positions, whether they are degrees, and metres from them; all decided by one aggregate row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import metres, number, utm_epsg, utm_xy

# Names of geographic columns, the largest span of degrees in X and Y, usable fixes that geographic columns need.
LAT_NAMES, LON_NAMES, DEGREE_SPAN, FIXES = ("lat", "latitude"), ("lon", "long", "longitude"), 0.05, 10


@dataclass(frozen=True)
class Choice:
    x: str
    y: str
    is_degrees: bool


def degree_like(x: str, y: str) -> Column:
    """T6, an aggregate: all present values within the globe, and both spans under 0.05 degrees."""
    small = (F.max(x) - F.min(x) < DEGREE_SPAN) & (F.max(y) - F.min(y) < DEGREE_SPAN)
    return F.coalesce(small & (F.max(F.abs(x)) <= 180) & (F.max(F.abs(y)) <= 90), F.lit(False))


def choose(df: DataFrame, mode: str = "auto") -> Choice:
    """Longitude and latitude with ten usable fixes or more ((0, 0) is none); else X and Y, in degrees if told or if they look so."""
    lower = {c.strip().lower(): c for c in df.columns}
    lat, lon = (next((lower[n] for n in names if n in lower), None) for names in (LAT_NAMES, LON_NAMES))
    have_xy = "x" in lower and "y" in lower
    wanted = []
    if lat and lon:
        a, b = number(F.col(f"`{lat}`")), number(F.col(f"`{lon}`"))
        wanted.append(F.count_if(a.isNotNull() & b.isNotNull() & ~((a == 0) & (b == 0))).alias("fixes"))
    p = df
    if have_xy and mode == "auto":
        p = df.withColumns({"_vx": number(F.col(f"`{lower['x']}`")), "_vy": number(F.col(f"`{lower['y']}`"))})
        wanted.append(degree_like("_vx", "_vy").alias("like"))
    got = p.agg(*wanted).first().asDict() if wanted else {}
    if got.get("fixes", 0) >= FIXES:
        return Choice(lon, lat, True)
    if not have_xy:
        raise ValueError("the table has no position columns (X and Y, or longitude and latitude)")
    return Choice(lower["x"], lower["y"], {"degrees": True, "metres": False}.get(mode, got.get("like", False)))


def with_metres(df: DataFrame, mode: str = "auto", origin: tuple[float, float] | None = None, utm: bool = False, names: tuple[str, str] = ("x_m", "y_m")) -> tuple[DataFrame, tuple[float, float] | None, int | None]:
    """The table with positions in metres, the origin (degrees) and the EPSG code used. Readings at (0, 0) degrees have none. Local metres are taken about
    the origin or the mean position; UTM metres in the zone of that."""
    c = choose(df, mode)
    x, y = number(F.col(f"`{c.x}`")), number(F.col(f"`{c.y}`"))
    if not c.is_degrees:
        return df.withColumns({names[0]: x, names[1]: y}), None, None
    fixed = ~((x == 0) & (y == 0))
    x, y = F.when(fixed, x), F.when(fixed, y)
    if origin is None:
        m = df.agg(F.avg(x).alias("lon"), F.avg(y).alias("lat")).first()
        origin = (m["lon"], m["lat"])
    if origin[0] is None:
        return df.withColumns({n: F.lit(None).cast("double") for n in names}), None, None
    if utm:
        code = df.sparkSession.range(1).select(utm_epsg(F.lit(origin[0]), F.lit(origin[1])).alias("e")).first()["e"]
        e, n = utm_xy(x, y, F.lit(code % 100))
        return df.withColumns({names[0]: e, names[1]: n}), origin, code
    e, n = metres(x, y, F.lit(origin[0]), F.lit(origin[1]))
    return df.withColumns({names[0]: e, names[1]: n}), origin, None


def epsg_problem(code: int) -> str | None:
    """Why a code can't be used here, or nothing."""
    return None if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else f"EPSG:{code} isn't a WGS 84 UTM zone (32601 to 32660, 32701 to 32760)"


def layers(rows: list[dict]) -> tuple[list[float], list[float], list[float]]:
    """(conductivities in S/m, susceptibilities in SI, thicknesses in m) of a table of layers from the top (thickness, ec in mS/m, ms in 1/1000); rows without
    ec are passed over, the last one's thickness doesn't count."""
    own = [r for r in rows if r.get("ec") is not None]
    if not own:
        raise ValueError("a model needs one layer with a conductivity at least")
    thick = [r.get("thickness") for r in own[:-1]]
    if any(t is None or not t > 0 for t in thick):
        raise ValueError("all layers above the last need a positive thickness")
    if any(r["ec"] < 0 for r in own):
        raise ValueError("conductivities must not be negative")
    return [r["ec"] / 1000 for r in own], [(r.get("ms") or 0.0) / 1000 for r in own], thick


def frequencies(text: str) -> list[float]:
    """Numbers apart by commas, semicolons or blanks; positive ones in order, each once."""
    return sorted({float(t) for t in text.replace(";", " ").replace(",", " ").split() if float(t) > 0})


def transects(tracks: DataFrame | None, traces: list[str]) -> dict[int, list[str]] | None:
    """V5: {track: its lines} where lines lie on two tracks or more; None where they are passes of one, or their positions aren't known. One row a line."""
    if tracks is None:
        return None
    out: dict[int, list[str]] = {}
    for r in tracks.where(F.col("line").isin(traces)).orderBy("track", "line").collect():
        out.setdefault(r["track"], []).append(r["line"])
    return out if len(out) > 1 else None
