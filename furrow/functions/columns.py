"""Column expressions: names, units, times, projections, simple physics. Missing values are NULL, never NaN."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel columns by mode, aliases, auxiliary channels and their units, key columns, formats.
CHANNEL_PATTERNS = {
    "EC": r"^EC(\d+(?:\.\d+)?)Hz\[mS/m\]$",
    "MS": r"^MSusc(\d+(?:\.\d+)?)Hz\[1/1000\]$",
    "I": r"^I_(\d+(?:\.\d+)?)Hz$",
    "Q": r"^Q_(\d+(?:\.\d+)?)Hz$",
}
CHANNEL_FORMATS = {"EC": "EC{}[mS/m]", "MS": "MSusc{}[1/1000]", "I": "I_{}", "Q": "Q_{}"}
UNITS = {"EC": "mS/m", "MS": "1/1000", "I": "ppm", "Q": "ppm"}
AUX_UNITS = {"PowerLn": "mG", "QSum": "ppm", "TotalEC[mS/m]": "mS/m", "ECqdiff[mS/m]": "mS/m", "MagViscosity[1/1000]": "1/1000"}
EARTH_RADIUS_M = 6_371_008.8
MU_0 = 4e-7 * math.pi
DAY_S, HALF_DAY_S = 86_400.0, 43_200.0


def number(column: str | Column) -> Column:
    """A double, or NULL for what isn't a finite number."""
    v = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def find_channels(columns: list[str]) -> dict[str, dict[str, str]]:
    """{mode: {label: column}} of a header; labels such as 4525Hz."""
    out: dict[str, dict[str, str]] = {}
    for c in columns:
        for mode, pattern in CHANNEL_PATTERNS.items():
            if m := re.match(pattern, c):
                out.setdefault(mode, {})[f"{m[1]}Hz"] = c
        if c in AUX_UNITS:
            out.setdefault("AUX", {})[c] = c
    return out


def channel_column(mode: str, label: str) -> str:
    return label if mode == "AUX" else CHANNEL_FORMATS[mode].format(label)


def rename_map(columns: list[str]) -> dict[str, str]:
    """Alias columns (Ip_, Qd_) to their canonical names, unless those are taken."""
    out = {}
    for c in columns:
        for alias, own in (("Ip_", "I_"), ("Qd_", "Q_")):
            to = own + c.removeprefix(alias)
            if c.startswith(alias) and re.match(CHANNEL_PATTERNS[own[0]], to) and to not in columns:
                out[c] = to
    return out


def is_survey_header(columns: list[str]) -> bool:
    """Whether a header has Line, Y and a frequency channel, once aliases are renamed."""
    names = [rename_map(columns).get(c, c) for c in columns]
    return {"Line", "Y"} <= set(names) and bool(set(find_channels(names)) & set(CHANNEL_PATTERNS))


def frequency_hz(label: Column) -> Column:
    """Hz of a label: a bare number, or one with Hz or kHz in any case; else NULL."""
    p = r"^\s*(\d+(?:\.\d+)?)\s*([kK]?[hH][zZ])?\s*$"
    scale = F.when(F.lower(F.regexp_extract(label, p, 2)) == "khz", 1000.0).otherwise(1.0)
    return F.regexp_extract(label, p, 1).try_cast("double") * scale


def line_text(v: Column) -> Column:
    """A numeric line label as text: 7.0 is "7"."""
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def packed_time_s(v: Column) -> Column:
    """Seconds of a number written hhmmss.sss."""
    return F.floor(v / 10000) * 3600 + F.floor(F.pmod(v, F.lit(10000.0)) / 100) * 60 + F.pmod(v, F.lit(100.0))


def metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres east and north of an origin in degrees."""
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M


def degrees(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(lat0)))), lat0 + F.degrees(y / EARTH_RADIUS_M)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


# WGS 84 and the UTM scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm_xy(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the third order of n, as column expressions (under a millimetre in a zone)."""
    n = _F / (2 - _F)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum(al[j - 1] * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j in (1, 2, 3))
    y = xi + sum(al[j - 1] * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j in (1, 2, 3))
    return 500_000 + _K0 * a * x, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + _K0 * a * y


def ec_at_25(ec: Column, celsius: Column) -> Column:
    return ec * (0.4470 + 1.4034 * F.exp(-celsius / 26.815))


def skin_depth(sigma: Column, hz: Column) -> Column:
    """Metres; infinite where nothing conducts."""
    return F.when(sigma > 0, F.sqrt(2 / (2 * math.pi * hz * MU_0 * F.when(sigma > 0, sigma)))).otherwise(float("inf"))


def induction_number(sigma: Column, hz: Column, separation: float = 1.66) -> Column:
    return separation / skin_depth(sigma, hz)


def lin_ppm_per_sigma(hz: Column, height: float = 1.0, separation: float = 1.66, bucking: float = 1.035) -> Column:
    """ppm per S/m at low induction numbers, of the receiver less the bucking coil."""
    pair = sum(sign * r * r / math.sqrt(4 * (height / r) ** 2 + 1) for sign, r in ((1, separation), (-1, bucking)))
    return 1e6 * (2 * math.pi * hz) * MU_0 / 4 * pair


def viscosity_per_decade(kappa_q: Column) -> Column:
    return 2 * math.log(10) / math.pi * kappa_q


def significant(v: Column, digits: int = 2) -> Column:
    """Positive finite values to so many significant figures; others as they are."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.when(v > 0, v))))
    return F.when(v > 0, F.bround(v * power) / power).otherwise(v)


# Axis labels.
VALUE_LABELS = {"EC": "EC (mS/m)", "MS": "MS (10⁻³ SI)", "I": "In-phase (ppm)", "Q": "Quadrature (ppm)"}
AUX_VALUE_LABELS = {"PowerLn": "Power-line noise (mG)", "QSum": "Quadrature sum (ppm)", "TotalEC[mS/m]": "Total EC (mS/m)", "ECqdiff[mS/m]": "EC from quadrature difference (mS/m)", "MagViscosity[1/1000]": "Magnetic viscosity κ″ (10⁻³ SI)"}


def value_label(mode: Column, channel: Column) -> Column:
    """The axis label of a channel; auxiliary channels have their own, or their name."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    aux = F.coalesce(table(AUX_VALUE_LABELS)[channel], F.when(channel != "", channel), F.lit("Auxiliary channel"))
    return F.when(mode == "AUX", aux).otherwise(F.coalesce(table(VALUE_LABELS)[mode], mode))


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute and a half, minutes below an hour, then hours and minutes; a dash where unknown."""
    known = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    m = F.bround(seconds / 60).cast("long")
    short = F.concat(F.bround(seconds).cast("long").cast("string"), F.lit(" s"))
    long = F.concat((m / 60).cast("long").cast("string"), F.lit(" h "), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(" min"))
    return F.when(~known, "—").when(seconds < 90, short).when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(long)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with its noun."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def summary_text(lines: Column, readings: Column, length: Column, spacing: Column, seconds: Column) -> Column:
    """The size of a survey in a line; what isn't known is left out."""
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    parts = [
        bold(counted(lines, "line")), bold(counted(readings, "reading")),
        F.when(known(length), F.concat(bold(F.concat(F.format_number(length, 0), F.lit(" m"))), F.lit(" along the lines"))),
        F.when(known(spacing), F.concat(F.lit("readings "), bold(F.concat(F.format_string("%.3g", spacing), F.lit(" m"))), F.lit(" apart"))),
        F.when(seconds.isNotNull(), F.concat(bold(duration_text(seconds)), F.lit(" of recording"))),
    ]
    return F.concat_ws(" · ", *parts)
