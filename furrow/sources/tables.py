"""Survey files in and out: CSV, XLSX (by the standard library alone), settings. Reading order is kept in a column."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.columns import degrees, is_survey_header, number, rename_map

SHEET_NAME = 31
ENCODINGS = ("utf-8-sig", "cp1253", "latin-1")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, and rid: the reading order across splits of a file, as (file, place in it, number within the split)."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    return df.withColumn("rid", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")))


def normalised(df: DataFrame) -> DataFrame:
    """Alias columns under their canonical names."""
    return df.withColumnsRenamed(rename_map(df.columns))


def accepted(df: DataFrame) -> bool:
    """S3: whether the header is that of a survey. No job runs."""
    return is_survey_header(df.columns)


def long_form(df: DataFrame, channels: dict[str, dict[str, str]], keep: list[str]) -> DataFrame:
    """(keep.., mode, label, value) with a row for each reading and channel; the value a finite number or NULL."""
    cols = [F.struct(F.lit(m).alias("mode"), F.lit(lab).alias("label"), number(F.col(f"`{c}`")).alias("value")) for m, labels in channels.items() for lab, c in labels.items()]
    return df.select(*keep, F.inline(F.array(*cols)))


def whole_number_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose present values are all whole, which hints at lost decimals; one pass."""
    r = df.agg(*[F.struct(F.count(number(F.col(f"`{c}`"))).alias("n"), F.bool_and(number(F.col(f"`{c}`")) % 1 == 0).alias("w")).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [c for k, c in enumerate(columns) if r[f"c{k}"]["n"] and r[f"c{k}"]["w"]]


def sniffed(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of the start of a file."""
    for e in ENCODINGS:
        try:
            text = head.decode(e)
            break
        except UnicodeDecodeError:
            continue
    try:
        return e, csv.Sniffer().sniff(text, delimiters=",;\t|").delimiter
    except csv.Error:
        return e, ","


def read_offsets(text: str) -> dict[str, float]:
    """{column: offset} of a two-column CSV."""
    rows = list(csv.DictReader(io.StringIO(text)))
    if not rows or not {"column", "offset"} <= set(rows[0]):
        raise ValueError("the file needs the columns column and offset")
    return {r["column"]: float(r["offset"]) for r in rows if r["column"]}


def settings_text(settings: dict, app: str = "furrow", version: str = "1") -> str:
    """S8"""
    return json.dumps({"app": app, "version": version, "settings": settings}, indent=2, ensure_ascii=False)


def parse_settings(text: str, known: set[str], choices: dict[str, tuple] | None = None) -> dict:
    """The known settings of a file; a choice that isn't offered any more keeps its default."""
    try:
        got = json.loads(text.lstrip("﻿"))["settings"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a settings file") from e
    if not isinstance(got, dict):
        raise ValueError("not a settings file")
    offered = choices or {}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in known and (k not in offered or v in offered[k])}


def _letters(k: int) -> str:
    return _letters(k // 26 - 1) + chr(65 + k % 26) if k >= 26 else chr(65 + k)


def write_xlsx(sheets: dict[str, pd.DataFrame]) -> bytes:
    """K1, K3: a workbook of small tables."""
    names = sheet_names(list(sheets))
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(names)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names))) + "</Relationships>")
        for k, df in enumerate(sheets.values()):
            rows = [list(df.columns), *df.itertuples(index=False)]
            body = []
            for i, row in enumerate(rows):
                cells = []
                for j, v in enumerate(row):
                    at = f"{_letters(j)}{i + 1}"
                    if v is None or v != v:
                        continue
                    cells.append(f'<c r="{at}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{at}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def read_xlsx(data: bytes) -> pd.DataFrame:
    """The first sheet, its first row as names, all as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows: list[dict[int, str | None]] = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in row.findall("m:c", ns):
                k = 0
                for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                    k = 26 * k + ord(ch) - 64
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells[k - 1] = text
            rows.append(cells)
    names = [rows[0].get(k) or f"column{k}" for k in range(max(rows[0]) + 1)] if rows else []
    return pd.DataFrame([[r.get(k) for k in range(len(names))] for r in rows[1:]], columns=names)


def sheet_names(names: list[str]) -> list[str]:
    """K1, K3: without the characters that workbooks forbid, at most 31 long, each once."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", n)[:SHEET_NAME]
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            tail = f"_{k}"
            name, k = base[: SHEET_NAME - len(tail)] + tail, k + 1
        out.append(name)
    return out


def profile_workbook(means: DataFrame) -> bytes:
    """K1: a sheet for each channel (label, dist, mean)."""
    pdf = means.select("label", "dist", "mean").orderBy("label", "dist").toPandas()  # profiles on a grid: some thousands of rows
    return write_xlsx({k: g[["dist", "mean"]].set_axis(["Distance (m)", f"{k[: SHEET_NAME - 5]}_mean"], axis=1) for k, g in pdf.groupby("label")})


def batch_workbook(scores: DataFrame, means: DataFrame) -> bytes:
    """K3: scores of all surveys (4 decimals), and a sheet for each survey with its mean profiles side by side (6 decimals)."""
    sheets = {"Scores": scores.toPandas().round(4)}
    pdf = means.select("survey", "label", "dist", "mean").toPandas()
    for s, g in pdf.groupby("survey"):
        sheets[str(s)] = g.pivot(index="dist", columns="label", values="mean").round(6).reset_index()
    return write_xlsx(sheets)


def write_scores(scores: DataFrame, path: str) -> None:
    """K2"""
    scores.withColumnRenamed("label", "sheet").write.csv(path, header=True)


def emagpy(df: DataFrame, channels: dict[str, float], separation: float = 1.66, height: float = 1.0, errors: dict[str, float] | None = None) -> DataFrame:
    """X, y, elevation and a column for each frequency, of readings with a position and any value."""
    cols = [number(F.col(f"`{c}`")).alias(f"HCP{separation:g}f{f:g}h{height:g}") for c, f in channels.items()]
    errs = [F.lit(float(errors[c])).alias(f"HCP{separation:g}f{f:g}h{height:g}_err") for c, f in channels.items() if errors and c in errors]
    some = F.coalesce(*[number(F.col(f"`{c}`")) for c in channels]).isNotNull()
    return df.where(number("x").isNotNull() & number("y").isNotNull() & some).select("x", "y", F.lit(0.0).alias("elevation"), *cols, *errs)


def map_archive(files: dict[str, bytes], failed: dict[str, str]) -> bytes:
    """K8: a zip of the maps of all channels, with a list of those that failed and why."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
        if failed:
            z.writestr("failed.txt", "".join(f"{k}: {v}\n" for k, v in failed.items()))
    return out.getvalue()


def read_reference(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    """A CSV of places with a column for each channel, as (id, label, x, y, ref); what isn't a number is left out."""
    df = read_csv(spark, path)
    channels = [c for c in df.columns if c not in (x, y, "rid")]
    rows = df.withColumnRenamed("rid", "id")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), number(F.col(f"`{c}`")).alias("ref")) for c in channels])).alias("r")
    return rows.select("id", number(F.col(f"`{x}`")).alias("x"), number(F.col(f"`{y}`")).alias("y"), each).select("id", "r.label", "x", "y", "r.ref").where("x is not null and y is not null and ref is not null")


def offsets_text(offsets: dict[str, float]) -> str:
    """The two-column CSV that read_offsets reads."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerows([("column", "offset"), *((k, repr(float(v))) for k, v in offsets.items())])
    return out.getvalue()


def placed(df: DataFrame, values: list[str], origin: tuple[float, float] | None = None) -> DataFrame:
    """X, y, lon and lat (with the origin of local metres, in degrees) and some columns, of rows that have them all but `variance`: sites, predictions,
    zones and grids as they are written to CSV."""
    extra = list(zip(("lon", "lat"), degrees(F.col("x"), F.col("y"), F.lit(origin[0]), F.lit(origin[1])), strict=True)) if origin else []
    present = [F.col(f"`{v}`").isNotNull() for v in values if v != "variance"]
    out = df.where(functools.reduce(lambda a, b: a & b, [F.col("x").isNotNull() & F.col("y").isNotNull(), *present]))
    return out.select("x", "y", *[e.alias(n) for n, e in extra], *[F.col(f"`{v}`") for v in values])


def grid_rows(grid: DataFrame, origin: tuple[float, float] | None = None) -> DataFrame:
    """K4: x, y, value, the variance where there is one, and lon and lat with an origin; blank nodes are left out."""
    named = grid.withColumnRenamed("z", "value")
    order = ["x", "y", "value", *(["variance"] if "variance" in grid.columns else []), *(["lon", "lat"] if origin else [])]
    return placed(named, [c for c in order if c in ("value", "variance")], origin).select(*order)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one for each task."""
    df.write.mode("errorifexists").csv(path, header=True)


def channel_maps(points: DataFrame, channels: list[str], mapped, epsg: int | None = None, stem: str = "survey") -> bytes:
    """K8: a zip of the grids of all channels: CSV, ESRI ASCII, GeoTIFF and projection. mapped(points of a channel) gives (spec, blocks, grid), as prepare.area_map does;
    a channel that fails is named with the reason, the others go on. A grid has some millions of nodes at most and is written by the driver."""
    from furrow.sources import rasters

    files: dict[str, bytes] = {}
    failed: dict[str, str] = {}
    for c in channels:
        try:
            spec, _, grid = mapped(points.where(F.col("label") == c))
            grid = grid.persist()
            files[f"{stem}_{c}.csv"] = grid_rows(grid).toPandas().to_csv(index=False).encode()
            files[f"{stem}_{c}.asc"] = rasters.asc_text(grid, spec).encode()
            files[f"{stem}_{c}.tif"] = rasters.geotiff(rasters.dense(grid, spec[3], spec[4]), spec[0], spec[1], spec[2], epsg)
            if epsg:
                files[f"{stem}_{c}.prj"] = rasters.prj_wkt(epsg).encode()
            grid.unpersist()
        except ValueError as e:
            failed[c] = str(e)
    return map_archive(files, failed)
