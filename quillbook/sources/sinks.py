"""Sinks: one table a sheet, as Parquet, CSV or JSON; a stdlib workbook for small results."""

from __future__ import annotations

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sheets(sheets: dict[str, DataFrame], folder: str, fmt: str = "parquet", stamp: bool = False) -> str:
    """One directory a sheet. Nested columns become JSON text where the format has none."""
    folder = f"{folder}_{datetime.now():%Y-%m-%d_%H-%M}" if stamp else folder
    for name, df in sheets.items():
        flat = df if fmt != "csv" else df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(f"`{c}`") for c in df.columns])
        writer = flat.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")
    return folder


def json_records(df: DataFrame) -> DataFrame:
    """Each row as JSON: ISO dates, nulls kept, NaN as null."""
    cols = [F.when(F.isnan(F.col(f"`{c}`")), None).otherwise(F.col(f"`{c}`")).alias(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(f"`{c}`") for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_workbook(sheets: dict[str, DataFrame], path: str, max_rows: int = 100_000) -> None:
    """A workbook of inline cells. It is a report for people: a sheet of more rows is refused, not cut."""

    def sheet(df: DataFrame) -> str:
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} rows don't fit a sheet; write tables instead")
        cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
        return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows]) + "</sheetData></worksheet>"

    names = list(sheets) or ["Empty"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(sheets[n]) if sheets else '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>')
