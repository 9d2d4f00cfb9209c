"""Lists for people: CSV with a byte-order mark and XLSX, one file each, streamed from the executors partition by partition."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.functions.web import escape_cell

NUMBERS = {"lat", "lon", "score"}


def _rows(df: DataFrame):
    safe = df.select(*(escape_cell(c, F.col(c).cast("string")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    return safe.toLocalIterator(prefetchPartitions=True)


def csv_bytes(df: DataFrame) -> bytes:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    w.writerows(("" if v is None else v for v in r) for r in _rows(df))
    return "﻿".encode() + out.getvalue().encode()


def write_csv(df: DataFrame, path: str, about: list[tuple[str, str]] = ()) -> int:
    """One UTF-8 file with a mark and header; cells are guarded against formulas; ``about`` goes beside it."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in _rows(df):
            w.writerow("" if v is None else v for v in r)
            n += 1
    if about:
        with open(os.path.splitext(path)[0] + ".about.txt", "w", encoding="utf-8") as f:
            f.writelines(f"{k}: {v}\n" for k, v in about)
    return n


def _cell(column: str, v) -> str:
    if v is None or v == "":
        return "<c/>"
    if column in NUMBERS and isinstance(v, (int, float)):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'


def _sheet(columns, rows, filtered: bool):
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    yield '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield "<row>" + "".join(f'<c t="inlineStr" s="1"><is><t>{escape(c)}</t></is></c>' for c in columns) + "</row>"
    n = 1
    for r in rows:
        n += 1
        yield "<row>" + "".join(_cell(c, v) for c, v in zip(columns, r)) + "</row>"
    yield "</sheetData>"
    if filtered:
        last, k = "", len(columns)
        while k:
            k, m = divmod(k - 1, 26)
            last = chr(65 + m) + last
        yield f'<autoFilter ref="A1:{last}{n}"/>'
    yield "</worksheet>"


def write_xlsx(df: DataFrame, path: str, about: list[tuple[str, str]] = ()) -> None:
    """Two sheets, Leads and About: text cells but for positions and scores, a bold frozen header, a filter."""
    ns = "http://schemas.openxmlformats.org/"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main = ns + "spreadsheetml/2006/main"
    rel = ns + "officeDocument/2006/relationships"
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{sheet_type}{t}+xml"/>' for p, t in (("workbook", "sheet.main"), ("styles", "styles"), ("worksheets/sheet1", "worksheet"), ("worksheets/sheet2", "worksheet")))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Leads" sheetId="1" r:id="rId1"/><sheet name="About" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for name, columns, rows, filtered in (("sheet1", df.columns, _rows(df), True), ("sheet2", ["Field", "Value"], about, False)):
            with z.open(f"xl/worksheets/{name}.xml", "w") as f:
                for piece in _sheet(columns, rows, filtered):
                    f.write(piece.encode())


def export_all(targets: dict, df: DataFrame) -> tuple[dict, dict]:
    """Write to every target; the failure of one doesn't lose the others."""
    done, failed = {}, {}
    for name, write in targets.items():
        try:
            done[name] = write(df)
        except Exception as e:
            failed[name] = str(e)[:200]
    return done, failed
