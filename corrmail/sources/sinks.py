"""Exports: labelled frames, CSV with a byte order mark, JSON, spreadsheets."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions.text import formula_guard

DETAIL_ROWS = 5000
#: Fixed values of a report's look: header colours and font, least and most column width, rows that set the width.
HEADER_FILL, HEADER_TEXT, HEADER_FONT = "4472C4", "FFFFFF", "微软雅黑"
WIDTHS, WIDTH_ROWS = (10, 50), 49


def export_frame(merged: DataFrame, labels: bool = True) -> DataFrame:
    """All cells as guarded text; booleans as yes and no; columns named for readers."""
    kinds = dict(merged.dtypes)

    def cell(c: str):
        x = F.when(F.col(c), L.YES).otherwise(L.NO) if kinds[c] == "boolean" else F.col(c).cast("string")
        return formula_guard(x).alias(L.COLUMN_LABELS[c] if labels else c)

    return merged.select(*[cell(c) for c in L.COLUMN_LABELS])


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV parts with a header whose first name starts with a byte order mark, so spreadsheets read it as UTF-8."""
    first, *rest = frame.columns
    frame.toDF("﻿" + first, *rest).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def json_document(merged: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines of JSON: one with the statistics, one for each correspondent."""
    head = stats.select(F.to_json(F.struct(F.lit("stats").alias("kind"), F.struct(*stats.columns).alias("stats"))).alias("value"))
    rows = merged.select(F.to_json(F.struct(F.lit("correspondent").alias("kind"), F.struct(*merged.columns).alias("row"))).alias("value"))
    return head.union(rows)


def write_json(merged: DataFrame, stats: DataFrame, path: str) -> None:
    json_document(merged, stats).write.mode("overwrite").text(path)


def workbook(sheets: Iterable[tuple[str, list[str], list[tuple]]]) -> bytes:
    """A spreadsheet file (Office Open XML): coloured header row, frozen and filtered, columns as wide as their text."""
    sheets = list(sheets)
    out = BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

    def column(k: int) -> str:
        name = ""
        while k >= 0:
            k, r = divmod(k, 26)
            name, k = chr(65 + r) + name, k - 1
        return name

    def widths(table: list[tuple]) -> str:
        longest = [max(len("" if v is None else str(v)) for v in cells) for cells in zip(*table[:WIDTH_ROWS])]
        cols = "".join(f'<col min="{k}" max="{k}" width="{min(max(1.5 * n + 2, WIDTHS[0]), WIDTHS[1]):g}" customWidth="1"/>' for k, n in enumerate(longest, 1))
        return f"<cols>{cols}</cols>" if cols else ""

    def styles() -> str:
        """Cell formats: 0 plain, 1 header, 2 wrapped text."""
        fonts = f'<fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FF{HEADER_TEXT}"/><name val="{HEADER_FONT}"/></font></fonts>'
        fill = f'<fill><patternFill patternType="solid"><fgColor rgb="FF{HEADER_FILL}"/></patternFill></fill>'
        fills = f'<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill}</fills>'
        borders = '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders>'
        base = '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        header = '<xf numFmtId="0" fontId="1" fillId="2" borderId="0" xfId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf>'
        wrapped = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>'
        cells = f'<cellXfs count="3"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{header}{wrapped}</cellXfs>'
        return f'{head}<styleSheet xmlns="{main}">{fonts}{fills}{borders}{base}{cells}</styleSheet>'

    def sheet(names: list[str], rows: list[tuple]) -> str:
        lines = []
        for n, row in enumerate([tuple(names), *rows], 1):
            cells = "".join(f'<c r="{column(k)}{n}" s="{1 if n == 1 else 2}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for k, v in enumerate(row))
            lines.append(f'<row r="{n}">{cells}</row>')
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        last = f"{column(max(len(names) - 1, 0))}{len(rows) + 1}"
        return f'{head}<worksheet xmlns="{main}">{view}{widths([tuple(names), *rows])}<sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rIdStyles" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles())
        for k, (_, names, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(names, rows))
    return out.getvalue()


def write_workbook(path: str, frames: dict[str, DataFrame], most: int = DETAIL_ROWS) -> None:
    """A spreadsheet of small tables, at most ``most`` rows of each: a report, not a way to move data."""
    sheets = [(name, df.columns, [tuple(r) for r in df.limit(most).collect()]) for name, df in frames.items()]
    with open(path, "wb") as f:
        f.write(workbook(sheets))
