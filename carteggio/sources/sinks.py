"""Writers: partitioned Parquet for use, delimited text and JSON for exchange."""

from __future__ import annotations

import html as _html
import json as _json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold none."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """CSV with header, one file per partition; ``fields`` fixes order and choice, missing ones come out blank."""
    have = set(df.columns)
    out = df if fields is None else df.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in fields])
    flat(out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that identify people emptied, their types kept."""
    return df.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in columns else F.col(f.name) for f in df.schema.fields])


#: Rows of a file made on the driver at most: reports for people, not tables.
REPORT_ROWS = 100_000


def _rows(df: DataFrame) -> tuple[list[str], list[list]]:
    rows = flat(df).limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: write this as a table")
    return df.columns, [list(r) for r in rows]


def single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, as spreadsheets read it; for reports."""
    import csv as _csv

    names, rows = _rows(df)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        _csv.writer(f).writerows([names, *[["" if v is None else v for v in r] for r in rows]])


def markdown(df: DataFrame, path: str, title: str) -> None:
    names, rows = _rows(df)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def html(df: DataFrame, path: str, title: str) -> None:
    names, rows = _rows(df)
    tr = lambda tag, r: "<tr>" + "".join(f"<{tag}>{_html.escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1><table>{tr('th', names)}{''.join(tr('td', r) for r in rows)}</table>")


def report(data: dict, path: str, title: str) -> None:
    """A summary of figures as JSON or, by the end of the name, as HTML."""
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith(".json"):
            _json.dump({"title": title, **data}, f, ensure_ascii=False, indent=2, default=str)
        else:
            rows = "".join(f"<dt>{_html.escape(str(k))}</dt><dd>{_html.escape(_json.dumps(v, ensure_ascii=False, default=str))}</dd>" for k, v in data.items())
            f.write(f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1><dl>{rows}</dl>")


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out = chr(65 + n % 26) + out
        n = n // 26 - 1
    return out


def xlsx(df: DataFrame, path: str, sheet: str = "Data") -> None:
    """A workbook of one sheet with texts in place, of any number of columns."""
    names, rows = _rows(df)
    main, rel, pack = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    cell = lambda i, j, v: f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate([names, *rows], 1))
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def study_pack(artifacts: dict[str, DataFrame], folder: str, aliases: dict[str, str] | None = None) -> dict[str, int]:
    """Every named frame as Parquet and CSV below ``folder`` and an index of names and row counts.

    ``aliases`` (name of the copy -> artifact) are written from the Parquet tables, for tools that expect other names.
    """
    counts = {}
    for name, df in artifacts.items():
        parquet(df, f"{folder}/{name}.parquet")
        back = df.sparkSession.read.parquet(f"{folder}/{name}.parquet")
        csv(back, f"{folder}/{name}.csv")
        counts[name] = back.count()
    for name, of in (aliases or {}).items():
        csv(artifacts[of].sparkSession.read.parquet(f"{folder}/{of}.parquet"), f"{folder}/{name}.csv")
    if counts:
        spark = next(iter(artifacts.values())).sparkSession
        json(spark.createDataFrame(sorted(counts.items()), "artifact string, rows long").coalesce(1), f"{folder}/index.json")
    return counts
