"""Readers and writers of the exchange formats."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, keep_empty: bool = True) -> DataFrame:
    """A quoted CSV with header, line breaks in cells and maybe a byte-order mark, all strings.

    With ``keep_empty`` an empty cell is ``""``, else null.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if keep_empty:
        r = r.option("nullValue", "\u0000")
    if columns:
        r = r.schema(strings(*columns))
    df = r.csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]) if not columns else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has all the columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def optional(read, empty: DataFrame) -> DataFrame:
    """What ``read()`` yields, or ``empty`` where the source doesn't exist."""
    try:
        return read()
    except Exception as e:  # noqa: BLE001 - Spark reports a missing path by class name
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError):
            return empty
        raise


def latest(files: DataFrame, path: str) -> DataFrame:
    """The path with the largest last eight-digit date in its file name, then the largest name."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    date = F.coalesce(F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d{8})"), F.lit(1)), F.lit(-1)), F.lit(""))
    return files.select(F.col(path).alias("pfad"), date.alias("datum"), name.alias("name")).distinct().agg(F.max_by("pfad", F.struct("datum", "name")).alias("pfad"))


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path")


def sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """Rows of a workbook's sheet as text, read with the standard library."""
    import io

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {s.get("name"): s.get(rel) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        tree = ElementTree.fromstring(z.read("xl/" + targets[names[sheet]].removeprefix("/xl/")))
    rows = []
    for r in tree.iterfind(".//m:row", ns):
        row: dict[int, str | None] = {}
        for c in r.iterfind("m:c", ns):
            letters = re.match("[A-Z]+", c.get("r", "A")).group()
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iterfind(".//m:t", ns)) if c.get("t") == "inlineStr" else v.text if v is not None else None
            row[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        rows.append([row.get(i) for i in range(max(row) + 1)] if row else [])
    return rows


def read_workbook(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """Sheets of workbooks as all-string rows; header cells are trimmed, one task per file."""
    return parse_workbooks(spark.read.format("binaryFile").load(path), "content", sheet, columns)


def parse_workbooks(files: DataFrame, content: str, sheet: str, columns: list[str]) -> DataFrame:
    """The rows of the workbooks in a binary column, as ``read_workbook`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                head, *rows = sheet_rows(data, sheet) or [[]]
                names = [(h or "").strip() for h in head]
                absent = [c for c in columns if c not in names]
                if absent:
                    raise ValueError(f"columns missing: {', '.join(absent)}")
                out += [[r[names.index(c)] if names.index(c) < len(r) else None for c in columns] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(len(columns))], columns)

    return files.select(content).mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def workbook(sheet: str, columns: list[str], rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet of text cells, written with the standard library; a null is no cell."""
    import io
    from xml.sax.saxutils import escape, quoteattr

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def line(r: int, cells: list[str | None]) -> str:
        shown = (f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</t></is></c>' for c, x in enumerate(cells) if x is not None)
        return f'<row r="{r}">{"".join(shown)}</row>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{link}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{link}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(line(i, r) for i, r in enumerate([columns, *rows], 1))}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def workbooks(df: DataFrame, block, sheet: str) -> DataFrame:
    """``block, content``: a workbook for each value of the column expression ``block``, of bounded blocks of rows."""
    import pandas as pd

    columns = df.columns

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[None if x is None or x != x else str(x) for x in r] for r in pdf[columns].itertuples(index=False)]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "content": [workbook(sheet, columns, rows)]})

    return df.withColumn("block", block).groupBy("block").applyInPandas(write, "block bigint, content binary")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a line, by a schema; what is absent is null."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """All cells quoted, CRLF, byte-order mark before the header, for spreadsheet programs; one file only where a small table is wanted so."""
    first, *rest = df.columns
    out = df.withColumnRenamed(first, "\ufeff" + first)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, column: str, path: str) -> None:
    """One compact JSON document per row."""
    df.select(F.to_json(column).alias("value")).write.mode("overwrite").text(path)


def matrix(pairs: DataFrame, value: str, ids: list, digits: int = 4) -> DataFrame:
    """The symmetric matrix of a bounded number of entities, a column per id, empty diagonal."""
    both = pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    return both.groupBy("a").pivot("b", ids).agg(F.first(F.round(value, digits))).withColumnRenamed("a", "id")


def unmatrix(wide: DataFrame, key: str, value: str) -> DataFrame:
    """A matrix as pairs a < b again; columns without a row of their name are dropped by a semi-join."""
    kind = wide.schema[key].dataType
    long = wide.unpivot(key, [c for c in wide.columns if c != key], "b", value).select(F.col(key).alias("a"), F.col("b").cast(kind).alias("b"), value)
    return long.join(wide.select(F.col(key).alias("b")), "b", "left_semi").where("a < b").select("a", "b", value)


def slots(members: DataFrame, group: str, order: list[str], columns: list[str], least: int = 3) -> DataFrame:
    """Members of each group side by side: ``group, slot1_x, slot1_y, …`` for as many slots as the largest group has."""
    w = Window.partitionBy(group).orderBy(*order)
    placed = members.withColumn("slot", F.row_number().over(w))
    most = max(least, placed.agg(F.max("slot")).first()[0] or 0)
    return placed.groupBy(group).pivot("slot", list(range(1, most + 1))).agg(*[F.first(c).alias(c) for c in columns])


def observed(df: DataFrame, name: str = "summary", **metrics) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are known once it has been written: no pass of their own."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in metrics.items()]), o
