"""Readers and writers."""

import glob
import io
import zipfile

import pytest

from quercus.sources import tables as T
from quercus.sources.markdown import read_handbook

HANDBOOK = """# Handbuch
## **Recht I (W3M10001) Law I**
|ECTS-LEISTUNGSPUNKTE|DAVON SELBSTSTUDIUM|
|---|---|
|90|5|
|Prof. Dr. Anna Berg|Deutsch|
### **FACHKOMPETENZ**
Die Studierenden kennen **Recht**.
Stand vom 01.02.2023
### **METHODENKOMPETENZ**
Methoden.
|LERNEINHEITEN UND INHALTE|PRÄSENZZEIT|SELBSTSTUDIUM|
|---|---|---|
|Vertragsrecht|30|60|
|• Vertrag<br>Haftung|||
### **BESONDERHEITEN**
keine
### **LITERATUR**
Berg, A.: Recht
## **Anhang**
weg
"""


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', ""), ("2", "ü;,", "x")], "id string, t string, e string")
    T.write_csv(df, str(tmp_path / "c"), one_file=True)
    raw = open(glob.glob(str(tmp_path / "c/part-*.csv"))[0], "rb").read()
    assert raw.startswith(b'\xef\xbb\xbf"id"') or raw.startswith(b'"\xef\xbb\xbfid"')
    assert b'"2","\xc3\xbc;,","x"\r\n' in raw
    back = T.read_csv(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "b"\nc', ""), ("2", "ü;,", "x")]


def test_columns_and_missing(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(ValueError, match="b, c"):
        T.require(df, ["a", "b", "c"])
    empty = spark.createDataFrame([], "a string")
    assert T.optional(lambda: spark.read.parquet(str(tmp_path / "no")), empty).count() == 0


def test_latest(spark):
    files = spark.createDataFrame([("x/a_20230101.xlsx",), ("x/20240101_b_20230301.xlsx",), ("x/z.xlsx",)], "path string")
    assert T.latest(files, "path").first()["pfad"] == "x/20240101_b_20230301.xlsx"


def workbook() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Datenbasis" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Code </t></si><si><t>M1</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Zahl</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    p = tmp_path / "w.xlsx"
    p.write_bytes(workbook())
    assert [tuple(r) for r in T.read_workbook(spark, str(p), "Datenbasis", ["Code", "Zahl"]).collect()] == [("M1", "12")]


def test_handbook(spark, tmp_path):
    p = tmp_path / "h.md"
    p.write_text(HANDBOOK)
    (r,) = read_handbook(spark, str(p)).collect()
    assert (r.modulnummer, r.modulname, r.modulname_en, r.ects, r.verantwortung) == ("W3M10001", "Recht I", "Law I", "5", "Prof. Dr. Anna Berg")
    assert (r.fachkompetenz, r.methodenkompetenz, r.lehr_lerneinheiten, r.literatur) == ("Die Studierenden kennen Recht.", "Methoden.", "Vertragsrecht", "Berg, A.: Recht")
    assert "Vertrag" in r.inhalte and "weg" not in r.text_gesamt and "Stand" not in r.fachkompetenz


def test_matrix(spark):
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25), (1, 2, None)], "a int, b int, v double")
    wide = T.matrix(pairs, "v", [0, 1, 2])
    assert wide.columns == ["id", "0", "1", "2"] and {r.id: r["1"] for r in wide.collect()} == {0: 0.5, 1: None, 2: None}
    assert {(r.a, r.b): r.v for r in T.unmatrix(wide, "id", "v").collect()} == {(0, 1): 0.5, (0, 2): 0.25, (1, 2): None}


def test_slots_and_observed(spark, tmp_path):
    m = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (2, 9, "z")], "g int, o int, n string")
    r = {x.g: x for x in T.slots(m, "g", ["o"], ["n"]).collect()}
    assert (r[1]["1"], r[1]["2"], r[1]["3"]) == ("y", "x", None)
    df, o = T.observed(m, "s")
    T.write_json(df.selectExpr("struct(g, n) AS d"), "d", str(tmp_path / "j"))
    assert o.get["rows"] == 3
