"""Readers, sinks and streams on files made here."""

from __future__ import annotations

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.sources import readers, writers
from siltstone.streaming.feedback import feedback_stream, windowed_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACD\nEF\n>two\n\n>three\nGG\n")
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path)).collect()} == {("one x", "ACDEF"), ("two", ""), ("three", "GG")}


def test_assay_csv(spark, tmp_path):
    (tmp_path / "alpha_2017_HIC.csv").write_text("heavy,light,HIC - RRT,fitness\nac d,EF,9.5,1.5\nGG,,8,\n")
    (tmp_path / "beta_Tm.csv").write_text("heavy,Tm\nKK,x\n")
    rows = readers.read_assay_csv(spark, [str(tmp_path / "alpha_2017_HIC.csv"), str(tmp_path / "beta_Tm.csv")])
    assert {tuple(r) for r in rows.collect()} == {("alpha", "HIC", "ACD", "EF", 1.5), ("alpha", "HIC", "GG", None, 8.0), ("beta", "Tm", "KK", None, None)}


def test_repertoire(spark, tmp_path):
    (tmp_path / "u.csv.gz").write_bytes(gzip.compress(b'"{""Species"": ""human""}"\nseq,locus\nACD,H\nEFG,K\n'))
    rows = readers.read_repertoire(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].metadata == '{"Species": "human"}' and '"locus": "H"' in rows[0].record
    assert readers.metadata_line("no json") == {}


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="first" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>value</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>m1</t></is></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    rows = readers.read_workbook(spark, str(tmp_path)).where("column <> ''").collect()
    assert {(r.sheet, r.row, r.column, r.cell) for r in rows} == {("first", 1, "id", "m1"), ("first", 1, "value", "2.5")}


def test_structure_atoms(spark, tmp_path):
    (tmp_path / "s.pdb").write_text("ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 80.00\nATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00 81.50\n")
    assert [(r.chain, r.residue, r.name, r.x, r.b) for r in readers.read_structure_atoms(spark, str(tmp_path)).collect()] == [("A", 1, "ALA", 11.639, 81.5)]


def test_json_labels_and_manifest(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"seq": "A", "label": " Failure"}, {"seq": "B", "label": "0"}, {"seq": "C", "label": "?"}]')
    assert [r.label for r in readers.read_labeled_json(spark, str(tmp_path / "l.json")).orderBy("seq").collect()] == [1, 0, None]
    import hashlib

    digest = hashlib.sha256((tmp_path / "l.json").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("l.json", digest), ("gone.json", "x")], "file string, sha256 string")
    assert {r.file: r.verified for r in readers.verified_files(spark, str(tmp_path / "l.json"), manifest).collect()} == {"l.json": True, "gone.json": False}


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i long, s string")
    path = writers.write_bundle(df, str(tmp_path), "src")
    assert path == writers.write_bundle(df.orderBy(F.desc("i")).repartition(2), str(tmp_path), "src") and writers.same_rows(writers.read_bundle(spark, path), df)
    spark.createDataFrame([(1, "a"), (2, ""), (3, "")], "i long, s string").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="manifest"):
        writers.read_bundle(spark, path)


def test_single_shot(spark, tmp_path):
    gate = writers.SingleShot(spark, str(tmp_path / "ledger"))
    gate.begin("final", "h")
    gate.finish("final", {"auc": 0.5})
    assert [e["state"] for e in gate.entries()].count("completed") == 1
    with pytest.raises(PermissionError):
        writers.SingleShot(spark, str(tmp_path / "ledger")).begin("final", "h")
    writers.write_tsv(spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string").coalesce(1), str(tmp_path / "t"), ["i"])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_feedback_stream(spark, tmp_path):
    table, conflicts, inbox = (str(tmp_path / n) for n in ("table", "conflicts", "inbox"))
    schema = "i long, k string, y int"
    spark.createDataFrame([(0, "A", 1)], schema).write.parquet(table)
    spark.createDataFrame([(1, "A", 0), (2, "B", 1), (3, "B", 1)], schema).write.parquet(inbox)
    feedback_stream(spark.readStream.schema(schema).parquet(inbox), table, conflicts, "k", "y", "i", str(tmp_path / "c")).awaitTermination()
    assert {r.k for r in spark.read.parquet(table).collect()} == {"A", "B"} and spark.read.parquet(table).count() == 2
    assert [r.i for r in spark.read.parquet(conflicts).collect()] == [1]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "a", 5.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    assert [(r.n, r.mean_value) for r in windowed_counts(df, "t", "k", "v").orderBy("window_start").collect()] == [(2, 2.0), (1, 5.0)]
