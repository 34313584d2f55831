"""Readers of assay files.  All read through Spark, so that any store that Spark knows will do."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence of each record (lines of a sequence joined)."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    body = F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.lit(1)), r"\s", "")).otherwise("")
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("header"), body.alias("sequence"))


def read_assay_csv(spark: SparkSession, paths: Sequence[str], sequence: str = "heavy", partner: str = "light", scores: Sequence[str] = ("fitness",)) -> DataFrame:
    """Assay files whose headers differ, in one table: study and metric from the file's name, the first score column that has a number."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        own = [c for c in df.columns if c not in (sequence, partner) and c not in scores]
        picked = [X.finite(F.col(f"`{c}`")) for c in [*scores, *own] if c in df.columns]
        study, metric = X.study_and_metric(F.lit(path))
        rows = df.select(study.alias("study"), metric.alias("metric"), X.canonical_text(F.col(f"`{sequence}`")).alias("sequence"), (X.canonical_text(F.col(f"`{partner}`")) if partner in df.columns else F.lit(None).cast("string")).alias("partner"), (F.coalesce(*picked) if picked else F.lit(None).cast("double")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_repertoire(spark: SparkSession, path: str) -> DataFrame:
    """Units whose first line is JSON and whose second is a CSV header: the file's metadata (JSON) beside each record."""

    def parse(it):
        import csv
        import gzip

        for batch in it:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
                first, _, rest = text.partition("\n")
                meta = metadata_line(first)
                rows = list(csv.DictReader(io.StringIO(rest if meta else text)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([json.dumps(meta, sort_keys=True)] * len(rows), pa.string()), pa.array([json.dumps(r) for r in rows], pa.string())], names=["file", "metadata", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, metadata string, record string")


def metadata_line(line: str) -> dict:
    """The JSON object of a file's first line, also if it is quoted like a CSV cell; {} if there is none."""
    for text in (line.strip(), line.strip().strip('"').replace('""', '"')):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheets(data: bytes) -> dict[str, list[list[str]]]:
    """The cells of each sheet of a workbook, as text (shared and inline strings; absent cells are empty)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
        shared = [text_of(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = {}
        for title, file in zip(titles, files, strict=False):
            rows = []
            for row in ElementTree.fromstring(z.read(file)).iter(f"{_NS}row"):
                cells: list[str] = []
                for cell in row.iter(f"{_NS}c"):
                    at = 0
                    for ch in re.match("[A-Z]*", cell.get("r") or "")[0]:
                        at = at * 26 + ord(ch) - 64
                    at = at - 1 if at else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = cell.find(f"{_NS}v")
                    raw = value.text or "" if value is not None else ""
                    cells[at] = shared[int(raw)] if cell.get("t") == "s" and raw else text_of(cell) if cell.get("t") == "inlineStr" else raw
                rows.append(cells)
            out[title] = rows
        return out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, column (header), cell of every workbook under the path."""

    def parse(it):
        for batch in it:
            out: list[list] = [[], [], [], [], []]
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sheet, rows in sheets(data).items():
                    for i, cells in enumerate(rows[1:], 1):
                        for header, cell in zip(rows[0], cells, strict=False):
                            for column, value in zip(out, (name, sheet, i, header, cell), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file", "sheet", "row", "column", "cell"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, sheet string, row int, column string, cell string")


def read_labeled_json(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """Rows of JSON arrays or lines, with the label normalized to 0, 1 or null."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumn(label, X.binary_label(F.col(label)))


def read_structure_atoms(spark: SparkSession, path: str, atom: str = "CA") -> DataFrame:
    """chain, residue number, coordinates and B-factor of one atom a residue from fixed-width structure files."""
    rows = spark.read.text(path).where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM") & (F.trim(F.substring("value", 13, 4)) == atom))
    number = lambda a, n: F.trim(F.substring("value", a, n)).try_cast("double")
    return rows.select(F.substring("value", 22, 1).alias("chain"), F.trim(F.substring("value", 23, 4)).try_cast("int").alias("residue"), F.trim(F.substring("value", 18, 3)).alias("name"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("b"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, sha256 and whether it is what the manifest (file, sha256) says."""
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.sha2("content", 256).alias("found"))
    return rows.join(manifest.select("file", "sha256"), "file", "full").select("file", "found", "sha256", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("verified"))
