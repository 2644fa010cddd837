import json

import duckdb
import pytest

import __spark_entry__
from quillbook.plans import catalogue, pipelines
from quillbook.sources import layout, sinks
from quillbook.sources.store import staged
from tests.fixtures import TEXTS, batch
from tests.test_tables import CELLS

SF = "/root/testdata/sf0.001"
LEDGER = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def same(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", LEDGER)
def test_query_against_its_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        assert df.count() > 0
        return
    cols = sorted(df.columns)
    got = sorted(tuple(map(same, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    quoted = ", ".join('"{}"'.format(c) for c in cols)
    want = sorted(tuple(map(same, r)) for r in duck.sql(f"select {quoted} from ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_statutory_batch(spark, tmp_path):
    sheets = pipelines.statutory(*batch(spark), keep=staged(spark, "batch"))
    ledger = {r.SourceFile: r for r in sheets["Consolidated"].collect()}
    assert len(ledger) == len(TEXTS) - 1 and ledger["TDS_Challan.pdf"].Status == "OK" and ledger["TDS_Challan.pdf"].Confidence == 90
    assert ledger["PF_Challan.pdf"].ReturnType == "PF" and ledger["PF_Payment.pdf"].FY == "2025-26"
    assert {r.File: r.Error_Type for r in sheets["Parsing_Errors"].collect()} == {"scan.pdf": "NeedsOCR", "tie.pdf": "AmbiguousType", "odd.pdf": "UnknownType", "mix.pdf": "MixedDocument"}
    assert sheets["Reconciliation"].count() > 0
    out = sinks.write_sheets({k: sheets[k] for k in ("Dashboard", "Parsing_Errors")}, str(tmp_path / "t"), "csv")
    assert spark.read.csv(f"{out}/Parsing_Errors", header=True).count() == 4
    assert json.loads(sinks.json_records(sheets["Parsing_Errors"]).first()[0])["File"]
    sinks.write_workbook({"Errors": sheets["Parsing_Errors"]}, str(tmp_path / "x.xlsx"))
    import zipfile

    assert "xl/worksheets/sheet1.xml" in zipfile.ZipFile(tmp_path / "x.xlsx").namelist()


def test_bank_batch(spark):
    text = "Axis Bank\nStatement of Axis Bank Account No: 12345678\nAccount Name: ACME\nTran Date Opening Balance: 1,000.00\nCurrency: INR\n" + "x" * 60
    pages = spark.createDataFrame([("a.pdf", 1, text), ("b.pdf", 1, "mutual fund folio no balance units nav(inr) " + "x" * 60)], "source_file string, page_no int, text string")
    cells = spark.createDataFrame([("a.pdf", 1, 1, 1, ["Tran Date", "Particulars", "Debit", "Credit", "Balance"]), ("a.pdf", 1, 1, 2, ["01-04-2025", "x", "100", "", "900"])], CELLS)
    sheets = pipelines.bank(pages, cells)
    r = sheets["Bank_Summary"].first()
    assert (r.ReturnType, r.EntityID, r.Status, r.ClosingBalance, r.Confidence, r.RowsExtracted) == ("BANK", "12345678", "OK", 900.0, 100, 1)
    assert {r.Field: r.Found for r in sheets["Review_Evidence"].collect()} == {c: True for c in ("AccountNumber", "AccountName", "Currency", "PeriodFrom", "PeriodTo", "OpeningBalance", "ClosingBalance")}
    assert sheets["Transactions"].count() == 1 and [e.Error_Type for e in sheets["Parsing_Errors"].collect()] == ["UnsupportedDocument"]


def test_folder_and_manifest(spark, tmp_path):
    for n in ("a.pdf", "A.PDF", "b.txt"):
        (tmp_path / n).write_bytes(b"x" * len(n))
    assert [r.source_file for r in layout.folder(spark, str(tmp_path)).collect()] == ["a.pdf"]
    files = layout.folder(spark, str(tmp_path), any_case=True)
    assert len({r.source_file.lower() for r in files.collect()}) == 2
    where = str(tmp_path / "manifest")
    assert layout.unread(files, layout.read_manifest(spark, where)).count() == 2
    layout.append_manifest(files, where)
    assert layout.unread(files, layout.read_manifest(spark, where)).count() == 0
    assert layout.unread(files, layout.read_manifest(spark, where, version=2)).count() == 2
    bad = layout.read_pdf_text(files)
    assert bad.count() == 2 and all(r.error for r in bad.collect())
    cells, words = layout.read_pdf_layout(files)
    assert cells.collect() == words.collect() == []
    turned_down = pipelines.statutory(bad, cells, words)["Parsing_Errors"].collect()
    assert {r.Error_Type for r in turned_down} == {"ParserError"} and all(r.Message for r in turned_down)
    with pytest.raises(ValueError):
        layout.folder(spark, str(tmp_path / "manifest"))


def test_deposits_that_were_scanned_need_their_tables(spark):
    pages = spark.createDataFrame([("f.pdf", 1, "x")], "source_file string, page_no int, text string")
    ocr = spark.createDataFrame([("f.pdf", ["IDFC FIRST list of fixed deposits FD account no maturity amount " + "y" * 60])], "source_file string, ocr_pages array<string>")
    rows = pipelines.bank(pages, spark.createDataFrame([], CELLS), ocr)["Bank_Summary"].collect()
    assert [r.Flags for r in rows] == ["STRUCTURED_OCR_REQUIRED"]


def test_stream_of_pages(spark, tmp_path):
    from quillbook.streaming import incremental

    pages, _, _ = batch(spark)
    pages.selectExpr("*", "cast(null as string) as ocr_text").coalesce(1).write.parquet(str(tmp_path / "pages"))
    seen = []
    q = incremental.start(spark, str(tmp_path / "pages"), str(tmp_path / "cp"), lambda good, bad, n: seen.append((good.count(), bad.count())))
    q.awaitTermination(60)
    assert seen == [(len(TEXTS) - 1, 4)]
    again = incremental.start(spark, str(tmp_path / "pages"), str(tmp_path / "cp"), lambda good, bad, n: seen.append("again"))
    again.awaitTermination(60)
    assert len(seen) == 1
