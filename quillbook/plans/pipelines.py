"""The two batch plans from layout relations to tables. Everything is lazy; a rejected document is a row of Errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import text as T
from quillbook.operators import bank as B
from quillbook.operators import classify as C
from quillbook.operators import flags
from quillbook.operators import ledger as L
from quillbook.parsers import bill, forms, gst
from quillbook.rules import banks
from quillbook.rules.forms import LEDGER_AUDIT, LEDGER_CORE
from quillbook.sources import layout
from quillbook.sources.store import Store, publish_run

#: Why a document is rejected, what is said of it, what to do; in the order in which it is tried.
STATUTORY_GATES = {
    "EncryptedPDF": ("The file is locked with a password.", "Save it without a password and try again."),
    "ParserError": ("The file couldn't be read.", "Check that it opens; get it anew."),
    "NeedsOCR": ("No readable text layer was found.", "Run OCR on the file and try again."),
    "MixedDocument": ("Pages belong to more than one kind of document.", "Split the file by document."),
    "AmbiguousType": ("More than one form fits about as well.", "Check the file; split it if it is a bundle."),
    "UnknownType": ("No known form was recognised.", "Check that the file is a supported form."),
    "ScannedShippingBill": ("A scanned bill has no coordinates to read tables from.", "Use the original file."),
    "NeedsStructuredOCR": ("Tables of this return can't be read from OCR text.", "Use the original file."),
}
BANK_GATES = {
    "EncryptedPDF": ("The file is locked with a password.", "Save it without a password and try again."),
    "ParserError": ("The file couldn't be read.", "Check that it opens; get it anew."),
    "NeedsOCR": ("No readable text layer was found.", "Run OCR on the file and try again."),
    "MixedDocument": ("Pages belong to more than one bank.", "Split the file by statement."),
    "UnsupportedDocument": ("This kind of statement isn't read.", "Leave it out."),
    "UnknownBankLayout": ("No known layout was recognised clearly.", "Check that the layout is supported."),
}


def gated(docs: DataFrame, gates: dict[str, tuple[str, str]], rules: dict[str, Column]) -> DataFrame:
    """Adds reject_reason: the first gate whose rule holds."""
    out = None
    for name in gates:
        if name in rules:
            out = F.when(rules[name], name) if out is None else out.when(rules[name], name)
    return docs.withColumn("reject_reason", out)


def errors(docs: DataFrame, gates: dict[str, tuple[str, str]]) -> DataFrame:
    look = F.create_map(*[x for k, v in gates.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bad = docs.where("reject_reason is not null").withColumn("m", F.element_at(look, F.col("reject_reason")))
    return bad.select(F.col("source_file").alias("File"), F.col("reject_reason").alias("Error_Type"), T.cut_message(F.coalesce("error", F.get("m", F.lit(0)))).alias("Message"), F.get("m", F.lit(1)).alias("Action"))


def _unread() -> dict[str, Column]:
    return {"EncryptedPDF": F.col("error").rlike("(?i)password|encrypt"), "ParserError": F.col("error").isNotNull()}


def classified(pages: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    docs = C.with_forms(layout.documents(pages, sidecars), pages="pages")
    f = F.col("form")
    return gated(docs, STATUTORY_GATES, _unread() | {
        "NeedsOCR": F.col("needs_ocr"), "MixedDocument": F.col("mixed"), "AmbiguousType": ~f["accepted"] & (f["score"] > 0), "UnknownType": ~f["accepted"],
        "ScannedShippingBill": (f["return_type"] == "SB") & F.col("ocr_used"), "NeedsStructuredOCR": f["return_type"].isin("GSTR1", "GSTR3B") & F.col("ocr_used"),
    })


def _as_it_is(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    return df


def statutory(pages: DataFrame, cells: DataFrame, words: DataFrame, sidecars: DataFrame | None = None, keep: Callable[..., DataFrame] = _as_it_is) -> dict[str, DataFrame]:
    """All tables of a statutory batch: the ledger and what is made of it, a detail table a form, errors.

    keep(frame, name, by) is asked about everything that several tables are made of: classified documents, each form's rows,
    and the ledger, by form and year. As it is, plans work these out anew for each table; `published` writes them once.
    """
    docs = keep(classified(pages, sidecars), "documents")
    good = docs.where("reject_reason is null")
    sheets: dict[str, DataFrame] = {}
    rows: list[DataFrame] = []
    details: dict[str, list[DataFrame]] = {}
    for (form, kind), parser in forms.PARSERS.items():
        mine = good.where((F.col("form.return_type") == form) & (F.col("form.doc_kind") == kind))
        read = parser(mine.select("source_file", "text"))
        # ranks read the challans three times
        read = keep(read, "ESIC_read") if form == "ESIC" else read
        got = keep(flags.flagged(read, form, kind), f"{form}_{kind}")
        details.setdefault(form, []).append(got)
        rows.append(L.consolidated(got))
    # once the names of a form's files are written, their size is known, and few of them are sent to the pages, not pages to them
    of = {form: keep(good.where(F.col("form.return_type") == form).select("source_file"), f"{form}_files") for form in ("GSTR1", "GSTR3B", "SB")}
    only = lambda rel, form: rel.join(of[form], "source_file", "left_semi")
    rows.append(L.consolidated(gst.gstr1(only(pages, "GSTR1"), only(cells, "GSTR1"))))
    three_b, analysis = gst.gstr3b(only(pages, "GSTR3B"), only(cells, "GSTR3B"))
    analysis = keep(analysis, "analysis")
    rows.append(L.consolidated(three_b))
    bill_pages = keep(bill.pages_of(only(words, "SB")), "bill_pages")
    bills = keep(bill.parsed(bill_pages), "bills")
    lost = bill.unreadable(bill_pages).withColumn("reject_reason", F.lit("ParserError"))
    rows.append(L.consolidated(bill.ledger(bills)))
    ledger = keep(L.union_all(rows), "rows")
    recon = L.reconcile(ledger)
    ledger = L.flag_back(ledger, recon)
    context = good.select(F.col("source_file").alias("SourceFile"), "form", "sparse_text", "ocr_used")
    audited = keep(L.audited(ledger.join(context, "SourceFile", "left")), "ledger", ["ReturnType", "FY"])
    final = audited.select(*LEDGER_CORE, *LEDGER_AUDIT)
    findings, evidence = L.finding_rows(audited), L.evidence_rows(audited)
    sheets["Consolidated"] = L.ordered(final)
    sheets["Dashboard"] = L.dashboard(final)
    sheets["Reconciliation"] = L.mismatches_first(recon.drop("group_key"))
    sheets["Validation_Findings"], sheets["Review_Evidence"] = findings, evidence
    sheets["Review_Packets"] = L.review_packets(final, findings, evidence)
    sheets["GSTR 3B"] = analysis.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in ("Return Period", "GSTIN", "Source File")])
    for form, parts in details.items():
        sheets[form] = L.lead_columns(L.union_all(parts), ["SourceFile", "ReturnType", "DocKind"])
    sheets["SB"], sheets["SB_Items"], sheets["SB_Invoices"] = bill.flat_rows(bills), bill.item_rows(bills), bill.invoice_rows(bills)
    sheets["Parsing_Errors"] = errors(docs, STATUTORY_GATES).unionByName(errors(lost, STATUTORY_GATES))
    return sheets


def published(store: Store, pages: DataFrame, cells: DataFrame, words: DataFrame, sidecars: DataFrame | None = None) -> int:
    """Writes a statutory batch as one run of the store: the ledger once, by form and year, and every table from it. Readers
    see all tables of the run, or all of the run before."""
    return publish_run(store, lambda keep: statutory(pages, cells, words, sidecars, keep))


def bank(pages: DataFrame, cells: DataFrame, sidecars: DataFrame | None = None, keep: Callable[..., DataFrame] = _as_it_is) -> dict[str, DataFrame]:
    """All tables of a batch of bank documents. keep is asked about what several of them are made of, as in `statutory`."""
    docs = C.with_banks(layout.documents(pages, sidecars))
    other = (F.col("unsupported.score") > 0) & ~F.col("accepted")
    docs = gated(docs, BANK_GATES, _unread() | {"NeedsOCR": F.col("needs_ocr"), "MixedDocument": F.col("mixed"), "UnsupportedDocument": other, "UnknownBankLayout": ~F.col("bank.clear")})
    of = lambda attr: F.element_at(F.create_map(*[F.lit(x) for b in banks.BANKS for x in (b.code, getattr(b, attr))]), F.col("bank.code"))
    docs = docs.withColumns({"debt": F.when(F.col("bank").isNotNull(), of("debt")), "layout": of("layout")})
    docs, cells = keep(docs, "documents"), keep(cells, "cells")
    good = docs.where("reject_reason is null")
    statements = good.where("layout <> 'deposits'")
    only = lambda kind: cells.join(good.where(F.col("layout") == kind).select("source_file"), "source_file", "left_semi")
    rows = keep(B.transactions(only("table"), good).unionByName(B.key_value_transactions(good.where("layout = 'key_value'").select("source_file", "text"))), "rows")
    meta = B.infer_balances(B.metadata(statements), rows, ["source_file"], B.ORDER)
    recon = B.reconciled(rows, meta, ["source_file"], B.ORDER)
    summary = B.bank_ledger(meta, recon, good)
    held = B.deposits(only("deposits"))
    totals = B.deposit_totals(held)
    fd = B.metadata(good.where("layout = 'deposits'")).drop("PeriodTo").join(totals, "source_file", "left").join(good.select("source_file", "ocr_used"), "source_file")
    codes = F.coalesce("codes", F.array(F.when(F.col("ocr_used"), "STRUCTURED_OCR_REQUIRED").otherwise("NO_DEPOSITS")))
    fd = fd.select(F.lit("FD").alias("ReturnType"), F.lit("Deposit").alias("DocKind"), F.col("AccountNumber").alias("EntityID"), F.col("AccountName").alias("EntityName"), F.col("PeriodTo").alias("PeriodDate"), F.when(F.size(codes) > 0, "Review").otherwise("OK").alias("Status"), F.array_join(codes, "; ").alias("Flags"), "PrimaryAmount", F.col("AccountNumber").alias("DocRef"), F.col("source_file").alias("SourceFile"))
    summary = L.union_all([summary, L.consolidated(fd)])
    carry = good.select("source_file", F.col("bank.bank").alias("Bank"))
    return {
        "Bank_Summary": summary, "Dashboard": L.dashboard(summary), "Transactions": rows.join(carry, "source_file"), "Fixed_Deposits": held.join(carry, "source_file"),
        "Reconciliation": B.review_first(recon.join(carry, "source_file")), "Review_Evidence": B.evidence(meta), "Validation_Findings": summary.select("SourceFile", "ReturnType", F.explode(T.split_flags(F.col("Flags"))).alias("Code")), "Parsing_Errors": errors(docs, BANK_GATES),
    }
