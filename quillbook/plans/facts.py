"""The star schema of the two GST returns and the executive summaries over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.parsers import gst
from quillbook.rules import gst as R

KEY = ["GSTIN", "Period_Year"]
#: The credit and cash columns of the payment table.
PAID = ["ITC_Integrated", "ITC_Central", "ITC_State_UT", "ITC_Cess", "Tax_paid_cash"]
HEADS = ["Integrated tax", "Central tax", "State/UT tax", "Cess"]


def with_context(rows: DataFrame, meta: DataFrame, on: str = "SourceFile") -> DataFrame:
    """rows with their return's key in front; columns that clash are renamed Raw_*."""
    context = [c for c in ("GSTIN", "Period", "FY", "Period_Year") if c in meta.columns]
    renamed = rows.withColumnsRenamed({c: f"Raw_{c}" for c in context if c in rows.columns})
    # both sides grow with the returns, however small a compressed file of them looks: neither goes through the driver
    return meta.select(on, *context).hint("merge").join(renamed, on).select(*context, on, *[c for c in renamed.columns if c != on])


def ensured(df: DataFrame, numbers: list[str], ids: list[str]) -> DataFrame:
    """df with all of these columns: absent amounts are 0, absent ids null."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(0.0) for c in numbers if c not in have} | {c: F.lit(None).cast("string") for c in ids if c not in have})


def taxpayer_calendar(*metas: DataFrame) -> DataFrame:
    """Dim_Taxpayer_Calendar: one row a return key, from all returns."""
    out = None
    for m in metas:
        one = ensured(m, [], ["Legal_Name", "Trade_Name", "FY"]).select(*KEY, "Legal_Name", "Trade_Name", "FY")
        out = one if out is None else out.unionByName(one)
    d = D.label_date(F.col("Period_Year"))
    first = out.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("Legal_Name", "Trade_Name", "FY")])
    return first.withColumns({"PeriodDate": d, "MonthIndex": D.fiscal_index(d), "IsoMonth": F.date_format(d, "yyyy-MM")}).orderBy(F.col("PeriodDate").asc_nulls_last(), "GSTIN")


def liability(totals: DataFrame) -> DataFrame:
    """Fact_Liability: an amount a return, section and head; zeros are left out."""
    return gst.unpivoted(ensured(totals, R.HEADS, KEY), [*KEY, "Section_Code", "Section_Label"], R.HEADS)


def payments(paid: DataFrame) -> DataFrame:
    """Fact_Tax_Payments"""
    return gst.unpivoted(ensured(paid, PAID, KEY), [*KEY, "Section", "Description"], PAID, "Mode")


def outward(supplies: DataFrame) -> DataFrame:
    """Fact_Outward_Liability from rows as maps of header to cell."""
    row = F.col("row")
    words = dict(zip(HEADS, [("integrated",), ("central",), ("state", "tax"), ("cess",)], strict=True))
    flat = supplies.where("kind = 'Table_3_1'").select(*KEY, gst.lookup(row, "nature").alias("Nature"), *[N.to_float(gst.lookup(row, *w)).alias(h) for h, w in words.items()])
    return gst.unpivoted(flat, [*KEY, "Nature"], HEADS)


def eligible_credit(credit: DataFrame) -> DataFrame:
    """Fact_Eligible_ITC"""
    return gst.unpivoted(ensured(credit, HEADS, KEY), [*KEY, "Section", "Details"], HEADS)


def _sum(cond: Column, amount: str = "Amount") -> Column:
    return F.round(F.sum(F.when(cond, F.col(amount)).otherwise(0.0)), 2)


def outward_summary(returns: DataFrame, fact: DataFrame) -> DataFrame:
    """Seven measures a return of outward supplies, from one aggregation; a return without facts has zeros."""
    taxes = ["IGST", "CGST", "SGST", "Cess"]
    code, head = F.col("Section_Code"), F.col("Head")
    g = fact.groupBy(*KEY).agg(
        _sum(code.isin(R.SUPPLY) & (head == "Value")).alias("SupplyValue"), _sum(code.isin("6A", "6B") & (head == "Value")).alias("ExportValue"), _sum((code == "9B_CDNR") & (head == "Value")).alias("NotesValue"),
        *[_sum(code.isin(R.LIABILITY) & (head == t)).alias(f"Total_{t}") for t in taxes],
    )
    out = returns.select(*KEY).distinct().join(g, KEY, "left")
    return out.na.fill(0.0).withColumn("d_", D.label_date(F.col("Period_Year"))).orderBy(F.col("d_").asc_nulls_first(), "GSTIN").drop("d_")


def payment_summary(returns: DataFrame, out_fact: DataFrame, paid_fact: DataFrame, credit_fact: DataFrame, net: DataFrame, tol: N.Tolerances = N.DEFAULT) -> DataFrame:
    """A row a summary return: outward tax, net tax paid, credit used, cash, reverse charge and its credit, variance."""
    o = out_fact.groupBy(*KEY).agg(_sum(~F.col("Nature").rlike(r"(?i)\(d\)")).alias("GrossOutward"), _sum(F.col("Nature").rlike(r"(?i)\(d\)")).alias("RcmDeclared"))
    p = paid_fact.groupBy(*KEY).agg(_sum(F.col("Mode").startswith("ITC")).alias("CreditUsed"), _sum(F.col("Mode") == "Tax_paid_cash").alias("CashPaid"))
    c = credit_fact.groupBy(*KEY).agg(_sum(F.col("Details").rlike(r"\(3\)")).alias("RcmCredit"))
    n = net.groupBy(*KEY).agg(F.round(F.sum(F.coalesce("Net_Tax_Payable", F.lit(0.0))), 2).alias("NetPayable"))
    out = returns.select(*KEY).distinct()
    for part in (o, p, c, n):
        out = out.join(part.hint("merge"), KEY, "left")
    out = out.na.fill(0.0).withColumn("NetTaxPaid", F.round(F.col("CreditUsed") + F.col("CashPaid"), 2))
    out = out.withColumn("Variance", F.round(F.col("NetPayable") - F.col("NetTaxPaid"), 2))
    return out.withColumn("Status", F.when(F.abs("Variance") <= tol.gst, "PASS").otherwise("REVIEW"))


def gstr1_star(pages: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """The tables of the outward-supplies return's two masters."""
    meta = gst.gstr1_metadata(pages)
    labelled = gst.labelled(gst.summary_rows(cells))
    totals = with_context(gst.section_totals(labelled, meta), meta)
    fact = liability(totals)
    return {
        "Metadata": meta, "Raw_Rows": with_context(labelled, meta), "Section_Totals": totals, "Table_Coverage": with_context(gst.coverage(totals), meta), "Exceptions": with_context(gst.gstr1_checks(totals), meta),
        "Reconciliation": gst.liability_matrix(totals, KEY), "Dim_Taxpayer_Calendar": taxpayer_calendar(meta), "Fact_Liability": fact, "Summary": outward_summary(meta, fact),
    }


def gstr3b_star(pages: DataFrame, cells: DataFrame, keep: Callable[..., DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The tables of the summary return's two masters. `keep` writes a frame and reads it back, for what many are made of."""
    meta = keep(gst.gstr3b_metadata(pages).withColumnRenamed("Year", "FY"), "meta")
    tables = keep(gst.routed(cells), "tables")
    all_kinds = [name for name, _ in R.TABLES if name.startswith("Table") and name != "Table_6_1"]
    keyed = lambda df: with_context(df, meta, "source_file")
    promoted, credit, paid = gst.promoted(tables, all_kinds), gst.input_credit(tables), keep(gst.payments(tables), "paid")
    checks = keyed(gst.gstr3b_checks(promoted, credit, paid))
    facts = {"Fact_Outward_Liability": outward(keyed(promoted)), "Fact_Tax_Payments": payments(keyed(paid)), "Fact_Eligible_ITC": eligible_credit(keyed(credit))}
    return {
        "Metadata": meta, "Tables": keyed(promoted), "Table_4_ITC": keyed(credit), "Table_6_1": keyed(paid), "Exceptions": checks, "Checksum_Matrix": gst.checksum_matrix(meta, checks, KEY), "Dim_Taxpayer_Calendar": taxpayer_calendar(meta), **facts,
        "Summary": payment_summary(meta, facts["Fact_Outward_Liability"], facts["Fact_Tax_Payments"], facts["Fact_Eligible_ITC"], keyed(paid)),
    }


def net_sections(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Many measures by group; nulls don't count, and only a group of nulls is null."""
    return rows.groupBy(*keys).agg(*[F.sum(T.blank_to_null(F.col(m).cast("string")).try_cast("double")).alias(m) for m in measures])
