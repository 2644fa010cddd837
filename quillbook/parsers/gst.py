"""The two GST returns: sections of a summary table that spans pages, and tables told apart by what they contain.

Table rows come as (source_file, page_no, table_no, row_no, cells). Headers differ by document, so they stay data: a row
becomes a map from header to cell, and never columns of the frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.operators.geometry import carried
from quillbook.rules import gst as R

ORDER = ["page_no", "table_no", "row_no"]


def _fields(t: Column, meta: dict[str, tuple[list[str], str]]) -> list[Column]:
    """Cleaned values after printed labels, Unknown where there are none."""
    return [F.coalesce(T.blank_to_null(T.clean_cell(F.regexp_extract(t, T.FLAGS + r"\b" + T.labelled(labels, value), 1))), F.lit("Unknown")).alias(name) for name, (labels, value) in meta.items()]


# outward-supplies return ----------------------------------------------------------------------------------------------


def gstr1_metadata(pages: DataFrame) -> DataFrame:
    out = pages.where("page_no = 1").select(F.col("source_file").alias("SourceFile"), *_fields(F.col("text"), R.OUTWARD_META))
    return out.withColumn("Period_Year", D.period_year(F.col("Period"), F.col("FY")))


def summary_rows(cells: DataFrame) -> DataFrame:
    """Rows of the summary table: the third table of page one (the last if it has fewer), the first of each other page,
    without the header row and rows that describe nothing; exactly eight columns."""
    of_page = Window.partitionBy("source_file", "page_no")
    tables = cells.withColumns({"t_": F.dense_rank().over(of_page.orderBy("table_no")), "n_": F.max("table_no").over(of_page)})
    tables = tables.withColumn("count_", F.max("t_").over(of_page))
    wanted = F.when(F.col("page_no") == 1, F.when(F.col("count_") >= 3, 3).otherwise(F.col("count_"))).otherwise(1)
    first = F.min("row_no").over(Window.partitionBy("source_file", "page_no", "table_no"))
    rows = tables.withColumn("first_", first).where((F.col("t_") == wanted) & (F.col("row_no") > F.col("first_")))
    fixed = T.fit(F.col("cells"), len(R.SUMMARY_COLUMNS))
    rows = rows.select(F.col("source_file").alias("SourceFile"), *ORDER, *[T.clean_cell(F.get(fixed, F.lit(i))).alias(c) for i, c in enumerate(R.SUMMARY_COLUMNS)])
    return rows.where((F.col("Description") != "") & (F.lower("Description") != "description"))


def section_code(description: Column) -> Column:
    """The first section whose pattern the description matches; null if none."""
    out = None
    for code, _, start, _ in R.SECTIONS:
        hit = description.rlike("(?i)" + start)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def labelled(rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds Section_Code: a row that names a section begins it, and others continue it."""
    return carried(rows, keys or ["SourceFile"], order or ORDER, section_code(F.col("Description")), "Section_Code", F.lit(""))


def sections(spark) -> DataFrame:
    return spark.createDataFrame([(i, c, t, p) for i, (c, t, _, p) in enumerate(R.SECTIONS)], "seq int, Section_Code string, Section_Label string, total_pattern string")


def section_totals(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document and section, whether printed or not: the first of the section's rows that is its total.

    documents (SourceFile) times 33 sections, each looked up once.
    """
    spark = rows.sparkSession
    hit = None
    for code, _, _, total in R.SECTIONS:
        match = F.col("Description").rlike("(?i)" + total)
        hit = F.when(F.col("Section_Code") == code, match) if hit is None else hit.when(F.col("Section_Code") == code, match)
    w = Window.partitionBy("SourceFile", "Section_Code").orderBy(*ORDER)
    first = rows.where(hit).withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    amounts = [N.to_float(F.col(c)).alias(c) for c in R.HEADS]
    first = first.select("SourceFile", "Section_Code", F.lit(True).alias("Found"), N.to_float(F.col("Num_Records")).cast("int").alias("Num_Records"), "Doc_Type", *amounts)
    all_ = documents.select("SourceFile").distinct().crossJoin(F.broadcast(sections(spark)))  # the 33 sections are fixed
    out = all_.join(first, ["SourceFile", "Section_Code"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in R.HEADS]
    return out.select("SourceFile", "seq", "Section_Code", "Section_Label", F.coalesce("Found", F.lit(False)).alias("Found"), F.coalesce("Num_Records", F.lit(0)).alias("Num_Records"), F.coalesce("Doc_Type", F.lit("")).alias("Doc_Type"), *zero)


def coverage(totals: DataFrame) -> DataFrame:
    some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in R.HEADS])
    return totals.withColumn("Has_Data", F.when(some, "Yes").otherwise("No")).select("SourceFile", "Section_Code", "Section_Label", "Has_Data", "Found", "Num_Records", *R.HEADS)


def gstr1_checks(totals: DataFrame, key: str = "SourceFile", tol: N.Tolerances = N.DEFAULT, enabled: frozenset[str] | None = None) -> DataFrame:
    """Exceptions (key, Check, Computed, Reported, Variance, Status) of the six rules, from one pass over the sections.

    enabled names the rules that are on (all, if it is null). What only the others need isn't summed, or even read."""
    on = lambda rule: enabled is None or rule in enabled
    needed: dict[str, Column] = {}

    def value(codes: list[str], c: str) -> Column:
        """A sum over the rows of these sections, as a column of the one aggregate."""
        name = f"{c}_{'_'.join(codes)}"
        needed[name] = F.sum(F.when(F.col("Section_Code").isin(codes), N.numeric_or_zero(F.col(c))).otherwise(0.0)).alias(name)
        return F.col(name)

    def finding(check: str, bad: Column, computed: Column, reported: Column, variance: Column, status: str) -> Column:
        return F.when(bad, F.struct(F.lit(check).alias("Check"), F.round(computed.cast("double"), 2).alias("Computed"), F.round(reported.cast("double"), 2).alias("Reported"), F.round(variance.cast("double"), 2).alias("Variance"), F.lit(status).alias("Status")))

    zero, rules = F.lit(0.0), []
    for h in R.HEADS if on("Total_Liability") else []:
        made, stated = value(R.LIABILITY, h), value(["TOTAL_LIABILITY"], h)
        gap = F.round(made - stated, 2)
        rules.append(finding(f"Total_Liability_{h}", F.abs(gap) > tol.gst, made, stated, gap, "FAIL"))
    if on("HSN_vs_Supply_Tables"):
        supply, hsn = value(R.SUPPLY, "Value"), value(["12_HSN"], "Value")
        share = F.abs(F.try_divide(hsn - supply, supply)) * 100
        rules.append(finding("HSN_vs_Supply_Tables", (supply != 0) & (share > tol.hsn_percent), supply, hsn, hsn - supply, "WARN"))
    for s in R.COUNTED if on("Record_Count") else []:
        n, v = value([s], "Num_Records"), value([s], "Value")
        rules.append(finding(f"Record_Count_{s}", ((n == 0) & (v != 0)) | ((n > 0) & (v == 0)), n, v, zero, "WARN"))
    if on("B2CL_Threshold"):
        n, v = value(["5"], "Num_Records"), value(["5"], "Value")
        mean = F.try_divide(v, n)
        rules.append(finding("B2CL_Threshold", (n > 0) & (mean <= tol.b2cl_average), mean, F.lit(tol.b2cl_average), zero, "FAIL"))
    for s in R.INTERSTATE if on("Interstate_Tax") else []:
        central, state = value([s], "CGST"), value([s], "SGST")
        rules.append(finding(f"Interstate_Tax_{s}", (central > 0) | (state > 0), central + state, zero, central + state, "FAIL"))
    if on("CDNR_Sign_Check"):
        notes = value(["9B_CDNR", "9C_CDNUR"], "Value")
        rules.append(finding("CDNR_Sign_Check", notes > 0, notes, zero, notes, "WARN"))
    if not rules:
        return totals.where("false").select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("Check", "string"), ("Computed", "double"), ("Reported", "double"), ("Variance", "double"), ("Status", "string"))])
    g = totals.groupBy(key).agg(*needed.values())
    return g.select(key, F.explode(F.array_compact(F.array(*rules))).alias("f")).select(key, "f.*")


def gstr1_status(worst: Column) -> Column:
    """Of the statuses of a return's exceptions: a failed check is an error, any other is for review."""
    return F.when(F.array_contains(worst, "FAIL"), "Error").when(F.size(worst) > 0, "Review").otherwise("OK")


def gstr1(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Ledger rows: the amount is the stated liability's taxes. The filing date is the acknowledgement's."""
    meta = gstr1_metadata(pages)
    totals = section_totals(labelled(summary_rows(cells)), meta)
    tax = F.sum(F.when(F.col("Section_Code") == "TOTAL_LIABILITY", F.col("IGST") + F.col("CGST") + F.col("SGST") + F.col("Cess")).otherwise(0.0))
    amount = totals.groupBy("SourceFile").agg(tax.alias("PrimaryAmount"))
    failed = gstr1_checks(totals).groupBy("SourceFile").agg(F.array_sort(F.collect_list("Check")).alias("checks"), F.collect_set("Status").alias("worst"))
    out = meta.join(amount, "SourceFile", "left").join(failed, "SourceFile", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        F.lit("GSTR1").alias("ReturnType"), F.lit("Return").alias("DocKind"), F.col("GSTIN").alias("EntityID"), F.col("Legal_Name").alias("EntityName"), "FY", D.label_date(F.col("Period_Year")).alias("PeriodDate"),
        gstr1_status(F.coalesce("worst", none)).alias("Status"), F.array_join(F.coalesce("checks", none), "; ").alias("Flags"), "PrimaryAmount", F.col("ARN").alias("DocRef"), D.form_date(F.col("ARN_Date")).alias("FilingDate"), "SourceFile",
    )


# summary return -------------------------------------------------------------------------------------------------------


def routed(cells: DataFrame) -> DataFrame:
    """(source_file, page_no, table_no, kind, rows): each table with its kind, the first that any of its cells tells."""
    tables = cells.groupBy("source_file", "page_no", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    tables = tables.withColumn("all_", F.flatten(F.col("rows")["cells"]))
    all_cells = F.col("all_")
    has = lambda p: F.exists(all_cells, lambda c: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False)))
    kind = None
    for name, pattern in R.TABLES:
        hit = has(pattern)
        if name == "Table_Breakup":
            hit = hit | (F.array_contains(all_cells, "Period") & F.array_contains(all_cells, "Integrated tax"))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    tables = tables.withColumn("kind", kind).where("kind is not null")
    # of the tables of a kind the last counts, but input credit comes in pieces
    last = F.row_number().over(Window.partitionBy("source_file", "kind").orderBy(F.desc("page_no"), F.desc("table_no")))
    return tables.drop("all_").withColumn("n_", last).where("n_ = 1 or kind like 'ITC%'").drop("n_")


def promoted(tables: DataFrame, kinds: list[str]) -> DataFrame:
    """(source_file, kind, seq, row): rows under their table's first row as a map from unique header to cell."""
    header = T.unique_headers(F.get(F.col("rows"), F.lit(0))["cells"])
    body = tables.where(F.col("kind").isin(kinds)).withColumn("header", header).select("source_file", "kind", "header", F.posexplode("rows").alias("seq", "r")).where("seq > 0")
    body = body.where(F.exists("r.cells", lambda c: c.isNotNull()))
    width = F.size("header")
    cells = F.slice(F.concat("r.cells", F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)
    return body.select("source_file", "kind", "seq", F.map_from_arrays("header", cells).alias("row"))


def payment_header(c: Column) -> Column:
    """The canonical name of a payment table's header, by the words in it; others keep theirs."""
    s, out = F.lower(c), None
    for name, words, not_ in R.PAYMENT_WORDS:
        fits = reduce(lambda a, b: a & b, [s.contains(w) for w in words] + [~s.contains(w) for w in not_])
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(c)


def payments(tables: DataFrame) -> DataFrame:
    """(source_file, seq, Section, Description and ten amounts) of the payment table, whose header is two rows."""
    t = tables.where("kind = 'Table_6_1'").where(F.size("rows") >= 3)
    top, low = F.get(F.col("rows"), F.lit(0))["cells"], F.get(F.col("rows"), F.lit(1))["cells"]
    both = F.zip_with(top, low, lambda a, b: F.trim(F.concat_ws(" ", T.clean_cell(a), T.clean_cell(b))))
    t = t.withColumn("header", F.transform(T.unique_headers(both), payment_header)).where(F.array_contains("header", "Description"))
    rows = t.select("source_file", "header", F.posexplode("rows").alias("seq", "r")).where("seq >= 2")
    cell = lambda name: F.when(F.array_position("header", name) > 0, F.get(F.col("r.cells"), (F.array_position("header", name) - 1).cast("int")))
    rows = rows.select("source_file", "seq", *[cell(c).alias(c) for c in R.PAYMENT_HEADERS])
    head = F.when(F.col("Description").rlike(r"\([AB]\)"), F.col("Description"))
    rows = carried(rows, ["source_file"], ["seq"], head, "Section").where(~F.coalesce(F.col("Description").rlike(r"\([A-B]\)"), F.lit(False)))
    return rows.select("source_file", "seq", T.clean_cell(F.col("Section")).alias("Section"), T.clean_cell(F.col("Description")).alias("Description"), *[F.when(F.col(c).isNotNull(), N.to_float(F.col(c))).alias(c) for c in R.PAYMENT_HEADERS[1:]])


def input_credit(tables: DataFrame) -> DataFrame:
    """(source_file, seq, Section, Details and four amounts): the pieces of the input-credit table in page order."""
    pieces = tables.where("kind like 'ITC%'").select("source_file", "page_no", "table_no", "kind", F.posexplode("rows").alias("row_no", "r"))
    pieces = pieces.where("not (kind = 'ITC_first' and row_no = 0)").where(F.exists("r.cells", lambda c: c.isNotNull()))
    fixed = T.fit(F.col("r.cells"), 5, F.lit(""))
    pieces = pieces.select("source_file", *ORDER, *[F.get(fixed, F.lit(i)).alias(c) for i, c in enumerate(R.ITC_COLUMNS)])
    pieces = pieces.where(~F.coalesce(F.col("Details").rlike("(?i)Details"), F.lit(False))).withColumn("Details", T.clean_cell(F.col("Details")))
    pieces = carried(pieces, ["source_file"], ORDER, F.when(F.col("Details").rlike(r"^[A-D]\."), F.col("Details")), "Section")
    pieces = pieces.where(~F.col("Details").rlike(r"^[ABD]\."))
    return pieces.select("source_file", *ORDER, T.clean_cell(F.col("Section")).alias("Section"), "Details", *[N.to_float(F.col(c)).alias(c) for c in R.ITC_COLUMNS[1:]])


def lookup(row: Column, *words: str) -> Column:
    """The first cell of a row whose header has all of the words, by normalised name."""
    has = lambda name: reduce(lambda a, b: a & b, [name.contains(w) for w in words])
    names = F.filter(F.map_keys(row), lambda k: T.bound(T.normalised(k), has))
    return F.element_at(row, F.get(names, F.lit(0)))


def masked_sum(match: Column, value: Column) -> Column:
    """The sum over matching rows to two places; null if no row matches, which isn't the same as 0."""
    return F.round(F.sum(F.when(match, F.coalesce(value, F.lit(0.0)))), 2)


def gstr3b_metadata(pages: DataFrame) -> DataFrame:
    out = pages.where("page_no = 1").select("source_file", *_fields(F.col("text"), R.SUMMARY_META))
    return out.withColumn("Period_Year", D.period_year(F.col("Period"), F.col("Year")))


def analysis(meta: DataFrame, supplies: DataFrame, credit: DataFrame, paid: DataFrame) -> DataFrame:
    """One wide row a return, and its missing fields. A number is null where its source row wasn't found, and so is all
    that is worked out from it."""
    c = F.col
    nature = lambda k: lookup(c("row"), "nature").rlike("(?i)" + R.SUPPLY_ROWS[k])
    cell = lambda *w: N.to_float(lookup(c("row"), *w))
    words = {"IGST": ("integrated",), "CGST": ("central",), "SGST": ("state", "tax")}
    s = supplies.where("kind = 'Table_3_1'").groupBy("source_file").agg(
        *[masked_sum(nature(k), cell("taxable", "value")).alias(f"v_{k}") for k in R.SUPPLY_ROWS],
        *[masked_sum(nature(k), cell(*w)).alias(f"{t}_{k}") for t, w in words.items() for k in R.SUPPLY_ROWS],
    )
    columns = dict(zip(words, ["Integrated tax", "Central tax", "State/UT tax"], strict=True))
    k = credit.groupBy("source_file").agg(*[masked_sum(c("Section").startswith(p), c(f"`{col}`")).alias(f"{n}_{t}") for n, p in (("in", "A."), ("not", "B.")) for t, col in columns.items()])
    pay = lambda mark, tax, col: masked_sum(c("Section").contains(mark) & T.normalised(c("Description")).contains(R.TAXES[tax]), c(col))
    flows = {"IGST to IGST": ("IGST", "ITC_Integrated"), "IGST to CGST": ("CGST", "ITC_Integrated"), "IGST to SGST": ("SGST", "ITC_Integrated"), "CGST to IGST": ("IGST", "ITC_Central"), "CGST to CGST": ("CGST", "ITC_Central"), "SGST to IGST": ("IGST", "ITC_State_UT"), "SGST to SGST": ("SGST", "ITC_State_UT")}
    cash = lambda col: reduce(lambda a, b: a + b, [pay(m, t, col) for m in ("(A)", "(B)") for t in R.TAXES])
    p = paid.groupBy("source_file").agg(*[pay("(A)", t, col).alias(n) for n, (t, col) in flows.items()], F.round(cash("Interest_paid_cash"), 2).alias("Interest paid"), F.round(cash("Late_fee_paid_cash"), 2).alias("Late Fees paid"))
    out = meta.join(s, "source_file", "left").join(k, "source_file", "left").join(p, "source_file", "left")
    r2 = lambda x: F.round(x, 2)
    out = out.withColumns({f"Output {t}": r2(c(f"{t}_a") + c(f"{t}_b") + c(f"{t}_c")) for t in words} | {f"RCM {t} Payable": c(f"{t}_d") for t in words} | {f"Total Input {t}": c(f"in_{t}") for t in words} | {f"Ineligible {t}": c(f"not_{t}") for t in words} | {f"Net Input {t}": r2(c(f"in_{t}") - c(f"not_{t}")) for t in words})
    used = {t: [n for n, (to, _) in flows.items() if to == t] for t in words}
    payable = {f"{t} Payable": r2(c(f"Output {t}") + c(f"RCM {t} Payable") - reduce(lambda a, b: a + b, [c(n) for n in used[t]])) for t in words}
    filed = D.form_date(c("Date_of_ARN"))
    out = out.withColumns(payable | {"Return Period": D.iso_month(c("Period_Year")), "Month": c("Period"), "Company Name": c("Legal_Name"), "Trade Name": c("Trade_Name"), "Date of filing": F.date_format(filed, "yyyy-MM-dd"), "Source File": c("source_file"), "RCM Taxable Value": c("v_d"), **{title: c(f"v_{key}") for key, title in R.OUTWARD.items()}})
    lost = F.array_compact(F.array(*[F.when(c(f"`{f}`").isNull() | c(f"`{f}`").cast("string").isin("", "Unknown"), f) for f in R.REQUIRED]))
    out = out.withColumn("missing", lost)
    codes = F.when(F.size("missing") > 0, "GSTR3B_FIELDS_MISSING").otherwise("")
    out = out.withColumns({"Missing Fields": F.array_join("missing", "; "), "Validation Findings": codes, "Status": F.when(F.size("missing") > 0, "Review").otherwise("OK")})
    return out.select(*[c(f"`{f}`") for f in R.ANALYSIS])


def gstr3b_checks(supplies: DataFrame, credit: DataFrame, paid: DataFrame, tol: N.Tolerances = N.DEFAULT, enabled: frozenset[str] | None = None) -> DataFrame:
    """Exceptions (source_file, Check, Sanity_Status, Variance) of payment, credit and reverse-charge rules, as far as they are
    enabled (all, if that is null)."""
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    total = reduce(lambda a, b: a + b, [zero(x) for x in ("ITC_Integrated", "ITC_Central", "ITC_State_UT", "ITC_Cess", "Tax_paid_cash")])
    gap = F.round(zero("Net_Tax_Payable") - total, 2)
    first = paid.where("Net_Tax_Payable is not null and Tax_paid_cash is not null").select("source_file", F.lit("Payment_Recon_6_1").alias("Check"), F.lit("FAIL").alias("Sanity_Status"), gap.alias("Variance")).where(F.abs("Variance") > tol.gst)
    heads = R.ITC_COLUMNS[1:]
    part = lambda cond, h: F.sum(F.when(cond, c(f"`{h}`")).otherwise(0.0))
    g = credit.groupBy("source_file").agg(*[F.round(part(c("Section").startswith("A."), h) - part(c("Section").startswith("B."), h) - part(c("Details").rlike("(?i)Net ITC available"), h), 2).alias(h) for h in heads])
    name = F.concat(F.lit("ITC_Math_"), F.regexp_replace("h", "[/ ]", "_"))
    second = g.unpivot(["source_file"], [c(f"`{h}`") for h in heads], "h", "Variance").select("source_file", name.alias("Check"), F.lit("FAIL").alias("Sanity_Status"), "Variance").where(F.abs("Variance") > tol.gst)
    tax3 = N.to_float(lookup(c("row"), "integrated")) + N.to_float(lookup(c("row"), "central")) + N.to_float(lookup(c("row"), "state", "tax"))
    rcm = supplies.where("kind = 'Table_3_1'").groupBy("source_file").agg(F.sum(F.when(lookup(c("row"), "nature").rlike(r"(?i)\(d\)"), tax3).otherwise(0.0)).alias("rcm"))
    claimed = credit.groupBy("source_file").agg(F.sum(F.when(c("Details").rlike(r"\(3\)"), c("`Integrated tax`") + c("`Central tax`") + c("`State/UT tax`")).otherwise(0.0)).alias("claimed"))
    third = rcm.join(claimed, "source_file").where((c("rcm") > 0) & (F.abs(c("rcm") - c("claimed")) / c("rcm") * 100 > tol.rcm_percent))
    third = third.select("source_file", F.lit("RCM_CrossCheck").alias("Check"), F.lit("WARN").alias("Sanity_Status"), F.round(c("rcm") - c("claimed"), 2).alias("Variance"))
    parts = [df for rule, df in (("Payment_Recon_6_1", first), ("ITC_Math", second), ("RCM_CrossCheck", third)) if enabled is None or rule in enabled]
    return reduce(DataFrame.unionByName, parts) if parts else first.where("false")


def gstr3b(pages: DataFrame, cells: DataFrame, keep: Callable[..., DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, analysis rows). A failed check puts this return up for review; it is no error. `keep` writes a frame and
    reads it back, for what many tables are made of."""
    tables = keep(routed(cells), "tables")
    supplies, credit, paid = keep(promoted(tables, ["Table_3_1"]), "supplies"), keep(input_credit(tables), "credit"), keep(payments(tables), "paid")
    # neither side of the joins by file is small, however small it looks in a compressed file
    meta = keep(gstr3b_metadata(pages), "meta").hint("merge")
    wide = analysis(meta, supplies, credit, paid)
    checks = gstr3b_checks(supplies, credit, paid).groupBy("source_file").agg(F.array_sort(F.collect_list("Check")).alias("checks"))
    amount = paid.groupBy("source_file").agg(F.coalesce(F.sum("Net_Tax_Payable"), F.sum("Tax_Payable"), F.lit(0.0)).alias("PrimaryAmount"))
    out = meta.join(checks, "source_file", "left").join(amount, "source_file", "left").join(wide.select(F.col("`Source File`").alias("source_file"), F.col("`Validation Findings`").alias("found")), "source_file", "left")
    flags = T.distinct_flags(F.array_compact(F.concat(F.coalesce("checks", F.expr("cast(array() as array<string>)")), F.array(T.blank_to_null(F.col("found"))))))
    out = out.withColumn("Flags", flags)
    ledger = out.select(
        F.lit("GSTR3B").alias("ReturnType"), F.lit("Return").alias("DocKind"), F.col("GSTIN").alias("EntityID"), F.col("Legal_Name").alias("EntityName"), F.col("Year").alias("FY"), D.label_date(F.col("Period_Year")).alias("PeriodDate"),
        F.when(F.col("Flags") != "", "Review").otherwise("OK").alias("Status"), "Flags", F.coalesce("PrimaryAmount", F.lit(0.0)).alias("PrimaryAmount"), F.col("ARN").alias("DocRef"), D.form_date(F.col("Date_of_ARN")).alias("FilingDate"), F.col("source_file").alias("SourceFile"),
    )
    return ledger, wide


# facts and matrices ---------------------------------------------------------------------------------------------------


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str = "Head", amount: str = "Amount", drop_zero: bool = True) -> DataFrame:
    """A row for each amount that isn't zero."""
    out = df.unpivot(ids, [F.col(f"`{v}`") for v in values], name, amount)
    return out.where(F.col(amount) != 0) if drop_zero else out


def liability_matrix(totals: DataFrame, keys: list[str], tol: N.Tolerances = N.DEFAULT) -> DataFrame:
    """For each return and head: the sections' sum, the stated footer, their variance, PASS or FAIL."""
    side = lambda codes, h: F.round(F.sum(F.when(F.col("Section_Code").isin(codes), F.coalesce(h, F.lit(0.0))).otherwise(0.0)), 2)
    g = totals.groupBy(*keys).agg(*[F.struct(side(R.LIABILITY, h).alias("Computed"), side(["TOTAL_LIABILITY"], h).alias("Reported")).alias(h) for h in R.HEADS])
    out = g.unpivot(keys, R.HEADS, "Head", "s").select(*keys, "Head", "s.*").withColumn("Variance", F.round(F.col("Computed") - F.col("Reported"), 2))
    return out.withColumn("Status", F.when(F.abs("Variance") <= tol.gst, "PASS").otherwise("FAIL"))


def checksum_matrix(returns: DataFrame, exceptions: DataFrame, keys: list[str], check: str = "Check", status: str = "Sanity_Status", order: list[str] | None = None) -> DataFrame:
    """Every return times the known checks, with the status of the first exception or PASS."""
    checks = returns.sparkSession.createDataFrame([(i, c) for i, c in enumerate(R.KNOWN_CHECKS)], f"check_seq int, {check} string")
    w = Window.partitionBy(*keys, check).orderBy(*(order or [status]))
    first = exceptions.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select(*keys, check, status)
    return returns.select(*keys).distinct().crossJoin(F.broadcast(checks)).join(first, [*keys, check], "left").withColumn(status, F.coalesce(status, F.lit("PASS")))  # six fixed checks
