"""Frames of the spreadsheet generation: one contract for all returns, its sorts, and the union of what is there."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import text as T
from quillbook.operators import flags
from quillbook.sources import layout

#: The columns that all frames have, and what each frame is sorted by after year and month.
CONTRACT = {"ReturnType": "string", "EntityID": "string", "EntityName": "string", "FY": "string", "PeriodDate": "date", "MonthName": "string", "MonthIndex": "int", "Status": "string", "Flags": "string", "PrimaryAmount": "double"}
ORDER = {"GSTR3B": ["EntityID"], "ESIC": ["Party"], "PF": ["EntityID"], "PTRC": ["EntityName"], "TDS": ["Section", "EntityID"]}
#: Printed labels of a tax challan's amounts.
TDS_AMOUNTS = {"Total Amount Paid": "AMOUNT (IN RS.)", "Tax": "TAX", "Surcharge": "SURCHARGE", "Cess": "CESS", "Interest": "INTEREST", "Penalty": "PENALTY", "Fee under section 234E": "FEE UNDER SECTION 234E"}
#: Major heads by what their upper-cased text has, in order.
TDS_HEADS = [("OTHER THAN COMPAN|0021", "Other than Companies"), ("COMPAN|CORPORATION|0020", "Corporation Tax")]


def contracted(rows: DataFrame, form: str, parsed: Column, found: Column, amount: Column) -> DataFrame:
    """rows with the contract's columns in front. Year and month are those of PeriodDate; without one they are Unknown and 0.
    `found` are the flags, `parsed` says which rows could be read: the others are errors with null amounts."""
    day, unknown = F.col("PeriodDate"), F.lit("Unknown")
    out = rows.withColumns({"ReturnType": F.lit(form), "FY": F.coalesce(D.fiscal_year(day), unknown), "MonthName": F.coalesce(D.month_name(day), unknown), "MonthIndex": F.coalesce(D.fiscal_index(day), F.lit(0)).cast("int")})
    out = out.withColumns({"Flags": found, "PrimaryAmount": F.when(parsed, amount.cast("double"))})
    out = out.withColumn("Status", flags.sheet_status(F.col("Flags"), parsed))
    return out.select(*CONTRACT, *[c for c in out.columns if c not in CONTRACT])


def in_order(frame: DataFrame, form: str) -> DataFrame:
    """By year, month and what the form's frame is sorted by, nulls first."""
    return frame.orderBy("FY", "MonthIndex", *ORDER[form])


def all_returns(frames: list[DataFrame | None], keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The contract's columns of all frames that are there, by form, year and month. A column that a frame lacks is null; at
    least one frame has to be there. A sort works its input out twice, once to find its ranges: `keep` writes the rows before."""
    typed = lambda f: f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in CONTRACT.items()])
    rows = reduce(DataFrame.unionAll, [typed(f) for f in frames if f is not None])
    return (keep(rows, "returns") if keep else rows).orderBy("ReturnType", "FY", "MonthIndex")


def merged(shards: list[DataFrame]) -> DataFrame:
    """Rows of all shards in the order of their files; what a shard lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards).orderBy("SourceFile")


def _number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def tds(cells: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A row a challan from its table cells: each value is the cell after its label. `failed` names files (source_file) that
    couldn't be read, which become error rows. The tax is due for the month before a payment in April or by the 7th, or one
    with interest."""
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "table_no", "row_no", "cells"))), lambda r: r["cells"]))
    rows = cells.groupBy("source_file").agg(flat.alias("c"))
    rows = rows.withColumn("c", F.filter(F.transform("c", lambda x: F.trim(F.replace(x, F.lit(":"), F.lit("")))), lambda x: x != ""))
    rows = rows.withColumn("u", F.transform("c", lambda x: F.upper(x)))
    place = lambda label: F.array_position("u", F.lit(label)).cast("int")
    value = lambda label: F.when(place(label) > 0, F.coalesce(F.get("c", place(label)), F.lit(""))).otherwise("")
    long = place("FINANCIAL YEAR") - place("NAME") - 1
    name = F.when((place("NAME") > 0) & (long >= 0), F.array_join(F.slice("c", place("NAME") + 1, F.greatest(long, F.lit(0))), " ")).otherwise(value("NAME"))
    head = reduce(lambda rest, h: F.when(F.upper(value("MAJOR HEAD")).rlike(h[0]), h[1]).otherwise(rest), reversed(TDS_HEADS), F.trim(F.split_part(value("MAJOR HEAD"), F.lit("("), F.lit(1))))
    rows = rows.select(
        F.col("source_file").alias("SourceFile"), F.coalesce(T.blank_to_null(value("TAN")), F.lit("Unknown")).alias("EntityID"), F.trim(F.regexp_replace(name, r"(?is)assessment year.*", "")).alias("EntityName"),
        F.when(value("NATURE OF PAYMENT") == "", "Unknown").otherwise(F.split_part(value("NATURE OF PAYMENT"), F.lit(" "), F.lit(1))).alias("Section"),
        head.alias("Major Head"), value("CHALLAN NO").alias("Challan No"), D.payment_date(value("DATE OF DEPOSIT")).alias("Payment Date"), *[_number(value(label)).alias(c) for c, label in TDS_AMOUNTS.items()],
    )
    paid = F.col("Payment Date")
    before = (F.month(paid) == 4) | (F.dayofmonth(paid) <= 7) | (F.col("Interest") > 0)
    total, *parts = [F.col(f"`{c}`") for c in TDS_AMOUNTS]
    rows = rows.withColumns({"Crosscheck Diff": total - reduce(lambda a, b: a + b, parts), "PeriodDate": F.trunc(F.when(before, F.add_months(paid, -1)).otherwise(paid), "month"), "read": F.lit(True)})
    if failed is not None:
        lost = failed.select(F.col("source_file").alias("SourceFile"), F.lit("ERROR").alias("EntityID"), F.col("source_file").alias("EntityName"), F.lit(False).alias("read"))
        rows = rows.unionByName(lost, allowMissingColumns=True)
    return contracted(rows, "TDS", F.col("read"), flags.sheet_tds(F.col("read")), F.col("Total Amount Paid")).drop("read")
