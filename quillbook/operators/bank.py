"""Bank statements and deposits: table rows to transactions, running balances, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.operators.geometry import carried
from quillbook.rules import banks as R

ORDER = ["page_no", "table_no", "row_no"]
#: What findings of a statement are called, in the order in which they are listed.
STATEMENT_CODES = ["NO_TRANSACTIONS", "TRANSACTION_DATE_MISSING", "DEBIT_CREDIT_CONFLICT", "RUNNING_BALANCE_MISMATCH", "SUMMARY_BALANCE_MISMATCH", "SUMMARY_BALANCE_MISSING"]
REQUIRED_METADATA = ["AccountNumber", "AccountName", "Currency", "PeriodFrom", "PeriodTo"]


def metadata(docs: DataFrame) -> DataFrame:
    """source_file, debt and the statement's own fields from text (null where not printed; INR by default)."""
    t = F.col("text")
    one = lambda *tries: T.blank_to_null(T.squeeze(F.coalesce(*tries)))
    rest, number, day = r"[^\n]+", r"[A-Z0-9*-]{5,}", r"\d{1,2}[-/][A-Za-z0-9]{2,3}[-/]\d{2,4}"
    money = r"[()0-9,.\-]+"
    dates = T.printed(*R.PERIOD) + r"[^\n\d]{0,12}(" + day + r")\s*" + T.printed(*R.PERIOD_WORDS) + r"\s*:?\s*(" + day + ")"
    name = F.coalesce(T.found(t, T.labelled(R.ACCOUNT_NAME, rest)), T.found(t, T.labelled([R.OWN_NAME], rest, start=True)), T.line_above(t, R.NAME_ABOVE), T.line_below(t, R.NAME_BELOW))
    sign = lambda x: F.when(F.col("debt"), -F.abs(x)).otherwise(x)
    period = lambda g: D.bank_date(F.regexp_extract(t, T.FLAGS + dates, g))
    return docs.select(
        "source_file", "debt", one(*[T.found(t, T.labelled(labels, number)) for labels in R.ACCOUNT_NUMBER]).alias("AccountNumber"), one(name).alias("AccountName"), one(T.found(t, T.labelled(R.ACCOUNT_TYPE, rest, start=True))).alias("AccountType"), F.coalesce(one(T.found(t, T.labelled(R.CURRENCY, r"[A-Z]{3}\b", start=True))), F.lit("INR")).alias("Currency"),
        period(1).alias("PeriodFrom"), period(2).alias("PeriodTo"), sign(N.parse_amount(T.found(t, T.labelled(R.OPENING, money)))).alias("OpeningBalance"), sign(N.parse_amount(T.last_match(t, T.labelled(R.CLOSING, money)))).alias("ClosingBalance"),
    )


def header_map(cells: Column) -> Column:
    """Canonical header to place (from 1) of a row's cells; of equal headers the first counts."""
    # names, and the first of each, are worked out once a row
    firsts = lambda names: F.filter(F.array_distinct(names), lambda n: n != "")
    places = lambda names: T.bound(firsts(names), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda n: F.array_position(names, n).cast("int"))))
    return T.bound(F.transform(cells, lambda c: T.canonical_header(c, R.HEADERS)), places)


def _is_statement_header(m: Column) -> Column:
    has = lambda k: F.map_contains_key(m, k)
    return has("date") & has("balance") & (has("description") | has("debit") | has("credit"))


def _is_deposit_header(m: Column) -> Column:
    return F.map_contains_key(m, "deposit number") & F.map_contains_key(m, "principal")


def _with_headers(cells: DataFrame, is_header) -> DataFrame:
    """Rows with the header that holds for their table: the first of its first eight rows that is one, or none."""
    rows = cells.withColumn("place", F.row_number().over(Window.partitionBy("source_file", "page_no", "table_no").orderBy("row_no")))
    rows = rows.withColumn("map", F.when(F.col("place") <= 8, header_map(F.col("cells"))))
    rows = rows.withColumn("head", F.when(F.coalesce(is_header(F.col("map")), F.lit(False)), F.struct("place", "map")))
    return rows.withColumn("own", F.min_by("head", F.when(F.col("head").isNotNull(), F.col("place"))).over(Window.partitionBy("source_file", "page_no", "table_no"))).drop("map", "head")


def _cell(name: str, m: str = "m") -> Column:
    return T.squeeze(F.get(F.col("cells"), F.element_at(F.col(m), F.lit(name)) - 1))


def transactions(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """Transactions from table rows; profiles (source_file, debt).

    A table without a header continues the last header before it, if its first row has a date in that header's place.
    """
    rows = _with_headers(cells, _is_statement_header)
    rows = carried(rows, ["source_file"], ORDER, F.col("own.map"), "before")
    rows = rows.withColumn("m", F.coalesce("own.map", "before"))
    first = F.max(F.when(F.col("place") == 1, D.bank_date(_cell("date")).isNotNull())).over(Window.partitionBy("source_file", "page_no", "table_no"))
    rows = rows.withColumn("goes_on", F.coalesce(first, F.lit(False)))
    rows = rows.where((F.col("own").isNotNull() & (F.col("place") > F.col("own.place"))) | (F.col("own").isNull() & F.col("m").isNotNull() & F.col("goes_on")))
    rows = rows.join(profiles.select("source_file", "debt"), "source_file")
    size = lambda n: F.abs(N.parse_amount(_cell(n)))
    out = rows.select(
        "source_file", *ORDER, D.bank_date(_cell("date")).alias("TransactionDate"), D.bank_date(_cell("value date")).alias("ValueDate"), _cell("description").alias("Description"), _cell("reference").alias("Reference"), size("debit").alias("Debit"), size("credit").alias("Credit"),
        N.signed_balance(_cell("balance"), _cell("balance type"), F.col("debt")).alias("Balance"), F.upper(_cell("balance type")).alias("BalanceType"), _cell("channel").alias("Channel"), F.col("page_no").alias("Page"), F.lit("profile table").alias("Method"),
    )
    out = out.where(F.col("TransactionDate").isNotNull() & F.coalesce("Debit", "Credit", "Balance").isNotNull())
    return out.withColumns({"Debit": F.coalesce("Debit", F.lit(0.0)), "Credit": F.coalesce("Credit", F.lit(0.0))})


def key_value_transactions(docs: DataFrame) -> DataFrame:
    """Transactions of the layout that prints one block of labels for each."""
    chunks = docs.select("source_file", F.posexplode(F.split("text", r"(?im)^Transaction Description\s+")).alias("row_no", "chunk")).where("row_no > 0")
    c = F.col("chunk")
    rest = F.regexp_replace(c, r"^[^\n]*\n?", "")
    side = F.upper(T.label_line(rest, "Debit/Credit"))
    amount = F.abs(N.parse_amount(T.label_line(rest, "Cheque Amount/Transaction Amount")))
    day = D.bank_date(T.label_line(rest, "Value Date"))
    out = chunks.select(
        "source_file", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), "row_no", day.alias("TransactionDate"), day.alias("ValueDate"), T.squeeze(F.regexp_extract(c, r"^[^\n]*", 0)).alias("Description"), F.coalesce(T.label_line(rest, "Customer Reference"), T.label_line(rest, "Bank Reference"), F.lit("")).alias("Reference"),
        F.when(side == "DEBIT", amount).otherwise(0.0).alias("Debit"), F.when(side == "CREDIT", amount).otherwise(0.0).alias("Credit"), F.lit(None).cast("double").alias("Balance"), F.lit("").alias("BalanceType"), F.coalesce(T.label_line(rest, "Product Type"), F.lit("")).alias("Channel"), F.lit(None).cast("int").alias("Page"), F.lit("profile key-value").alias("Method"), side.alias("side"), amount.alias("amount"),
    )
    return out.where(F.col("side").isin("DEBIT", "CREDIT") & (F.col("amount") > 0) & F.col("TransactionDate").isNotNull()).drop("side", "amount")


def deposits(cells: DataFrame) -> DataFrame:
    """Deposits of tables with a number and a principal."""
    rows = _with_headers(cells, _is_deposit_header).withColumn("m", F.col("own.map")).where(F.col("own").isNotNull() & (F.col("place") > F.col("own.place")))
    amount = lambda n: N.parse_amount(_cell(n))
    out = rows.select(
        "source_file", *ORDER, _cell("deposit number").alias("DepositNumber"), D.bank_date(_cell("deposit date")).alias("DepositDate"), amount("principal").alias("Principal"), D.bank_date(_cell("maturity date")).alias("MaturityDate"), amount("interest rate").alias("InterestRate"),
        amount("maturity amount").alias("MaturityAmount"), amount("gross interest").alias("GrossInterest"), amount("interest paid").alias("InterestPaid"), amount("tds").alias("TDS"), F.col("page_no").alias("Page"), F.lit("profile table").alias("Method"),
    )
    return out.where((F.col("DepositNumber") != "") & F.col("Principal").isNotNull())


def infer_balances(meta: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fills what a statement doesn't print from its first and last row, in the order of the file."""
    seq = F.struct(*order)
    ends = rows.groupBy(*keys).agg(F.min_by(F.struct("Balance", "Debit", "Credit", "TransactionDate"), seq).alias("a"), F.max_by(F.struct("Balance", "TransactionDate"), seq).alias("z"))
    out = meta.join(ends, keys, "left")
    fill = {"OpeningBalance": F.col("a.Balance") + F.col("a.Debit") - F.col("a.Credit"), "ClosingBalance": F.col("z.Balance"), "PeriodFrom": F.col("a.TransactionDate"), "PeriodTo": F.col("z.TransactionDate")}
    return out.withColumns({c: F.coalesce(c, e) for c, e in fill.items()}).drop("a", "z")


def running(rows: DataFrame, meta: DataFrame, keys: list[str], order: list[str], tol: N.Tolerances = N.DEFAULT) -> DataFrame:
    """Adds Previous, Expected and Mismatch. The balance before a row is the last one printed, or the opening balance; a
    row without a balance isn't compared, and what it moved isn't carried."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("Previous", F.last("Balance", ignorenulls=True).over(w)).join(meta.select(*keys, "OpeningBalance"), keys, "left")
    out = out.withColumn("Previous", F.coalesce("Previous", "OpeningBalance")).drop("OpeningBalance")
    out = out.withColumn("Expected", F.col("Previous") - F.col("Debit") + F.col("Credit"))
    # a relative part as small as float comparison allows, on top of the fixed tolerance
    allowed = F.greatest(F.lit(tol.bank), 1e-9 * F.greatest(F.abs("Expected"), F.abs("Balance")))
    return out.withColumn("Mismatch", F.coalesce(F.abs(F.col("Expected") - F.col("Balance")) > allowed, F.lit(False)))


def reconciled(rows: DataFrame, meta: DataFrame, keys: list[str], order: list[str], tol: N.Tolerances = N.DEFAULT) -> DataFrame:
    """One row a statement: totals, expected closing, difference, mismatches, finding codes, PASS or REVIEW."""
    moved = lambda c: F.abs(F.coalesce(c, F.lit(0.0))) > tol.bank
    g = running(rows, meta, keys, order, tol).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("TransactionDate").alias("dated"), F.count_if(moved("Debit") == moved("Credit")).alias("conflicts"), F.count_if("Mismatch").alias("RunningMismatches"), F.sum("Debit").alias("TotalDebit"), F.sum("Credit").alias("TotalCredit"),
    )
    out = meta.select(*keys, "OpeningBalance", "ClosingBalance").join(g, keys, "left")
    out = out.na.fill(0, ["n", "dated", "conflicts", "RunningMismatches"]).na.fill(0.0, ["TotalDebit", "TotalCredit"])
    out = out.withColumn("ExpectedClosing", F.col("OpeningBalance") - F.col("TotalDebit") + F.col("TotalCredit")).withColumn("Difference", F.col("ClosingBalance") - F.col("ExpectedClosing"))
    allowed = F.greatest(F.lit(tol.bank), 1e-9 * F.greatest(F.abs("ExpectedClosing"), F.abs("ClosingBalance")))
    rules = [F.col("n") == 0, (F.col("n") > 0) & (F.col("dated") != F.col("n")), F.col("conflicts") > 0, F.col("RunningMismatches") > 0, F.abs("Difference") > allowed, F.col("Difference").isNull()]
    codes = F.array_compact(F.array(*[F.when(r, c) for r, c in zip(rules, STATEMENT_CODES, strict=True)]))
    out = out.withColumn("codes", codes)
    return out.withColumn("Status", F.when(F.size("codes") == 0, "PASS").otherwise("REVIEW")).drop("dated", "conflicts")


def confidence(score: Column, n_findings: Column, ocr: Column) -> Column:
    x = score + F.when(n_findings == 0, 20).otherwise(0) - F.when(ocr, 20).otherwise(0) - F.least(F.lit(60), 15 * n_findings)
    return N.clamp(x).cast("int")


def bank_ledger(meta: DataFrame, recon: DataFrame, docs: DataFrame) -> DataFrame:
    """Ledger rows of statements; docs has source_file, bank (as classified), ocr_used."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    lost = F.array_compact(F.array(*[F.when(blank(c), f"{c.upper()}_MISSING") for c in REQUIRED_METADATA]))
    out = meta.join(recon.select("source_file", "codes", F.col("n").alias("RowsExtracted")), "source_file", "left").join(docs.select("source_file", "bank", "ocr_used"), "source_file")
    ocr = F.coalesce("ocr_used", F.lit(False))
    out = out.withColumn("all", F.concat(F.coalesce("codes", F.expr("cast(array() as array<string>)")), lost, F.array_compact(F.array(F.when(ocr, "OCR_TEXT")))))
    info = {b.code: b for b in R.BANKS}
    of = lambda attr: F.element_at(F.create_map(*[F.lit(x) for c, b in info.items() for x in (c, getattr(b, attr))]), F.col("bank.code"))
    score = confidence(F.col("bank.score"), F.size("all"), ocr)
    return out.select(
        F.lit("BANK").alias("ReturnType"), F.lit("Statement").alias("DocKind"), F.col("AccountNumber").alias("EntityID"), F.col("AccountName").alias("EntityName"), D.fiscal_year(F.col("PeriodTo")).alias("FY"), F.col("PeriodTo").alias("PeriodDate"), F.lit("").alias("MonthName"), F.lit(0).alias("MonthIndex"),
        F.when(F.size("all") > 0, "Review").otherwise("OK").alias("Status"), F.array_join("all", "; ").alias("Flags"), F.coalesce("ClosingBalance", F.lit(0.0)).alias("PrimaryAmount"), F.col("AccountNumber").alias("DocRef"), F.lit(None).cast("date").alias("FilingDate"), F.col("source_file").alias("SourceFile"),
        score.alias("Confidence"), N.grade(score).alias("ConfidenceGrade"), of("version").alias("ProfileVersion"), F.array_join("all", "; ").alias("ValidationFindings"), ocr.alias("OCRUsed"), F.col("bank.bank").alias("Bank"), of("document").alias("DocumentType"), "AccountType", "Currency", "PeriodFrom", "PeriodTo", "OpeningBalance", "ClosingBalance", "RowsExtracted",
    )


def review_first(recon: DataFrame) -> DataFrame:
    """By status, bank and file."""
    return recon.orderBy(F.when(F.col("Status") == "PASS", 1).otherwise(0), "Bank", "source_file")


def evidence(meta: DataFrame) -> DataFrame:
    """A row for each field that a statement has to have: SourceFile, Field, Value (null if not printed), Found."""
    fields = F.array(*[F.struct(F.lit(c).alias("Field"), F.col(c).cast("string").alias("Value")) for c in [*REQUIRED_METADATA, "OpeningBalance", "ClosingBalance"]])
    return meta.select(F.col("source_file").alias("SourceFile"), F.explode(fields).alias("f")).select("SourceFile", "f.*", (F.coalesce("f.Value", F.lit("")) != "").alias("Found"))


def deposit_totals(rows: DataFrame) -> DataFrame:
    """Per document: count, principal, latest maturity, finding codes."""
    g = rows.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("Principal").alias("PrimaryAmount"), F.max("MaturityDate").alias("PeriodTo"), F.count_if((F.col("DepositNumber") == "") | F.col("Principal").isNull()).alias("incomplete"))
    return g.withColumn("codes", F.array_compact(F.array(F.when(F.col("n") == 0, "NO_DEPOSITS"), F.when(F.col("incomplete") > 0, "DEPOSIT_FIELDS_MISSING"))))
