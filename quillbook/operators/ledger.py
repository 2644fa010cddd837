"""The common ledger: consolidation, reconciliation, audit, dashboard, review."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import dates, numbers, text
from quillbook.rules import forms

#: What the sentences in findings say.
MESSAGES = {
    "SPARSE_TEXT": "Low extracted text density; verify fields against the source PDF.",
    "OCR_TEXT": "Fields were read by local OCR; verify them against the source PDF.",
    "AMBIGUOUS_TYPE": "Document classification did not clear the acceptance margin.",
}
LEDGER_TYPES = {"PeriodDate": "date", "MonthIndex": "int", "PrimaryAmount": "double", "FilingDate": "date", "Confidence": "int", "OCRUsed": "boolean"}


def consolidated(rows: DataFrame) -> DataFrame:
    """Rows of any parser as core ledger rows: absent columns are added, calendar columns derived, defaults set."""
    have = set(rows.columns)
    get = lambda c: F.col(f"`{c}`") if c in have else F.lit(None)
    d = get("PeriodDate").cast("date")
    flags = F.coalesce(get("Flags").cast("string"), F.lit(""))
    cols = {c: get(c).cast(LEDGER_TYPES.get(c, "string")) for c in forms.LEDGER_CORE}
    cols |= {
        "DocKind": F.coalesce(get("DocKind"), F.lit("Return")),
        "FY": F.coalesce(text.blank_to_null(get("FY").cast("string")), dates.fiscal_year(d)),
        "PeriodDate": d,
        "MonthName": dates.month_name(d) if "MonthName" not in have else get("MonthName"),
        "MonthIndex": dates.fiscal_index(d) if "MonthIndex" not in have else get("MonthIndex").cast("int"),
        "Flags": flags,
        "Status": F.coalesce(get("Status").cast("string"), F.when(flags == "", "OK").otherwise("Review")),
        "PrimaryAmount": F.coalesce(get("PrimaryAmount").cast("double"), F.lit(0.0)),
    }
    return rows.select(*[cols[c].alias(c) for c in forms.LEDGER_CORE])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames of different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered(ledger: DataFrame) -> DataFrame:
    keys = ["ReturnType", "DocKind", "FY", "MonthIndex", "EntityID", "SourceFile"]
    return ledger.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def lead_columns(df: DataFrame, lead: list[str]) -> DataFrame:
    return df.select(*[c for c in lead if c in df.columns], *[c for c in df.columns if c not in lead])


def dashboard(ledger: DataFrame) -> DataFrame:
    """Counts and amounts by form, kind and year. Rows with a null key are left out."""
    is_ = lambda s: F.count_if(F.col("Status") == s)
    keys = ["ReturnType", "DocKind", "FY"]
    return ledger.dropna(subset=keys).groupBy(*keys).agg(
        F.count("Status").alias("Records"), is_("OK").alias("OK"), is_("Review").alias("Review"), is_("Error").alias("Errors"),
        F.countDistinct("PeriodDate").alias("Periods"), F.sum("PrimaryAmount").alias("TotalAmount"),
    )


def flag_rate(ledger: DataFrame) -> DataFrame:
    """By form and year, with the share of rows that aren't OK to three places."""
    is_ = lambda s: F.count_if(F.col("Status") == s)
    out = ledger.groupBy("ReturnType", "FY").agg(F.count("*").alias("Records"), is_("OK").alias("OK"), is_("Review").alias("Review"), is_("Error").alias("Errors"), F.sum("PrimaryAmount").alias("TotalAmount"))
    return out.withColumn("FlagRate", F.round(F.try_divide(F.col("Review") + F.col("Errors"), F.col("Records")), 3))


#: Groups up to this number are sent to all tasks; more are merged by their keys.
FEW_GROUPS = 100_000


def top_two(rows: DataFrame, keys: list[str], largest: str, ties: list[str], keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """keys, first, second: the two rows that come first in each group, as structs of `largest` (falling, nulls last) and
    ties (rising). Two minima, which are made of partial ones: no group is ever sorted, or gathered in one task. Second is
    null where all rows of a group are equal in these columns. `keep` writes a frame and reads it back: then Spark knows before
    it shuffles rows whether the groups are few."""
    place = _place(largest, ties)
    best = _sized(rows.groupBy(*keys).agg(F.min(place).alias("first")), "first", keep)
    behind = _beside(rows.withColumn("place_", place), best, keys).where(F.col("place_") > F.col("first"))
    return _sized(_beside(best, behind.groupBy(*keys).agg(F.min("place_").alias("second")), keys), "second", keep)


def _sized(groups: DataFrame, name: str, keep: Callable[..., DataFrame] | None) -> DataFrame:
    if keep is None:
        return groups
    kept = keep(groups, name)
    return F.broadcast(kept) if kept.count() <= FEW_GROUPS else kept.hint("merge")


def _place(largest: str, ties: list[str]) -> Column:
    return F.struct(F.col(largest).isNull().alias("none"), (-F.col(largest)).alias("minus"), *[F.struct(F.col(t).isNull().alias("none"), F.col(t).alias("tie")).alias(f"tie_{i}") for i, t in enumerate(ties)])


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns that found has for their group; nulls are a group. Found has one row a group, so Spark sends it
    to all tasks where it is small, and splits large groups of rows where it is not."""
    names = {k: f"{k}_of" for k in keys}
    for k, n in names.items():
        found = found.withColumnRenamed(k, n)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(found, on, "left").drop(*names.values())


def party_rank(rows: DataFrame, keys: list[str], largest: str, ties: list[str], name: str = "Party", keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Employer for the largest of a group, Employee for the next, Other for the rest. Ties tell rows of one amount apart:
    rows that are equal in them, too, get the same party."""
    out = _beside(rows.withColumn("place_", _place(largest, ties)), top_two(rows, keys, largest, ties, keep), keys)
    party = F.when(F.col("place_") == F.col("first"), "Employer").when(F.col("place_") == F.col("second"), "Employee").otherwise("Other")
    return out.withColumn(name, party).drop("place_", "first", "second")


def _group_key() -> Column:
    # a document without a period is a group of its own: pooling it with others would make up mismatches
    return F.coalesce(F.col("PeriodDate").cast("string"), F.concat(F.lit("~undated~"), F.col("SourceFile")))


def reconcile(ledger: DataFrame, roles: dict[str, forms.Roles] = forms.ROLES, tol: numbers.Tolerances = numbers.DEFAULT) -> DataFrame:
    """Demand against settlement by form, entity and period, for forms that have more than one kind of document.

    Carries `group_key` besides the report's columns. Groups with neither demand nor settlement are left out.
    """
    several = ledger.groupBy("ReturnType").agg(F.countDistinct("DocKind").alias("kinds")).where("kinds > 1").select("ReturnType")
    amount = lambda k: F.sum(F.when(F.col("DocKind") == k, F.coalesce("PrimaryAmount", F.lit(0.0))).otherwise(0.0))
    # as many rows as there are forms: shuffled, all documents of a form would meet in one task
    g = ledger.join(F.broadcast(several), "ReturnType", "left_semi").groupBy("ReturnType", "EntityID", _group_key().alias("group_key"))
    g = g.agg(F.first("PeriodDate").alias("PeriodDate"), F.count("*").alias("Docs"), *[amount(k).alias(k) for k in forms.KINDS])

    def by_role(part: str) -> Column:
        out = None
        for name, r in roles.items():
            hit, kind = F.col("ReturnType") == name, F.col(getattr(r, part))
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        default = F.col(getattr(forms.Roles(), part))
        return default if out is None else out.otherwise(default)

    g = g.withColumns({"demand_": by_role("demand"), "settled_": by_role("settlement")}).where("demand_ > 0 or settled_ > 0")
    delta = F.round(F.col("settled_") - F.col("demand_"), 2)
    within = F.abs(delta) <= F.greatest(F.lit(tol.reconcile_floor), tol.reconcile_share * F.col("demand_"))
    status = F.when((F.col("demand_") > 0) & (F.col("settled_") > 0), F.when(within, "Matched").otherwise("Mismatch")).when(F.col("demand_") > 0, "Unpaid?").otherwise("No demand doc")
    return g.select("ReturnType", "EntityID", "PeriodDate", "Docs", F.round("demand_", 2).alias("Declared"), *[F.round(k, 2).alias(k) for k in forms.KINDS], delta.alias("Delta"), status.alias("Status"), "group_key")


def flag_back(ledger: DataFrame, recon: DataFrame) -> DataFrame:
    """Every document of an unsettled group gets the group's flag, and is for review if it was OK."""
    tag = F.when(F.col("Status") == "Mismatch", "UNRECONCILED").when(F.col("Status") == "Unpaid?", "UNPAID?").when(F.col("Status") == "No demand doc", "NO DEMAND")
    tags = recon.select(F.col("ReturnType").alias("r_"), F.col("EntityID").alias("e_"), F.col("group_key").alias("k_"), tag.alias("tag_")).where("tag_ is not null")
    out = ledger.withColumn("g_", _group_key()).join(tags, (F.col("ReturnType") == F.col("r_")) & F.col("EntityID").eqNullSafe(F.col("e_")) & (F.col("g_") == F.col("k_")), "left")
    flags = F.concat_ws("; ", text.blank_to_null(F.col("Flags")), F.col("tag_"))
    status = F.when(F.col("tag_").isNotNull() & (F.col("Status") == "OK"), "Review").otherwise(F.col("Status"))
    return out.withColumns({"Flags": flags, "Status": status}).select(*ledger.columns)


def audited(ledger: DataFrame, weights: forms.AuditWeights | None = None) -> DataFrame:
    """Adds confidence, findings and evidence to ledger rows that carry form, sparse_text and ocr_used.

    The score starts at the classifier's, loses for sparse text and OCR, is capped if the form is in doubt, and loses for
    each required field that is missing. Rows without a form (null) pass as they are, with null confidence.
    """
    weights = weights or forms.AuditWeights()
    sparse, ocr = F.coalesce("sparse_text", F.lit(False)), F.coalesce("ocr_used", F.lit(False))
    form = F.col("form.return_type")
    required = F.lit(None).cast("array<string>")
    for name, fields in weights.required.items():
        required = F.when(form == name, F.array(*map(F.lit, fields))).otherwise(required)
    fields = sorted({f for r in weights.required.values() for f in r})
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    missing = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda f: text.is_missing(F.element_at(values, f)))
    existing = text.split_flags(F.col("Flags"))
    sev = F.when(F.col("Status") == "Error", "Error").otherwise("Review")
    one = lambda code, message: F.struct(code.alias("Code"), F.lit("Review").alias("Severity"), message.alias("Message"))
    when = lambda cond, code: F.when(cond, one(F.lit(code), F.lit(MESSAGES[code])))
    findings = F.concat(
        F.array_compact(F.array(when(sparse, "SPARSE_TEXT"), when(ocr, "OCR_TEXT"), when(~F.col("form.accepted"), "AMBIGUOUS_TYPE"))),
        F.transform(missing, lambda f: one(F.concat(F.upper(f), F.lit("_MISSING")), F.concat(F.lit("Required field "), f, F.lit(" was not extracted.")))),
        F.transform(existing, lambda f: F.struct(F.lit("PARSER_CHECK").alias("Code"), sev.alias("Severity"), f.alias("Message"))),
    )
    score = F.col("form.score") - F.when(sparse, weights.sparse).otherwise(0) - F.when(ocr, weights.ocr).otherwise(0)
    score = F.when(F.col("form.accepted"), score).otherwise(F.least(score, F.lit(weights.unaccepted_cap)))
    score = numbers.clamp(score - weights.missing * F.size(missing)).cast("int")
    evidence = F.transform(F.coalesce(required, F.array().cast("array<string>")), lambda f: F.struct(f.alias("Field"), F.element_at(values, f).alias("Value"), F.element_at(values, f).alias("RawValue")))
    known = F.col("form").isNotNull()
    df = ledger.withColumns({"findings": F.when(known, findings), "evidence": F.when(known, evidence), "Confidence": F.when(known, score)})
    codes = F.transform("findings", lambda f: f["Code"])
    status = F.when(F.col("Status") == "Error", "Error").when(F.size("findings") > 0, "Review").otherwise("OK")
    return df.withColumns({
        "Status": F.when(known, status).otherwise(F.col("Status")),
        "Flags": F.when(known, text.distinct_flags(F.concat(existing, codes))).otherwise(F.col("Flags")),
        "ConfidenceGrade": F.when(known, numbers.grade(F.col("Confidence"))),
        "ProfileVersion": F.when(known, F.coalesce("form.profile", F.lit("unclassified"))),
        "ValidationFindings": F.when(known, F.array_join(codes, "; ")),
        "OCRUsed": F.when(known, ocr),
    })


def finding_rows(audited_: DataFrame) -> DataFrame:
    """One row a finding. The severity is the document's, as it stands after the audit."""
    rows = audited_.select("SourceFile", "ReturnType", F.col("Status").alias("Severity"), F.posexplode("findings").alias("Seq", "f"))
    return rows.select("SourceFile", "ReturnType", "Seq", F.col("f.Code").alias("Code"), "Severity", F.lit("*").alias("AffectedFields"), F.col("f.Message").alias("Message"))


def evidence_rows(audited_: DataFrame) -> DataFrame:
    rows = audited_.select("SourceFile", "ReturnType", "ProfileVersion", F.array_join("form.markers", "; ").alias("Anchor"), F.when(F.col("OCRUsed"), "local OCR + form parser").otherwise("form parser").alias("Method"), F.posexplode("evidence").alias("Seq", "e"))
    return rows.select("SourceFile", "ReturnType", "Seq", F.col("e.Field").alias("Field"), F.col("e.Value").alias("Value"), F.col("e.RawValue").alias("RawValue"), F.lit(None).cast("int").alias("Page"), "Method", "Anchor", "ProfileVersion")


def review_packets(ledger: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flagged documents with their findings and evidence as arrays, in order."""
    def nested(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("SourceFile", "ReturnType")]
        first = ["Seq"] if "Seq" in rest else []
        return rows.groupBy("SourceFile").agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in rest if c != "Seq"]))).alias(name))

    flagged = ledger.where(F.col("Status") != "OK").drop("findings", "evidence", "form")
    return flagged.join(nested(findings, "Findings"), "SourceFile", "left").join(nested(evidence, "Evidence"), "SourceFile", "left")


def kpis(ledger: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    amount = lambda *kinds: F.coalesce(F.sum(F.when(F.col("DocKind").isin(*kinds), F.col("PrimaryAmount"))), F.lit(0.0))
    rows = F.sum("RowsExtracted") if "RowsExtracted" in ledger.columns else F.lit(None).cast("long")
    one = ledger.agg(F.count("*").alias("documents"), F.count_if(F.col("Status") == "OK").alias("clean"), F.count_if(F.col("Status") == "Review").alias("review"), F.count_if(F.col("Status") == "Error").alias("error"), amount("Return").alias("declared"), amount("Challan", "Payment").alias("paid"), rows.alias("rows_extracted"))
    return one.crossJoin(errors.agg(F.count("*").alias("unreadable"))).withColumn("flagged", F.col("review") + F.col("error") + F.col("unreadable"))


def type_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ReturnType").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ReturnType")


def filtered(ledger: DataFrame, flagged_only: bool = False, return_type: str | None = None, fy: str | None = None, status: str | None = None) -> DataFrame:
    out = ledger.where(F.col("Status") != "OK") if flagged_only else ledger
    for c, v in (("ReturnType", return_type), ("FY", fy), ("Status", status)):
        out = out.where(F.col(c) == v) if v is not None else out
    return out


def exceptions_first(ledger: DataFrame) -> DataFrame:
    rank = F.when(F.col("Status") == "Error", 0).when(F.col("Status") == "Review", 1).otherwise(2)
    return ledger.orderBy(rank, *[F.col(c).asc_nulls_last() for c in ("ReturnType", "FY", "MonthIndex", "SourceFile")])


def mismatches_first(recon: DataFrame) -> DataFrame:
    rank = F.when(F.col("Status") == "Mismatch", 0).when(F.col("Status").isin("Unpaid?", "No demand doc"), 1).otherwise(2)
    return recon.orderBy(rank, "ReturnType", F.col("EntityID").asc_nulls_last(), F.col("PeriodDate").asc_nulls_last())
