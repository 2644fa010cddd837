"""Registered queries that lay out documents from rows of the given tables and parse every one of them.

A form is printed from a row: its amounts, dates, names and numbers are the row's, and what a parser has to find is known from
the same row. Some rows print a form with a part left out, by a rule on the key. Oracles work on the rows alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.operators import bank as B
from quillbook.operators import flags
from quillbook.operators import ledger as L
from quillbook.parsers import bill, forms, gst
from quillbook.plans import catalogue as Q
from quillbook.plans import facts, pipelines, sheets
from quillbook.plans.registered import ORACLES, query, read, spread
from quillbook.rules import gst as RG
from quillbook.sources import layout
from quillbook.sources.store import new_store, publish_run, staged


def printed(template: str, **values: Column) -> Column:
    """The template with {names} in the place of these columns; a null is nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts) if p])


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def parsed(docs: DataFrame, form: str, kind: str) -> DataFrame:
    return flags.flagged(forms.PARSERS[form, kind](docs), form, kind)


def orders(spark, sf_dir) -> DataFrame:
    """Orders with what forms print of them: key, day, cents."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


_ORDERS = "o as (select o_orderkey as k, o_custkey as c, o_orderdate::date as d, round(o_totalprice * 100)::bigint as cents from orders)"
_FY = "(case when month({0}) >= 4 then year({0}) else year({0}) - 1 end)"


def fy(d: str) -> str:
    start = _FY.format(d)
    return f"(({start})::varchar || '-' || lpad((({start} + 1) % 100)::varchar, 2, '0'))"


def flag_list(*rules: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"case when {cond} then '{flag}' end" for cond, flag in rules) + ")"


# text forms -----------------------------------------------------------------------------------------------------------

TDS = """INCOME TAX DEPARTMENT
Challan Receipt
{id_label} : {id}
Name : {name}
Financial Year : {year}
Major Head : {head}
Minor Head : TDS (200)
Nature of Payment : {section} contracts
Amount (in Rs.) : ₹ {total}
A Tax ₹ {tax}
B Surcharge ₹ {surcharge}
D Interest ₹ {interest}
Challan No : {number}
Date of Deposit : {day}
BSR code : 0002271
CIN : {cin}
"""


@query(f"""with {_ORDERS},
p as (select *, cents // 100 as tax, cents % 100 as surcharge, case when k % 6 = 0 then 7 else 0 end as interest, date_trunc('month', d)::date as own from o),
m as (select *, case when month(d) = 4 or day(d) <= 7 or interest > 0 then (own - interval 1 month)::date else own end as month, tax + surcharge + interest + case when k % 10 = 0 then 5 else 0 end as total from p),
y as (select *, case when k % 5 = 0 then make_date({_FY.format('d')}, 4, 1) else make_date({_FY.format('month')}, 4, 1) end as lo from m),
g as (select *, month < lo or month > lo + interval 11 month as guess from y)
select k, case when k % 9 = 0 then 'ABCDE' || lpad((c % 10000)::varchar, 4, '0') || 'F' else 'ABCD' || lpad((c % 100000)::varchar, 5, '0') || 'E' end as "EntityID", case when k % 9 = 0 then 'PAN' else 'TAN' end as id_type,
  case when k % 4 = 0 then 'Other than Companies' else 'Corporation Tax' end as major_head, case when k % 8 = 0 then 'Unknown' else '9' || (k % 7)::varchar || 'C' end as section, tax::double as tax, surcharge::double as surcharge, interest::double as interest,
  round(case when k % 10 = 0 then 5.0 else 0.0 end, 2)::double as crosscheck, (case when guess then (lo + interval 11 month)::date else month end)::varchar as period, guess, {fy("lo")} as "FY", total::double as "PrimaryAmount", k::varchar as "DocRef", d::varchar as filed,
  {flag_list(("k % 10 = 0", "CROSSCHECK"), ("k % 8 = 0", "SECTION?"), ("k % 11 = 0", "CIN?"), ("guess", "PERIOD_EST"))} as "Flags"
from g""")
def tds_challans(spark, sf_dir):
    """Tax-deduction challans of all orders: with TAN or PAN, other totals than their parts, other years than their months."""
    o = spread(orders(spark, sf_dir), "k")
    tax, surcharge, interest = F.floor(F.col("cents") / 100), F.col("cents") % 100, F.when(F.col("k") % 6 == 0, 7).otherwise(0)
    month = F.when((F.month("d") == 4) | (F.dayofmonth("d") <= 7) | (interest > 0), F.add_months(F.trunc("d", "MM"), -1)).otherwise(F.trunc("d", "MM"))
    start = F.year(F.add_months(F.when(F.col("k") % 5 == 0, F.col("d")).otherwise(month), -3))
    text = printed(
        TDS, id_label=F.when(F.col("k") % 9 == 0, "PAN").otherwise("TAN"), id=F.when(F.col("k") % 9 == 0, F.concat(F.lit("ABCDE"), F.lpad((F.col("c") % 10000).cast("string"), 4, "0"), F.lit("F"))).otherwise(F.concat(F.lit("ABCD"), F.lpad((F.col("c") % 100000).cast("string"), 5, "0"), F.lit("E"))),
        name=F.concat(F.lit("ACME "), F.col("c").cast("string")), year=F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")), head=F.when(F.col("k") % 4 == 0, "Income Tax other than companies (0021)").otherwise("Corporation Tax (0020)"),
        section=F.when(F.col("k") % 8 != 0, F.concat(F.lit("9"), (F.col("k") % 7).cast("string"), F.lit("C"))), total=money(tax + surcharge + interest + F.when(F.col("k") % 10 == 0, 5).otherwise(0)), tax=F.format_number(tax, 0), surcharge=surcharge, interest=interest,
        number=F.col("k"), day=F.date_format("d", "dd-MMM-yyyy"), cin=F.when(F.col("k") % 11 != 0, F.concat(F.lit("25"), F.col("k").cast("string"), F.lit("XX"))),
    )
    # without a section the label stands alone
    text = F.replace(text, F.lit("Nature of Payment :  contracts"), F.lit("Nature of"))
    got = parsed(o.select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "TDS", "Challan")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", F.col("Taxpayer ID Type").alias("id_type"), F.col("Major Head").alias("major_head"), F.col("Section").alias("section"), F.col("Tax").alias("tax"), F.col("Surcharge").alias("surcharge"), F.col("Interest").alias("interest"), F.round("Crosscheck Diff", 2).alias("crosscheck"), F.col("PeriodDate").cast("string").alias("period"), F.col("PeriodEstimated").alias("guess"), "FY", "PrimaryAmount", "DocRef", F.col("FilingDate").cast("string").alias("filed"), "Flags")


PF = """PROVIDENT FUND ORGANISATION
CHALLAN FOR WAGE MONTH : {month}
Code : {id} Name : ACME {c}
Address x
Employee's Share Of Contribution {ee} NA NA NA NA
Employer's Share Of Contribution {er} NA {eps} {edli} NA
Admin/ Insp. Charges NA {admin} NA NA 5
TRRN : {trrn}
system generated challan on {day} 11:00"""


@query(f"""with {_ORDERS},
p as (select *, cents // 100 as ee, (cents // 100) * 3 // 10 as er, cents // 100 - (cents // 100) * 3 // 10 + case when k % 6 = 0 then cents // 500 else 0 end as eps, k % 90 as edli, k % 70 as admin from o)
select k, 'MHBAN' || lpad(c::varchar, 10, '0') as "EntityID", 'ACME ' || c::varchar as "EntityName", ee::double as ee, er::double as er, eps::double as eps, edli::double as edli, admin::double as admin, (ee + er + eps + edli + admin + 5)::double as "PrimaryAmount",
  date_trunc('month', d)::date::varchar as period, {fy("d")} as "FY", d::varchar as filed, case when k % 7 = 0 then strftime(d, '%d-%b-%Y') else (100000 + k)::varchar end as "DocRef",
  case when er + eps > 0 and abs(ee - er - eps) / greatest(er + eps, 1) > 0.05 then 'EE<>ER?' else '' end as "Flags"
from p""")
def pf_challans(spark, sf_dir):
    """Provident-fund challans of all orders; a sixth of them have shares that don't balance."""
    o, ee = spread(orders(spark, sf_dir), "k"), F.floor(F.col("cents") / 100)
    er = F.floor(ee * 3 / 10)
    eps = ee - er + F.when(F.col("k") % 6 == 0, F.floor(F.col("cents") / 500)).otherwise(0)
    text = printed(
        PF, month=F.upper(F.date_format("d", "MMM yyyy")), id=F.concat(F.lit("MHBAN"), F.lpad(F.col("c").cast("string"), 10, "0")), c=F.col("c"), ee=F.format_number(ee, 0), er=F.format_number(er, 0), eps=F.format_number(eps, 0), edli=F.col("k") % 90, admin=F.col("k") % 70,
        trrn=F.when(F.col("k") % 7 != 0, 100000 + F.col("k")), day=F.date_format("d", "dd-MMM-yyyy"),
    )
    text = F.regexp_replace(text, r"TRRN : \n", "")
    got = parsed(o.select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "PF", "Challan")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", F.col("Employee_EPF_AC01").alias("ee"), F.col("Employer_EPF_AC01").alias("er"), F.col("Employer_EPS_AC10").alias("eps"), F.col("Employer_EDLI_AC21").alias("edli"), F.col("PF_Admin_AC02").alias("admin"), "PrimaryAmount", F.col("PeriodDate").cast("string").alias("period"), "FY", F.col("FilingDate").cast("string").alias("filed"), "DocRef", "Flags")


PF_OTHERS = {
    "Return": "ELECTRONIC CHALLAN CUM RETURN (ECR)\nName of Establishment ACME {c} LIN 123\nEstablishment Id MH{c}\nWage Month {month}\nTotal EPF Contribution {a}\nTotal EPS Contribution {b}\nTotal EPF-EPS Contribution 250\nTotal Members {n}\nECR Id {k}\nUploaded Date Time {day} 10:00",
    "Arrears": "ARREAR\nName of Establishment ACME {c} LIN 1\nEstablishment Id MH{c}\nFrom Date {month}\nTotal EPF Contribution {a}\nTotal EPS Contribution {b}\nArrear Id {k}\nDisbursement Date {day}",
    "Payment": "PAYMENT CONFIRMATION RECEIPT\nTRRN No : {k} x\nEstablishment ID : MH{c}\nEstablishment Name : ACME {c}\nWage Month : {month}\nTotal Amount (Rs) : {a}\nAccount-1 Amount (Rs) : {b}\nPayment Date : {day}",
}


@query(f"""with {_ORDERS}, kinds(kind) as (values ('Return'), ('Arrears'), ('Payment'))
select k, kind as "DocKind", 'MH' || c::varchar as "EntityID", 'ACME ' || c::varchar as "EntityName", (cents // 100 + case kind when 'Return' then k % 500 + 250 when 'Arrears' then k % 500 else 0 end)::double as "PrimaryAmount",
  date_trunc('month', d)::date::varchar as period, {fy("d")} as "FY", d::varchar as filed, k::varchar as "DocRef", case when kind = 'Return' then k % 40 else 0 end::int as members
from o join kinds on (k % 3 = 0 and kind = 'Return') or (k % 3 = 1 and kind = 'Arrears') or (k % 3 = 2 and kind = 'Payment')""")
def pf_other_forms(spark, sf_dir):
    """Provident-fund returns, arrears and payment receipts, a third of the orders each."""
    o, out = spread(orders(spark, sf_dir), "k"), None
    for i, (kind, template) in enumerate(PF_OTHERS.items()):
        text = printed(template, c=F.col("c"), month=F.upper(F.date_format("d", "MMM-yyyy")), a=F.format_number(F.floor(F.col("cents") / 100), 0), b=F.col("k") % 500, n=F.col("k") % 40, k=F.col("k"), day=F.upper(F.date_format("d", "dd-MMM-yyyy")))
        got = parsed(o.where(F.col("k") % 3 == i).select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "PF", kind)
        members = F.col("Total_Members") if "Total_Members" in got.columns else F.lit(0)
        got = got.select(F.col("SourceFile").cast("long").alias("k"), "DocKind", "EntityID", "EntityName", "PrimaryAmount", F.col("PeriodDate").cast("string").alias("period"), "FY", F.col("FilingDate").cast("string").alias("filed"), "DocRef", members.alias("members"))
        out = got if out is None else out.unionByName(got)
    return out


PTRC = """FORM_IIIB PROFESSION TAX R.C. NO. (TIN) {tin}
Registration ) 3
Name of the Employer {name} ( Select
appropriate ) Type of Return {kind}
Periodicity Monthly
Period Covered by Return 6 From 01 {month} To 31 {month}
{years}
Total Tax Payable Rs. {tax}
Exceed Rs. 10,000 for Male 200 {n} {slab}
Transaction Id {ref}
Date of Filing Return {day}"""
#: Names of employers that hold words of the form, signs and numbers, in turn.
PTRC_NAMES = ["M/S {0}", "BANK OF {0} LTD", "NAME OF THE {0} TRADERS", "A & B {0}", "RETURN OF THE {0} (INDIA) PVT. LTD", "SELECTED {0} FRESHLY", "{0} 24 SEVEN-STORES"]
PTRC_MEANT = ["{0}", "BANK OF {0} LTD", "NAME OF THE {0} TRADERS", "A & B {0}", "RETURN OF THE {0} (INDIA) PVT. LTD", "SELECTED {0} FRESHLY", "{0} SEVEN-STORES"]


@query(f"""with p as (select c_custkey as k, c_mktsegment as s, greatest(0, round(c_acctbal * 100)::bigint) as cents, make_date(2020 + c_custkey % 5, c_custkey % 12 + 1, 1) as m from customer)
select k, (27000000000 + k)::varchar as "EntityID", case k % 7 {" ".join(f"when {i} then replace('{n}', '{{0}}', s)" for i, n in enumerate(PTRC_MEANT))} end as "EntityName", {fy("m")} as "FY", m::varchar as period, cents / 100.0::double as "PrimaryAmount",
  (k % 50)::double as n, (k % 50 * 200)::double as slab, k::varchar as "DocRef", (m + interval 1 month + interval 19 day)::date::varchar as filed, case k % 3 when 0 then 'Original' when 1 then 'Revised' else 'Fresh' end as kind, case when cents = 0 then 'AMT?' else '' end as "Flags"
from p""")
def ptrc_returns(spark, sf_dir):
    """Profession-tax returns of all customers, whose names hold the form's own words, signs and numbers."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.lit(None).cast("string")
    for i, n in enumerate(PTRC_NAMES):
        name = F.when(k % 7 == i, F.replace(F.lit(n), F.lit("{0}"), s)).otherwise(name)
    m = F.make_date(2020 + k % 5, k % 12 + 1, F.lit(1))
    start = F.year(F.add_months(m, -3))
    text = printed(
        PTRC, tin=27_000_000_000 + k, name=name, kind=F.when(k % 3 == 0, "Original").when(k % 3 == 1, "Revised").otherwise("Fresh"), month=F.date_format(m, "MMM yyyy"), years=F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string")), tax=money(F.greatest(F.col("c_acctbal"), F.lit(0.0))),
        n=k % 50, slab=F.format_number(k % 50 * 200, 0), ref=k, day=F.date_format(F.date_add(F.add_months(m, 1), 19), "dd MMM yyyy"),
    )
    got = parsed(spread(read(spark, sf_dir, "customer"), "c_custkey").select(k.cast("string").alias("source_file"), text.alias("text")), "PTRC", "Return")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", "FY", F.col("PeriodDate").cast("string").alias("period"), "PrimaryAmount", F.col("Slab_Above10000_Count").alias("n"), F.col("Slab_Above10000_Amt").alias("slab"), "DocRef", F.col("FilingDate").cast("string").alias("filed"), F.col("Type of Return").alias("kind"), "Flags")


MTR = """MTR Form Number-6
TAX ID / TAN {tin}P
Full Name M/S ACME & SONS {name} Location x
From {first} To {last}
AMOUNT OF TAX {tax}
Interest Amount {interest}
Total {total}
GRN MH{grn}
Date {day}"""


@query(f"""with {_ORDERS}
select k, (27000000000 + c)::varchar as "EntityID", 'ACME & SONS' as "EntityName", date_trunc('month', d)::date::varchar as period, {fy("d")} as "FY", cents / 100.0::double as tax, (k % 13)::double as interest, round(cents / 100.0::double + k % 13, 2) as "PrimaryAmount", 'MH' || lpad(k::varchar, 9, '0') as "DocRef",
  d::varchar as filed, '' as "Flags" from o""")
def mtr_challans(spark, sf_dir):
    """Profession-tax challans of all orders."""
    o = spread(orders(spark, sf_dir), "k")
    text = printed(MTR, tin=27_000_000_000 + F.col("c"), name=F.col("c"), first=F.date_format(F.trunc("d", "MM"), "dd/MM/yyyy"), last=F.date_format(F.last_day("d"), "dd/MM/yyyy"), tax=money(F.col("cents") / 100), interest=F.col("k") % 13, total=money(F.col("cents") / 100 + F.col("k") % 13), grn=F.lpad(F.col("k").cast("string"), 9, "0"), day=F.date_format("d", "dd/MM/yyyy"))
    got = parsed(o.select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "PTRC", "Challan")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", F.col("PeriodDate").cast("string").alias("period"), "FY", F.col("Amount_of_Tax").alias("tax"), F.col("Interest").alias("interest"), F.round("PrimaryAmount", 2).alias("PrimaryAmount"), "DocRef", F.col("FilingDate").cast("string").alias("filed"), "Flags")


ESIC = "Challan Period: {month}-{year} \nAmount Paid: {amount} \nChallan Number: {k}\nChallan Submitted Date {day}"


@query(f"""with {_ORDERS}, r as (select *, row_number() over (partition by {_FY.format('d')}, strftime(d, '%b') order by case when k % 17 = 0 then 0 else cents end desc, k::varchar) as n from o)
select k, case n when 1 then 'Employer' when 2 then 'Employee' else 'Other' end as "Party", case when k % 17 = 0 then 0.0 else cents / 100.0 end::double as "Amount", date_trunc('month', d)::date::varchar as period, {fy("d")} as "FY", d::varchar as filed,
  {flag_list(("n > 2", "EXTRA CHALLAN"), ("k % 17 = 0", "AMT?"))} as "Flags" from r""")
def esic_challans(spark, sf_dir):
    """State-insurance challans of all orders, ranked within their month."""
    o = orders(spark, sf_dir)
    amount = F.when(F.col("k") % 17 == 0, F.lit(0.0)).otherwise(F.col("cents") / 100)
    text = printed(ESIC, month=F.date_format("d", "MMM"), year=F.date_format("d", "yyyy"), amount=money(amount), k=F.col("k"), day=F.date_format("d", "dd/MM/yyyy"))
    # ranks read the challans three times
    read_ = staged(spark, "esic")(forms.PARSERS["ESIC", "Challan"](o.select(F.col("k").cast("string").alias("source_file"), text.alias("text"))), "challans")
    got = flags.flagged(read_, "ESIC", "Challan")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "Party", "Amount", F.col("PeriodDate").cast("string").alias("period"), "FY", F.col("FilingDate").cast("string").alias("filed"), "Flags")


EBRC = """STATEMENT OF BANK REALISATION
1 Firm Name ACME EXPORTS {c}
IEC {iec}
GSTIN - {gstin}
Bank Realisation Certificate
4 SBIN0{k} No
Date of Realisation of Money
5 {day} by bank
Total Realised Value {total}
Net Realised Value {net}
Deductions {a} 2.0 3.0 {b} 0.0
Shipping Bill / Invoice No. {bill}
Shipping Bill / Invoice Date {bill_day}
EAST PORT
9 Shipping Bill Port
MUMBAI
Currency of Realisation USD"""


@query(f"""with {_ORDERS}
select k, lpad(c::varchar, 10, '0') as "EntityID", 'ACME EXPORTS ' || c::varchar as "EntityName", 'SBIN0' || lpad(k::varchar, 12, '0') as "DocRef", cents / 100.0::double as total, round((cents - k % 9 * 100 - k % 4 * 100 - 500) / 100.0::double, 2) as "PrimaryAmount", (k % 9)::double as commission, (k % 4)::double as freight,
  'EAST PORT MUMBAI' as port, 'USD' as currency, (d - interval 30 day)::date::varchar as bill_day, d::varchar as filed, date_trunc('month', d)::date::varchar as period, {fy("d")} as "FY", '' as "Flags" from o""")
def realisation_certificates(spark, sf_dir):
    """Certificates of bank realisation of all orders."""
    o = spread(orders(spark, sf_dir), "k")
    a, b = F.col("k") % 9, F.col("k") % 4
    text = printed(
        EBRC, c=F.col("c"), iec=F.lpad(F.col("c").cast("string"), 10, "0"), gstin=F.concat(F.lit("27ABCDE"), F.lpad((F.col("c") % 10000).cast("string"), 4, "0"), F.lit("F1Z5")), k=F.lpad(F.col("k").cast("string"), 12, "0"), day=F.date_format("d", "dd-MM-yyyy"), total=money(F.col("cents") / 100),
        net=money((F.col("cents") - a * 100 - b * 100 - 500) / 100), a=F.format_number(a, 1), b=F.format_number(b, 1), bill=F.col("k"), bill_day=F.date_format(F.date_sub("d", 30), "dd-MM-yyyy"),
    )
    got = parsed(o.select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "EBRC", "Return")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", "DocRef", F.col("Total_Realised").alias("total"), "PrimaryAmount", F.col("Commission").alias("commission"), F.col("Freight").alias("freight"), F.col("ShippingBill_Port").alias("port"), F.col("Currency").alias("currency"), F.col("ShippingBill_Date").cast("string").alias("bill_day"), F.col("FilingDate").cast("string").alias("filed"), F.col("PeriodDate").cast("string").alias("period"), "FY", "Flags")


EWB = """E-WAY BILL SYSTEM
E-Way Bill No: {a} {b} {c4}
E-Way Bill Date: {day} 10:00 AM
GSTIN of Supplier {gstin} , ACME {c}
GSTIN of Recipient URP , Bob & Co {c}
Document No. INV/{k}
Document Date {doc_day}
Value of Goods {value}
pumps {hsn}
HSN Code
water pumps
Valid From: {day} 18:52:00[{km} Kms]
{mode} MH12AB{plate}"""


@query(f"""with {_ORDERS}
select k, '27ABCDE' || lpad((c % 10000)::varchar, 4, '0') || 'F1Z5' as "EntityID", 'ACME ' || c::varchar as "EntityName", 'Bob & Co ' || c::varchar as recipient, '1000' || lpad((k // 10000)::varchar, 4, '0') || lpad((k % 10000)::varchar, 4, '0') as "DocRef", 'INV/' || k::varchar as document, cents / 100.0::double as "PrimaryAmount",
  (84130000 + k % 10000)::varchar as hsn, 'water pumps' as goods, (k % 900 + 1)::double as km, 'MH12AB' || lpad((k % 10000)::varchar, 4, '0') as vehicle, case k % 2 when 0 then 'Road' else 'Rail' end as mode, d::varchar as filed, date_trunc('month', d - interval 1 day)::date::varchar as period, '' as "Flags" from o""")
def eway_bills(spark, sf_dir):
    """E-way bills of all orders."""
    o = spread(orders(spark, sf_dir), "k")
    text = printed(
        EWB, a=F.lit("1000"), b=F.lpad(F.floor(F.col("k") / 10000).cast("string"), 4, "0"), c4=F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), day=F.date_format("d", "dd/MM/yyyy"), gstin=F.concat(F.lit("27ABCDE"), F.lpad((F.col("c") % 10000).cast("string"), 4, "0"), F.lit("F1Z5")), c=F.col("c"), k=F.col("k"),
        doc_day=F.date_format(F.date_sub("d", 1), "dd/MM/yyyy"), value=money(F.col("cents") / 100), hsn=84_130_000 + F.col("k") % 10000, km=F.col("k") % 900 + 1, mode=F.when(F.col("k") % 2 == 0, "Road").otherwise("Rail"), plate=F.lpad((F.col("k") % 10000).cast("string"), 4, "0"),
    )
    got = parsed(o.select(F.col("k").cast("string").alias("source_file"), text.alias("text")), "EWB", "Return")
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", F.col("Recipient_Name").alias("recipient"), "DocRef", F.col("Document_No").alias("document"), "PrimaryAmount", F.col("HSN_Code").alias("hsn"), F.col("HSN_Desc").alias("goods"), F.col("Distance_Km").alias("km"), F.col("Vehicle_No").alias("vehicle"), F.col("Mode").alias("mode"), F.col("FilingDate").cast("string").alias("filed"), F.col("PeriodDate").cast("string").alias("period"), "Flags")


# outward returns ------------------------------------------------------------------------------------------------------

OUTWARD = """FORM GSTR-1
Financial year 2025-26
Tax period {month}
GSTIN {gstin}
Legal name of the registered person {name}
Trade name, if any T {k}
ARN AA27{k}
ARN date 11/05/2025"""
#: Sections as a return prints them: code, page, title, the row of the total.
PRINTED_SECTIONS = [("4A", 1, "4A - B2B Regular", "Total"), ("5", 1, "5 - B2CL", "Total"), ("6A", 2, "6A - Exports", "Total"), ("9B_CDNR", 2, "9B - Credit/Debit Notes Registered CDNR", "Total - Net off"), ("12_HSN", 3, "12 - HSN", "Total"), ("TOTAL_LIABILITY", 3, None, "Total Liability")]


def outward_returns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages and cells of a return for each supplier, whose sections are its line items by flag and status."""
    rows = Q.section_rows(spark, sf_dir)
    k = F.col("l_suppkey")
    text = printed(OUTWARD, month=F.date_format(F.make_date(F.lit(2025), k % 12 + 1, F.lit(1)), "MMMM"), gstin=F.concat(F.lit("27ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5")), name=F.concat(F.lit("ACME "), k.cast("string")), k=k)
    pages = rows.select("l_suppkey").distinct().select(k.cast("string").alias("source_file"), F.lit(1).alias("page_no"), text.alias("text"))
    def of(values: list) -> Column:
        out = F.lit(None)
        for (code, *_), v in zip(PRINTED_SECTIONS, values, strict=True):
            out = F.when(F.col("Section_Code") == code, F.lit(v)).otherwise(out)
        return out

    title, total = of([t for _, _, t, _ in PRINTED_SECTIONS]).cast("string"), of([t for *_, t in PRINTED_SECTIONS]).cast("string")
    amounts = F.array(total, F.when(F.col("Section_Code") != "TOTAL_LIABILITY", F.col("Num_Records").cast("string")), F.lit("Invoice"), *[money(F.col(h)) for h in RG.HEADS])
    rows = rows.select(k.cast("string").alias("source_file"), of([p for _, p, _, _ in PRINTED_SECTIONS]).cast("int").alias("page_no"), of([2 * i for i in range(len(PRINTED_SECTIONS))]).cast("int").alias("row"), F.array(F.array(title), amounts).alias("both"))
    cells = rows.select("source_file", "page_no", F.lit(1).alias("table_no"), "row", F.posexplode("both").alias("i", "cells"))
    # the footer has no title
    cells = cells.where(F.get("cells", F.lit(0)).isNotNull()).select("source_file", "page_no", "table_no", (F.col("row") + F.col("i") + 1).alias("row_no"), "cells")
    heads = cells.select("source_file", "page_no").distinct().select("source_file", "page_no", F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.array(F.lit("Description")).alias("cells"))
    return pages, cells.unionByName(heads)


_MONTH = "make_date(2025 + (l_suppkey % 12 < 3)::int, (l_suppkey % 12 + 1)::int, 1)"


@query(f"""with {Q._SECTIONS}, checks as ({ORACLES["gst_checks"]}),
f as (select l_suppkey, string_agg("Check", '; ' order by "Check") as flags, max(("Check" is not null and Status = 'FAIL')::int) as failed from checks group by 1),
a as (select l_suppkey, sum(case when sec = 'TOTAL_LIABILITY' then IGST + CGST + SGST + Cess else 0 end) as amount from s group by 1)
select l_suppkey as k, '27ABCDE' || lpad((l_suppkey % 10000)::varchar, 4, '0') || 'F1Z5' as "EntityID", 'ACME ' || l_suppkey::varchar as "EntityName", '2025-26' as "FY", {_MONTH}::varchar as period, case when failed = 1 then 'Error' when flags is not null then 'Review' else 'OK' end as "Status",
  coalesce(flags, '') as "Flags", round(amount, 2) as "PrimaryAmount", 'AA27' || l_suppkey::varchar as "DocRef", '2025-05-11' as filed from a left join f using (l_suppkey)""")
def outward_ledger(spark, sf_dir):
    """Ledger rows of the outward returns of all suppliers, with their checks."""
    got = gst.gstr1(*outward_returns(spark, sf_dir))
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", "FY", F.col("PeriodDate").cast("string").alias("period"), "Status", "Flags", F.round("PrimaryAmount", 2).alias("PrimaryAmount"), "DocRef", F.col("FilingDate").cast("string").alias("filed"))


@query(f"""with {Q._SECTIONS}, all_(seq, code) as (values {", ".join(f"({i}, '{c}')" for i, (c, *_) in enumerate(RG.SECTIONS))}), returns as (select distinct l_suppkey from lineitem)
select r.l_suppkey as k, code as "Section_Code", case when coalesce(Value, 0) <> 0 or coalesce(IGST, 0) <> 0 or coalesce(CGST, 0) <> 0 or coalesce(SGST, 0) <> 0 then 'Yes' else 'No' end as "Has_Data", sec is not null as "Found",
  coalesce(case when sec = 'TOTAL_LIABILITY' then 0 else n end, 0)::int as "Num_Records", coalesce(Value, 0) as "Value", coalesce(IGST, 0) as "IGST", coalesce(CGST, 0) as "CGST", coalesce(SGST, 0) as "SGST"
from returns r cross join all_ left join s on s.l_suppkey = r.l_suppkey and s.sec = code""")
def outward_coverage(spark, sf_dir):
    """All 33 sections of the outward returns of all suppliers, printed or not."""
    pages, cells = outward_returns(spark, sf_dir)
    out = gst.coverage(gst.section_totals(gst.labelled(gst.summary_rows(cells)), gst.gstr1_metadata(pages)))
    return out.select(F.col("SourceFile").cast("long").alias("k"), "Section_Code", "Has_Data", "Found", "Num_Records", *RG.HEADS[:4])


@query(f"""with {Q._SECTIONS}, a as (select l_suppkey, sum(case when sec in ('4A', '5', '6A') then Value else 0 end) as sv, sum(case when sec = '6A' then Value else 0 end) as ev, sum(case when sec = '9B_CDNR' then Value else 0 end) as nv, sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then IGST else 0 end) as ig from s group by 1)
select '27ABCDE' || lpad((l_suppkey % 10000)::varchar, 4, '0') || 'F1Z5' as "GSTIN", strftime({_MONTH}, '%b-%y') as "Period_Year", round(sum(sv), 2) as "SupplyValue", round(sum(ev), 2) as "ExportValue", round(sum(nv), 2) as "NotesValue", round(sum(ig), 2) as "Total_IGST",
  min({_MONTH})::varchar as period, min((month({_MONTH}) + 8) % 12 + 1)::int as month_index from a group by 1, 2""")
def outward_star(spark, sf_dir):
    """The summary of the outward returns of all suppliers beside their calendar."""
    star = facts.gstr1_star(*outward_returns(spark, sf_dir))
    out = star["Summary"].join(star["Dim_Taxpayer_Calendar"], facts.KEY)
    return out.select(*facts.KEY, "SupplyValue", "ExportValue", "NotesValue", "Total_IGST", F.col("PeriodDate").cast("string").alias("period"), F.col("MonthIndex").cast("int").alias("month_index"))


# summary returns ------------------------------------------------------------------------------------------------------

SUMMARY = """GSTR-3B
Year 2025-26
Period {month}
GSTIN of the supplier {gstin}
Legal name of the registered person ACME {k}
Trade name, if any T {k}
ARN AA27{k}
Date of ARN 20/07/2025"""


def summary_returns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages and cells of a summary return for each customer: its taxes are shares of the balance. A fifth pays 10 too little,
    a seventh claims 30 less than its table says, an eleventh claims twice the reverse charge, a thirteenth has no payments."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.abs("c_acctbal")).cast("long").alias("v"))
    k, v = F.col("k"), F.col("v")
    text = printed(SUMMARY, month=F.date_format(F.make_date(F.lit(2025), k % 12 + 1, F.lit(1)), "MMMM"), gstin=F.concat(F.lit("27ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5")), k=k)
    pages = c.select(k.cast("string").alias("source_file"), F.lit(1).alias("page_no"), text.alias("text"))
    half, third, rcm = F.floor(v / 2), F.floor(v / 3), k % 90
    row = lambda *cells: F.array(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in cells])
    none = F.lit(None).cast("string")
    comma = lambda x: F.format_number(x, 0)
    supplies = [row("Nature of Supplies", "Total taxable value", "Integrated tax", "Central tax", "State/UT tax"), row("(a) Outward taxable supplies (other than zero rated)", comma(v * 10), comma(v), comma(half), comma(half)), row("(b) Outward taxable supplies (zero rated)", "0", "0", "0", "0"),
                row("(c) Other outward supplies", "0", "0", "0", "0"), row("(d) Inward supplies (liable to reverse charge)", comma(rcm * 10), rcm, "0", "0")]
    claimed = rcm * F.when(k % 11 == 0, 2).otherwise(1)
    net = third + claimed - 7 - F.when(k % 7 == 0, 30).otherwise(0)
    credit = [row("Details", "Integrated tax", "Central tax", "State/UT tax", "Cess"), row("A. ITC Available", "", "", "", ""), row("(3) Inward supplies liable to reverse charge", claimed, "0", "0", "0"), row("(5) All other ITC", comma(third), "20", "20", "0"),
              row("B. ITC Reversed", "", "", "", ""), row("(1) As per rules", "7", "0", "0", "0"), row("C. Net ITC available (A-B)", comma(net), "20", "20", "0")]
    cash = v - third - F.when(k % 5 == 0, 10).otherwise(0)
    pay = [row("Description", "Net Tax", "Tax paid through ITC", none, none, none, "Tax paid in cash", "Interest\npaid in cash", "Late fee"), row("", "Payable", "Integrated", "Central", "State/UT", "Cess", "", "", ""), row("(A) Other than reverse charge", *[none] * 8),
           row("Integrated tax", comma(v), comma(third), "0", "0", "0", comma(cash), k % 3, "0"), row("Central tax", comma(half), "0", "20", "0", "0", comma(half - 20), "0", "0"), row("State/UT tax", comma(half), "0", "0", "20", "0", comma(half - 20), "0", k % 4),
           row("(B) Reverse charge", *[none] * 8), row("Integrated tax", rcm, "0", "0", "0", "0", rcm, "0", "0"), row("Central tax", *["0"] * 8), row("State/UT tax", *["0"] * 8)]
    tables = F.array(F.array(*supplies), F.array(*credit), F.when(k % 13 != 0, F.array(*pay)))
    cells = c.select(k.cast("string").alias("source_file"), F.lit(1).alias("page_no"), F.posexplode(tables).alias("table_no", "rows")).where("rows is not null")
    return pages, cells.select("source_file", "page_no", "table_no", F.posexplode("rows").alias("row_no", "cells"))


_SUMMARY = """p as (select c_custkey as k, floor(abs(c_acctbal))::bigint as v, floor(abs(c_acctbal))::bigint // 2 as half, floor(abs(c_acctbal))::bigint // 3 as third, c_custkey % 90 as rcm from customer),
q as (select *, rcm * case when k % 11 = 0 then 2 else 1 end as claimed, k % 13 <> 0 as paid, make_date(2025 + (k % 12 < 3)::int, (k % 12 + 1)::int, 1) as m from p)"""


@query(f"""with {_SUMMARY}
select k, '27ABCDE' || lpad((k % 10000)::varchar, 4, '0') || 'F1Z5' as "EntityID", 'ACME ' || k::varchar as "EntityName", m::varchar as period, '2025-26' as "FY", case when paid then v + 2 * half + rcm else 0 end::double as "PrimaryAmount", 'AA27' || k::varchar as "DocRef", '2025-07-20' as filed,
  {flag_list(("k % 7 = 0", "ITC_Math_Integrated_tax"), ("paid and k % 5 = 0", "Payment_Recon_6_1"), ("rcm > 0 and k % 11 = 0", "RCM_CrossCheck"), ("not paid", "GSTR3B_FIELDS_MISSING"))} as "Flags",
  case when k % 7 = 0 or (paid and k % 5 = 0) or (rcm > 0 and k % 11 = 0) or not paid then 'Review' else 'OK' end as "Status" from q""")
def summary_ledger(spark, sf_dir):
    """Ledger rows of the summary returns of all customers, with their checks."""
    got = gst.gstr3b(*summary_returns(spark, sf_dir), keep=staged(spark, "summary"))[0]
    return got.select(F.col("SourceFile").cast("long").alias("k"), "EntityID", "EntityName", F.col("PeriodDate").cast("string").alias("period"), "FY", "PrimaryAmount", "DocRef", F.col("FilingDate").cast("string").alias("filed"), "Flags", "Status")


@query(f"""with {_SUMMARY}
select k, v::double as output, rcm::double as rcm_payable, (third + claimed)::double as input, 7.0::double as ineligible, (third + claimed - 7)::double as net_input, case when paid then third end::double as used, case when paid then v + rcm - third end::double as payable, case when paid then k % 3 end::double as interest, case when paid then k % 4 end::double as late,
  case when paid then 'OK' else 'Review' end as "Status", strftime(m, '%Y-%m') as period from q""")
def summary_analysis(spark, sf_dir):
    """The wide rows of the summary returns of all customers: numbers that weren't printed are null, and so is what needs them."""
    got = gst.gstr3b(*summary_returns(spark, sf_dir), keep=staged(spark, "summary"))[1]
    names = {"Output IGST": "output", "RCM IGST Payable": "rcm_payable", "Total Input IGST": "input", "Ineligible IGST": "ineligible", "Net Input IGST": "net_input", "IGST to IGST": "used", "IGST Payable": "payable", "Interest paid": "interest", "Late Fees paid": "late", "Status": "Status", "Return Period": "period"}
    return got.select(F.col("`Source File`").cast("long").alias("k"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


@query(f"""with {_SUMMARY}
select '27ABCDE' || lpad((k % 10000)::varchar, 4, '0') || 'F1Z5' as "GSTIN", strftime(m, '%b-%y') as "Period_Year", sum(v + 2 * half)::double as "GrossOutward", sum(rcm)::double as "RcmDeclared", sum(case when paid then third + 40 else 0 end)::double as "CreditUsed",
  sum(case when paid then v - third - case when k % 5 = 0 then 10 else 0 end + 2 * half - 40 + rcm else 0 end)::double as "CashPaid", sum(case when paid then v + 2 * half + rcm else 0 end)::double as "NetPayable", sum(case when paid and k % 5 = 0 then 10 else 0 end)::double as "Variance"
from q group by 1, 2""")
def summary_star(spark, sf_dir):
    """Outward tax, credit used, cash and variance of the summary returns of all customers."""
    out = facts.gstr3b_star(*summary_returns(spark, sf_dir), keep=staged(spark, "summary"))["Summary"]
    return out.select(*facts.KEY, "GrossOutward", "RcmDeclared", "CreditUsed", "CashPaid", "NetPayable", "Variance")


# bank documents -------------------------------------------------------------------------------------------------------


def statement_cells(spark, sf_dir) -> DataFrame:
    """Events as the tables of a statement for each user: twenty rows a page, a header on the first page only. Some rows have no
    date and are none."""
    w = Q.Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = Q.statement_rows(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1)
    blank = (F.col("event_id") % 19 == 0) & (F.col("n") % 20 != 0)
    side = lambda c, other: F.when((F.col(c) > 0) | (F.col(other) == 0), money(F.col(c))).otherwise("")
    cells = F.array(F.when(blank, "").otherwise(F.date_format("TransactionDate", "dd-MM-yyyy")), F.concat(F.lit("entry "), F.col("event_id").cast("string")), side("Debit", "Credit"), F.when(F.col("Credit") > 0, money(F.col("Credit"))).otherwise(""), F.coalesce(money(F.col("Balance")), F.lit("")))
    rows = rows.select(F.col("user_id").cast("string").alias("source_file"), (F.floor(F.col("n") / 20) + 1).cast("int").alias("page_no"), F.lit(1).alias("table_no"), (F.col("n") % 20 + 1).cast("int").alias("row_no"), cells.alias("cells"))
    head = rows.select("source_file").distinct().select("source_file", F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.array(*map(F.lit, ["Tran Date", "Particulars", "Debit", "Credit", "Balance"])).alias("cells"))
    return rows.unionByName(head)


_ENTRIES = f"""{Q._STATEMENT.rsplit("f as (", 1)[0].rstrip().rstrip(",")},
n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as n from t),
x as (select user_id, ts, event_id, n, Debit, Credit, Balance from n where not (event_id % 19 = 0 and n % 20 <> 0))"""


@query(f"""with {_ENTRIES}
select user_id, event_id, ts::date::varchar as day, Debit as "Debit", Credit as "Credit", Balance as "Balance", (n // 20 + 1)::int as "Page" from x""")
def statement_transactions(spark, sf_dir):
    """The transactions of all statements: headers carry over pages, rows without a date are none."""
    cells = statement_cells(spark, sf_dir)
    profiles = cells.select("source_file").distinct().withColumn("debt", F.lit(False))
    got = B.transactions(cells, profiles)
    return got.select(F.col("source_file").cast("long").alias("user_id"), F.split("Description", " ")[1].cast("long").alias("event_id"), F.col("TransactionDate").cast("string").alias("day"), "Debit", "Credit", "Balance", "Page")


STATEMENT = """Axis Bank
Statement of Axis Bank Account No: {account}
Account Name: ACME {k}
Tran Date Opening Balance: 1,000.00
Currency: INR
{filler}"""
#: What a rule on the user's number puts in the place of a statement's text.
OTHER_TEXTS = {3: "axis bank mutual fund folio no balance units nav(inr) ", 5: "nothing that is known "}


@query(f"""with {_ENTRIES},
p as (select *, coalesce(last_value(Balance ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 1000.0) as prev from x),
r as (select user_id, count(*) as n, count(*) filter (abs(prev - Debit + Credit - Balance) > 0.05) as mism, sum(Debit) as td, sum(Credit) as tc, count(*) filter ((Debit > 0.05) = (Credit > 0.05)) as conf, last(Balance order by ts, event_id) as closing, min(ts)::date as pf, last(ts order by ts, event_id)::date as pt from p group by 1),
z as (select *, closing - (1000.0 - td + tc) as diff, [x for x in [case when conf > 0 then 'DEBIT_CREDIT_CONFLICT' end, case when mism > 0 then 'RUNNING_BALANCE_MISMATCH' end, case when abs(closing - (1000.0 - td + tc)) > 0.05 then 'SUMMARY_BALANCE_MISMATCH' end, case when closing is null then 'SUMMARY_BALANCE_MISSING' end] if x is not null] as codes from r)
select user_id, case user_id % 10 when 3 then 'UnsupportedDocument' when 5 then 'UnknownBankLayout' end as "Error_Type", case when user_id % 10 not in (3, 5) then 'AC' || (100000 + user_id)::varchar end as "EntityID", case when user_id % 10 not in (3, 5) then array_to_string(codes, '; ') end as "Flags",
  case when user_id % 10 not in (3, 5) then least(100, greatest(0, 95 + case when len(codes) = 0 then 20 else 0 end - least(60, 15 * len(codes)))) else 0 end as score, case when user_id % 10 not in (3, 5) then n else 0 end as "RowsExtracted", case when user_id % 10 not in (3, 5) then round(coalesce(closing, 0), 2) end as "PrimaryAmount", case when user_id % 10 not in (3, 5) then pt::varchar end as period from z""")
def bank_batch(spark, sf_dir):
    """The whole bank plan over the statements of all users; texts of some are of kinds that aren't read."""
    cells = statement_cells(spark, sf_dir)
    users = cells.select(F.col("source_file").cast("long").alias("k")).distinct()
    text = printed(STATEMENT, account=F.concat(F.lit("AC"), (100000 + F.col("k")).cast("string")), k=F.col("k"), filler=F.lit("x" * 60))
    for rest, other in OTHER_TEXTS.items():
        text = F.when(F.col("k") % 10 == rest, F.lit(other * 4)).otherwise(text)
    pages = users.select(F.col("k").cast("string").alias("source_file"), F.lit(1).alias("page_no"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    sheets = pipelines.bank(pages, cells, keep=staged(spark, "bank"))
    good = sheets["Bank_Summary"].select(F.col("SourceFile").cast("long").alias("user_id"), "EntityID", "Flags", F.col("Confidence").alias("score"), F.col("RowsExtracted"), F.round("PrimaryAmount", 2).alias("PrimaryAmount"), F.col("PeriodTo").cast("string").alias("period"))
    bad = sheets["Parsing_Errors"].select(F.col("File").cast("long").alias("user_id"), "Error_Type")
    return L.union_all([good, bad]).na.fill(0, ["score", "RowsExtracted"]).select("user_id", "Error_Type", "EntityID", "Flags", "score", "RowsExtracted", "PrimaryAmount", "period")


@query(f"""with {Q._STATEMENT.rsplit("b as (", 1)[0].rstrip().rstrip(",")}
select user_id, event_id, ts::date::varchar as day, case when event_type in ('purchase', 'error') then v else 0 end as "Debit", case when event_type in ('purchase', 'error') then 0 else v end as "Credit", 'R' || event_id::varchar as "Reference"
from (select *, round(value * 100) / 100.0::double as v from events) where v > 0""")
def key_value_statements(spark, sf_dir):
    """Transactions of the layout that prints labels, from a text of all events of each user; those of nothing are none."""
    e = read(spark, sf_dir, "events")
    block = printed("Transaction Description entry {id}\nValue Date: {day}\nDebit/Credit: {side}\nCheque Amount/Transaction Amount: {amount}\nCustomer Reference: R{id}\n", id=F.col("event_id"), day=F.date_format("ts", "dd/MM/yyyy"), side=F.when(F.col("event_type").isin("purchase", "error"), "Debit").otherwise("Credit"), amount=money(F.round(F.col("value") * 100) / 100))
    texts = e.groupBy(F.col("user_id").cast("string").alias("source_file")).agg(F.concat(F.lit("CitiDirect\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda x: x["b"]), "")).alias("text"))
    got = B.key_value_transactions(texts)
    return got.select(F.col("source_file").cast("long").alias("user_id"), F.split("Description", " ")[1].cast("long").alias("event_id"), F.col("TransactionDate").cast("string").alias("day"), "Debit", "Credit", "Reference")


@query(f"""with {_ORDERS}
select c, count(*) as n, round(sum(cents) / 100.0, 2)::double as "PrimaryAmount", max((d + interval 1 year)::date)::varchar as period, min(d)::varchar as first_deposit, round(max((k % 80) / 10.0), 2)::double as best_rate from o where k % 12 <> 0 group by 1""")
def deposit_statements(spark, sf_dir):
    """Deposits of a statement for each customer with orders; rows without a number are none."""
    o = orders(spark, sf_dir).withColumn("n", F.row_number().over(Q.Window.partitionBy("c").orderBy("k")))
    cells = F.array(F.when(F.col("k") % 12 == 0, "").otherwise(F.col("k").cast("string")), F.date_format("d", "dd-MM-yyyy"), money(F.col("cents") / 100), F.date_format(F.add_months("d", 12), "dd-MM-yyyy"), F.concat(F.format_number(F.col("k") % 80 / 10, 1), F.lit("%")))
    rows = o.select(F.col("c").cast("string").alias("source_file"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.col("n").alias("row_no"), cells.alias("cells"))
    head = rows.select("source_file").distinct().select("source_file", F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.array(*map(F.lit, ["FD Account No", "FD Date", "Principal Amount", "Maturity Date", "Int. Rate"])).alias("cells"))
    got = staged(spark, "deposits")(B.deposits(rows.unionByName(head)), "deposits")
    more = got.groupBy("source_file").agg(F.min("DepositDate").cast("string").alias("first_deposit"), F.round(F.max("InterestRate"), 2).alias("best_rate"))
    return B.deposit_totals(got).join(more, "source_file").select(F.col("source_file").cast("long").alias("c"), "n", F.round("PrimaryAmount", 2).alias("PrimaryAmount"), F.col("PeriodTo").cast("string").alias("period"), "first_deposit", "best_rate")


# shipping bills -------------------------------------------------------------------------------------------------------

#: Fixed value: rows that an order counts for when bills are dealt.
BILL_ROWS = 10


def bill_lines(spark, sf_dir) -> DataFrame:
    """(source_file, c, page, seq, text): the lines of a bill for each customer with orders. Its items are the orders, in turn on
    one of two invoices. A fifth states too much for the first invoice, a seventh too much in all. Orders are dealt by file, and
    what follows stays where it is."""
    o = orders(spark, sf_dir).withColumn("source_file", F.col("c").cast("string"))
    # an order is some forty words, and a line with its words more than a row
    o = spread(o, "source_file", o.count() * BILL_ROWS)
    o = o.withColumn("n", F.row_number().over(Q.Window.partitionBy("source_file").orderBy("k")))
    o = o.withColumn("inv", F.when(F.col("n") % 2 == 1, 1).otherwise(2))
    c = o.groupBy("source_file", "c").agg(F.array_sort(F.collect_list(F.struct("n", "k", "inv", "cents"))).alias("items"))
    value = lambda i: F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.when(x["inv"] == i, x["cents"]).otherwise(0))
    c = c.withColumns({"v1": value(1), "v2": value(2)})
    c = c.withColumns({"n_items": F.size("items"), "n_inv": F.least(F.size("items"), F.lit(2)), "fob": F.col("v1") + F.col("v2") + F.when(F.col("c") % 7 == 0, 10_000).otherwise(0), "v1": F.when(F.col("c") % 5 == 0, F.floor(F.col("v1") * 101 / 100)).otherwise(F.col("v1"))})
    key = F.col("c").cast("string")
    hs = lambda x: (84_000_000 + x["k"] % 100_000).cast("string")
    rupees = lambda cents: money(cents / 100)
    quantity = lambda x: (x["k"] % 9 + 1).cast("string")
    line = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    one = F.array(
        F.lit("PART - I - x"), line("INDIAN CUSTOMS EDI SYSTEM INBOM1", (1_000_000 + F.col("c")).cast("string"), "05-MAY-25"), line("IEC/Br", F.lpad(key, 10, "0"), "1"), line("GSTIN/TYPE", F.concat(F.lit("27ABCDE"), F.lpad((F.col("c") % 10000).cast("string"), 4, "0"), F.lit("F1Z5")), "GSN"),
        line("Nos", F.col("n_inv").cast("string"), F.col("n_items").cast("string"), "1"), F.lit("12.PORT OF LOADING INBOM1 (Mumbai) 13.COUNTRY OF FINAL DESTINATION GERMANY"), F.lit("-"), F.lit("-"), F.lit("1.FOB@40 VALUE@65 2.FREIGHT@190 3.INSURANCE@290"), line(F.concat(rupees(F.col("fob")), F.lit("@42")), "20@195", ".81@295"),
    )

    def two(i: int) -> Column:
        of = F.filter("items", lambda x: x["inv"] == i)
        rows = F.flatten(F.transform(of, lambda x: F.array(line(x["n"].cast("string"), hs(x), "pumps of 2 sizes", quantity(x), "NOS 2.5", rupees(x["cents"])), F.when(x["k"] % 3 == 0, "and more"))))
        total = rupees(F.col(f"v{i}"))
        head = F.array(F.lit("PART - II - x"), F.lit("1.S.No 2.INVOICE"), line(str(i), F.concat(F.lit("INV/"), key, F.lit(f"-{i}")), "01/05/2025 FOB"), F.lit("1.INVOICE VALUE 2.FOB VALUE"), line(total, total, "0 0 1 USD INR 80.0"), F.lit("1.ItemSNo 2.HS CD"))
        return F.when(F.size(of) > 0, F.concat(head, F.array_compact(rows), F.array(F.lit("Glossary x"))))

    three = F.concat(F.array(F.lit("PART - III - x")), F.flatten(F.transform("items", lambda x: F.array(F.lit("1INVSN 2ITEMSN"), line(x["inv"].cast("string"), x["n"].cast("string"), hs(x), "pumps", quantity(x), "NOS 2.5", rupees(x["cents"]), rupees(x["cents"]), "90"), F.lit("of steel"), F.lit("11.DUTYAMT"), F.lit("0 Y LUT 60")))))
    four = F.concat(F.array(F.lit("PART - IV - x"), F.lit("M. RODTEP DETAILS"), F.lit("1 1 5 NOS 5 10.25"), F.lit("I. CONTAINER DETAILS"), line("1", F.concat(F.lit("ABCD"), F.lpad((F.col("c") % 10_000_000).cast("string"), 7, "0")), "S1 05-MAY-25"), F.lit("H. INVOICE DETAILS")), F.transform(F.sequence(F.lit(1), F.col("n_inv")), lambda i: line(i.cast("string"), F.concat(F.lit("INV/"), key, F.lit("-"), i.cast("string")), "12.5 USD")))
    pages = F.array(one, two(1), two(2), three, four)
    out = c.select("source_file", "c", F.posexplode(pages).alias("page", "lines")).where("lines is not null")
    return out.select("source_file", "c", (F.col("page") + 1).alias("page"), F.posexplode("lines").alias("seq", "text"))


def bill_words(spark, sf_dir) -> DataFrame:
    """The words of the lines, each where it stands, or where it says (@x). Of a sixth of the bills a word of part three has no
    place, of a nineteenth one of every page."""
    lines = bill_lines(spark, sf_dir).withColumn("w", F.split("text", " "))
    # few words say where they stand; the others stand behind all before them
    said = lambda t, i: F.when(t.contains("@"), F.split_part(t, F.lit("@"), F.lit(i)))
    behind = lambda i: F.when(i > 0, F.char_length(F.call_function("substring_index", F.col("text"), F.lit(" "), i)) + 1).otherwise(0)
    at = F.transform("w", lambda t, i: F.struct(F.coalesce(said(t, 1), t).alias("text"), F.coalesce(said(t, 2).cast("double"), 40.0 + 5 * behind(i)).alias("x0")))
    words = lines.select("source_file", "c", "page", "seq", F.posexplode(at).alias("i", "v"))
    lost = (F.col("seq") == 1) & (F.col("i") == 0) & ((F.col("c") % 19 == 0) | ((F.col("c") % 6 == 0) & (F.col("page") == 4)))
    top = F.col("seq") * 10.0 + 10
    return words.select("source_file", F.col("page").alias("page_no"), "v.text", F.when(~lost, F.col("v.x0")).alias("x0"), (F.col("v.x0") + 5 * F.char_length("v.text")).alias("x1"), top.alias("top"), (top + 8).alias("bottom"), F.lit(True).alias("upright"))


_BILLS = f"""{_ORDERS},
i as (select *, row_number() over (partition by c order by k) as n from o),
j as (select *, case when n % 2 = 1 then 1 else 2 end as inv from i),
b as (select c, count(*) as items, least(2, count(*)) as invoices, sum(cents) as total, sum(cents) filter (inv = 1) as v1, sum(cents) filter (inv = 2) as v2, c % 19 = 0 as gone, c % 6 = 0 as broken from j group by 1)"""


@query(f"""with {_BILLS}
select c, gone as unreadable, case when not gone then (1000000 + c)::varchar end as "SB_No", case when not gone then '27ABCDE' || lpad((c % 10000)::varchar, 4, '0') || 'F1Z5' end as "GSTIN", case when gone then 0 else invoices end::int as invoices, case when gone or broken then 0 else items end::int as items,
  case when not gone then (total + case when c % 7 = 0 then 10000 else 0 end) / 100.0 end::double as fob, case when gone then 0 else 3 + invoices + case when broken then 0 else 2 end end::int as evaluated,
  case when not gone then concat_ws('; ', case when not broken and c % 7 = 0 then 'fob_total_vs_item_sum' end, case when c % 5 = 0 then 'invoice_1_value_vs_items' end, 'FIELDS?') end as "Flags",
  case when not gone then concat_ws('; ', case when broken then 'page 4: 1 words have no place' end, 'missing core fields: exporter, consignee') end as warnings from b""")
def shipping_bills(spark, sf_dir):
    """Bills of all customers with orders, some with pages that can't be read: these cost a page, and the checks that need it."""
    doc = bill.files(bill.pages_of(bill_words(spark, sf_dir)))
    gone = F.col("unreadable")
    rows = bill.flat_rows(doc, bill.flags(doc).alias("Flags"), F.col("error").isNotNull().alias("unreadable"))
    found = {"SB_No": "SB_No", "GSTIN": "GSTIN", "invoices": "Invoices", "items": "Items", "fob": "FOB_INR", "evaluated": "Checks_Run", "Flags": "Flags", "warnings": "Warnings"}
    return rows.select(F.col("source_file").cast("long").alias("c"), gone, *[F.when(~gone, F.col(c)).alias(n) for n, c in found.items()]).na.fill(0, ["invoices", "items", "evaluated"])


@query(f"""with {_BILLS}
select j.c, n::int as "Item_SNo", 'INV/' || j.c::varchar || '-' || inv::varchar as "Invoice_No", (84000000 + k % 100000)::varchar as "HS_Code", 'pumps of steel' as "Description", (k % 9 + 1)::double as "Quantity", cents / 100.0::double as "Value_FC", cents / 100.0::double as "FOB_INR", 'USD' as "Currency", 'LUT' as "IGST_Status"
from j join b on b.c = j.c where not gone and not broken""")
def shipping_bill_items(spark, sf_dir):
    """The items of part three of all bills, with their invoices."""
    got = bill.item_rows(bill.parse(bill_words(spark, sf_dir)))
    return got.select(F.col("SourceFile").cast("long").alias("c"), "Item_SNo", "Invoice_No", "HS_Code", "Description", "Quantity", "Value_FC", "FOB_INR", "Currency", "IGST_Status")


@query(f"""with {_BILLS}
select j.c, inv as invoice_sno, n::int as sno, (84000000 + k % 100000)::varchar as hs_code, 'pumps of 2 sizes' || case when k % 3 = 0 then ' and more' else '' end as description, (k % 9 + 1)::double as quantity, cents / 100.0::double as value_fc,
  case inv when 1 then case when j.c % 5 = 0 then v1 * 101 // 100 else v1 end else v2 end / 100.0::double as invoice_value
from j join b on b.c = j.c where not gone""")
def shipping_bill_invoices(spark, sf_dir):
    """The items of part two of all bills, with descriptions that go on below, and the value of their invoices."""
    items = bill.parse(bill_words(spark, sf_dir)).select("source_file", "invoices", F.explode("items_two").alias("i"))
    of = F.filter("invoices", lambda v: v["sno"] == F.col("i.invoice_sno"))
    return items.select("source_file", "i.*", F.explode(of).alias("v")).select(F.col("source_file").cast("long").alias("c"), "invoice_sno", "sno", "hs_code", "description", "quantity", "value_fc", F.col("v.invoice_value").alias("invoice_value"))


# batches, sheets and functions ----------------------------------------------------------------------------------------

#: What else a folder holds, by the rest of the key by 13: a scan, a text of no form, one of two forms, pages of two forms.
STRAY = {3: "x", 5: "nothing that is known here, at any length", 7: "GSTR-1 and GSTR-3B", 9: None}


@query(f"""with {_ORDERS}
select k, case k % 13 when 3 then 'NeedsOCR' when 5 then 'UnknownType' when 7 then 'AmbiguousType' when 9 then 'MixedDocument' end as "Error_Type", case when k % 13 not in (3, 5, 7, 9) then case k % 4 when 0 then 'TDS' when 1 then 'PF' when 2 then 'EBRC' else 'PTRC' end end as "ReturnType",
  case when k % 13 not in (3, 5, 7, 9) then case k % 4 when 2 then 'Return' else 'Challan' end end as "DocKind", case when k % 13 not in (3, 5, 7, 9) then case k % 4 when 0 then cents // 100 + 10 when 1 then 2 * (cents // 100) + 10 else cents / 100.0 end end::double as "PrimaryAmount",
  case when k % 13 not in (3, 5, 7, 9) then {fy("d")} end as "FY" from o""")
def statutory_batch(spark, sf_dir):
    """The whole statutory plan over a file for each order, published as one run: four forms, and files that are turned down."""
    o = spread(orders(spark, sf_dir), "k")
    k, whole = F.col("k"), F.floor(F.col("cents") / 100)
    late = F.date_format(F.date_add(F.trunc("d", "MM"), 14), "dd-MMM-yyyy")
    year = F.year(F.add_months(F.add_months(F.trunc("d", "MM"), -1), -3))
    tds = printed(TDS, id_label=F.lit("TAN"), id=F.lit("ABCD12345E"), name=k, year=F.lit("2000-01"), head=F.lit("Corporation Tax (0020)"), section=F.lit("94C"), total=F.format_number(whole + 10, 0), tax=F.format_number(whole, 0), surcharge=F.lit(10), interest=F.lit(0), number=k, day=late, cin=k)
    # the stated year is that of the deposit, so no month is a guess but of deposits in April
    tds = F.regexp_replace(tds, "Financial Year : 2000-01", F.concat(F.lit("Financial Year : "), D.fiscal_year(F.col("d"))))
    pf = printed(PF, month=F.upper(F.date_format("d", "MMM yyyy")), id=F.lit("MHBAN0012345"), c=F.col("c"), ee=F.format_number(whole, 0), er=F.format_number(whole, 0), eps=F.lit(0), edli=F.lit(3), admin=F.lit(2), trrn=k, day=F.date_format("d", "dd-MMM-yyyy"))
    ebrc = printed(EBRC, c=F.col("c"), iec=F.lpad(F.col("c").cast("string"), 10, "0"), gstin=F.lit("27ABCDE1234F1Z5"), k=F.lpad(k.cast("string"), 12, "0"), day=F.date_format("d", "dd-MM-yyyy"), total=money(F.col("cents") / 100), net=money(F.col("cents") / 100), a=F.lit("1.0"), b=F.lit("1.0"), bill=k, bill_day=F.date_format("d", "dd-MM-yyyy"))
    mtr = printed(MTR, tin=27_000_000_000 + F.col("c"), name=F.col("c"), first=F.date_format(F.trunc("d", "MM"), "dd/MM/yyyy"), last=F.date_format(F.last_day("d"), "dd/MM/yyyy"), tax=money(F.col("cents") / 100), interest=F.lit(0), total=money(F.col("cents") / 100), grn=F.lpad(k.cast("string"), 9, "0"), day=F.date_format("d", "dd/MM/yyyy"))
    form = F.when(k % 4 == 0, tds).when(k % 4 == 1, pf).when(k % 4 == 2, ebrc).otherwise(mtr)
    filler = F.lit(" " + "y" * 90)
    text = F.when(k % 13 == 3, "x").when(k % 13 == 5, F.concat(F.lit(STRAY[5]), filler)).when(k % 13 == 7, F.concat(F.lit(STRAY[7]), filler)).otherwise(F.concat(form, filler))
    two = F.array(F.concat(F.lit("E-WAY BILL NO 1"), filler), F.concat(F.lit("FORM_IIIB"), filler))
    pages = o.select(k.cast("string").alias("source_file"), F.posexplode(F.when(k % 13 == 9, two).otherwise(F.array(text))).alias("p", "text")).select("source_file", (F.col("p") + 1).alias("page_no"), "text")
    store = new_store(spark, "statutory")
    sheets_of = {}

    def build(keep):
        sheets_of.update(pipelines.statutory(pages, spark.createDataFrame([], layout.CELLS), spark.createDataFrame([], layout.WORDS), keep=keep))
        return {n: sheets_of[n] for n in ("Consolidated", "Dashboard", "Reconciliation", "Parsing_Errors")}

    publish_run(store, build)
    good = store.read("Consolidated", sheets_of["Consolidated"].schema).select(F.col("SourceFile").cast("long").alias("k"), "ReturnType", "DocKind", "PrimaryAmount", "FY")
    bad = store.read("Parsing_Errors", sheets_of["Parsing_Errors"].schema).select(F.col("File").cast("long").alias("k"), "Error_Type")
    return L.union_all([good, bad]).select("k", "Error_Type", "ReturnType", "DocKind", "PrimaryAmount", "FY")


@query(f"""with {_ORDERS}, p as (select *, cents // 100 as tax, case when k % 6 = 0 then 7 else 0 end as interest, date_trunc('month', d)::date as own from o),
m as (select *, case when month(d) = 4 or day(d) <= 7 or interest > 0 then (own - interval 1 month)::date else own end as month from p)
select 'TDS' as "ReturnType", case when k % 9 = 0 then 'Unknown' else 'ABCD' || lpad((c % 100000)::varchar, 5, '0') || 'E' end as "EntityID", {fy("month")} as "FY", month::varchar as period, ((month(month) + 8) % 12 + 1)::int as "MonthIndex", (tax + interest + case when k % 10 = 0 then 5 else 0 end)::double as "PrimaryAmount",
  {flag_list(("k % 10 = 0", "CROSSCHECK"), ("k % 8 = 0", "SECTION?"))} as "Flags", case when k % 10 = 0 or k % 8 = 0 then 'Review' else 'OK' end as "Status" from m
union all select 'TDS', 'ERROR', 'Unknown', null, 0, null, 'PARSE ERR; MONTH?; SECTION?; AMT?', 'Error' from nation""")
def sheet_challans(spark, sf_dir):
    """Challans of all orders as table cells, read by position relative to their labels, under the frames' contract; a file for
    each nation couldn't be read."""
    o = orders(spark, sf_dir).withColumn("source_file", F.col("k").cast("string"))
    o = spread(o, "source_file", o.count())
    k, tax, interest = F.col("k"), F.floor(F.col("cents") / 100), F.when(F.col("k") % 6 == 0, 7).otherwise(0)
    row = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x).cast("string") for x in c])
    rows = F.array(
        F.when(k % 9 != 0, row("TAN :", F.concat(F.lit("ABCD"), F.lpad((F.col("c") % 100000).cast("string"), 5, "0"), F.lit("E")))), row("Name", "Acme Ltd", None, "Financial Year", "x"), F.when(k % 8 != 0, row("Nature of Payment", "194C Contractors")), row("Major Head", "Corporation Tax (0020)"), row("Challan No", k.cast("string")),
        row("Date of Deposit", F.date_format("d", "dd-MMM-yyyy")), row("Amount (in Rs.)", F.concat(F.lit("Rs "), F.format_number(tax + interest + F.when(k % 10 == 0, 5).otherwise(0), 2))), row("Tax", F.format_number(tax, 0)), row("Surcharge", "0"), row("Cess", "0"), row("Interest", interest.cast("string")), row("Penalty", "0"),
    )
    cells = o.select("source_file", F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.posexplode(F.array_compact(rows)).alias("row_no", "cells"))
    failed = read(spark, sf_dir, "nation").select(F.concat(F.lit("lost "), F.col("n_name")).alias("source_file"))
    out = sheets.all_returns([sheets.tds(cells, failed), None], staged(spark, "sheets"))
    return out.select("ReturnType", "EntityID", "FY", F.col("PeriodDate").cast("string").alias("period"), "MonthIndex", "PrimaryAmount", "Flags", "Status")


_SAME = ["a", "b", "c", "e", "f", "g"]


@query(f"""with {_ORDERS}
select k, {", ".join(f"d::varchar as {x}" for x in _SAME)}, {", ".join(f"date_trunc('month', d)::date::varchar as m{i}" for i in range(4))}, strftime(d, '%b-%y') as label, month(d)::int as number from o""")
def date_fields(spark, sf_dir):
    """The days of all orders as forms print them, read back."""
    o, d = orders(spark, sf_dir), F.col("d")
    shown = lambda fmt: F.date_format(d, fmt)
    days = [D.form_date(shown("dd MMM yyyy")), D.form_date(F.concat(shown("dd/MM/yyyy"), F.lit(" 18:52:00"))), D.payment_date(shown("dd-MM-yyyy")), D.bank_date(shown("dd-MMM-yyyy")), D.filing_date(shown("yyyy-MM-dd")), D.filing_date(shown("dd/MM/yyyy"))]
    start = F.concat(D.fiscal_start(d).cast("string"), F.lit("-"), F.lpad(F.pmod(D.fiscal_start(d) + 1, F.lit(100)).cast("string"), 2, "0"))
    months = [D.month_and_year(F.concat(F.lit("wage "), F.upper(shown("MMM-yyyy")))), D.label_date(shown("MMM yyyy")), D.period_of(shown("MMMM"), F.year(d)), D.period_in_fiscal_year(shown("MMM"), D.fiscal_start(d))]
    return o.select("k", *[x.cast("string").alias(n) for n, x in zip(_SAME, days, strict=True)], *[x.cast("string").alias(f"m{i}") for i, x in enumerate(months)], D.period_year(shown("MMMM"), start).alias("label"), D.month_number(F.upper(shown("MMMM"))).alias("number"))


@query("""
with p as (select c_custkey as k, c_mktsegment as s, abs(round(c_acctbal * 100)::bigint) as cents from customer)
select k, s as cell, s || ' LTD' as value, 'P' || k::varchar as label, lower(s) as line, s as dealer, (k % 9999)::varchar as head, left(s, 3) as message, s || ' &lt;&amp;&quot;' as html, s || '|Col|' || s || '_2|Col_2' as headers, s || ',-,-' as fitted,
  s || ' LTD|1 Road Town ' || k::varchar as address, '[' || (cents // 100)::varchar || '.0, 2.0, 3.5, 0.0, 0.0, 0.0]' as numbers, cents / 100.0::double as last_number, cents / 100.0::double as after, cents / 100.0::double as strict from p""")
def text_fields(spark, sf_dir):
    """Strings made of all customers' rows, through each of the string and number functions."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), F.abs(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    k, s, whole, amount = F.col("k").cast("string"), F.col("s"), F.floor(F.col("cents") / 100), money(F.col("cents") / 100)
    made = {
        "cell": T.clean_cell(F.concat(F.lit("A\n  "), s, F.lit(" \n "))), "value": T.key_value(F.concat(F.lit("TAN : 1\nName : "), s, F.lit(" LTD\n")), "Name"), "label": T.after_label(F.concat(F.lit("x period: P"), k, F.lit(" ")), "Period:", 12), "line": T.label_line(F.concat(F.lit("a\nValue Date: "), F.lower(s), F.lit("\nb")), "Value Date"),
        "dealer": T.without_courtesy(F.concat(F.lit("M/S "), s)), "head": T.head_code(F.concat(F.lit("Corporation Tax ("), (F.col("k") % 9999).cast("string"), F.lit(")"))), "message": T.cut_message(s, 3), "html": T.html_escaped(F.concat(s, F.lit(' <&"'))),
        "headers": F.array_join(T.unique_headers(F.array(s, F.lit(""), s, F.lit(" "))), "|"), "fitted": F.array_join(T.fit(F.array(s), 3, F.lit("-")), ","), "address": F.concat_ws("|", *T.name_and_address(F.array(F.concat(s, F.lit(" LTD 2. X")), F.lit("1 Road"), F.concat(F.lit("Town "), k)))),
        "numbers": N.numbers_on_line(F.concat(F.lit("Employee "), F.format_number(whole, 0), F.lit(" 2 x 3.5\n9")), "Employee").cast("string"), "last_number": N.last_two_numbers(F.concat(F.lit("Slab 200 74 "), amount), "Slab")[1], "after": N.amount_after(F.concat(F.lit("Total "), amount), "Total"), "strict": N.strict_number(amount),
    }
    return c.select("k", *[x.alias(n) for n, x in made.items()])
