"""Every registered query of the ledger engine, with its oracle. The driver's tables stand in for extracted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.operators import bank as B
from quillbook.operators import classify as C
from quillbook.operators import geometry as G
from quillbook.operators import ledger as L
from quillbook.parsers import gst
from quillbook.plans import facts
from quillbook.plans.registered import ORACLES, QUERIES, query, read
from quillbook.rules import banks, forms
from quillbook.rules import gst as RG
from quillbook.sources import layout
from quillbook.sources.store import staged

def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows: the priority's first digit is the form, the status letter the status."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "Review").otherwise("Error")
    rows = o.select(F.substring("o_orderpriority", 1, 1).alias("ReturnType"), F.when(F.col("o_orderkey") % 3 == 0, "Challan").otherwise("Return").alias("DocKind"), F.col("o_custkey").cast("string").alias("EntityID"), F.trunc("o_orderdate", "MM").alias("PeriodDate"), status.alias("Status"), F.col("o_totalprice").alias("PrimaryAmount"), F.col("o_orderkey").cast("string").alias("SourceFile"))
    return L.consolidated(rows)


_FY = "case when month({d}) >= 4 then year({d}) else year({d}) - 1 end"
_FY_LABEL = f"({_FY})::varchar || '-' || lpad((({_FY} + 1) % 100)::varchar, 2, '0')"
_LEDGER = f"""l as (
  select substr(o_orderpriority, 1, 1) as ReturnType, case when o_orderkey % 3 = 0 then 'Challan' else 'Return' end as DocKind, o_custkey::varchar as EntityID,
    date_trunc('month', o_orderdate)::date as PeriodDate, case o_orderstatus when 'F' then 'OK' when 'O' then 'Review' else 'Error' end as Status,
    o_totalprice as PrimaryAmount, o_orderkey::varchar as SourceFile, {_FY_LABEL.format(d='o_orderdate')} as FY, (month(o_orderdate) + 8) % 12 + 1 as MonthIndex
  from orders)"""


@query(f"""
select o_orderkey, {_FY_LABEL.format(d='o_orderdate')} as fy, ((month(o_orderdate) + 8) % 12 + 1)::int as month_index, strftime(o_orderdate, '%B') as month_name,
  strftime(o_orderdate, '%b-%y') as month_label, strftime(o_orderdate, '20%y-%m') as iso_month, date_trunc('month', o_orderdate)::date::varchar as period, (date_trunc('month', o_orderdate) - interval 1 month)::date::varchar as month_before,
  (case when day(o_orderdate) <= 7 or month(o_orderdate) = 4 then date_trunc('month', o_orderdate) - interval 1 month else date_trunc('month', o_orderdate) end)::date::varchar as deduction
from orders""")
def fy_calendar(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    deduction, _ = D.deduction_month(d, F.lit(0.0), F.lit(None).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.fiscal_year(d).alias("fy"), D.fiscal_index(d).cast("int").alias("month_index"), D.month_name(d).alias("month_name"), D.month_label(d).alias("month_label"), D.iso_month(D.month_label(d)).alias("iso_month"), F.trunc(d, "MM").cast("string").alias("period"), D.day_before_month(d).cast("string").alias("month_before"), deduction.cast("string").alias("deduction"))


@query("""
select 'CUSTOMER' as ReturnType, 'Return' as DocKind, 'C' || c_custkey as EntityID, c_name as EntityName, case when c_mktsegment is null then '' else c_mktsegment end as Flags, coalesce(c_acctbal, 0) as PrimaryAmount, lower(trim(c_mktsegment)) in ('unknown', 'nat', 'none', '') as is_missing from customer
union all
select 'SUPPLIER', 'Return', 'S' || s_suppkey, s_name, '', coalesce(s_acctbal, 0), true from supplier""")
def consolidated(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    a = c.select(F.lit("CUSTOMER").alias("ReturnType"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("EntityID"), F.col("c_name").alias("EntityName"), F.col("c_mktsegment").alias("Flags"), F.col("c_acctbal").alias("PrimaryAmount"))
    b = s.select(F.lit("SUPPLIER").alias("ReturnType"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("EntityID"), F.col("s_name").alias("EntityName"), F.col("s_acctbal").alias("PrimaryAmount"))
    both = L.consolidated(L.union_all([a, b]))
    return both.select("ReturnType", "DocKind", "EntityID", "EntityName", "Flags", "PrimaryAmount", T.is_missing(F.col("Flags")).alias("is_missing"))


@query(f"""with {_LEDGER}
select ReturnType, DocKind, FY, count(Status) as Records, count(*) filter (Status = 'OK') as OK, count(*) filter (Status = 'Review') as Review, count(*) filter (Status = 'Error') as Errors,
  count(distinct PeriodDate) as Periods, round(sum(PrimaryAmount), 2) as TotalAmount from l group by all order by all""")
def dashboard(spark, sf_dir):
    out = L.dashboard(order_ledger(spark, sf_dir))
    return out.withColumn("TotalAmount", F.round("TotalAmount", 2)).orderBy("ReturnType", "DocKind", "FY")


@query(f"""with {_LEDGER}
select ReturnType, FY, count(*) as Records, count(*) filter (Status = 'OK') as OK, count(*) filter (Status = 'Review') as Review, count(*) filter (Status = 'Error') as Errors,
  round(sum(PrimaryAmount), 2) as TotalAmount, round(count(*) filter (Status <> 'OK') / count(*)::double, 3) as FlagRate from l group by all""")
def flag_rate(spark, sf_dir):
    return L.flag_rate(order_ledger(spark, sf_dir)).withColumn("TotalAmount", F.round("TotalAmount", 2))


@query(f"""with {_LEDGER}
select count(*) as documents, count(*) filter (Status = 'OK') as clean, count(*) filter (Status = 'Review') as review, count(*) filter (Status = 'Error') as error,
  round(sum(PrimaryAmount) filter (DocKind = 'Return'), 2) as declared, round(sum(PrimaryAmount) filter (DocKind in ('Challan', 'Payment')), 2) as paid, (select count(*) from documents where length(text) < 80) as unreadable,
  count(*) filter (Status <> 'OK') + (select count(*) from documents where length(text) < 80) as flagged from l""")
def kpis(spark, sf_dir):
    bad = read(spark, sf_dir, "documents").where(F.char_length("text") < 80)
    out = L.kpis(order_ledger(spark, sf_dir), bad)
    return out.drop("rows_extracted").withColumns({c: F.round(c, 2) for c in ("declared", "paid")})


@query(f"with {_LEDGER} select ReturnType, count(*) as n from l group by all order by n desc, 1")
def type_counts(spark, sf_dir):
    return L.type_counts(order_ledger(spark, sf_dir))


@query(f"with {_LEDGER} select ReturnType, EntityID, FY, Status, SourceFile from l where Status <> 'OK' and ReturnType = '2' and FY = '1997-98'")
def ui_filters(spark, sf_dir):
    return L.filtered(order_ledger(spark, sf_dir), flagged_only=True, return_type="2", fy="1997-98").select("ReturnType", "EntityID", "FY", "Status", "SourceFile")


@query(f"with {_LEDGER} select Status, ReturnType, FY, MonthIndex::int as MonthIndex, SourceFile from l order by case Status when 'Error' then 0 when 'Review' then 1 else 2 end, 2, 3, 4, 5")
def exceptions_first(spark, sf_dir):
    return L.exceptions_first(order_ledger(spark, sf_dir)).select("Status", "ReturnType", "FY", "MonthIndex", "SourceFile")


@query("""
with a as (select l_orderkey, l_extendedprice as amount, count(*) as copies from lineitem group by all),
r as (select *, row_number() over (partition by l_orderkey order by amount desc) as n from a)
select l_orderkey, amount, copies, case n when 1 then 'Employer' when 2 then 'Employee' else 'Other' end as party from r""")
def party_rank(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_extendedprice").alias("amount")).agg(F.count("*").alias("copies"))
    return L.party_rank(a, ["l_orderkey"], "amount", [], "party")


@query("""
with r as (select l_orderkey, l_linenumber, l_returnflag, row_number() over (partition by l_returnflag order by l_extendedprice desc nulls last, l_orderkey, l_linenumber) as n from lineitem)
select l_orderkey, l_linenumber, l_returnflag, case n when 1 then 'Employer' when 2 then 'Employee' else 'Other' end as party from r""")
def party_rank_few_groups(spark, sf_dir):
    """Three groups hold all line items."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return L.party_rank(li, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], "party", staged(spark, "party")).drop("l_extendedprice")


@query("""
with r as (select s_suppkey, row_number() over (order by s_acctbal desc nulls last, s_suppkey) as n from supplier)
select s_suppkey, case n when 1 then 'Employer' when 2 then 'Employee' else 'Other' end as party from r""")
def party_rank_one_group(spark, sf_dir):
    """One group holds all suppliers; its key is null."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lit(None).cast("string").alias("FY"))
    return L.party_rank(s, ["FY"], "s_acctbal", ["s_suppkey"], "party").select("s_suppkey", "party")


def recon_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are demands (some without a date, some left out), their lines' net sums settlements; line items of one form
    have one kind only and drop out."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    d = F.when(F.col("o_orderkey") % 11 != 0, F.trunc("o_orderdate", "MM"))
    demand = o.where("o_orderkey % 13 <> 0").select(F.lit("PTRC").alias("ReturnType"), F.lit("Return").alias("DocKind"), F.col("o_custkey").cast("string").alias("EntityID"), d.alias("PeriodDate"), F.col("o_totalprice").alias("PrimaryAmount"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("SourceFile"))
    net = li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("net"))
    paid = o.join(net, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("PTRC").alias("ReturnType"), F.lit("Challan").alias("DocKind"), F.col("o_custkey").cast("string").alias("EntityID"), d.alias("PeriodDate"), F.col("net").alias("PrimaryAmount"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("SourceFile"))
    single = o.where("o_orderkey % 13 = 0").select(F.lit("EWB").alias("ReturnType"), F.lit("Return").alias("DocKind"), F.col("o_custkey").cast("string").alias("EntityID"), d.alias("PeriodDate"), F.col("o_totalprice").alias("PrimaryAmount"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("SourceFile"))
    return L.consolidated(L.union_all([demand, paid, single]))


_RECON = """net as (select l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as net from lineitem group by 1),
x as (
  select 'PTRC' as ReturnType, 'Return' as DocKind, o_custkey::varchar as EntityID, case when o_orderkey % 11 <> 0 then date_trunc('month', o_orderdate)::date end as PeriodDate, o_totalprice as amt, 'o' || o_orderkey as SourceFile from orders where o_orderkey % 13 <> 0
  union all select 'PTRC', 'Challan', o_custkey::varchar, case when o_orderkey % 11 <> 0 then date_trunc('month', o_orderdate)::date end, net, 'o' || o_orderkey from orders join net on o_orderkey = l_orderkey
  union all select 'EWB', 'Return', o_custkey::varchar, case when o_orderkey % 11 <> 0 then date_trunc('month', o_orderdate)::date end, o_totalprice, 'e' || o_orderkey from orders where o_orderkey % 13 = 0),
m as (select ReturnType from x group by 1 having count(distinct DocKind) > 1),
g as (
  select ReturnType, EntityID, coalesce(PeriodDate::varchar, '~undated~' || SourceFile) as gk, any_value(PeriodDate) as PeriodDate, count(*) as Docs,
    coalesce(sum(amt) filter (DocKind = 'Return'), 0) as ret, coalesce(sum(amt) filter (DocKind = 'Challan'), 0) as cha from x where ReturnType in (select ReturnType from m) group by 1, 2, 3),
s as (
  select *, round(cha - ret, 2) as delta, case when ret > 0 and cha > 0 then case when abs(round(cha - ret, 2)) <= greatest(1, 0.01 * ret) then 'Matched' else 'Mismatch' end when ret > 0 then 'Unpaid?' else 'No demand doc' end as st
  from g where ret > 0 or cha > 0)"""


@query(f"""with {_RECON}
select ReturnType, EntityID, PeriodDate::varchar as PeriodDate, Docs, round(ret, 2) as Declared, round(ret, 2) as "Return", round(cha, 2) as Challan, 0.0::double as Payment, 0.0::double as Arrears, delta as Delta, st as Status from s""")
def reconcile(spark, sf_dir):
    return L.reconcile(recon_ledger(spark, sf_dir)).drop("group_key").withColumn("PeriodDate", F.col("PeriodDate").cast("string"))


@query(f"""with {_RECON}
select x.ReturnType, x.DocKind, x.EntityID, x.SourceFile, case s.st when 'Mismatch' then 'UNRECONCILED' when 'Unpaid?' then 'UNPAID?' when 'No demand doc' then 'NO DEMAND' else '' end as Flags,
  case when s.st is null or s.st = 'Matched' then 'OK' else 'Review' end as Status
from x left join s on x.ReturnType = s.ReturnType and x.EntityID = s.EntityID and coalesce(x.PeriodDate::varchar, '~undated~' || x.SourceFile) = s.gk""")
def recon_flag_back(spark, sf_dir):
    ledger = recon_ledger(spark, sf_dir)
    return L.flag_back(ledger, L.reconcile(ledger)).select("ReturnType", "DocKind", "EntityID", "SourceFile", "Flags", "Status")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements: a user's purchases and errors are debits, the rest credits; balances are missing or wrong by
    rule."""
    e = read(spark, sf_dir, "events")
    debit = F.col("event_type").isin("purchase", "error")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.withColumns({"d": F.when(debit, cents).otherwise(0), "c": F.when(debit, 0).otherwise(cents)})
    e = e.withColumn("b", 100_000 + F.sum(F.col("c") - F.col("d")).over(w))
    balance = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 31 == 0, F.col("b") + 100).otherwise(F.col("b"))
    return e.select("user_id", "ts", "event_id", (F.col("d") / 100).alias("Debit"), (F.col("c") / 100).alias("Credit"), (balance / 100).alias("Balance"), F.col("ts").cast("date").alias("TransactionDate"))


_STATEMENT = """e as (
  select user_id, ts, event_id, case when event_type in ('purchase', 'error') then round(value * 100)::bigint else 0 end as d, case when event_type in ('purchase', 'error') then 0 else round(value * 100)::bigint end as c from events),
b as (select *, 100000 + sum(c - d) over (partition by user_id order by ts, event_id rows unbounded preceding) as b from e),
t as (select user_id, ts, event_id, d / 100.0::double as Debit, c / 100.0::double as Credit, (case when event_id % 7 = 0 then null when event_id % 31 = 0 then b + 100 else b end) / 100.0::double as Balance from b),
f as (select user_id, first(Balance + Debit - Credit order by ts, event_id) as opening, last(Balance order by ts, event_id) as closing, first(ts order by ts, event_id)::date as pf, last(ts order by ts, event_id)::date as pt from t group by 1)"""


@query(f"with {_STATEMENT} select user_id, round(opening, 2) as OpeningBalance, round(closing, 2) as ClosingBalance, pf::varchar as PeriodFrom, pt::varchar as PeriodTo from f")
def infer_balances(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    out = _statement_meta(rows)
    return out.select("user_id", F.round("OpeningBalance", 2).alias("OpeningBalance"), F.round("ClosingBalance", 2).alias("ClosingBalance"), F.col("PeriodFrom").cast("string"), F.col("PeriodTo").cast("string"))


def _statement_meta(rows: DataFrame) -> DataFrame:
    empty = rows.select("user_id").distinct().select("user_id", *[F.lit(None).cast("double").alias(c) for c in ("OpeningBalance", "ClosingBalance")], *[F.lit(None).cast("date").alias(c) for c in ("PeriodFrom", "PeriodTo")])
    return B.infer_balances(empty, rows, ["user_id"], ["ts", "event_id"])


@query(f"""with {_STATEMENT},
p as (select t.*, coalesce(last_value(Balance ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), opening) as prev from t join f using (user_id)),
r as (
  select user_id, count(*) as n, count(*) filter (abs(prev - Debit + Credit - Balance) > 0.05) as mism, sum(Debit) as td, sum(Credit) as tc, count(*) filter ((Debit > 0.05) = (Credit > 0.05)) as conf from p group by 1),
z as (select r.*, opening, closing, closing - (opening - td + tc) as diff from r join f using (user_id))
select user_id, n, mism as RunningMismatches, round(td, 2) as TotalDebit, round(tc, 2) as TotalCredit, round(opening - td + tc, 2) as ExpectedClosing, round(diff, 2) + 0.0 as Difference,
  concat_ws('; ', case when conf > 0 then 'DEBIT_CREDIT_CONFLICT' end, case when mism > 0 then 'RUNNING_BALANCE_MISMATCH' end, case when abs(diff) > 0.05 then 'SUMMARY_BALANCE_MISMATCH' end, case when diff is null then 'SUMMARY_BALANCE_MISSING' end) as codes,
  case when conf = 0 and mism = 0 and abs(diff) <= 0.05 then 'PASS' else 'REVIEW' end as Status from z""")
def running_balance(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    out = B.reconciled(rows, _statement_meta(rows), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "n", "RunningMismatches", *[(F.round(c, 2) + 0.0).alias(c) for c in ("TotalDebit", "TotalCredit", "ExpectedClosing", "Difference")], F.array_join("codes", "; ").alias("codes"), "Status")


@query("""
with a as (select *, case when role = 'user' then turn end as mark from conversations)
select conv_id, turn, role, coalesce(last_value(mark ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), -1) as section from a""")
def section_ffill(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    out = G.carried(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section", F.lit(-1).cast("long"))
    return out.select("conv_id", "turn", "role", "section")


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as section rows: the suppliers are returns, flag and status pick the section, footers are planted."""
    li = read(spark, sf_dir, "lineitem")
    code = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    section = F.when(code == "AF", "4A").when(code == "AO", "5").when(code == "NF", "6A").when(code == "NO", "9B_CDNR").when(code == "RF", "12_HSN").otherwise("TOTAL_LIABILITY")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    g = li.groupBy("l_suppkey", section.alias("Section_Code")).agg(F.sum(cents("l_extendedprice")).alias("v"), F.sum(cents("l_discount")).alias("i"), F.sum(cents("l_tax")).alias("c"), F.count("*").alias("n"))
    return g.select("l_suppkey", "Section_Code", (F.col("v") / 100).alias("Value"), (F.col("i") / 100).alias("IGST"), F.when(F.col("Section_Code") == "6A", 0.0).otherwise(F.col("c") / 100).alias("CGST"), F.when(F.col("l_suppkey") % 5 == 0, 1.0).otherwise(0.0).alias("SGST"), F.lit(0.0).alias("Cess"), F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(F.col("n")).alias("Num_Records"))


_SECTIONS = """k as (
  select l_suppkey, case l_returnflag || l_linestatus when 'AF' then '4A' when 'AO' then '5' when 'NF' then '6A' when 'NO' then '9B_CDNR' when 'RF' then '12_HSN' else 'TOTAL_LIABILITY' end as sec,
    round(l_extendedprice * 100)::bigint as v, round(l_discount * 100)::bigint as i, round(l_tax * 100)::bigint as c from lineitem),
s as (
  select l_suppkey, sec, sum(v) / 100.0::double as Value, sum(i) / 100.0::double as IGST, case when sec = '6A' then 0 else sum(c) / 100.0::double end as CGST, case when l_suppkey % 5 = 0 then 1.0 else 0.0 end::double as SGST, 0.0::double as Cess,
    case when l_suppkey % 7 = 0 then 0 else count(*) end as n from k group by l_suppkey, sec)"""


@query(f"""with {_SECTIONS}, u as (
  select l_suppkey, sec, 'Value' as Head, Value as a from s union all select l_suppkey, sec, 'IGST', IGST from s union all select l_suppkey, sec, 'CGST', CGST from s union all select l_suppkey, sec, 'SGST', SGST from s union all select l_suppkey, sec, 'Cess', Cess from s),
h as (select l_suppkey, Head, round(sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then a else 0 end), 2) as Computed, round(sum(case when sec = 'TOTAL_LIABILITY' then a else 0 end), 2) as Reported from u group by 1, 2)
select *, round(Computed - Reported, 2) as Variance, case when abs(round(Computed - Reported, 2)) <= 1 then 'PASS' else 'FAIL' end as Status from h""")
def liability_matrix(spark, sf_dir):
    return gst.liability_matrix(section_rows(spark, sf_dir), ["l_suppkey"])


@query(f"""with {_SECTIONS}, u as (
  select l_suppkey, sec, 'Value' as Head, Value as Amount from s union all select l_suppkey, sec, 'IGST', IGST from s union all select l_suppkey, sec, 'CGST', CGST from s union all select l_suppkey, sec, 'SGST', SGST from s union all select l_suppkey, sec, 'Cess', Cess from s)
select l_suppkey, sec as Section_Code, Head, Amount from u where Amount <> 0""")
def fact_unpivot(spark, sf_dir):
    return gst.unpivoted(section_rows(spark, sf_dir), ["l_suppkey", "Section_Code"], RG.HEADS)


@query(f"""with {_SECTIONS}, g as (
  select l_suppkey, sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then Value else 0 end) lv, sum(case when sec = 'TOTAL_LIABILITY' then Value else 0 end) tv, sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then IGST else 0 end) li, sum(case when sec = 'TOTAL_LIABILITY' then IGST else 0 end) ti,
    sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then CGST else 0 end) lc, sum(case when sec = 'TOTAL_LIABILITY' then CGST else 0 end) tc, sum(case when sec in ('4A', '5', '6A', '9B_CDNR') then SGST else 0 end) ls, sum(case when sec = 'TOTAL_LIABILITY' then SGST else 0 end) ts,
    sum(case when sec = '12_HSN' then Value else 0 end) hsn, sum(case when sec in ('4A', '5', '6A') then Value else 0 end) sup, sum(case when sec = '9B_CDNR' then Value else 0 end) notes,
    sum(case when sec = '5' then Value else 0 end) v5, sum(case when sec = '5' then n else 0 end) n5, sum(case when sec = '4A' then Value else 0 end) v4, sum(case when sec = '4A' then n else 0 end) n4, sum(case when sec = '6A' then Value else 0 end) v6, sum(case when sec = '6A' then n else 0 end) n6, sum(case when sec = '9B_CDNR' then n else 0 end) n9,
    sum(case when sec = '5' then CGST else 0 end) c5, sum(case when sec = '5' then SGST else 0 end) s5, sum(case when sec = '6A' then CGST else 0 end) c6, sum(case when sec = '6A' then SGST else 0 end) s6 from s group by 1),
r as (
  select l_suppkey, 'Total_Liability_Value' as "Check", lv as a, tv as b, round(lv - tv, 2) as c, 'FAIL' as Status from g where abs(round(lv - tv, 2)) > 1
  union all select l_suppkey, 'Total_Liability_IGST', li, ti, round(li - ti, 2), 'FAIL' from g where abs(round(li - ti, 2)) > 1
  union all select l_suppkey, 'Total_Liability_CGST', lc, tc, round(lc - tc, 2), 'FAIL' from g where abs(round(lc - tc, 2)) > 1
  union all select l_suppkey, 'Total_Liability_SGST', ls, ts, round(ls - ts, 2), 'FAIL' from g where abs(round(ls - ts, 2)) > 1
  union all select l_suppkey, 'HSN_vs_Supply_Tables', sup, hsn, hsn - sup, 'WARN' from g where sup <> 0 and abs((hsn - sup) / sup) * 100 > 10
  union all select l_suppkey, 'Record_Count_4A', n4, v4, 0, 'WARN' from g where (n4 = 0 and v4 <> 0) or (n4 > 0 and v4 = 0)
  union all select l_suppkey, 'Record_Count_5', n5, v5, 0, 'WARN' from g where (n5 = 0 and v5 <> 0) or (n5 > 0 and v5 = 0)
  union all select l_suppkey, 'Record_Count_6A', n6, v6, 0, 'WARN' from g where (n6 = 0 and v6 <> 0) or (n6 > 0 and v6 = 0)
  union all select l_suppkey, 'Record_Count_9B_CDNR', n9, notes, 0, 'WARN' from g where (n9 = 0 and notes <> 0) or (n9 > 0 and notes = 0)
  union all select l_suppkey, 'B2CL_Threshold', v5 / n5, 250000, 0, 'FAIL' from g where n5 > 0 and v5 / n5 <= 250000
  union all select l_suppkey, 'Interstate_Tax_5', c5 + s5, 0, c5 + s5, 'FAIL' from g where c5 > 0 or s5 > 0
  union all select l_suppkey, 'Interstate_Tax_6A', c6 + s6, 0, c6 + s6, 'FAIL' from g where c6 > 0 or s6 > 0
  union all select l_suppkey, 'CDNR_Sign_Check', notes, 0, notes, 'WARN' from g where notes > 0)
select l_suppkey, "Check", round(a::double, 2) as Computed, round(b::double, 2) as Reported, round(c::double, 2) as Variance, Status from r""")
def gst_checks(spark, sf_dir):
    return gst.gstr1_checks(section_rows(spark, sf_dir), key="l_suppkey")


@query(f"""with {_SECTIONS}, u as (
  select l_suppkey, sec, 'Value' as Head, Value as a from s union all select l_suppkey, sec, 'IGST', IGST from s union all select l_suppkey, sec, 'CGST', CGST from s union all select l_suppkey, sec, 'SGST', SGST from s)
select l_suppkey::varchar as GSTIN, 'Apr-25' as Period_Year, round(coalesce(sum(a) filter (Head = 'Value' and sec in ('4A', '5', '6A')), 0), 2) as SupplyValue, round(coalesce(sum(a) filter (Head = 'Value' and sec = '6A'), 0), 2) as ExportValue,
  round(coalesce(sum(a) filter (Head = 'Value' and sec = '9B_CDNR'), 0), 2) as NotesValue, round(coalesce(sum(a) filter (Head = 'IGST' and sec in ('4A', '5', '6A', '9B_CDNR')), 0), 2) as Total_IGST,
  round(coalesce(sum(a) filter (Head = 'CGST' and sec in ('4A', '5', '6A', '9B_CDNR')), 0), 2) as Total_CGST, round(coalesce(sum(a) filter (Head = 'SGST' and sec in ('4A', '5', '6A', '9B_CDNR')), 0), 2) as Total_SGST, 0.0::double as Total_Cess
from u group by 1""")
def exec_summary(spark, sf_dir):
    rows = section_rows(spark, sf_dir).withColumns({"GSTIN": F.col("l_suppkey").cast("string"), "Period_Year": F.lit("Apr-25"), "Section_Label": F.lit("")})
    return facts.outward_summary(rows, facts.liability(rows))


_CHECKS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(RG.KNOWN_CHECKS))


@query(f"""
with checks(check_seq, "Check") as (values {_CHECKS}),
e as (select n_regionkey as r, checks."Check", 'FAIL' as s, n_nationkey from nation join checks on n_nationkey % 8 = check_seq),
f as (select r, "Check", s from e qualify row_number() over (partition by r, "Check" order by n_nationkey) = 1)
select r_regionkey, check_seq::int as check_seq, c."Check", coalesce(s, 'PASS') as Sanity_Status from region cross join checks c left join f on f.r = r_regionkey and f."Check" = c."Check" """)
def checksum_matrix(spark, sf_dir):
    checks = spark.createDataFrame([(i, c) for i, c in enumerate(RG.KNOWN_CHECKS)], "k int, Check string")
    bad = read(spark, sf_dir, "nation").join(F.broadcast(checks), F.col("n_nationkey") % 8 == F.col("k")).select(F.col("n_regionkey").alias("r_regionkey"), "Check", F.lit("FAIL").alias("Sanity_Status"), "n_nationkey")
    return gst.checksum_matrix(read(spark, sf_dir, "region"), bad, ["r_regionkey"], order=["n_nationkey"]).select("r_regionkey", "check_seq", "Check", "Sanity_Status")


@query("""
with g as (select l_orderkey, sum(round(l_extendedprice * 100)::bigint) filter (l_returnflag = 'A') / 100.0::double as a, sum(round(l_extendedprice * 100)::bigint) filter (l_returnflag = 'R') / 100.0::double as r from lineitem group by 1)
select l_orderkey, round(a, 2) as a, round(r, 2) as r, round(a + r, 2) as both from g""")
def masked_sum_null(spark, sf_dir):
    amount = F.round(F.col("l_extendedprice") * 100).cast("long") / 100
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[gst.masked_sum(F.col("l_returnflag") == k.upper(), amount).alias(k) for k in ("a", "r")])
    return g.select("l_orderkey", "a", "r", F.round(F.col("a") + F.col("r"), 2).alias("both"))


@query("""
with x as (select l_shipdate, l_partkey, case when l_returnflag = 'R' then null else l_quantity end as q, case when l_returnflag in ('R', 'A') then null else l_tax end as t from lineitem)
select strftime(l_shipdate, '%Y-%m') as month, l_partkey % 10 as party, sum(q) as q, round(sum(t), 4) as t from x group by 1, 2""")
def null_skip_sum(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    q, t = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")), F.when(~F.col("l_returnflag").isin("R", "A"), F.col("l_tax"))
    rows = li.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_partkey") % 10).alias("party"), q.alias("q"), t.alias("t"))
    return facts.net_sections(rows, ["month", "party"], ["q", "t"]).withColumn("t", F.round("t", 4))


@query("""
with a(zone, x0) as (values ('low', 908.0), ('mid', 1108.0), ('high', 1508.0), ('top', 1808.0)),
b as (select zone, x0 - 8 as lo, coalesce(lead(x0) over (order by x0) - 8, 1e18) as hi from a)
select p_partkey, zone from part join b on p_retailprice >= lo and p_retailprice < hi""")
def zone_split(spark, sf_dir):
    anchors = spark.createDataFrame([(1, "low", 908.0), (1, "mid", 1108.0), (1, "high", 1508.0), (1, "top", 1808.0)], "page int, zone string, x0 double")
    values = read(spark, sf_dir, "part").select(F.lit(1).alias("page"), "p_partkey", F.col("p_retailprice").alias("at"))
    return G.zone_join(values, F.broadcast(anchors), ["page"]).select("p_partkey", "zone")  # four fixed anchors


#: Texts for the classifiers: markers are planted by rule on document ids.
_PLANTED = {3: "INCOME TAX DEPARTMENT DATE OF DEPOSIT", 4: "GSTR-1 summary", 5: "gstr-3b return", 6: "E-Way Bill No 1", 7: "FORM_IIIB GSTR-1", 8: "PROVIDENT FUND ORGANISATION GSTR1", 9: "CUST0MS ED1 SYSTEM", 10: "Challan Period: ESIC", 11: "PTRC MTR FORM", 12: "COMBINED CHALLAN OF A/C"}


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    mark = None
    for k, v in _PLANTED.items():
        mark = F.when(F.col("doc_id") % 17 == k, v) if mark is None else mark.when(F.col("doc_id") % 17 == k, v)
    return d.withColumn("text", F.concat_ws(" ", "text", mark.otherwise("")))


_PLANT_SQL = "select doc_id, text || ' ' || case doc_id % 17 " + " ".join(f"when {k} then '{v}'" for k, v in _PLANTED.items()) + " else '' end as text from documents"


def _count_sql(markers: list[str]) -> str:
    return " + ".join("contains(t, '{}')::int".format(m.replace("'", "''")) for m in markers)


@query(f"""
with d as (select doc_id, upper(text) as t from ({_PLANT_SQL})),
tok as (select *, regexp_extract_all(translate(t, '01', 'OI'), '[A-Z]+') as k from d),
c as (
  select doc_id, unnest([
    {{'o': 0, 'f': 'SB', 's': case when {_count_sql(forms.SB_STRONG)} > 0 or list_has_all(k, ['CUSTOMS', 'EDI', 'SYSTEM']) or list_has_all(k, ['SHIPPING', 'BILL', 'SUMMARY']) then 100 when contains(t, 'SHIPPING BILL') and {_count_sql(forms.SB_SUPPORT)} >= 3 then 85 else 0 end}},
    {{'o': 1, 'f': 'EBRC', 's': case when contains(t, '{forms.EBRC_TITLE}') or {_count_sql(forms.EBRC)} = 2 then 100 else 0 end}},
    {{'o': 2, 'f': 'EWB', 's': case when {_count_sql(forms.EWB)} > 0 then 100 else 0 end}},
    {{'o': 3, 'f': 'GSTR3B', 's': case when {_count_sql(forms.GSTR3B)} > 0 then 100 else 0 end}},
    {{'o': 4, 'f': 'GSTR1', 's': case when {_count_sql(forms.GSTR1)} > 0 then 100 else 0 end}},
    {{'o': 5, 'f': 'PF', 's': case when {_count_sql(forms.PF)} > 0 then 90 else 0 end}},
    {{'o': 6, 'f': 'ESIC', 's': case when contains(t, 'CHALLAN PERIOD:') and {_count_sql(forms.ESIC)} > 1 then 90 else 0 end}},
    {{'o': 7, 'f': 'PTRC', 's': case when {_count_sql(forms.PTRC)} > 0 then 85 else 0 end}},
    {{'o': 8, 'f': 'TDS', 's': case when {_count_sql(forms.TDS_TITLES)} > 0 and {_count_sql(forms.TDS)} >= 2 then 90 else 0 end}}]) as x from tok),
r as (select doc_id, x.f, x.s, row_number() over (partition by doc_id order by x.s desc, x.o) as n from c where x.s > 0),
b as (select doc_id, max(f) filter (n = 1) as f, max(s) filter (n = 1) as s, coalesce(max(s) filter (n = 2), 0) as s2 from r group by 1)
select d.doc_id, b.f as return_type, coalesce(s, 0)::int as score, coalesce(s - s2, 0)::int as margin, coalesce(s >= 70 and s - s2 >= 15, false) as accepted from d left join b using (doc_id)""")
def classify(spark, sf_dir):
    out = C.with_forms(planted(spark, sf_dir))
    return out.select("doc_id", "form.return_type", "form.score", "form.margin", "form.accepted")


_BANK_TEXT = "case doc_id % 13 when 1 then 'Axis Bank statement of axis bank account tran date' when 2 then 'State Bank of India statement of account' when 3 then 'Axis Bank Federal Bank balance type deposits withdrawals' when 4 then 'mutual fund folio no balance units axis bank statement of axis bank account' when 5 then 'citidirect account statement details report' else '' end"


def _bank_sql() -> str:
    def score(anchors: dict[str, int]) -> str:
        return " + ".join("case when contains(t, '{}') then {} else 0 end".format(m, w) for m, w in anchors.items())

    each = ", ".join(f"{{'o': {i}, 'c': '{b.code}', 's': least(100, {score(b.anchors)})}}" for i, b in enumerate(banks.BANKS))
    other = ", ".join(f"{score(a)}" for a in banks.UNSUPPORTED.values())
    return f"""
with d as (select doc_id, upper(text || ' ' || {_BANK_TEXT}) as t from documents),
c as (select doc_id, unnest([{each}]) as x, greatest({other}) as u from d),
r as (select doc_id, u, x.c, x.s, row_number() over (partition by doc_id order by x.s desc, x.o) as n from c where x.s > 0),
b as (select doc_id, any_value(u) as u, max(c) filter (n = 1) as code, max(s) filter (n = 1) as s, coalesce(max(s) filter (n = 2), 0) as s2 from r group by 1)
select d.doc_id, code, coalesce(s, 0)::int as score, coalesce(s - s2, 0)::int as margin, coalesce(s >= 60 and s - s2 >= 15 and not (u > 0 and u >= s), false) as accepted from d left join b using (doc_id)"""


@query(_bank_sql())
def bank_score(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", F.expr(_BANK_TEXT)).alias("text")).withColumn("pages", F.array("text"))
    return C.with_banks(d).select("doc_id", "bank.code", "bank.score", "bank.margin", "accepted")


@query("""
with p as (select doc_id, string_split(trim(text, ' '), chr(10)) as pages from documents)
select doc_id, len(pages) as n_pages, length(pages[1]) < 20 or list_sum(list_transform(pages, lambda x: length(x))) < 20 as needs_ocr,
  length(pages[1]) < 20 or list_sum(list_transform(pages, lambda x: length(x))) < 80 * len(pages) as sparse_text from p""")
def preflight(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.trim("text"), "\n").alias("pages"))
    return layout.preflight(d).select("doc_id", F.size("pages").cast("long").alias("n_pages"), "needs_ocr", "sparse_text")


@query("""
with s as (select o_orderkey, case o_orderkey % 5 when 0 then '₹ ' || printf('%,.2f', o_totalprice) when 1 then '(' || printf('%,.2f', o_totalprice) || ')' when 2 then '-' || printf('%.2f', o_totalprice) when 3 then 'n/a' else printf('%,.2f', o_totalprice) || ' Dr' end as s, round(o_totalprice, 2) as v, o_orderkey % 5 as k from orders)
select o_orderkey, case when k in (1, 2) then -v when k = 3 then null else v end as amount, case when k = 2 then -v else 0.0 end as number, case k when 4 then -v when 1 then -v when 2 then -v when 3 then null else v end as balance from s""")
def parse_amount(spark, sf_dir):
    money, k = F.format_number("o_totalprice", 2), F.col("o_orderkey") % 5
    s = F.when(k == 0, F.concat(F.lit("₹ "), money)).when(k == 1, F.concat(F.lit("("), money, F.lit(")"))).when(k == 2, F.concat(F.lit("-"), F.translate(money, ",", ""))).when(k == 3, "n/a").otherwise(F.concat(money, F.lit(" Dr")))
    return read(spark, sf_dir, "orders").withColumn("s", s).select("o_orderkey", N.parse_amount(F.col("s")).alias("amount"), N.to_float(F.col("s")).alias("number"), N.signed_balance(F.col("s"), F.lit(""), F.lit(False)).alias("balance"))


@query("""
select event_id, nullif(trim(regexp_extract(props, '"page"\\s*:\\s*([^,}]+)', 1)), '') as page, nullif(regexp_extract(props, '([0-9]+)', 1), '') as digits, len(regexp_extract_all(props, '[0-9,]+')) as n from events""")
def kv_extract(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    p = F.col("props")
    return e.select("event_id", T.found(p, r'"page"\s*:\s*([^,}]+)').alias("page"), T.found(p, "([0-9]+)").alias("digits"), F.size(F.regexp_extract_all(p, F.lit("[0-9,]+"), F.lit(0))).cast("long").alias("n"))


_PRINTED = ["Tran Date", "Value Date", "Particulars", "Chq No", "Withdrawals (Rs)", "DEPOSITS", "Balance Type", "FD Account No.", "Int. Rate", "Maturity Amount", "TDS Paid", "Ref No./Cheque No", "Something else", "Transaction Date extra"]
_MEANT = ["date", "value date", "description", "reference", "debit", "credit", "balance type", "deposit number", "interest rate", "maturity amount", "tds", "reference", "something else", "date"]


@query("with h(printed, meant) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_PRINTED, _MEANT, strict=True)) + ") select r_regionkey, printed, meant from region cross join h")
def header_alias(spark, sf_dir):
    h = spark.createDataFrame([(p,) for p in _PRINTED], "printed string")
    return read(spark, sf_dir, "region").select("r_regionkey").crossJoin(F.broadcast(h)).select("r_regionkey", "printed", T.canonical_header(F.col("printed"), banks.HEADERS).alias("meant"))


def audit_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = planted(spark, sf_dir), read(spark, sf_dir, "labels")
    x = C.with_forms(d).join(lab, "doc_id", "left")
    rows = x.select("doc_id", "form", (F.char_length("text") < 400).alias("sparse_text"), (F.col("doc_id") % 4 == 0).alias("ocr_used"), F.col("form.return_type").alias("ReturnType"), F.when(F.col("quality") == 1, F.concat(F.lit("E"), F.col("doc_id").cast("string"))).otherwise("Unknown").alias("EntityID"), F.when(F.col("doc_id") % 2 == 0, F.make_date(F.lit(2025), F.lit(4), F.lit(1))).alias("PeriodDate"), F.when(F.col("doc_id") % 3 != 0, "R1").alias("DocRef"), F.when(F.col("toxic") == 1, "TOXIC?; BAD?").otherwise("").alias("Flags"), F.when(F.col("doc_id") % 29 == 0, "Error").otherwise("OK").alias("Status"), F.col("doc_id").cast("string").alias("SourceFile"))
    return L.audited(rows)


_AUDIT = f"""cl as ({ORACLES['classify']}),
a as (
  select d.doc_id, cl.return_type as ReturnType, cl.score, cl.accepted, length(d.text) < 400 as sparse, d.doc_id % 4 = 0 as ocr, coalesce(quality, 0) <> 1 as no_id, d.doc_id % 2 <> 0 as no_period, d.doc_id % 3 = 0 and cl.return_type not in ('GSTR1', 'GSTR3B') as no_ref, coalesce(toxic, 0) = 1 as tox, d.doc_id % 29 = 0 as err, cl.return_type is not null as has
  from ({_PLANT_SQL}) d join cl using (doc_id) left join labels using (doc_id)),
f as (
  select *, list_filter([case when sparse then 'SPARSE_TEXT' end, case when ocr then 'OCR_TEXT' end, case when not accepted then 'AMBIGUOUS_TYPE' end, case when has and no_id then 'ENTITYID_MISSING' end, case when has and no_period then 'PERIODDATE_MISSING' end, case when has and no_ref then 'DOCREF_MISSING' end, case when tox then 'PARSER_CHECK' end, case when tox then 'PARSER_CHECK' end], lambda x: x is not null) as codes,
    greatest(0, least(100, case when accepted then score - 15 * sparse::int - 20 * ocr::int else least(50, score - 15 * sparse::int - 20 * ocr::int) end - 25 * (has::int * (no_id::int + no_period::int + coalesce(no_ref, false)::int)))) as conf from a)"""


@query(f"""with {_AUDIT}
select doc_id, ReturnType, conf::int as Confidence, case when conf >= 90 then 'High' when conf >= 70 then 'Medium' else 'Low' end as ConfidenceGrade, array_to_string(codes, '; ') as ValidationFindings,
  case when err then 'Error' when len(codes) > 0 then 'Review' else 'OK' end as Status,
  array_to_string(list_concat(case when tox then ['TOXIC?', 'BAD?'] else [] end, case when tox then list_append(list_filter(codes, lambda x: x <> 'PARSER_CHECK'), 'PARSER_CHECK') else codes end), '; ') as Flags from f""")
def audit_score(spark, sf_dir):
    return audit_input(spark, sf_dir).select("doc_id", "ReturnType", "Confidence", "ConfidenceGrade", "ValidationFindings", "Status", "Flags")


@query(f"""with {_AUDIT}
select doc_id, array_to_string(codes, ',') as findings, case when ReturnType is null then null when ReturnType in ('GSTR1', 'GSTR3B') then 'EntityID,PeriodDate' else 'EntityID,PeriodDate,DocRef' end as evidence
from f where err or len(codes) > 0""")
def review_packet(spark, sf_dir):
    a = staged(spark, "review")(audit_input(spark, sf_dir), "audited")
    out = L.review_packets(a, L.finding_rows(a), L.evidence_rows(a))
    return out.select(F.col("SourceFile").cast("long").alias("doc_id"), F.array_join(F.transform(F.coalesce("Findings", F.array().cast(out.schema["Findings"].dataType)), lambda x: x["Code"]), ",").alias("findings"), F.array_join(F.transform("Evidence", lambda x: x["Field"]), ",").alias("evidence"))


@query("select doc_id, n_chars from documents where doc_id % 5 = 0 or doc_id % 7 = 0")
def incremental_manifest(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"), "n_chars")
    changed = F.when(F.col("doc_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    manifest = files.where("doc_id % 5 <> 0").withColumn("length", changed)
    return layout.unread(files, manifest).select("doc_id", "n_chars")


@query(rf"""with recursive
d as (select doc_id::varchar as source_file, unnest(w) as text, unnest(range(len(w))) as i from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)),
p as (select source_file, (i // 400)::int as page_no, text, i % 10 * 50.0::double as x0, (i % 400 // 10) * 12 + i % 3 * 0.9::double as top from d),
s as materialized (select *, row_number() over (partition by source_file, page_no order by round(top, 1), x0) as k from p),
walk as (
  select source_file, page_no, k, 0 as line_no, top as anchor from s where k = 1
  union all
  select s.source_file, s.page_no, s.k, line_no + (abs(s.top - anchor) > {N.DEFAULT.line})::int, case when abs(s.top - anchor) > {N.DEFAULT.line} then s.top else anchor end
  from walk join s on s.source_file = walk.source_file and s.page_no = walk.page_no and s.k = walk.k + 1)
select source_file, page_no, line_no, min(top) as top, string_agg(text, ' ' order by x0) as text from walk join s using (source_file, page_no, k) group by all""")
def line_cluster(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "text"))
    words = d.select(F.col("doc_id").cast("string").alias("source_file"), F.floor(F.col("i") / 400).cast("int").alias("page_no"), "text", (F.col("i") % 10 * 50.0).alias("x0"), (F.col("i") % 10 * 50.0 + 40).alias("x1"), (F.floor(F.col("i") % 400 / 10) * 12 + F.col("i") % 3 * 0.9).alias("top"), (F.floor(F.col("i") % 400 / 10) * 12 + 10.0).alias("bottom"))
    return G.cluster_lines(words, ["source_file", "page_no"]).select("source_file", "page_no", "line_no", "top", "text")


from quillbook.plans import laid_out, runs  # noqa: E402, F401  they register their queries
