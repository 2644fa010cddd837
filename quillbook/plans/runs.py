"""Registered queries of what lasts longer than one plan: the cache, published runs, handlers, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.operators import classify as C
from quillbook.operators import ledger as L
from quillbook.parsers import gst
from quillbook.plans import catalogue as Q
from quillbook.plans import settings as S
from quillbook.plans.registered import ORACLES, query, read
from quillbook.plans.registry import Handler, Registry
from quillbook.sources import layout
from quillbook.sources.cache import KEYS, TABLE, read_through
from quillbook.sources.store import new_store, publish_run, staged


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the key columns and the text."""
    return Q.planted(spark, sf_dir).select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.char_length("text").cast("long").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"), "doc_id", "text")


def extracted(files: DataFrame) -> DataFrame:
    """What is kept of a file: its pages, what the preflight says, and its form."""
    pages = files.withColumn("pages", F.split(F.trim("text"), "\n"))
    out = C.with_forms(layout.preflight(pages))
    return out.select(*KEYS, "doc_id", "pages", "needs_ocr", "sparse_text", "form")


_PREFLIGHT = f"""p as (select doc_id, string_split(trim(text, ' '), chr(10)) as pages from ({Q._PLANT_SQL})),
f as (select doc_id, len(pages) as n_pages, length(pages[1]) < 20 or list_sum(list_transform(pages, lambda x: length(x))) < 20 as needs_ocr from p)"""


@query(f"with cl as ({ORACLES['classify']}), {_PREFLIGHT} select f.doc_id, n_pages, needs_ocr, return_type, score, accepted from f join cl using (doc_id)")
def cached_layout(spark, sf_dir):
    """All documents through a store that has seen an older state of the folder: a seventh of them changed since, a fifth came
    later, and one of its parts is lost."""
    files, store = document_files(spark, sf_dir), new_store(spark, "layout")
    older = files.where("doc_id % 5 <> 0").withColumn("length", F.when(F.col("doc_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")))
    read_through(older, extracted, store)
    fs, lost = store._path(sorted(store.current()[TABLE].values())[0])
    fs.delete(lost, True)
    out = read_through(files, extracted, store)
    return out.select("doc_id", F.size("pages").cast("long").alias("n_pages"), "needs_ocr", "form.return_type", "form.score", "form.accepted")


def _sheets(ledger: DataFrame, recon: DataFrame, fail: bool):
    """The tables of a run over a ledger; where it is to fail, one of them can't be written."""

    def build(keep):
        kept = keep(ledger, "ledger", ["ReturnType", "FY"])
        rates = L.flag_rate(kept)
        if fail:
            rates = rates.withColumn("FlagRate", F.when(F.col("Records") > 0, F.raise_error(F.lit("the disk is full")).cast("double")))
        return {"Dashboard": L.dashboard(kept), "Flag_Rate": rates, "Reconciliation": L.reconcile(keep(recon, "recon")).drop("group_key")}

    return build


@query(f"""with a as ({ORACLES['dashboard']}), b as ({ORACLES['flag_rate']}), c as ({ORACLES['reconcile']})
select run, 'Dashboard' as sheet, count(*) as n, sum(Records) as records, round(sum(TotalAmount) / 1000, 0) as thousands from a, (values ('first'), ('after the failure'), ('second')) r(run) where run = 'second' or ReturnType <> '5' group by run
union all select run, 'Flag_Rate', count(*), sum(Records), round(sum(TotalAmount) / 1000, 0) from b, (values ('first'), ('after the failure'), ('second')) r(run) where run = 'second' or ReturnType <> '5' group by run
union all select run, 'Reconciliation', count(*), sum(Docs), round(sum(Declared) / 1000, 0) from c, (values ('first'), ('after the failure'), ('second')) r(run) group by run""")
def published_runs(spark, sf_dir):
    """Publishes a run, fails in the middle of one, and publishes another; what readers see after each."""
    store, ledger, recon = new_store(spark, "runs"), Q.order_ledger(spark, sf_dir), Q.recon_ledger(spark, sf_dir)
    schemas = {n: df.schema for n, df in _sheets(ledger, recon, False)(lambda df, name, by=None: df).items()}
    sums = {"Dashboard": ("Records", "TotalAmount"), "Flag_Rate": ("Records", "TotalAmount"), "Reconciliation": ("Docs", "Declared")}

    def seen(run: str) -> list[DataFrame]:
        return [store.read(n, schemas[n]).agg(F.lit(run).alias("run"), F.lit(n).alias("sheet"), F.count("*").alias("n"), F.sum(a).alias("records"), F.round(F.sum(F.round(b, 2)) / 1000, 0).alias("thousands")) for n, (a, b) in sums.items()]

    publish_run(store, _sheets(ledger.where("ReturnType <> '5'"), recon, False))
    out = seen("first")
    try:
        publish_run(store, _sheets(ledger, recon, True))
    except Exception as e:  # what the executors said
        if "the disk is full" not in str(e):
            raise
    out += seen("after the failure")
    publish_run(store, _sheets(ledger, recon, False))
    return L.union_all(out + seen("second")).select("run", "sheet", "n", "records", "thousands")


def _memo() -> Handler:
    """A form that the rule set doesn't know: its number is its length, and short ones are flagged."""
    return Handler(
        "MEMO", lambda t: F.when(t.contains("$$$") & ~t.contains("GSTR"), 100).otherwise(0),
        lambda text: {"EntityID": F.regexp_extract(text, r"(\w+)", 1), "PrimaryAmount": F.char_length(text).cast("double"), "DocKind": F.lit("Note"), "words": F.size(F.split(text, " "))},
        lambda v: [(v["PrimaryAmount"] < 400, "SHORT?"), (v["words"] > 200, "LONG?")],
    )


def _returns() -> Handler:
    return Handler("GSTR1", lambda t: F.when(t.contains("GSTR-1"), 90).otherwise(0), lambda text: {"DocKind": F.lit("Return"), "PrimaryAmount": F.lit(1.0)})


def _broken() -> Handler:
    """A handler that fails on an executor, on every text that it gets."""
    return Handler("PF", lambda t: F.when(t.contains("PROVIDENT FUND ORGANISATION"), 95).when(t.contains("COMBINED CHALLAN"), 95).otherwise(0), lambda text: {"PrimaryAmount": F.raise_error(F.concat(F.lit("no amount in "), F.substring(text, 1, 0))).cast("double")})


def _unplannable() -> Handler:
    return Handler("EWB", lambda t: F.when(t.contains("E-WAY BILL NO"), 100).otherwise(0), lambda text: {"PrimaryAmount": F.col("no such column")})


@query(f"""
with d as (select doc_id, text, upper(text) as t from ({Q._PLANT_SQL})),
s as (select *, case when contains(t, 'GSTR-1') then 90 else 0 end as gst, case when contains(t, 'PROVIDENT FUND ORGANISATION') or contains(t, 'COMBINED CHALLAN') then 95 else 0 end as pf,
  case when contains(t, 'E-WAY BILL NO') then 100 else 0 end as ewb, case when contains(t, '$$$') and not contains(t, 'GSTR') then 100 else 0 end as memo from d),
b as (select *, list_sort([gst, pf, ewb, memo], 'DESC') as v from s),
h as (select *, case when v[1] < 70 or v[1] - v[2] < 15 then null when gst = v[1] then 'GSTR1' when pf = v[1] then 'PF' when ewb = v[1] then 'EWB' else 'MEMO' end as handler from b)
select doc_id, handler as ReturnType, case handler when 'MEMO' then length(text)::double when 'GSTR1' then 1.0 end as PrimaryAmount,
  case when handler = 'MEMO' then concat_ws('; ', case when length(text) < 400 then 'SHORT?' end, case when len(string_split(text, ' ')) > 200 then 'LONG?' end) when handler = 'GSTR1' then '' end as Flags,
  case when handler is null and v[1] > 0 then 'AmbiguousType' when handler is null then 'UnknownType' when handler in ('PF', 'EWB') then 'ParserError' end as Error_Type
from h""")
def handlers_at_run_time(spark, sf_dir):
    """Documents by handlers that were added at run time; one of them can't be planned and another fails as it runs."""
    registry = Registry([_returns(), _broken(), _unplannable()])
    registry.register(_memo())
    docs = Q.planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), "text")
    rows, errors = registry.materialised(docs, staged(spark, "handlers"))
    rows = rows.select(F.col("SourceFile").cast("long").alias("doc_id"), "ReturnType", "PrimaryAmount", "Flags")
    handler = F.when(F.col("Error_Type") == "ParserError", F.when(F.col("Message").contains("no amount in"), "PF").otherwise("EWB"))
    errors = errors.select(F.col("File").cast("long").alias("doc_id"), handler.alias("ReturnType"), "Error_Type")
    return L.union_all([rows, errors]).select("doc_id", "ReturnType", "PrimaryAmount", "Flags", "Error_Type")


@query(f"""with all_ as ({ORACLES['gst_checks'].replace('> 1 ', '> 5000 ').replace('<= 250000', '<= 2500000').replace(', 250000,', ', 2500000,').replace("where abs(round(lv - tv, 2)) > 1", "where abs(round(lv - tv, 2)) > 5000")})
select * from all_ where "Check" like 'Total_Liability%' and abs(Variance) > 5000 or "Check" = 'B2CL_Threshold'""")
def gst_checks_configured(spark, sf_dir):
    """The checks of the outward return as a relation of settings has them: two of six on, with other thresholds."""
    config = spark.createDataFrame([("variance_tolerance", "5000"), ("b2cl_invoice_threshold", " 2500000 "), ("checks_enabled", "Total_Liability"), ("checks_enabled", "B2CL_Threshold")], "Setting string, Value string")
    s = S.settings(config)
    return gst.gstr1_checks(Q.section_rows(spark, sf_dir), "l_suppkey", s.tolerances, s.enabled)
