"""Secret scan with multipart credential linking. DataFrame expressions only.

Three kinds of match stand by themselves (assign, access, hex). Three more are weak: a login, an opaque token and an
endpoint say little alone, so they are reported only where complementary parts of a credential lie in the same scope.
Scopes are intervals of SCOPE code points around a weak match, from start to start, and a part counts only if it has no
character in common with the match: the same characters can't be both halves. The interval join is one sorted pass over a
document's spans to either side: the nearest identifier and the nearest secret that end before a match, or begin after
it, decide exactly whether one is in reach.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbook.llm.common import cut, fresh, table

SCOPE = 200
#: kind: (pattern, group that must be long enough, its least length), in the order in which equal starts are listed.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "login": (r"""(?i)(?<![A-Za-z0-9])(client_?id|user_?name|user|login|account|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3),
    "opaque": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])", 0, 32),
    "endpoint": (r"""(?i)(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\x00-\x20"'<>]+""", 0, 1),
}
KINDS = [*BASE, *WEAK]
#: What part of a credential each kind is: an identifier, a secret or an endpoint.
PART = {"assign": "secret", "access": "id", "hex": "secret", "login": "id", "opaque": "secret", "endpoint": "endpoint"}
#: What has to be in reach of a weak match of that part.
NEEDS = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}
SPAN = "struct<start:bigint,rank:int,stop:bigint>"
NONE = f"cast(array() as array<{SPAN}>)"


def running(lengths: Column) -> Column:
    """Sums of all elements before each one, and of all. Summed in blocks of about the square root of the size, since
    appending to an array copies it."""
    zero = F.array(F.lit(0).cast("long"))
    fold = lambda a: F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / width).cast("int") - 1)), lambda b: fold(F.slice(lengths, b * width + 1, width)))
    return F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("sum"), F.array(zero).alias("parts")),
        lambda acc, b: F.struct((acc["sum"] + F.element_at(b, -1)).alias("sum"), F.concat(acc["parts"], F.array(F.transform(F.slice(b, 2, F.size(b)), lambda x: x + acc["sum"]))).alias("parts")),
        lambda acc: F.flatten(acc["parts"]),
    )


def with_spans(df: DataFrame, text: str, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds a column `kind`: sorted spans of the pattern's leftmost non-overlapping matches whose group is long enough.

    Matches and the gaps between them (what split leaves) alternate, so the starts are running sums of their lengths.
    """
    t, rank = F.col(text), KINDS.index(kind)
    df = df.withColumn("found 0", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    some = F.size("found 0") > 0
    judged = F.when(some, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))) if group else F.col("found 0")
    step = lambda g, m: F.struct(F.char_length(g).cast("long").alias("g"), F.coalesce(F.char_length(m), F.lit(0)).cast("long").alias("m"))
    steps = F.when(some, F.zip_with(F.split(t, pattern, -1), F.col("found 0"), step))
    df = df.withColumns({"judged 0": judged, "steps 0": steps})
    df = df.withColumn("sums 0", F.when(some, running(F.transform("steps 0", lambda s: s["g"] + s["m"]))))
    ok = F.filter(
        F.transform("found 0", lambda m, i: F.struct((F.get("sums 0", i) + F.get("steps 0", i)["g"]).alias("start"), F.lit(rank).alias("rank"), F.get("sums 0", i + 1).alias("stop"), F.char_length(F.get("judged 0", i)).alias("long"))),
        lambda s: s["long"] >= least,
    )
    spans = F.transform(ok, lambda s: F.struct(s["start"], s["rank"], s["stop"]))
    return df.withColumn(kind, F.when(some, spans).otherwise(F.expr(NONE))).drop("found 0", "judged 0", "steps 0", "sums 0")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked(found: DataFrame, key: list[str], weak: str, base: str) -> DataFrame:
    """key and `confirmed`: the weak spans in whose scope the complementary parts lie. Rows equal in key count once."""
    part = F.element_at(F.create_map(*[F.lit(x) for r, k in enumerate(KINDS) for x in (r, PART[k])]), F.col("s.rank"))
    rows = found.where(F.size(weak) > 0).where(F.size(weak) + F.size(base) > 1)
    rows = rows.select(*key, F.explode(F.concat(base, weak)).alias("s")).distinct().withColumn("part", part)
    start, stop = F.col("s.start"), F.col("s.stop")
    event = lambda side, at, asks: F.struct(F.lit(side).alias("side"), at.alias("at"), F.lit(asks).alias("asks"))
    # a part is met at its end on the way right and at its start on the way left, a match asks where it begins and ends
    events = F.array(event(1, stop, 0), event(-1, -start, 0))
    events = F.when(F.col("s.rank") < len(BASE), events).otherwise(F.concat(events, F.array(event(1, start, 1), event(-1, -stop, 1))))
    rows = rows.withColumn("e", F.explode(events)).select(*key, "s", "part", "e.*")
    before = Window.partitionBy(*key, "side").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.col("side") * start
    near = {p: F.max(F.when((F.col("asks") == 0) & (F.col("part") == p), here)).over(before) >= here - SCOPE for p in ("id", "secret")}
    met = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(f"near_{p}") for p, c in near.items()]).where("asks = 1")
    met = met.groupBy(*key, "s", "part").agg(*[F.max(f"near_{p}").alias(f"has_{p}") for p in ("id", "secret")])
    ok = F.lit(False)
    for p, needs in NEEDS.items():
        both = F.lit(True)
        for n in needs:
            both = both & F.col(f"has_{n}")
        ok = ok | ((F.col("part") == p) & both)
    return met.where(ok).groupBy(*key).agg(F.collect_set("s").alias("confirmed"))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without its text, with base (base spans) and spans (all spans): sorted arrays of (start, rank, stop) in code
    points, stop exclusive; rank is a place in KINDS. A null text is an empty one and has none; texts are scanned whole,
    however long, and an empty table gives an empty result. Columns named base or spans, or like one of the kinds, give way.
    Rows that share id and text, and rows whose id is null, are linked alike.
    """
    new = {*KINDS, "base", "spans", "weak", "confirmed"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    mark = fresh(docs, "text_md5_")
    whole = fresh(docs, "text_0")
    df = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    for kind, (pattern, group, least) in (BASE | WEAK).items():
        df = with_spans(df, whole, kind, pattern, group, least)
    token = lambda s: F.substring(F.col(whole), s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))
    mixed = F.filter("opaque", lambda s: token(s).rlike("[0-9]") & token(s).rlike("[A-Z]") & token(s).rlike("[a-z]"))
    df = df.withColumns({"base": F.sort_array(F.concat(*BASE)), "weak": F.sort_array(F.concat("login", F.when(F.size("opaque") > 0, mixed).otherwise(F.col("opaque")), "endpoint")), mark: F.md5(whole)})
    found = cut(df.select(*[c for c in docs.columns if c != text], mark, "base", "weak"), "secrets")
    key = [id_col, mark]  # no document meets another
    links = linked(found, key, "weak", "base")
    links = links.select(*[F.col(c).alias(f"{c}_of") for c in key], "confirmed")
    out = found.join(links, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in key], "left")
    spans = F.sort_array(F.concat(F.col("base"), F.coalesce(F.col("confirmed"), F.expr(NONE))))
    return out.withColumn("spans", spans).select(*[c for c in docs.columns if c != text], mark, "base", "spans")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover replaced."""
    piece = lambda start, stop: F.substring(text, start.cast("int") + 1, F.greatest(F.lit(0), (stop - start)).cast("int"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(by))).alias("out")))
    end = lambda acc: F.concat(acc["out"], piece(acc["at"], F.char_length(text).cast("long")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, end)).otherwise(text)


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _either_case(names: str) -> str:
    """Letters in both cases, spelled out: RE2's own folding reaches beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", names)


_SEPARATED = r"""["']?\x20*[:=]\x20*["']?"""
#: The kinds as RE2 writes them: pattern, and the group that must be long enough. The first group is what lies before the match:
#: it stands for the lookbehind. Opaque runs are taken with all signs that follow, and judged by what comes after.
_RE2 = {
    "assign": (f"()({_either_case('password|passwd|secret|token|api_?key')}){_SEPARATED}([A-Za-z0-9+/_.=-]+)", 3),
    "access": ("()AKIA[A-Z0-9]+", 0),
    "hex": ("()[0-9a-f]{24,}", 0),
    "login": (f"(^|[^A-Za-z0-9])({_either_case('client_?id|user_?name|user|login|account|access_key_id')}){_SEPARATED}([A-Za-z0-9@+/_.-]+)", 3),
    "opaque": ("()[A-Za-z0-9+/_-]{32,}=*", 0),
    "endpoint": (rf"""()({_either_case("https?|ftp|postgres(ql)?|mysql|redis|amqps?|mongodb")}|{_either_case("jdbc")}:[A-Za-z]+)://[^\x00-\x20"'<>]+""", 0),
}


def _matches(kind: str) -> str:
    pattern, group = _RE2[kind]
    quoted, least = "'" + pattern.replace("'", "''") + "'", (BASE | WEAK)[kind][2]
    found = f"unnest(regexp_extract_all(t, {quoted})) as m, unnest(regexp_extract_all(t, {quoted}, 1)) as before, unnest(regexp_extract_all(t, {quoted}, {group})) as j, unnest(regexp_split_to_array(t, {quoted})) as gap"
    places = f"select *, sum(length(gap) + length(m)) over (partition by r order by i) as stop from (select r, t, {found}, unnest(range(len(regexp_extract_all(t, {quoted})))) as i from d) where m is not null"
    alone = r" and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and not ends_with(m, '===') and not regexp_matches(substr(t, stop::bigint + 1, 1), '[A-Za-z0-9+/_-]')" if kind == "opaque" else ""
    return f"select r, {KINDS.index(kind)} as k, (stop - length(m) + length(before))::bigint as a, stop::bigint as b, '{PART[kind]}' as part from ({places}) where length(j) >= {least}{alone}"


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_BASE_RANKS, _ALL_SPANS = f"k < {len(BASE)}", "coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, k), '')"
OP4_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as materialized ({" union all ".join(_matches(k) for k in KINDS)}),
near as (
  select distinct w.r, w.k, w.a, w.part, x.part as other from found w join found x on w.r = x.r
  where w.k >= {len(BASE)} and abs(w.a - x.a) <= {SCOPE} and (x.b <= w.a or x.a >= w.b)),
linked as (
  select r, k, a from near group by r, k, a, part
  having case part {" ".join(f"when '{p}' then " + " and ".join(f"bool_or(other = '{n}')" for n in needs) for p, needs in NEEDS.items())} end),
spans as (
  select r, k, a, b, {_NAMES}[k + 1] as kind from found
  where {_BASE_RANKS} or exists (select 1 from linked l where l.r = found.r and l.k = found.k and l.a = found.a))
select doc_id, {", ".join(f"count(*) filter (k = {i}) as n_{k}" for i, k in enumerate(BASE))},
  sha256({_ALL_SPANS.replace(" order by a, k)", f" order by a, k) filter ({_BASE_RANKS})")}) as base_sha256, {_ALL_SPANS} as spans
from d left join spans using (r) group by r, doc_id
"""
