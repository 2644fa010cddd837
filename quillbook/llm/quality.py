"""Quality rules with a verdict by distribution divergence. DataFrame expressions only; texts are never shuffled.

A document's character classes and its common words are two histograms. Each is compared with the mean histogram of every
language that labelled documents teach, as far as they are in the document's script, by Jensen-Shannon distance (base 2, so
0 to 1), and the nearest reference counts. Classes are Unicode's, so they mean the same in all scripts with letter case.
Each language's common words are learned too, from all its documents. Short texts are too noisy for all
that, and of a script that no reference has nothing is known: there the verdict is left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbook.llm.common import SPACE, cut, table

#: The SQL learns common words from about so many documents of each language, taken by a hash of the text; the query from all.
LEARN_ROWS = 2000
#: Common words of each language. What is counted a document grows with the number of languages.
COMMON = 12
#: Character classes besides white space, as Java and RE2 both write them; what is in none of them is the last class.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "caseless": r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "digit": r"\p{Nd}+", "symbol": "[#*$%&|<>]+", "stop": r"\p{P}+"}
#: Scripts by their names in Unicode; letters of all others are one more.
SCRIPTS = {"latin": ["Latin"], "cyrillic": ["Cyrillic"], "greek": ["Greek"], "eastern": ["Han", "Hiragana", "Katakana", "Hangul"], "arabic": ["Arabic"]}
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.3
#: In shares of the distance that a text without any common word has from the nearest reference: the bound for n words is
#: the first plus the second by the root of n, as the share of a short text scatters more.
MAX_WORD_SHARE, WORD_SCATTER = 0.55, 3.0
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "script", "common"]


def learned_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[str]:
    """The words that are in the most documents of each language, COMMON of each, ties in alphabetical order, all in one
    sorted list. Learned from all its documents of MIN_WORDS words and more."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    known = known.select("l", F.array_remove(F.split(F.lower("t"), SPACE), "").alias("w")).where(F.size("w") >= MIN_WORDS)
    counts = known.select("l", F.explode(F.array_distinct("w")).alias("w")).where(F.col("w").rlike(r"^\p{L}+$")).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    # a rank below the bound is found in each task first, so no language's words meet in one task; few rows reach the driver
    first = Window.partitionBy("l").orderBy(F.desc("n"), "w")
    best = counts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= COMMON)
    return sorted({r.w for r in best.select("w").distinct().collect()})


def counted(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """Adds the base counts, both histograms and the script. A null text has no words. Existing columns of these names give
    way."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    kept, t = docs.columns, F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({"text 0": t, "words 0": F.array_remove(F.split(t, SPACE), ""), "left 0": F.regexp_replace(t, SPACE, "")})
    words = F.col("words 0")
    gram = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    lines = F.filter(F.split(F.col("text 0"), "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length("left 0").cast("long"),
        "lines 0": F.when(F.instr("text 0", "\n") > 0, lines),
        "hashes 0": F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(gram(w, i).alias("h"), i.alias("i"))),
        "low 0": F.array_join(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(vocabulary)), "  ") if vocabulary else F.lit(""),
    })
    # what each class leaves is the next one's text, so most of it is looked at once
    last, classes = "left 0", []
    for k, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"left {k + 1}", F.regexp_replace(last, pattern, ""))
        classes.append((F.char_length(last) - F.char_length(f"left {k + 1}")).cast("long"))
        last = f"left {k + 1}"
    df = df.withColumns({"letters 0": F.regexp_replace("left 0", r"\P{L}+", ""), "classes": F.array(*classes, F.char_length(last).cast("long"))})
    last, scripts = "letters 0", []
    for name, parts in SCRIPTS.items():
        df = df.withColumn(f"{name} 0", F.regexp_replace(last, "[" + "".join(rf"\p{{Is{p}}}" for p in parts) + "]+", ""))
        scripts.append(F.struct((F.char_length(last) - F.char_length(f"{name} 0")).alias("n"), F.lit(name).alias("s")))
        last = f"{name} 0"
    scripts.append(F.struct(F.char_length(last).alias("n"), F.lit("other").alias("s")))
    low, padded = F.col("low 0"), F.concat(F.lit(" "), F.col("low 0"), F.lit(" "))
    found = [((F.char_length("padded 0") - F.char_length(F.replace(F.col("padded 0"), F.lit(f" {v} "), F.lit("")))) / (len(v) + 2)).cast("long") for v in vocabulary]
    grams = F.col("hashes 0")
    some = F.size(F.array_distinct(F.transform(grams, lambda x: x["h"]))) < F.size(grams)
    df = df.withColumns({
        "script": F.when(F.char_length("letters 0") > 0, F.greatest(*scripts)["s"]),
        "padded 0": F.when(low == "", "").otherwise(padded),
        # only texts that repeat a window need them in order
        "grams 0": F.when(some, F.sort_array(grams)).otherwise(F.slice(grams, 1, 0)),
        "n_symbols": F.element_at("classes", list(CLASSES).index("symbol") + 1),
        "n_dup_lines": F.when(F.col("lines 0").isNull(), 0).otherwise(F.size("lines 0") - F.size(F.array_distinct("lines 0"))).cast("long"),
    })
    df = df.withColumn("common 0", F.array(*found) if vocabulary else F.expr("cast(array() as array<bigint>)"))
    g = F.col("grams 0")
    twin = lambda x, i: (x["h"] == F.get(g, i - 1)["h"]) | (x["h"] == F.get(g, i + 1)["h"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    df = df.withColumns({
        "places 0": F.sort_array(F.transform(F.filter(g, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"])),
        "common": F.concat("common 0", F.array(F.col("n_words") - total(F.col("common 0")))),
    })
    p = F.col("places 0")
    # each repeated window covers its three words, or as many as lie before the next such window
    df = df.withColumn("n_repeat_words", total(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.select(*kept, *NEW)


def shares(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(histogram, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def references(counts: DataFrame, n_common: int, lang: str = "lang") -> list[tuple[str, list[float], list[float]]]:
    """Script and mean histograms of the documents that pass the base rules, over all of them, by language and script; one
    row each reaches the driver."""
    sizes = {"classes": len(CLASSES) + 1, "common": n_common}
    df = counts.where(~F.col("base_failed") & F.col(lang).isNotNull() & F.col("script").isNotNull()).select(F.col(lang).alias("lang"), "script", *[shares(F.col(k)).alias(k) for k in sizes])
    means = df.groupBy("lang", "script").agg(*[F.avg(F.col(k)[i]).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)])
    return [(r["script"], *([r[f"{k}{i}"] for i in range(n)] for k, n in sizes.items())) for r in means.orderBy("lang", "script").collect()]


def divergence(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares to fixed shares, in base 2."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, F.array(*map(F.lit, q)), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def _least(found: list[Column]) -> Column:
    """The least of what isn't null."""
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")


def judge(counts: DataFrame, refs: list[tuple[str, list[float], list[float]]], n_common: int) -> DataFrame:
    """Adds char_distance and word_share (to the nearest reference of the document's script; null without any) and kept."""
    nothing = [0.0] * (n_common - 1) + [1.0]
    mine = lambda script, c: F.when(F.col("script") == script, c)
    df = counts.withColumns({"p 0": shares(F.col("classes")), "q 0": shares(F.col("common"))})
    bare = F.array(*map(F.lit, nothing))
    df = df.withColumns({
        "char_distance": _least([mine(s, divergence(F.col("p 0"), p)) for s, p, _ in refs]),
        "word_share": _least([mine(s, F.try_divide(divergence(F.col("q 0"), q), divergence(bare, q))) for s, _, q in refs]),
    }).drop("p 0", "q 0")
    odd = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_share") > MAX_WORD_SHARE + WORD_SCATTER / F.sqrt("n_words"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd)


def assess(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without its text, with counts, distances and verdict. The counts are written once and read twice.

    A null or empty text fails the base rules; texts are read whole, however long. Rows with a null lang are judged but
    teach nothing; repeated rows are judged alike; where nothing can be learned, as in an empty table, the base rules
    decide. Columns of docs called as the new ones give way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("char_distance", "word_share", "kept")])
    words = learned_words(docs, text, lang)
    counts = cut(counted(docs, words, text).drop(text), "quality")
    return judge(counts, references(counts, len(words) + 1, lang), len(words) + 1)


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"'[^\x20\x09-\x0D]+'"


def _strips(first: str, name: str, patterns: list[str]) -> str:
    """select lists that take each pattern out of what the last one left."""
    out = first
    for k, pattern in enumerate(patterns):
        out = f"(select *, regexp_replace({name}{k}, '{pattern}', '', 'g') as {name}{k + 1} from {out})"
    return out


def _distance(p: str, q: str) -> str:
    term = lambda x: f"case when z[{x}] > 0 then z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) else 0 end"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term(1)} + {term(2)})) / 2))"


_SCRIPT_PARTS = ["[" + "".join(rf"\p{{{x}}}" for x in parts) + "]+" for parts in SCRIPTS.values()]
_COUNTS = ", ".join(f"length(c{k}) - length(c{k + 1})" for k in range(len(CLASSES)))
_SCRIPT = ", ".join(f"{{'n': length(s{k}) - length(s{k + 1}), 's': '{name}'}}" for k, name in enumerate(SCRIPTS))
OP2_SQL = rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
win as (select doc_id, i, w[i : i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cover as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
lines as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
          where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
known as (select lang, text from documents where text is not null and lang is not null),
sizes as (select lang, count(*) as n from known group by 1),
taken as (select lang, list_distinct(regexp_extract_all(lower(text), {_WORDS})) as w from known join sizes using (lang)
          where ('0x' || substr(md5(text), 1, 8))::bigint < 4294967296.0::double * {LEARN_ROWS} / n and len(regexp_extract_all(text, {_WORDS})) >= {MIN_WORDS}),
often as (select lang, x, count(*) as n from (select lang, unnest(w) as x from taken) where regexp_matches(x, '^\p{{L}}+$') group by all),
vocabulary as (select coalesce(list(distinct x order by x), []) as v from (select lang, x from often qualify row_number() over (partition by lang order by n desc, x) <= {COMMON})),
shape as (select doc_id, length(c0) as word_chars, length(c4) - length(c5) as n_symbols, [{_COUNTS}, length(c{len(CLASSES)})] as c,
    case when length(s0) > 0 then list_sort([{_SCRIPT}, {{'n': length(s{len(SCRIPTS)}), 's': 'other'}}], 'DESC')[1].s end as script
  from {_strips(_strips(r"(select doc_id, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') as c0, regexp_replace(t, '[^\p{L}]+', '', 'g') as s0 from d)", "c", list(CLASSES.values())), "s", _SCRIPT_PARTS)}),
f as (
  select d.doc_id, lang, script, c, len(w)::bigint as n_words, word_chars, n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words,
    list_transform(v, lambda y: len(list_filter(w, lambda x: lower(x) = y))) as v0
  from d join shape using (doc_id) left join lines using (doc_id) left join cover using (doc_id), vocabulary),
h as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, list_append(v0, n_words - coalesce(list_sum(v0), 0)) as v1 from f),
p as (
  select *, list_transform(c, lambda x: case when word_chars > 0 then x / word_chars::double else 0 end) as p, list_transform(v1, lambda x: case when n_words > 0 then x / n_words::double else 0 end) as q,
    list_transform(range(len(v1)), lambda i: case when i = len(v1) - 1 then 1.0::double else 0 end) as bare from h),
long as (select lang, script, 'p' as k, unnest(p) as x, unnest(range(1, len(p) + 1)) as i from p where not base_failed and lang is not null and script is not null
  union all select lang, script, 'q', unnest(q), unnest(range(1, len(q) + 1)) from p where not base_failed and lang is not null and script is not null),
ref as (select lang, script, list(m order by i) filter (k = 'p') as rp, list(m order by i) filter (k = 'q') as rq
  from (select lang, script, k, i, avg(x) as m from long group by all) group by lang, script),
dist as (
  select doc_id, min({_distance('p', 'rp')}) as c, min({_distance('q', 'rq')} / nullif({_distance('bare', 'rq')}, 0)) as v
  from p join ref on p.script = ref.script group by doc_id)
select doc_id, n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(dist.c > {MAX_CHAR_DISTANCE}, false) and not coalesce(dist.v > {MAX_WORD_SHARE} + {WORD_SCATTER} / sqrt(n_words), false) as kept
from p left join dist using (doc_id)
"""
