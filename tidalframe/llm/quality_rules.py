"""Operator 1: quality rules whose thresholds come from the data, per language and source.

Only DataFrame functions run here. Each text is measured once; the measures are kept
in a written table. Rates per thousand words go into a mergeable quantile sketch per
(language, source): a histogram whose bin widths double with every power of two (a value
is off by at most 1/512). So does what one occurrence adds to a text's rate, its step,
which is wide in short texts. Sketches merge by adding counts, so the sketch of a language
and of everything are sums of the finer ones, and a group with too few documents to trust
is judged by the next wider one. A rate may reach the fence, median + k * spread of its
group: the spread is the upper quartile's distance from the median, or the upper quartile
of the group's steps if that is more (the median as the last value of its bin, so that a
rate all documents share is within it). Median, spread and steps are the group's own: no
rate has a fixed cutoff, nor is it measured in bins. Measures and fences are then joined
and the rules applied.

Nulls and edges: a null or blank text has no words and fails the base rule; null
languages or sources form groups of their own; repeated rows are judged one by one, and
equal rates get equal verdicts; an empty table gives one; a very long text is measured whole, in
one row. A column of docs that has the
name of a struct made here makes that name take an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import fresh, written

_SPACES = " \t\n\x0b\x0c\r"
#: rate per thousand words -> (measure that it is taken from, spreads from the median to the fence)
RATES = {"symbol_rate": ("n_symbols", 8), "dup_line_rate": ("n_dup_lines", 8), "char_rate": ("word_chars", 8)}
#: A text's step, per million words, so that it has digits.
STEP = "step"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: str, n: str, width: int) -> Column:
    """Words that lie in a window of `width` words that the text has twice or more.

    Windows are compared by a 64-bit hash of their words. Only a text with some
    repeated window pays for finding where: (hash, place) pairs are sorted, those
    next to an equal hash are kept, and their places, in order, cover words.
    """
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    hashes = f"transform(sequence(0, {n} - {width}), i -> xxhash64({parts}))"
    order = f"array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    repeated = "filter(s, (e, j) -> (j > 0 and s[j - 1].x = e.x) or (j < size(s) - 1 and s[j + 1].x = e.x))"
    places = f"array_sort(transform({repeated}, e -> e.i))"
    covered = f"aggregate(p, struct(0 as total, -{width} as last), (a, i) -> struct(a.total + least({width}, i - a.last) as total, i as last)).total"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    found = let("s", order, let("p", places, covered))
    counted = let("h", hashes, f"case when size(array_distinct(h)) = size(h) then 0 else {found} end")
    return F.expr(f"cast(case when {n} < {width} then 0 else {counted} end as long)")


def measured(docs: DataFrame, text_column: str = "text", window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) in a struct `rule_measures`."""
    words, lines, n, out = (fresh(docs, x) for x in ("words", "lines", "n_words_", "rule_measures"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    return (
        docs.withColumn(words, _words(text))
        .withColumn(n, F.size(words))
        .withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0))
        .withColumn(
            out,
            F.struct(
                F.col(n).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words, n, window).alias("n_repeat_words"),
            ),
        )
        .drop(words, lines, n)
    )


#: Numbers below 2**_DIGITS have a bin each; every power of two from there on has half as many bins.
_DIGITS = 10


def _bin(x: Column) -> Column:
    """The sketch's bin."""
    shift = F.greatest(F.length(F.bin(x)) - _DIGITS, F.lit(0))
    return (shift * (1 << _DIGITS) + F.floor(x / F.pow(F.lit(2.0), shift))).cast("long")


def _bin_floor(b: Column) -> Column:
    shift = F.floor(b / (1 << _DIGITS))
    return ((b % (1 << _DIGITS)) * F.pow(F.lit(2.0), shift)).cast("long")


def _bin_last(b: Column) -> Column:
    """The largest value of a bin."""
    return ((b % (1 << _DIGITS) + 1) * F.pow(F.lit(2.0), F.floor(b / (1 << _DIGITS))) - 1).cast("long")


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, symbol_rate, ..., step) -> (lang, source, measure, bin, n): one mergeable sketch per group
    and measure. A null step, of a text without words, isn't counted."""
    long = rates.select(
        "lang", "source", F.explode(F.create_map(*[y for r in (*RATES, STEP) for y in (F.lit(r), _bin(F.col(r)))])).alias("measure", "bin")
    )
    return long.where("bin is not null").groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str], spreads: dict[str, float] | None = None, upper: float = 0.75) -> DataFrame:
    """Merge sketches over what is not in `by` and read each measure's fence off the merged ones."""
    spreads = spreads or {r: k for r, (_, k) in RATES.items()}
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    # a sketch has a bounded number of bins: sorted in one array per group, then walked
    grouped = merged.groupBy(*by, "measure").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))
    at = lambda q: F.expr(
        f"aggregate(bins, struct(cast(0 as long) as seen, cast(null as long) as bin), (a, e) -> "
        f"struct(a.seen + e.n as seen, case when a.bin is null and a.seen + e.n >= {q} * rows then e.bin else a.bin end as bin)).bin"
    )
    read = grouped.select(*by, "measure", "rows", _bin_floor(at(0.5)).alias("middle"), _bin_floor(at(upper)).alias("high"), _bin_last(at(0.5)).alias("top"))
    of = lambda r, x: F.max(F.when(F.col("measure") == r, F.col(x)))
    step = of(STEP, "high") / 1000
    fence = lambda r, k: of(r, "top") + F.lit(float(k)) * F.greatest((of(r, "high") - of(r, "middle")).cast("double"), step)
    return read.groupBy(*by).agg(F.max("rows").alias("rows"), *[fence(r, spreads[r]).alias(r) for r in RATES])


def judged(measures: DataFrame, struct: str = "rule_measures", min_rows: int = 50) -> DataFrame:
    """measured rows -> the same with a struct column rule_verdict: base_failed, kept and a fence for each rate.

    Needs lang, source and the struct of measured(); other columns go along. min_rows: a
    (language, source) with fewer documents is judged by its language's sketch, a
    language with fewer by the sketch of all. The fences are written before the join,
    so the planner broadcasts them only if their true size is small.
    """
    rates = fresh(measures, "rule_rates")
    rate = lambda x: F.when(F.col(f"{struct}.n_words") > 0, F.floor(F.col(f"{struct}.{x}") * 1000 / F.col(f"{struct}.n_words"))).otherwise(0).cast("long")
    step = F.when(F.col(f"{struct}.n_words") > 0, F.floor(1_000_000 / F.col(f"{struct}.n_words"))).cast("long")
    docs = written(measures.withColumn(rates, F.struct(*[rate(x).alias(r) for r, (x, _) in RATES.items()], step.alias(STEP))), "measures")
    sketch = written(sketches(docs.select("lang", "source", f"{rates}.*")), "sketches")
    fine = fences(sketch, ["lang", "source"]).select("lang", "source", F.struct("rows", *RATES).alias("fine"))
    wide = fences(sketch, ["lang"]).select(F.col("lang").alias("wide_lang"), F.struct("rows", *RATES).alias("wide"))
    whole = fences(sketch.withColumn("all", F.lit(1)), ["all"]).select(F.struct(*RATES).alias("whole"))  # one row
    chosen = lambda r: F.when(F.col("fine.rows") >= min_rows, F.col(f"fine.{r}")).when(F.col("wide.rows") >= min_rows, F.col(f"wide.{r}")).otherwise(F.col(f"whole.{r}"))
    table = written(
        fine.join(wide, F.col("lang").eqNullSafe(F.col("wide_lang")))
        .join(F.broadcast(whole))
        .select(F.struct("lang", "source").alias("of"), F.struct(*[chosen(r).alias(f"fence_{r}") for r in RATES]).alias("fence")),
        "fences",
    )
    base = (F.col(f"{struct}.n_words") < 10) | (100 * F.col(f"{struct}.n_repeat_words") > 20 * F.col(f"{struct}.n_words"))
    kept = ~base
    for r in RATES:
        kept &= F.col(f"{rates}.{r}") <= table[f"fence.fence_{r}"]
    verdict = F.struct(base.alias("base_failed"), kept.alias("kept"), *[table[f"fence.fence_{r}"] for r in RATES])
    same = docs["lang"].eqNullSafe(table["of.lang"]) & docs["source"].eqNullSafe(table["of.source"])
    return docs.join(table, same, "left").select(docs["*"], verdict.alias(fresh(docs, "rule_verdict"))).drop(rates)


def kept_only(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    struct, verdict = fresh(docs, "rule_measures"), fresh(docs, "rule_verdict")
    return judged(measured(docs), struct).where(F.col(f"{verdict}.kept")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(measured(docs).drop("text")).select("doc_id", "rule_measures.*", "rule_verdict.*")


SQL = r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, string_split(t, chr(10)) as lines, t from d),
grams as (select r, i, array_to_string(words[i:i+4], ' ') as g from (select r, words, unnest(range(1, len(words) - 3)) as i from w)),
twice as (select r, i, lag(i) over (partition by r order by i) as before
          from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
rep as (select r, sum(least(5, i - coalesce(before, -5)))::bigint as n from twice group by r),
m as (select d.r, doc_id, lang, source, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words
      from d join (select r, words, lines from w) using (r) left join rep using (r)),
f as (select *, case when n_words > 0 then n_symbols * 1000 // n_words else 0 end as a, case when n_words > 0 then n_dup_lines * 1000 // n_words else 0 end as b,
        case when n_words > 0 then word_chars * 1000 // n_words else 0 end as c, case when n_words > 0 then 1000000 // n_words end as u from m),
long as (select lang, source, measure, greatest(length(bin(x)) - 10, 0) as s, x from
        (select lang, source, unnest(['symbol_rate', 'dup_line_rate', 'char_rate', 'step']) as measure, unnest([a, b, c, u]) as x from f) where x is not null),
sk as (select lang, source, measure, s * 1024 + (x >> s) as bin, count(*) as n from long group by all),
merged as (select 1 as k, lang, source, measure, bin, n from sk
     union all select 2, lang, null, measure, bin, sum(n) from sk group by lang, measure, bin
     union all select 3, null, null, measure, bin, sum(n) from sk group by measure, bin),
run as (select *, sum(n) over (partition by k, lang, source, measure order by bin) as seen, sum(n) over (partition by k, lang, source, measure) as rows from merged),
q as (select k, lang, source, measure, max(rows)::bigint as rows, min(bin) filter (where seen >= 0.5 * rows) as q50, min(bin) filter (where seen >= 0.75 * rows) as q75 from run group by all),
fl as (select k, lang, source, measure, rows, (q50 % 1024) << (q50 // 1024)::int as m, ((q50 % 1024 + 1) << (q50 // 1024)::int) - 1 as top, (q75 % 1024) << (q75 // 1024)::int as h from q),
st as (select k, lang, source, h / 1000 as step from fl where measure = 'step'),
fe as (select fl.k, fl.lang, fl.source, measure, rows, (top + 8.0::double * greatest((h - m)::double, step))::double as fence from fl
     left join st on fl.k = st.k and fl.lang is not distinct from st.lang and fl.source is not distinct from st.source where measure <> 'step'),
pick as (select a.lang, a.source, a.measure, case when a.rows >= 50 then a.fence when b.rows >= 50 then b.fence else c.fence end as fence
     from fe a join fe b on a.k = 1 and b.k = 2 and a.lang is not distinct from b.lang and a.measure = b.measure join fe c on c.k = 3 and c.measure = a.measure),
fences as (select lang, source, max(fence) filter (where measure = 'symbol_rate') as fence_symbol_rate, max(fence) filter (where measure = 'dup_line_rate') as fence_dup_line_rate,
     max(fence) filter (where measure = 'char_rate') as fence_char_rate from pick group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and a <= fence_symbol_rate and b <= fence_dup_line_rate and c <= fence_char_rate as kept,
  fence_symbol_rate, fence_dup_line_rate, fence_char_rate
from f join fences on f.lang is not distinct from fences.lang and f.source is not distinct from fences.source
"""
