"""Quality rules with adaptive thresholds from mergeable quantile sketches; DataFrame functions only.

Each text gets counts (words, symbols, repeated lines, words in repeated 5-word windows) and three rates. A sketch is a
histogram over integer buckets of bounded relative width (six leading bits, so at most 1/32 off): it is kept as rows
(lang, source, metric, bucket, n), made by a grouping with map-side combine, and two sketches merge by adding n. Sketches of
small sources are replaced by the sum over their language, and small languages by the sum over everything. A document is
rejected by the fixed base rules, or if a rate lies beyond the far fence `Q3 + reach * max(IQR, floor)` of its group.

Unlike sketches with random compaction, the same rows always give the same thresholds, also when a lost task runs again.

Defined results: a null text counts as empty (no words, so it fails the base rules); null lang or source is a group of its own;
repeated rows are judged alike, each row by itself; an empty table gives an empty result; extra columns stay untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Rates, in thousandths, and the least width that counts as spread.
METRICS = {"word_length": 500, "symbol_rate": 20, "dup_line_rate": 150}


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    reach: int = 3
    min_rows: int = 50


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by a window of five that occurs twice or more in the array, the first occurrence included.

    Windows are hashed, sorted by their upper 33 bits with the place in the lower 31, and only neighbours that agree there
    are compared by all 64 bits: n log n on plain numbers for texts of any length."""
    low = (1 << 31) - 1

    def by_hashes(hashes: Column) -> Column:
        def window(i: Column) -> Column:
            return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

        def twins(keys: Column) -> Column:
            near = lambda k, j: F.shiftright(k, 31).eqNullSafe(F.shiftright(F.get(keys, j), 31))
            return F.filter(keys, lambda k, i: near(k, i - 1) | near(k, i + 1))

        def places(pairs: Column) -> Column:
            same = lambda p, j: p["h"].eqNullSafe(F.get(pairs, j)["h"])
            return F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["i"]))

        def covered(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda total, n: total + n,
            )

        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        keys = F.sort_array(F.transform(starts, lambda i: window(i).bitwiseAND(~low).bitwiseOR(i.cast("long"))))
        place = lambda k: k.bitwiseAND(low).cast("int")
        pairs = let(keys, lambda ks: F.sort_array(F.transform(twins(ks), lambda k: F.struct(window(place(k)).alias("h"), place(k).alias("i")))))
        return let(let(pairs, places), covered)

    found = let(F.transform(words, lambda w: F.xxhash64(w)), by_hashes)
    return F.when(F.size(words) >= WINDOW + 1, found).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as a struct `row`, with counts and rates of each text."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(value, SPACES), lambda w: w != "")
    chars = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    by_words = let(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), chars(ws).alias("word_chars"), repeated_words(ws).alias("n_repeat_words")))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("kinds")))
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), by_words.alias("w"), by_lines.alias("l"),
        F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rate = lambda part, whole: F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")
    n_dup = F.col("l.n") - F.col("l.kinds")
    return counted.select(
        "row", F.col("w.n_words").alias("n_words"), F.col("w.word_chars").alias("word_chars"), "n_symbols", n_dup.alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        rate(F.col("w.word_chars"), F.col("w.n_words")).alias("word_length"),
        rate(F.col("n_symbols"), F.col("w.word_chars")).alias("symbol_rate"), rate(n_dup, F.col("l.n")).alias("dup_line_rate"),
    )


def bucket(value: Column) -> Column:
    """The sketch's bucket: values below 64 as they are, others by bit length and six leading bits."""
    bits = F.length(F.bin(value))
    return F.when(value < 64, value).otherwise(bits * 64 + F.floor(value / F.pow(F.lit(2.0), bits - 6)) - 32).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    bits = F.floor(b / 64)
    return F.when(b < 64, b).otherwise((b % 64 + 33) * F.pow(F.lit(2.0), bits - 6) - 1).cast("long")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketch of each metric of each source."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return (
        measured.where("n_words > 0").select(F.col(f"row.`{lang}`").alias("lang"), F.col(f"row.`{source}`").alias("source"), F.explode(values).alias("v"))
        .groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket(F.col("v.value")).alias("bucket")).agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and the first and third quartile of each group of a merged sketch."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    per_group = merged.groupBy(*keys, "metric").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bins"))

    def at(quarter: int) -> Column:
        def step(state: Column, b: Column) -> Column:
            found = F.when(state["found"].isNull() & ((state["seen"] + b["n"]) * 4 >= F.col("rows") * quarter), b["bucket"]).otherwise(state["found"])
            return F.struct((state["seen"] + b["n"]).alias("seen"), found.alias("found"))

        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))
        return bucket_top(F.aggregate("bins", start, step)["found"])

    return per_group.select(*keys, "metric", "rows", at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row per (lang, source) with a lower and an upper fence for each metric."""
    groups = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("lang_2"), F.col("metric").alias("metric_2"), F.struct("rows", "q1", "q3").alias("of_lang"))
    total = quantiles(sketch, []).select(F.col("metric").alias("metric_3"), F.struct("rows", "q1", "q3").alias("of_all"))
    joined = (
        groups.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_2")) & (F.col("metric") == F.col("metric_2")))
        .join(total, F.col("metric") == F.col("metric_3"))
    )
    own = F.struct("rows", "q1", "q3")
    used = F.when(F.col("rows") >= rules.min_rows, own).when(F.col("of_lang.rows") >= rules.min_rows, F.col("of_lang")).otherwise(F.col("of_all"))
    least = F.create_map(*[x for m, width in METRICS.items() for x in (F.lit(m), F.lit(width))])[F.col("metric")]
    reach = rules.reach * F.greatest(F.col("used.q3") - F.col("used.q1"), least)
    fences = joined.select("lang", "source", "metric", used.alias("used")).select(
        "lang", "source", "metric", (F.col("used.q1") - reach).alias("low"), (F.col("used.q3") + reach).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return fences.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[of(m, c) for m in METRICS for c in ("low", "high")])


def judged(measured: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """measured (a stored table: it is read twice) with base_failed and kept."""
    fences = thresholds(sketches(measured, lang, source), rules)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.col(m).between(F.coalesce(F.col(f"{m}_low"), F.col(m)), F.coalesce(F.col(f"{m}_high"), F.col(m)))
    both = measured.join(fences, F.col(f"row.`{lang}`").eqNullSafe(F.col("t_lang")) & F.col(f"row.`{source}`").eqNullSafe(F.col("t_source")), "left")
    return both.select(*measured.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Each row of docs (struct `row`) with its counts, rates, base_failed and kept."""
    return judged(stored(measure(docs, text), "measured"), rules, lang, source)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return judge(docs, rules).where("kept").select("row.*")


def counts_only(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The judgement without texts: what is stored between the two passes is small."""
    measured = measure(docs.select("doc_id", "lang", "source", "text"))
    slim = measured.withColumn("row", F.struct("row.doc_id", "row.lang", "row.source"))
    return judged(stored(slim, "measured"), rules)
