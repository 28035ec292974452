"""Quality rules with adaptive thresholds (operator 4, native expressions only).

Every document gets four counters. Three ratios and the mean word length are
put into log-linear integer sketches (64 unit buckets, then 32 buckets for each
power of two, at most 3 % relative error). Sketches are plain bucket counts, so
they merge by addition: one per language and source, one per language. A
document is rejected if a metric lies outside its fences, which come from the
quantiles of the documents that pass the base rule, without fixed cutoffs:
``q75 + REACH * (q75 - q50)``, but at least ``q95``, so that in a group whose
values are nearly all equal (no symbols, no repeated lines) a metric rejects the
last twentieth at most; word length has the mirror image below. A group's fence
is drawn to its language's as if the language added ``PRIOR`` documents, so small
groups follow the language and large ones themselves, without a switch.

Null text counts as empty, null language or source as the empty string. Rows
are judged one by one, by their own text: repeated rows get equal verdicts, ids
play no part, ties (values on a fence) are kept. Columns other than doc_id, text,
lang and source may have any name and are not touched. An empty table gives an
empty result.

Repeated three-word windows are found per document by sorting 64-bit values
that hold a window hash above its position; windows with an equal neighbour are
sorted once more with their words, and equal words alone count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_SPLIT, cut, let, lookup, scratch

MIN_WORDS = 50
PRIOR = 100
REACH = 5
BROADCAST_GROUPS = 100_000  # rows of limits, about 100 bytes each, that may be broadcast
# Metric: (numerator, denominator, scale, has a lower fence)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False),
    "repeats": ("n_repeat_words", "n_words", 1000, False),
    "word_len": ("word_chars", "n_words", 100, True),
}
SIDES = [(m, side) for m, spec in METRICS.items() for side in ("hi", "lo") if side == "hi" or spec[3]]
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    bits = F.when(n < 1 << 16, 16).when(n < 1 << 20, 20).when(n < 1 << 24, 24).otherwise(31)

    def on(b: Column) -> Column:
        size, shift = b["n"], b["bits"]

        def packed(x: Column, i: Column) -> Column:
            h = F.xxhash64(x, F.get(b["w"], i + 1), F.get(b["w"], i + 2))
            low = F.call_function("shiftright", h, shift)
            return F.call_function("shiftleft", low, shift).bitwiseOR(i.cast("long"))

        def starts(s: Column) -> Column:
            top = lambda x: F.call_function("shiftright", x, shift)
            same = lambda x, j: top(F.get(s, j)) == top(x)
            hits = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1

            def read(x: Column) -> Column:
                p = x.bitwiseAND(mask).cast("int")
                return F.struct(F.struct(top(x), *(F.get(b["w"], p + k) for k in range(3))).alias("window"), p.cast("long").alias("at"))

            return F.sort_array(F.transform(hits, read))

        def confirmed(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["window"] == x["window"]
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

        def covered(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        windows = F.sort_array(F.transform(F.slice(b["w"], F.lit(1), F.greatest(size - 2, F.lit(0))), packed))
        return F.when(size < 3, F.lit(0).cast("long")).otherwise(let(let(let(windows, starts), confirmed), covered))

    return let(F.struct(words.alias("w"), n.alias("n"), bits.alias("bits")), on)


def base_counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, or with ``whole`` the row as a struct, the group and the base counters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WS_SPLIT, -1), "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w, F.size(w)).alias("n_repeat_words")))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).alias("_group")
    row = F.struct(*docs.columns).alias("_row") if whole else F.col("doc_id")
    bare = docs.select(row, key, counts.alias("_w"), let(with_word, lines).alias("_l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    return bare.select(
        "_row" if whole else "doc_id", "_group",
        F.col("_w.n_words").cast("long").alias("n_words"),
        F.col("_w.chars").cast("long").alias("word_chars"), "n_symbols",
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
    )


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(v: Column) -> Column:
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(64 + (e - 1) * 32 + F.call_function("shiftright", v, e) - 32).cast("long")


def _lowest(b: Column) -> Column:
    e = F.floor((b - 64) / 32).cast("int") + 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - 64) % 32 + 32, F.greatest(e, F.lit(0))))


def _value(m: str) -> Column:
    num, den, scale, _ = METRICS[m]
    return F.expr(f"({scale} * {num}) div greatest({den}, 1)")


def sketches(counts: DataFrame) -> DataFrame:
    """Bucket counts for each language, source and metric of passing rows."""
    one = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(_value(m)).alias("bucket")) for m in METRICS])
    return (
        counts.filter(~_failed())
        .select("_group.lang", "_group.source", F.explode(one).alias("x"))
        .groupBy("lang", "source", "x.metric", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def _fences(sk: DataFrame, by: list[str], tag: str) -> DataFrame:
    """A row a group: ``{tag}_n`` documents and a fence for each metric and side."""
    w = Window.partitionBy(*by, "metric")
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    q = sk.withColumn("run", F.sum("n").over(run)).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("run") * 100 >= F.col("total") * p, F.col("bucket")))
    q = q.groupBy(*by, "metric").agg(F.max("total").alias("total"), *[at(p).alias(f"b{p}") for p in (5, 25, 50, 75, 95)])
    low = {p: _lowest(F.col(f"b{p}")) for p in (5, 25, 50)}
    high = {p: _lowest(F.col(f"b{p}") + 1) - 1 for p in (50, 75, 95)}  # the largest value of the bucket
    side = {
        "hi": F.greatest(high[75] + REACH * (high[75] - low[50]), high[95]),
        "lo": F.greatest(F.lit(0), F.least(low[25] - REACH * (high[50] - low[25]), low[5])),
    }
    out = [F.max(F.when(F.col("metric") == m, side[s])).alias(f"{tag}_{m}_{s}") for m, s in SIDES]
    return q.groupBy(*by).agg(F.max("total").alias(f"{tag}_n"), *out)


def limits(counts: DataFrame) -> DataFrame:
    """(_group, rows, fences): one row for each language and source, drawn to the language's."""
    sk = sketches(counts)
    fine = _fences(sk, ["lang", "source"], "s")
    coarse = _fences(sk.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["lang"], "l")
    drawn = [F.expr(f"(s_n * s_{m}_{s} + {PRIOR} * l_{m}_{s}) div (s_n + {PRIOR})").alias(f"{m}_{s}") for m, s in SIDES]
    both = fine.join(coarse, "lang").select(F.struct("lang", "source").alias("_group"), *drawn)
    return counts.groupBy("_group").agg(F.count("*").alias("rows")).join(both, "_group")


def _judged(counts: DataFrame) -> DataFrame:
    """``counts`` with base_failed and kept; the limits are broadcast if they are few."""
    fences = cut(limits(counts))
    if fences.count() <= BROADCAST_GROUPS:
        rows = counts.join(F.broadcast(fences.drop("rows")), "_group", "left")
    else:
        rows = lookup(counts.withColumn("_spread", F.monotonically_increasing_id()), fences, "_group", "rows", "_spread", outer=True)
    ok = F.lit(True)
    for m, s in SIDES:
        ok = ok & (_value(m) <= F.col(f"{m}_{s}") if s == "hi" else _value(m) >= F.col(f"{m}_{s}"))
    return rows.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, the counters, base_failed, kept."""
    return _judged(cut(base_counts(docs))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, judged where they lie: counters are kept beside the rows, no text is shuffled."""
    spark = docs.sparkSession
    path = scratch(spark, "quality")
    base_counts(docs, whole=True).write.parquet(path)
    counts = spark.read.schema(base_counts(docs, whole=True).schema).parquet(path)
    return _judged(counts).filter("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _sql() -> str:
    """The same verdicts in DuckDB SQL."""
    value = {m: f"({s} * {n}) // greatest({d}, 1)" for m, (n, d, s, _) in METRICS.items()}
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {value[m]} AS v FROM c WHERE NOT base_failed" for m in METRICS)
    lowest = lambda b: f"(CASE WHEN {b} < 64 THEN {b} ELSE (({b} - 64) % 32 + 32) << (({b} - 64) // 32 + 1) END)"
    low, high = lambda p: lowest(f"b{p}"), lambda p: f"({lowest(f'(b{p} + 1)')} - 1)"
    side = {
        "hi": f"greatest({high(75)} + {REACH} * ({high(75)} - {low(50)}), {high(95)})",
        "lo": f"greatest(0, least({low(25)} - {REACH} * ({high(50)} - {low(25)}), {low(5)}))",
    }

    def fences(name: str, by: str, src: str) -> str:
        cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {side[s]} END) AS {m}_{s}" for m, s in SIDES)
        at = ", ".join(f"min(CASE WHEN run * 100 >= total * {p} THEN bucket END) AS b{p}" for p in (5, 25, 50, 75, 95))
        return f"""{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS run,
            sum(n) OVER (PARTITION BY {by}, metric) AS total FROM {src}),
        {name}_q AS (SELECT {by}, metric, max(total) AS total, {at} FROM {name}_r GROUP BY {by}, metric),
        {name} AS (SELECT {by}, max(total) AS total, {cols} FROM {name}_q GROUP BY {by})"""

    pick = lambda f: f"((s.total * s.{f} + {PRIOR} * l.{f}) // (s.total + {PRIOR}))"
    ok = " AND ".join(f"{value[m]} {'<=' if s == 'hi' else '>='} {pick(f'{m}_{s}')}" for m, s in SIDES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n >= 2) GROUP BY doc_id),
    c AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
        len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
        FROM w LEFT JOIN r USING (doc_id)),
    v AS ({stacked}),
    k AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE 64 + (length(bin(v)) - 7) * 32 + (v >> (length(bin(v)) - 6)) - 32 END AS bucket,
        count(*) AS n FROM v GROUP BY ALL),
    kl AS (SELECT lang, metric, bucket, sum(n) AS n FROM k GROUP BY ALL),
    {fences("fs", "lang, source", "k")}, {fences("fl", "lang", "kl")}
    SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND coalesce({ok}, TRUE) AS kept
    FROM c LEFT JOIN fs s ON c.lang = s.lang AND c.source = s.source LEFT JOIN fl l ON c.lang = l.lang
    """


SQL = _sql()
