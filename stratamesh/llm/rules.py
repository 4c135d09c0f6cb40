"""Quality rules with adaptive thresholds, in DataFrame operations only.

Counts of every whole text give rates. Each rate goes into a mergeable quantile sketch for each language and source: counts
in log-linear buckets (exact below 32, then 16 buckets to each power of two, so a quantile is off by a sixteenth
at most), at most a few hundred rows a sketch whatever the input. Sketches merge by adding counts: a source with fewer than ``MIN_GROUP`` documents
takes its language's merged sketch, a language with fewer the one of all. The thresholds are fences around the middle half,
q25 - 3 (q75 - q25) - margin and q75 + 3 (q75 - q25) + margin, and take the place of fixed cutoffs; they are joined to the documents, and a document outside any of them is rejected.
Sketches hold the documents that pass the fixed base rules.

Null texts have no words and fail the base rules; null languages and sources count as empty strings; repeated rows are judged each;
an empty table gives no rows. Texts may be of any length. The input's columns are kept in one struct, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, numbered, stored

MIN_GROUP = 100
#: Rate, margin below and above its fences (None: no fence on that side). Rates are per million, mean_word in thousandths of a character.
FENCES = {"symbols": (None, 20_000), "dup_lines": (None, 400_000), "repeats": (None, 350_000), "upper": (None, 200_000), "mean_word": (1_500, 2_500)}
#: Thresholds of so many language and source pairs at most go to every task (about 200 bytes each); beyond it they are joined by a shuffle with SALTS copies.
SHARE_LIMIT, SALTS = 20_000, 16
#: Row numbers (8 bytes each) up to which the rejected ones go to every task.
REJECTED_LIMIT = 1_000_000
SPACE = r"\x20\x09-\x0D"


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once for each row: as a generated one it can't be copied into later filters, projections or lambda bodies."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def repeated(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words in 3-word windows found twice or more in an array of words.

    The windows' hashes are sorted with their places in the low bits; neighbours with equal high bits are compared word by word.
    """
    last = f"(size({words}) - 3)"
    df = let(df, "_b", F.expr(f"length(bin(greatest({last}, 0))) + 1"))
    hashed = f"transform(sequence(0, {last}), i -> (shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), _b) | cast(i as bigint)))"
    df = let(df, "_s", F.expr(f"case when {last} < 0 then cast(array() as array<bigint>) else sort_array({hashed}) end"))
    df = let(df, "_f", F.expr("case when size(_s) < 2 then cast(array() as array<int>) else filter(sequence(1, size(_s) - 1), k -> shiftright(_s[k] ^ _s[k - 1], _b) = 0) end"))
    pair = "transform(_f, k -> array(cast(_s[k - 1] & (shiftleft(1L, _b) - 1) as int), cast(_s[k] & (shiftleft(1L, _b) - 1) as int)))"
    same = " and ".join(f"{words}[p[0] + {j}] = {words}[p[1] + {j}]" for j in range(3))
    df = let(df, "_p", F.expr(f"sort_array(array_distinct(flatten(filter({pair}, p -> {same}))))"))
    covered = "cast(aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0, (a, b) -> a + b) as bigint)"
    return df.withColumn(name, F.expr(covered)).drop("_b", "_s", "_f", "_p")


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """A struct ``own`` of the documents' columns and a struct ``_q`` of counts and rates."""
    documents = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"))
    own = F.coalesce(F.col(f"own.`{text}`"), F.lit(""))
    df = let(documents, "_w", F.filter(F.split(own, f"[{SPACE}]+", -1), lambda x: x != ""))
    df = repeated(df, "_w", "_r")
    df = let(df, "_l", F.filter(F.split(own, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    n_words, lines = F.size("_w").cast("long"), F.size("_l").cast("long")
    counts = let(
        df,
        "_c",
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.col("_r").alias("n_repeat_words"),
            lines.alias("n_lines"),
            F.length(F.regexp_replace(own, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        ),
    ).drop("_w", "_l", "_r")
    c = {k: F.col(f"_c.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")}
    rate = lambda a, b, by: F.expr("0L") + F.floor(by * a / F.greatest(b, F.lit(1))).cast("long")
    rates = F.struct(
        rate(c["n_symbols"], c["word_chars"], 1_000_000).alias("symbols"),
        rate(c["n_dup_lines"], c["n_lines"], 1_000_000).alias("dup_lines"),
        rate(c["n_repeat_words"], c["n_words"], 1_000_000).alias("repeats"),
        rate(c["n_upper"], c["word_chars"], 1_000_000).alias("upper"),
        rate(c["word_chars"], c["n_words"], 1_000).alias("mean_word"),
    )
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return counts.withColumn("_q", F.struct("_c.*", failed.alias("base_failed"), rates.alias("rates"))).drop("_c")


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative long."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.when(value < 32, value).otherwise(shift * 16 + F.call_function("shiftright", value, shift)).cast("int")


def upper_bound(b: Column) -> Column:
    """The largest value in a bucket."""
    shift = F.when(b < 32, F.lit(0)).otherwise(F.floor(b / 16).cast("int") - 1)
    return F.when(b < 32, b.cast("long")).otherwise(F.call_function("shiftleft", (b - shift * 16 + 1).cast("long"), shift) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) from rows with lang, source and a struct ``rates``; unions of sketches merge by summing n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(f"rates.{k}")).alias("bucket")) for k in FENCES]))
    return rows.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.rate", "e.bucket").agg(F.count("*").alias("n"))


def quantile_of(buckets: Column, total: Column, hundredths: int) -> Column:
    """From an array of (bucket, n) in order: the bucket bound at the quantile (the least bucket with enough documents up to it)."""
    found = F.aggregate(
        buckets,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["at"] < 0) & (100 * (a["seen"] + x["n"]) >= hundredths * total), x["bucket"]).otherwise(a["at"]).alias("at")),
        lambda a: a["at"],
    )
    return upper_bound(found)


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, lows, highs): maps from rate to fence, by the smallest group that is large enough."""
    own = sketch.groupBy("lang", "source", "rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))
    by_lang = sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")).groupBy("lang", "rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("lb"), F.sum("n").alias("lt"))
    by_all = sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).groupBy("rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("ab"), F.sum("n").alias("at"))
    df = own.join(by_lang, ["lang", "rate"]).join(F.broadcast(by_all), "rate")  # by_all: one row for each rate
    level = F.when(F.col("total") >= min_group, F.struct("b", "total")).when(F.col("lt") >= min_group, F.struct(F.col("lb").alias("b"), F.col("lt").alias("total"))).otherwise(F.struct(F.col("ab").alias("b"), F.col("at").alias("total")))
    df = df.select("lang", "source", "rate", level.alias("g"))
    df = df.select("lang", "source", "rate", *[quantile_of(F.col("g.b"), F.col("g.total"), q).alias(f"q{q}") for q in (25, 75)])
    spread = 3 * (F.col("q75") - F.col("q25"))
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (below, above) in FENCES.items():
        low = F.when(F.col("rate") == k, F.col("q25") - spread - below).otherwise(low) if below is not None else low
        high = F.when(F.col("rate") == k, F.col("q75") + spread + above).otherwise(high) if above is not None else high
    df = df.select("lang", "source", "rate", low.alias("low"), high.alias("high"))
    return df.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == k, F.struct("low", "high"))).alias(k) for k in FENCES])


def assessed(documents: DataFrame, keep: list[str] | None = None, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """A struct ``own`` of the documents' columns (or ``keep`` of them) and a struct ``_q``: the counts, base_failed, rates and kept.

    Texts are measured once; the kept columns and the counts are stored for the verdicts, and never shuffled unless the thresholds are too many to share.
    """
    q = measured(documents)
    mine = [F.col(f"own.`{c}`").alias(c) for c in (documents.columns if keep is None else keep)]
    name = lambda c: F.coalesce(F.col(f"own.`{c}`").cast("string"), F.lit("")).alias(f"_{c}")
    keyed = stored(q.select(F.struct(*mine).alias("own"), name("lang"), name("source"), "_q"), "rule-counts")
    passing = keyed.select(F.col("_q.base_failed").alias("failed"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_q.rates").alias("rates")).filter("not failed")
    fences = stored(thresholds(sketches(passing)), "rule-fences").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*FENCES).alias("_f"))
    if fences.count() <= share_limit:
        joined = keyed.join(F.broadcast(fences), ["_lang", "_source"], "left")
    else:  # a source may hold a third of all rows: its documents are dealt out over SALTS tasks
        many = fences.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("_q"), F.lit(SALTS)).cast("int")).join(many, ["_lang", "_source", "_salt"], "left").drop("_salt")
    inside = ~F.col("_q.base_failed")
    for k in FENCES:
        v, f = F.col(f"_q.rates.{k}"), F.col(f"_f.{k}")
        inside = inside & F.coalesce(v >= f["low"], F.lit(True)) & F.coalesce(v <= f["high"], F.lit(True))
    return joined.select("own", F.struct("_q.*", inside.alias("kept")).alias("_q"))


def assess(documents: DataFrame, keep: list[str] | None = None, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """``assessed`` with the documents' columns side by side, which may have any names but ``_q``."""
    return assessed(documents, keep, share_limit).select("own.*", "_q")


def filtered(documents: DataFrame, share_limit: int = SHARE_LIMIT, rejected_limit: int = REJECTED_LIMIT) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names. Texts aren't stored: only the numbers of rejected rows are."""
    rows = numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole")))
    with Scratch(documents.sparkSession) as scratch:
        verdicts = assessed(rows.select("row", F.col("whole.text").alias("text"), F.col("whole.lang").alias("lang"), F.col("whole.source").alias("source")), ["row"], share_limit)
        rejected = scratch.keep(stored(verdicts.filter("not _q.kept").select("own.row"), "rule-rejected"))
        small = rejected.count() <= rejected_limit
    kept = rows.join(F.broadcast(rejected) if small else rejected, "row", "left_anti")
    return kept.select(*[F.col(f"whole.`{c}`").alias(c) for c in documents.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    """op3_rules: counts and verdicts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return assess(docs, keep=["doc_id"]).select("doc_id", *[F.col(f"_q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
