"""Personal data: pattern-matched identifiers, and more found by bootstrapped context, in DataFrame operations only.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns, leftmost and without overlap within a kind.
They are the seeds of the bootstrap: the word and the two words before and after a seed are lexical patterns, each for tokens of one coarse class (with @, five digits or
more, fewer), not for the seed's very shape. Other tokens with digits or @, and groups of digits with single spaces between them, are instances too. On the graph of patterns and instances, a pattern's score for a kind is the
mean score of its instances, counted only with ``MIN_SEEDS`` different seeds and a mean of ``MIN_SCORE``; an instance's score is the noisy-or of the best patterns of its two sides. After ``ROUNDS``
rounds, instances of ``ACCEPT`` or more are identifiers, and all their occurrences are added to the base spans, which always stay.

Only spans, contexts and tokens leave the texts; they are stored, and texts are read once. Patterns and tokens that a thousandth of all
rows share are joined by broadcast, the others by shuffles. Null texts count as empty; texts without identifiers get zero counts and
empty strings; repeated rows are reported each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import join_hot
from .storage import stored

#: Kinds in the order of the span lists, with their patterns. Possessive quantifiers and look-behinds only save work: they find what the plain patterns find.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
INSTANCE = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: Such a token with the groups of digits that follow it.
WINDOW = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+(?:\x20[().+-]*+[0-9][0-9().+-]*+(?![^\s0-9().+,;:-]))++"
#: Digits from which a token counts as long.
LONG = 5
MIN_SEEDS, MIN_SCORE, ACCEPT, ROUNDS, CONTEXT = 5, 0.8, 0.9, 3, 48


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once for each row, which the optimizer can't copy into other expressions."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _valid(kind: str, hit: str) -> str:
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return f"{hit} rlike r'^{_PART}(?:\\.{_PART}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    if kind == "card":
        each = f"transform(sequence(1, length({digits})), i -> cast(substring({digits}, -i, 1) as int))"
        luhn = f"aggregate(transform({each}, (d, i) -> case when i % 2 = 0 then d when d > 4 then 2 * d - 9 else 2 * d end), 0, (a, d) -> a + d) % 10 = 0"
        return f"case when length({digits}) between 16 and 19 then {luhn} else false end"
    return "true"


def _matches(df: DataFrame, name: str, pattern: str, need: str) -> DataFrame:
    """A column of all matches of a pattern: array of (s, e, hit), places in code points."""
    hits = F.when(F.col("text").rlike(need), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    df = _let(df, "_h", hits)
    gaps = F.when(F.size("_h") > 0, F.split("text", pattern, -1)).otherwise(F.expr("cast(array() as array<string>)"))
    df = _let(df, "_g", gaps)
    step = "named_struct('at', a.at + length(_g[i]) + length(_h[i]), 'out', concat(a.out, array(named_struct('s', a.at + length(_g[i]), 'e', a.at + length(_g[i]) + length(_h[i]), 'hit', _h[i]))))"
    empty = "cast(array() as array<struct<s:int,e:int,hit:string>>)"
    found = f"case when size(_h) = 0 then {empty} else aggregate(sequence(0, size(_h) - 1), named_struct('at', 0, 'out', {empty}), (a, i) -> {step}, a -> a.out) end"
    return _let(df, name, F.expr(found)).drop("_h", "_g")


def found(documents: DataFrame, text: str = "text") -> DataFrame:
    """row, doc_id, base (array of kind, s, e, with contexts) and other (tokens that might be identifiers, with contexts); stored."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k, pattern in KINDS.items():
        df = _matches(df, f"_{k}", pattern, NEEDS[k])
    df = _matches(df, "_o", INSTANCE, "[0-9@]")
    df = _matches(df, "_w", WINDOW, "[0-9@][^\\s]*\\x20[().+-]*[0-9]")
    kinds = [f"transform(filter(_{k}, x -> {_valid(k, 'x.hit')}), x -> named_struct('kind', {i}, 's', x.s, 'e', x.e, 'token', x.hit))" for i, k in enumerate(KINDS)]
    df = _let(df, "_b", F.expr(f"concat({', '.join(kinds)})"))
    trimmed = "named_struct('kind', -1, 's', x.s + length(regexp_extract(x.hit, '^[^A-Za-z0-9+(]*', 0)), 'e', x.e - length(regexp_extract(x.hit, '[^A-Za-z0-9)]*$', 0)), 'token', x.hit)"
    # a group of tokens that touches a base span falls back to its tokens
    df = _let(df, "_v", F.expr("filter(_w, x -> not exists(_b, b -> b.s < x.e and x.s < b.e))"))
    df = _let(df, "_t", F.expr("concat(_v, filter(_o, x -> not exists(_v, v -> v.s < x.e and x.s < v.e)))"))
    df = _let(df, "_c", F.expr(f"filter(transform(filter(_t, x -> not exists(_b, b -> b.s < x.e and x.s < b.e) and x.hit rlike '[A-Za-z0-9]'), x -> {trimmed}), x -> x.s < x.e)"))
    near = f"substring(text, greatest(x.s - {CONTEXT}, 0) + 1, least(x.s, {CONTEXT}))", f"substring(text, x.e + 1, {CONTEXT})"
    # where the nearest characters don't hold two whole words, all the text on that side is looked at
    left = f"case when x.s <= {CONTEXT} or {near[0]} rlike r'\\s[^\\s]++\\s++[^\\s]++\\s*+$' then {near[0]} else substring(text, 1, x.s) end"
    right = f"case when length({near[1]}) < {CONTEXT} or {near[1]} rlike r'^[^\\s]*+\\s++[^\\s]++\\s++[^\\s]++\\s' then {near[1]} else substring(text, x.e + 1) end"
    words = lambda t, pattern: f"lower(regexp_replace(regexp_extract({t}, r'{pattern}', 1), '\\\\s+', ' '))"
    contexts = {"before": words(left, r"(?<![^\s])([^\s]++)\s*+$"), "before2": words(left, r"(?<![^\s])([^\s]++\s++[^\s]++)\s*+$"), "after": words(right, r"^[^\s]*+\s++([^\s]++)"), "after2": words(right, r"^[^\s]*+\s++([^\s]++\s++[^\s]++)")}
    token = "substring(text, x.s + 1, x.e - x.s)"
    kind_of = f"case when {token} like '%@%' then '@' when length(regexp_replace({token}, '[^0-9]', '')) >= {LONG} then '9' else '1' end"
    fields = "".join(f", '{c}', {e}" for c, e in contexts.items())
    full = lambda c: F.expr(f"transform({c}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'token', lower({token}), 'class', {kind_of}{fields}))")
    return stored(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", full("_b").alias("base"), full("_c").alias("other")), "pii-found")


def bootstrap(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Discovered instances (token, kind, n occurrences) from ``found``'s rows."""
    each = stored(rows.select(F.explode(F.concat("base", "other")).alias("x")).select("x.*"), "pii-instances")
    context = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("word")) for c in ("before", "before2", "after", "after2")]))
    edges = each.select("token", "class", context.alias("c")).filter("c.word <> ''").select("token", F.concat_ws(" ", "c.side", "class", "c.word").alias("pattern")).distinct()
    seeds = each.filter("kind >= 0").select("token", "kind").distinct()
    edges = stored(edges.join(seeds.select("token", F.lit(True).alias("seed")).distinct(), "token", "left").withColumn("seed", F.coalesce("seed", F.lit(False))), "pii-edges")
    totals = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-patterns")
    count = edges.count()
    known = edges.filter("seed").join(seeds, "token").select("token", "pattern", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("is_seed"))
    known = stored(known, "pii-known")
    unknown = stored(edges.filter("not seed").select("token", "pattern"), "pii-unknown")
    scores = None
    for _ in range(rounds):
        scored = known if scores is None else known.unionByName(unknown.join(scores, "token").select("token", "pattern", "kind", "score", F.lit(0).alias("is_seed")))
        by_pattern = scored.groupBy("pattern", "kind").agg(F.sum(F.round("score", 9)).alias("sum"), F.sum("is_seed").alias("seeds"))
        good = by_pattern.filter(F.col("seeds") >= MIN_SEEDS).join(totals, "pattern").withColumn("p", F.round(F.col("sum") / F.col("n"), 6)).filter(F.col("p") >= MIN_SCORE)
        good = stored(good.groupBy("pattern").agg(F.max(F.struct("p", -F.col("kind"))).alias("best"), F.max("n").alias("n")).select("pattern", F.col("best.p").alias("p"), (-F.col("best.col2")).alias("kind"), "n"), "pii-good")
        reached = join_hot(unknown, good, "pattern", "n", max(count, 1)).filter("p is not null")
        side = F.col("pattern").startswith("before")
        reached = reached.groupBy("token", "kind", side.alias("side")).agg(F.max("p").alias("p"))  # what one side tells counts once
        scores = stored(reached.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("score")), "pii-scores")
    best = scores.groupBy("token").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("kind")).alias("k"))).alias("b")).filter(F.col("b.score") >= ACCEPT)
    occurrences = each.filter("kind < 0").groupBy("token").agg(F.count("*").alias("n"))
    return stored(best.select("token", (-F.col("b.k")).alias("kind")).join(occurrences, "token"), "pii-discovered")


def spans(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and all: arrays of (kind, s, e), kind the place in ``KINDS``, in order of kind and start."""
    rows = found(documents)
    new = bootstrap(rows, rounds)
    other = rows.select("row", F.explode("other").alias("x")).select("row", "x.token", "x.s", "x.e")
    total = other.count()
    added = join_hot(other, new, "token", "n", max(total, 1)).filter("kind is not null")
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))
    plain = F.sort_array(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    joined = rows.select("row", "doc_id", plain.alias("base")).join(added, "row", "left")
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("all"))


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _text(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    """op10_identifiers: personal data in every document."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("all").alias("spans"))
