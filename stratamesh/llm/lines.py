"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are folded (trimmed, lower case); lines of equal folded text are one class, known by a 64-bit hash. A class's signature
comes from one hash of each of its anchors, the first 7 characters from the beginning of a word (between spaces) on, of it and of the next one: the hash space is a circle with 16
marks, and the four hashes that follow a mark make a band. Lines with few anchors, at all or for their length (scripts without spaces, URLs, paths, rows of tables,
long compounds), get bands of all their 5-character shingles besides, as an edit would change most of the few. Two lines whose
anchor sets have similarity J share a mark's band with probability J^4, so one of 16 with 0.995 at J = 0.73, to which single edits all over lines of similarity 0.8 lead; lines of few hashes get bands of three.
Four short anchors are found again as often as three long ones, and several times as seldom by chance, so that groups, and what is moved to compare their members, grow little faster than the input.
Colliding classes are verified by exact Jaccard similarity of the 64-bit hashes of all their 5-character shingles and linked at 0.8 or more; components come from
distributed label steps, and of each component the first line (by doc_id, nulls last, then row, then line) stays.

Texts are read once for classes and signatures, and again only for the lines that share a band.

Lines without anything but white space are never duplicates. Null texts count as empty. Every row is a text of its own: repeated rows, and rows that share a doc_id or have none,
are told apart by a number of the row. Repeated lines within a text are duplicates too. Extra columns, of whatever names, are kept by ``deduplicated``; long texts are cut into lines of any
length; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import SHARE_KEYS, connected, join_hot, verified_links
from .storage import Scratch, delete, numbered, stored

PERCENT, SHINGLE = 80, 5
#: 2**REGION_BITS marks, bands of BAND hashes; anchors of HERE characters from the beginning of a word on, into the next one.
REGION_BITS, BAND, HERE = 4, 4, 7
#: Lines of fewer distinct anchors, or of more characters to each, get bands of all shingles besides.
ANCHORS, SPREAD = 6, 12
#: Lines of fewer distinct hashes than the first get shorter bands, those of fewer than the second both.
FEW = 24, 36
#: Texts (with the classes to be read from them) up to which the filter on texts goes to every task.
SHARE_LIMIT = 500_000
SPACE = "\t\n\x0b\x0c\r "


def _folded(line: str) -> Column:
    return F.lower(F.trim(line, F.lit(SPACE)))


def lines(rows: DataFrame) -> DataFrame:
    """row, doc_id, line_no (from 0), folded text and its hash of all lines that aren't blank; rows: row, doc_id, text."""
    each = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "raw"))
    each = each.filter(F.trim("raw", F.lit(SPACE)) != "")
    return _let(each, "folded", _folded("raw")).select("row", "doc_id", "line_no", "folded", F.xxhash64("folded").alias("line"))


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))


def signed(rows: DataFrame) -> DataFrame:
    """The rows with ``key`` (a row for each region that has anchors, and more for lines of few; the first has ``head``) in place of ``folded``."""
    df = _let(rows, "_w", F.split("folded", " "))
    # a negative length gives nothing of the next word
    anchors = F.transform("_w", lambda x, i: F.xxhash64(F.substring(x, 1, HERE), F.substring(F.get("_w", i + 1), F.lit(1), F.lit(HERE - 1) - F.length(x))))
    # sorted apart from the functions over elements: sorting is compiled then
    df = _let(_let(df, "_a", anchors).drop("_w"), "_s", F.sort_array(F.array_distinct("_a"))).drop("_a")
    few = (F.size("_s") < ANCHORS) | (F.length("folded") > SPREAD * F.size("_s"))
    df = _let(df, "_f", F.when(few, shingles("folded")).otherwise(F.expr("cast(array() as array<bigint>)"))).drop("folded")
    df = df.select("*", F.posexplode(F.when(F.size("_f") > 0, F.array("_s", F.sort_array(F.array_distinct("_f")))).otherwise(F.array("_s"))).alias("_k", "_h")).drop("_s", "_f")
    df = df.select("*", F.posexplode("_h").alias("_i", "_x"))
    # a region's band begins with its first hash, where the circle was cut or the top bits change
    region = lambda x: f"shiftright({x}, {64 - REGION_BITS})"
    df = df.filter(F.expr(f"_i = 0 or {region('_x')} <> {region('get(_h, _i - 1)')}"))
    band = lambda n: f"xxhash64({n}, _x, {', '.join(f'get(_h, pmod(_i + {j}, size(_h)))' for j in range(1, n))})"
    # equal bands have equal shorter ones, so both are for lines that may meet lines of either
    keys = F.expr(f"case when size(_h) < {FEW[0]} then array({band(BAND - 1)}) when size(_h) < {FEW[1]} then array({band(BAND)}, {band(BAND - 1)}) else array({band(BAND)}) end")
    df = df.select("*", F.posexplode(keys).alias("_j", "key"))
    return df.withColumn("head", F.expr("_k = 0 and _i = 0 and _j = 0")).drop("_k", "_h", "_i", "_x", "_j")


def shingles(folded: str) -> Column:
    """The hashes of a line's shingles; a shorter line is one. Cut from code points of four bytes each, as places in UTF-8 have to be searched."""
    starts = F.sequence(F.lit(1), F.greatest(4 * (F.length(folded) - SHINGLE), F.lit(0)) + 1, F.lit(4))
    cut = lambda wide: F.transform(starts, lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE))))
    # encoded outside the inner function, which runs for each shingle
    return F.get(F.transform(F.array(F.encode(folded, "UTF-32")), cut), F.lit(0))


def repeated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The lines of components of several lines: row (its number), doc_id, line_no, first_row, first_doc_id, first_line_no (the line that stays) and kept."""
    with Scratch(documents.sparkSession) as scratch:
        return _repeated(documents, percent, scratch)


def _repeated(documents: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    rows = numbered(documents.select("doc_id", "text"))
    spark = documents.sparkSession
    each = stored(signed(lines(rows)), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    found = stored(each.filter("head").drop("key", "head"), "line-places")
    classes = stored(found.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "line-classes")
    # copies of a line have its keys too, and one line may have a key twice
    shared = stored(each.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).filter("x <> y").select("key"), "line-keys")
    members = each.join(F.broadcast(shared) if shared.count() <= SHARE_KEYS else shared, "key").select("key", F.col("line").alias("item")).distinct()
    members = stored(members.withColumn("weight", F.lit(0).cast("long")), "line-members")
    delete(spark, each._stored_path)

    def features(items: DataFrame) -> DataFrame:
        few = classes.join(items.select(F.col("item").alias("line")), "line").select(F.col("first.row").alias("row"), F.struct("line", F.col("first.line_no").alias("at")).alias("one"))
        few = stored(few.groupBy("row").agg(F.collect_list("one").alias("these")), "line-texts")
        texts = rows.select("row", "text").join(F.broadcast(few) if few.count() <= SHARE_LIMIT else few, "row")
        texts = _let(texts, "parts", F.split("text", "\n", -1)).select("parts", F.explode("these").alias("one"))
        return texts.select(F.col("one.line").alias("item"), F.get("parts", F.col("one.at")).alias("raw")).select("item", _folded("raw").alias("tokens"))

    # texts are moved and not their shingles' hashes, which are eight times as large
    labels = connected(verified_links(members, features, percent, sets=shingles))
    named = classes.join(labels.select(F.col("id").alias("line"), "component"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    groups = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("n")).filter("n > 1")
    named = stored(named.join(groups, "component").select("line", "copies", "keep"), "line-named")
    scratch.keep(found)
    scratch.keep(named)
    out = join_hot(found, named, "line", "copies", found.count()).filter("keep is not null")
    stays = (F.col("row") == F.col("keep.row")) & (F.col("line_no") == F.col("keep.line_no"))
    return out.select("row", "doc_id", "line_no", F.col("keep.row").alias("first_row"), F.col("keep.doc_id").alias("first_doc_id"), F.col("keep.line_no").alias("first_line_no"), stays.alias("kept"))


def deduplicated(documents: DataFrame, percent: int = PERCENT, drop_emptied: bool = False) -> DataFrame:
    """The documents without the lines that ``repeated`` doesn't keep; n_chars, where there is such a column, follows the text.

    With ``drop_emptied`` documents of which nothing but white space is left, though there was more, go: all they said stays elsewhere.
    """
    gone = repeated(documents, percent).filter("not kept").groupBy("row").agg(F.collect_set("line_no").alias("lines"))
    own = documents.columns
    # whatever the documents' columns are called: theirs go into one struct
    whole = numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own")))
    joined = whole.join(gone, "row", "left")
    kept = F.array_join(F.filter(F.split("own.text", "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col("own.text")).otherwise(kept)
    joined = _let(joined, "kept", text)
    if drop_emptied:
        joined = joined.filter(F.col("lines").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.col("kept").alias("text") if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"own.`{c}`").alias(c) for c in own])


def op6(spark, sf_dir: str) -> DataFrame:
    """op6_lines: all repeated lines of all documents and which of them stay."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "first_row")
