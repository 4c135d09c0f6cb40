"""Connected components and verified links within candidate groups, in DataFrame operations only.

``connected`` labels each node of an edge list with the least node it can reach, by alternating large-star and small-star steps;
every step's edges are written to the shared folder, so lineage stays short and lost executors cost one step.

``verified_links`` finds the links between items that share a key, up to connectivity. No group is gathered and no group's pairs are all made:
groups of up to ``SMALL`` items give their pairs, larger ones compare each item with ``LEADERS`` leaders; items that are not in the
first leader's component then get other leaders, round by round while that helps and the rest is too large to compare at once. Those left over are compared with the members of their group that are in other
components, in blocks: first with every ``THIN``-th member, which links those that have many links, so that these don't give all their pairs; then what is still apart with all members, so that
no pair of a group whose members ended in different components went unseen. Groups whose members are in one
component already are done, which is what keeps groups of thousands of near copies cheap. Labels of one round are where the next one begins.

Before whole sets are moved, pairs have to pass two exact tests on a few numbers of each item: the sizes, and parity bits. A set's parity bits
are the exclusive or of one bit for each value, so two sets differ in no more bits than they differ in values, and
sets of n and m values with a similarity of p percent differ in at most (100 - p) (n + m) / (100 + p).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, delete, stored

SMALL, LEADERS, ROUNDS = 6, 4, 6
#: Members of a group that the left-over items are compared with in one block.
BLOCK = 1_000
#: Left-over items meet every so many-th member of their group before they meet all.
THIN = 16
#: Comparisons of sizes and parity bits up to which left-over items get no further leaders first.
COMPARED = 30_000_000
#: Parity bits of an item, in words of 64.
PARITY = 16
#: Keys of several items (16 bytes each) up to which they go to every task; beyond it members are shuffled to them.
SHARE_KEYS = 1_000_000
MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", F.lit(7))).alias("y")).first()
    return row["n"], row["x"], row["y"]


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge; edges: columns a and b (long). Loops and repeated edges don't matter; no edges give no rows."""
    with Scratch(edges.sparkSession) as scratch:
        return scratch.keep(_connected(edges))


def _connected(edges: DataFrame) -> DataFrame:
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        last, e = e, stored(small, "edges")
        delete(e.sparkSession, last._stored_path)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return stored(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "labels")


def _star(labels: DataFrame) -> DataFrame:
    """The edges that say what labels say."""
    return labels.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b")


def similar(x: Column, y: Column, percent: int) -> Column:
    """Whether two arrays of distinct values have a Jaccard similarity of ``percent`` or more; exact."""
    # the intersection is named once, as a filter works out what it names twice twice
    return (100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))


def sketched(sets: DataFrame) -> DataFrame:
    """(item, n, p0, p1 ...) of (item, set): the size and the parity bits of each array of hashes, equal ones side by side; the lowest bits of a hash tell its bit."""
    each = _distinct(sets, "set").select("item", "x")
    word, bit = F.expr(f"shiftright(x, 6) & {PARITY - 1}"), F.expr("shiftleft(1L, cast(x & 63 as int))")
    return each.groupBy("item").agg(F.count("*").cast("int").alias("n"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i in range(PARITY)])


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once for each row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _distinct(df: DataFrame, name: str) -> DataFrame:
    """A row with x for each value of an array in which equal values are side by side."""
    return df.select("*", F.posexplode(name).alias("_at", "x")).filter(F.expr(f"_at = 0 or x <> get({name}, _at - 1)"))


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes (n) and parity bits (p0, p1 ...) of two rows leave room for a link; x and y: what their columns' names begin with."""
    near = f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)"
    apart = " + ".join(f"bit_count({x}p{i} ^ {y}p{i})" for i in range(PARITY))
    return F.expr(f"{near} and {100 + percent} * ({apart}) <= {100 - percent} * ({x}n + {y}n)")


def verified_links(
    members: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    percent: int,
    attributes: DataFrame | None = None,
    condition: Callable[[str, str], Column] | None = None,
    small: int = SMALL,
    rounds: int = ROUNDS,
    read: Callable[[], None] | None = None,
    sets: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Edges (a, b) whose components are those of all links: pairs of items of one key whose token sets are similar.

    members: key, item (long), weight (long; the least leads its group), each (key, item) once. features: takes the items (item) that share a key
    with another and returns (item, tokens array<long>), once for each. ``condition`` takes the two beginnings of the names of ``attributes``' columns (item and others)
    and rules out pairs before they are verified. ``read`` is called when members won't be read any more.
    With ``sets`` the features are (item, tokens) with tokens of any type that is smaller to move, and ``sets`` makes the array from a column's name;
    a value may be repeated in it.
    """
    with Scratch(members.sparkSession) as scratch:
        return scratch.keep(_linked(members, features, percent, attributes, condition, small, rounds, read, sets))


def _linked(members, features, percent, attributes, condition, small, rounds, read, sets) -> DataFrame:
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "group-sizes")
    inside = stored(members.join(F.broadcast(sizes) if sizes.count() <= SHARE_KEYS else sizes, "key"), "group-members")
    if read is not None:
        read()
    tokens = stored(features(stored(inside.select("item").distinct(), "group-items")).select("item", "tokens"), "group-tokens")
    light = tokens.withColumnRenamed("tokens", "set")
    if sets:  # sorted apart from the sets' own functions: sorting is compiled then
        light = _let(_let(tokens, "raw", sets("tokens")).select("item", "raw"), "set", F.sort_array("raw")).select("item", "set")
    light = sketched(light)
    light = stored(light if attributes is None else light.join(attributes, "item"), "group-light")
    rest_of = [c for c in light.columns if c != "item"]

    def with_light(pairs: DataFrame, side: str, mark: str) -> DataFrame:
        return pairs.join(light.select(F.col("item").alias(side), *[F.col(c).alias(mark + c) for c in rest_of]), side)

    def may(x: str, y: str) -> Column:
        return may_link(x, y, percent) & condition(x, y) if condition else may_link(x, y, percent)

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b, both sizes together: n) that passed ``may``."""
        x, y = (tokens.select(F.col("item").alias(c), F.col("tokens").alias(t)) for c, t in (("a", "s"), ("b", "t")))
        both = pairs.join(x, "a").join(y, "b")
        if sets:  # little to move, much to do for each pair: to as many tasks as there are
            both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
            both = _let(_let(both, "x", sets("s")), "y", sets("t")).select("a", "b", "n", "x", "y")
            both = _let(both, "all", F.sort_array(F.concat("x", "y"))).select("a", "b", "n", "all")
            union = _distinct(both, "all").groupBy("a", "b", "n").agg(F.count("*").alias("union"))
            return union.filter(F.expr(f"100 * n >= {100 + percent} * union")).select("a", "b")
        return both.filter(similar(F.col("s"), F.col("t"), percent)).select("a", "b")

    def checked(pairs: DataFrame) -> DataFrame:
        return verify(with_light(with_light(pairs.distinct(), "a", "x_"), "b", "y_").filter(may("x_", "y_")).select("a", "b", (F.col("x_n") + F.col("y_n")).alias("n")))

    few = inside.filter(F.col("m") <= small)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.item") < F.col("y.item")))
    pairs = pairs.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    large = inside.filter(F.col("m") > small)
    edges = stored(checked(pairs.unionByName(_to_leaders(large, large, 0))), "links")
    if large.isEmpty():
        return edges
    labels, left = connected(edges), None
    for r in range(1, rounds):
        rest = stored(_unlinked(large, labels), "links-open")
        now, meet = rest.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
        if now == 0:
            return stored(_star(labels), "links")
        if meet <= COMPARED or left is not None and 10 * now > 9 * left:  # or further leaders hardly help
            break
        left = now
        labels = connected(_star(labels).unionByName(checked(_to_leaders(rest, large, r))))

    def apart(labels: DataFrame, thin: int) -> DataFrame:
        """The links of left-over items with every ``thin``-th member of their group that is in another component."""
        labelled = _labelled(large, labels)
        top = labelled.groupBy("key").agg(F.min_by("component", F.struct("weight", "item")).alias("head"))
        labelled = stored(labelled.join(top, "key"), "links-rest")
        rest = labelled.filter("component <> head")
        whole = labelled.join(rest.select("key").distinct(), "key", "left_semi").filter(F.pmod(F.xxhash64("item", F.lit(thin)), F.lit(thin)) == 0)
        # sizes of similar sets are in one band or neighbouring ones; a hot key's members are dealt out in blocks, each of which sees all that is left over
        band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")
        blocks = F.ceil(F.col("m") / (BLOCK * thin)).cast("int")
        rest = rest.join(light, "item").withColumn("band", F.explode(F.sequence(band - 1, band + 1))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        whole = whole.join(light, "item").withColumn("band", band).withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
        x = rest.select("key", "band", "block", *[F.col(c).alias(f"x_{c}") for c in ("item", "component", "head", *rest_of)])
        y = whole.select("key", "band", "block", *[F.col(c).alias(f"y_{c}") for c in ("item", "component", *rest_of)])
        once = (F.col("y_component") == F.col("x_head")) | (F.col("x_item") < F.col("y_item")) | F.lit(thin > 1)
        # compared inside the join: only pairs that may be links leave it
        pairs = x.join(y, ["key", "band", "block"]).filter((F.col("x_component") != F.col("y_component")) & once & may("x_", "y_"))
        return verify(pairs.select(F.least("x_item", "y_item").alias("a"), F.greatest("x_item", "y_item").alias("b"), (F.col("x_n") + F.col("y_n")).alias("n")).distinct())

    labels = connected(_star(labels).unionByName(apart(labels, THIN)))
    return stored(_star(labels).unionByName(apart(labels, 1)), "links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("id").alias("item"), "component"), "item", "left").withColumn("component", F.coalesce("component", "item"))


def _to_leaders(members: DataFrame, group: DataFrame, r: int) -> DataFrame:
    """Pairs of each member with LEADERS items of its key in ``group``: those of least weight in round 0, others by a hash of the round later."""
    rank = F.struct("weight", "item") if r == 0 else F.struct(F.xxhash64("item", F.lit(r)).alias("h"), "item")
    each = group.groupBy("key", F.pmod(F.xxhash64("item"), F.lit(LEADERS)).alias("slot")).agg(F.min(rank).alias("lead"))
    leaders = each.groupBy("key").agg(F.collect_list("lead.item").alias("leaders"))
    pairs = members.join(leaders, "key").select("item", F.explode("leaders").alias("leader")).filter("item <> leader")
    return pairs.select(F.least("item", "leader").alias("a"), F.greatest("item", "leader").alias("b")).distinct()


def _unlinked(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members outside the component of their group's leader."""
    labelled = _labelled(members, labels)
    top = labelled.groupBy("key").agg(F.min_by("component", F.struct("weight", "item")).alias("head"))
    return labelled.join(top, "key").filter("component <> head").drop("component", "head")


#: A key with a thousandth of all rows or more is hot; there are a thousand of them at most, and they are joined by broadcast.
HOT_SHARE = 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left join right on key, where right's ``weight`` tells how many rows of left a key has and ``total`` how many left has: hot keys aren't shuffled."""
    hot = F.broadcast(right.filter(F.col(weight) * HOT_SHARE >= total))  # so at most HOT_SHARE rows
    cold = right.filter(F.col(weight) * HOT_SHARE < total)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
