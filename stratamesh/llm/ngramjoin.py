"""Near-duplicate documents by an exact Jaccard join on word n-grams with multiple global orders.

A document's set holds the hashes of its distinct n-word shingles; a text of fewer words is one shingle. Documents with equal sets
are one class. Two classes link when 100 |intersection| >= 85 |union|.

Prefix filtering: under any global order of the shingles, linked sets of n share one of the first n - ceil(0.85 n) + 1
shingles of either. The orders here all put rare shingles first and break ties differently. A first pass counts in how many classes each shingle
is (an inverted index, dealt out by shingle hash in blocks of packed bytes and counted with numpy); shingles of a single class can't be shared and fill
prefixes without being indexed. What is left of the prefixes under the first order gives the candidate groups, sharing a prefix shingle under each further order and the sizes rule candidates out, and
the survivors are verified on their whole sets. Large groups go through leaders (see components), so copies are never expanded into all pairs.

Null texts and texts without words have empty sets, link with nothing and are components of their own. Every row is a text of its own: repeated rows are
reported each, and rows that share a doc_id are linked by their texts alone. A null doc_id counts as the largest: such a row's component is named by the least doc_id in it, and is
null if there is none. Extra columns are ignored (``deduplicated`` keeps them, whatever their names); texts may be of any length; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .components import connected, join_hot, verified_links
from .storage import Scratch, numbered, stored

SHINGLE, PERCENT = 4, 85
#: Row numbers (8 bytes each) up to which a filter on documents goes to every task.
SHARE_LIMIT = 1_000_000
#: Shingles of one part of the index, about.
PART_TOKENS = 3_000_000
#: Shingles that a task packs before it hands out its blocks.
PACK_TOKENS = 1_500_000
_TOKEN_BYTES = 5
_U = np.uint64


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each document of a chunk."""
    words = tn.Words(data, offsets, tn.SPACE_WORDS)
    h = words.hashes()
    prefix = tn.gram_prefix(h)
    g = tn.grams(h, k, prefix)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        elif b > a:
            n = b - a
            yield tn.mix((prefix[0][b : b + 1] - prefix[0][a : a + 1]) * prefix[1][a : a + 1] + _U(n))
        else:
            yield g[:0]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of each set (0 for the empty one)."""
    out = [tn.mix(np.array([tn.mix(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(x))], _U))[0] | _U(1) if len(x) else _U(0) for x in sets]
    return np.array(out, _U).view(np.int64)


def _each(batch, k: int):
    """(row numbers, doc ids, sets) of the chunks of a batch."""
    rows, ids = batch.column("row"), batch.column("doc_id")
    data, offs = tn.buffers(batch.column("text"))
    for a, b, d, o in tn.chunks(data, offs):
        yield rows.slice(a, b - a), ids.slice(a, b - a), list(token_sets(d, o, k))


def _classes(k: int):
    def run(batches):
        for batch in batches:
            for rows, ids, sets in _each(batch, k):
                yield pa.RecordBatch.from_arrays([rows, ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(set_ids(sets))], ["row", "doc_id", "n", "set"])
        tn.released()

    return run


def _packed(k: int, bits: int):
    """Blocks (part, sets, counts, tokens) of the shingles of distinct sets; part: the top bits of the shingle."""

    def run(batches):
        held, runs, count = [], [], 0
        seen: set[int] = set()

        def blocks():
            tokens = np.concatenate(held)
            owner = np.concatenate([np.full(len(x), i, np.int32) for i, x in enumerate(held)])
            part = (tokens >> _U(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tokens, owner, part = tokens[order], owner[order], part[order]
            rest = (tokens >> _U(64 - bits - 8 * _TOKEN_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES]
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            ids = np.array(runs, np.int64)
            rows = []
            for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                a, b = edges[p], edges[p + 1]
                own = owner[a:b]
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                rows.append((p, ids[own[begin]].tobytes(), np.diff(np.append(begin, len(own))).astype(np.uint32).tobytes(), rest[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["part", "sets", "counts", "tokens"])

        for batch in batches:
            for _, _, sets in _each(batch, k):
                for x, i in zip(sets, set_ids(sets).tolist(), strict=True):
                    if len(x) and i not in seen:  # a task hands out equal sets once
                        seen.add(i)
                        held.append(x)
                        runs.append(i)
                        count += len(x)
                if count >= PACK_TOKENS:
                    yield blocks()
                    held, runs, count = [], [], 0
        if held:
            yield blocks()
            held, runs = [], []
        tn.released()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(set, token, df) of the shingles of one part that several sets have."""
    get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    packed = get("tokens", np.uint8).reshape(-1, _TOKEN_BYTES)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :_TOKEN_BYTES] = packed
    tokens = wide.reshape(-1).view("<u8")
    owner = np.repeat(get("sets", np.int64), get("counts", np.uint32))
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    same = t[1:] == t[:-1]
    several = np.zeros(len(t), bool)
    several[1:] |= same
    several[:-1] |= same
    t, owner = t[several], owner[order[several]]
    order = np.lexsort((owner, t))
    t, owner = t[order], owner[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])
    t, owner = t[new], owner[new]
    _, inverse, df = np.unique(t, return_inverse=True, return_counts=True)
    df = df[inverse]
    keep = df > 1
    part = table.column("part")[0].as_py() if len(table) else 0
    tn.released()
    token = t[keep].astype(np.int64) | np.int64(part << (8 * _TOKEN_BYTES))
    return pa.table({"set": owner[keep], "token": token, "df": df[keep].astype(np.int64)})


def _sets_of(k: int):
    def run(batches):
        for batch in batches:
            for _, _, sets in _each(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["item", "tokens"])

    return run


def by_rows(docs: DataFrame, rows: DataFrame, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """The documents whose row number is in ``rows`` (a stored table of distinct row)."""
    return docs.join(F.broadcast(rows) if rows.count() <= share_limit else rows, "row", "left_semi")


def components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row (its number), doc_id, n_shingles, component_id (the least doc_id reachable by links) and keep_row (the row that stands for the component) of every row."""
    with Scratch(documents.sparkSession) as scratch:
        return _components(documents, k, percent, scratch)


def _components(documents: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    docs = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc_id", "text")
    rows = stored(docs.mapInArrow(_classes(k), "row long, doc_id long, n long, set long"), "ngram-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = stored(rows.filter("n > 0").groupBy("set").agg(first, F.max("n").alias("n"), F.count("*").alias("copies")), "ngram-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = min(20, max(3, (total // PART_TOKENS).bit_length()))
    blocks = docs.mapInArrow(_packed(k, bits), "part int, sets binary, counts binary, tokens binary")
    shared = blocks.groupBy("part").applyInArrow(_shared, "set long, token long, df long")
    lists = shared.groupBy("set").agg(F.collect_list(F.struct("df", "token")).alias("list")).join(classes.select("set", "n"), "set")
    p = F.expr(f"cast(n - floor(({percent} * n + 99) / 100) + 1 as int)")
    lists = lists.withColumn("keep", F.least(p - (F.col("n").cast("int") - F.size("list")), F.size("list"))).filter("keep > 0")
    order = lambda seed: F.slice(F.array_sort(F.transform("list", lambda x: F.struct(x["df"], F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"]))), 1, F.col("keep"))
    index = lists.select(F.col("set").alias("item"), (F.col("n") - F.size("list")).alias("weight"), *[F.transform(order(s), lambda x: x["token"]).alias(f"order{s}") for s in range(3)])
    index = stored(index, "ngram-index")
    members = index.select(F.explode("order0").alias("key"), "item", "weight")

    def narrow(x: str, y: str):
        return F.arrays_overlap(f"{x}order1", f"{y}order1") & F.arrays_overlap(f"{x}order2", f"{y}order2")

    def features(items: DataFrame) -> DataFrame:
        reps = stored(classes.join(items.select(F.col("item").alias("set")), "set").select(F.col("first.row").alias("row")), "ngram-reps")
        return by_rows(docs, reps).mapInArrow(_sets_of(k), "item long, tokens array<long>")

    links = verified_links(members, features, percent, index.select("item", "order1", "order2"), narrow)
    labels = connected(links)
    named = classes.join(labels.select(F.col("id").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("first").alias("keep"))
    named = stored(named.join(least, "component").select("set", "copies", "keep"), "ngram-named")
    found = join_hot(scratch.keep(rows), scratch.keep(named), "set", "copies", rows.count())
    return found.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"), F.coalesce("keep.row", "row").alias("keep_row"))


def deduplicated(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """The documents with one row of each component: the one of the least doc_id (then row). Rows without words all stay."""
    gone = stored(components(documents, k, percent).filter("row <> keep_row").select("row"), "ngram-gone")
    whole = numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")))
    kept = whole.join(F.broadcast(gone) if gone.count() <= share_limit else gone, "row", "left_anti")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in documents.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    """op9_ngram_join: components of all documents on 4-word shingles at 85 percent."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
