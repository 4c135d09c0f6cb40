"""Repeated passages by MinHash banding of paragraphs.

A text's paragraphs are its lines of at least ``MIN_WORDS`` words. Paragraphs of equal words are one class. Classes get MinHash signatures of their word 5-shingles, with bands tuned by
``tune`` for the wanted recall at the threshold; colliding classes are verified by exact Jaccard similarity of the whole shingle sets, linked, and clustered by components.
Of each cluster with several paragraphs the first one (by doc_id, nulls last, then row, then place) stays and the others are removals.

Paragraph borders hide passages that are set into longer paragraphs or broken into short lines. So every run of ``SPAN`` or more words that occurs twice (in two rows, or twice without
overlap in one) is found besides, wherever it stands and however its lines break. Of ``SPAN``
words the least hash of their ``SEED``-word shingles is a seed (a MinHash of one row); equal runs have equal seeds, so only windows whose seed is repeated are hashed whole, and windows of equal hashes are
repeats. Repeated seeds go to the tasks as a bitmap, whose false hits only cost windows that turn out single. Neighbouring windows of one state and one first document make a span.
Spans inside a removed paragraph are not reported again, nor those that stay and lie in a repeated paragraph.

Null and empty texts have no paragraphs. Every row is a text of its own: rows that repeat, that share a doc_id or that have none are told apart by a number of the row.
Ties in place can't occur within a text. Texts may be of any length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as tn
from .components import connected, join_hot, verified_links
from .ngramjoin import by_rows
from .storage import Scratch, numbered, stored

SHINGLE, PERCENT, RECALL = 5, 80, 0.995
MIN_WORDS = 25
#: Words of a run that is found for certain, and of the shingles that seed it.
SPAN, SEED = 50, 20
#: Most bits of the bitmap of repeated seeds (64 MB), and bits in a row of it.
MAP_BITS, ROW_BITS = 29, 15
_U = np.uint64


def tune(percent: int = PERCENT, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(rows, bands): the fewest bands of so many rows that make a pair at the threshold collide with probability ``recall``."""
    return rows, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def units(data: np.ndarray, offsets: np.ndarray):
    """(words, word hashes, first word, end word, document) of a chunk's paragraphs."""
    words = tn.Words(data, offsets, tn.SPACE_WORDS)
    h, n = words.hashes(), len(words)
    if n == 0:
        e = np.zeros(0, np.int64)
        return words, h, e, e, e
    breaks = np.union1d(np.flatnonzero(data == 0x0A), offsets)
    line = np.searchsorted(breaks, words.starts, "right")
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    end = np.append(first[1:], n)
    whole = end - first >= MIN_WORDS
    return words, h, first[whole], end[whole], words.doc()[first[whole]]


def identities(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, inverse = tn.gram_prefix(h)
    return tn.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U)).view(np.int64)


def _units(batches):
    for batch in batches:
        ids, rows = batch.column("doc_id"), batch.column("row")
        data, offs = tn.buffers(batch.column("text"))
        for a, _, d, o in tn.chunks(data, offs):
            words, h, s, e, doc = units(d, o)
            points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
            base, who = points[o[doc]], pa.array(a + doc)
            places = [pa.array((points[x] - base).astype(np.int64)) for x in (words.starts[s], words.ends[e - 1])]
            yield pa.RecordBatch.from_arrays([rows.take(who), ids.take(who), *places, pa.array((e - s).astype(np.int32)), pa.array(identities(h, s, e))], ["row", "doc_id", "start", "end", "n_words", "unit"])
    tn.released()


def _seeds(n: int) -> np.ndarray:
    return np.random.RandomState(7).randint(1, 2**63, n, dtype=np.int64).astype(_U) | _U(1)


def _signatures(rows: int, bands: int):
    def run(batches):
        seeds, seen = _seeds(rows * bands), set()
        for batch in batches:
            data, offs = tn.buffers(batch.column("text"))
            for _, _, d, o in tn.chunks(data, offs):
                _, h, s, e, _ = units(d, o)
                ids = identities(h, s, e)
                fresh = np.array([i not in seen for i in ids.tolist()], bool)
                seen.update(ids[fresh].tolist())
                if len(seen) > 2_000_000:  # only saves repeated rows
                    seen.clear()
                s, e, ids = s[fresh], e[fresh], ids[fresh]
                if not len(s):
                    continue
                g = np.append(tn.grams(h, SHINGLE), _U(0))
                borders = np.empty(2 * len(s), np.int64)
                borders[::2], borders[1::2] = s, e - SHINGLE + 1  # a paragraph's shingles, then those up to the next one
                keys = np.empty((len(s), bands), _U)
                for j in range(bands):
                    low = [np.minimum.reduceat((g ^ (g >> _U(29))) * seeds[j * rows + r] >> _U(7), borders)[::2] for r in range(rows)]
                    key = np.full(len(s), j + 1, _U)
                    for x in low:
                        key = tn.mix(key * _U(0x9E3779B97F4A7C15) + x)
                    keys[:, j] = key
                flat = pa.array(keys.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, len(s) * bands + 1, bands, dtype=np.int32)), flat)], ["unit", "keys"])
        tn.released()

    return run


def _sets(batches):
    for batch in batches:
        data, offs = tn.buffers(batch.column("text"))
        for _, _, d, o in tn.chunks(data, offs):
            _, h, s, e, _ = units(d, o)
            ids, g = identities(h, s, e), tn.grams(h, SHINGLE)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([np.unique(g[a : b - SHINGLE + 1]).view(np.int64) for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.list_(pa.int64()))], ["unit", "tokens"])


def windows(data: np.ndarray, offsets: np.ndarray):
    """(words, first word, seed, whole hash) of every window of ``SPAN`` words within a document of a chunk."""
    words = tn.Words(data, offsets, tn.SPACE_WORDS)
    n = len(words) - SPAN + 1
    if n <= 0:
        return words, np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    prefix = tn.gram_prefix(words.hashes())
    seed, width, rest = tn.grams(words.hashes(), SEED, prefix), 1, SPAN - SEED + 1
    while width < rest:  # least of ``width`` shingles from each place
        step = min(width, rest - width)
        seed, width = np.minimum(seed[:-step], seed[step:]), width + step
    at = np.flatnonzero(np.arange(n) + SPAN <= words.first[1:][words.doc()[:n]])
    return words, at, seed[at], tn.grams(words.hashes(), SPAN, prefix)[at]


def _seeded(batches):
    for batch in batches:
        data, offs = tn.buffers(batch.column("text"))
        for _, _, d, o in tn.chunks(data, offs):
            words, at, seed, _ = windows(d, o)
            if not len(at):
                continue
            doc = words.doc()[at]
            new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]))
            runs = np.diff(np.append(new, len(seed)))
            found, inverse = np.unique(seed[new], return_inverse=True)
            # one place seeds SPAN - SEED + 1 windows at most: a longer run has several
            places = np.bincount(inverse, -(-runs // (SPAN - SEED + 1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(places)], ["seed", "n"])
    tn.released()


def _windowed(shared, bits: int, part_bits: int):
    """Runs of neighbouring windows of one repeated seed; steps of their borders and hashes are packed."""

    def run(batches):
        table = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row")
            data, offs = tn.buffers(batch.column("text"))
            for a, _, d, o in tn.chunks(data, offs):
                words, at, seed, whole = windows(d, o)
                slot = seed & _U((1 << bits) - 1)
                hit = (table[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1
                at, seed, whole = at[hit], seed[hit], whole[hit]
                if not len(at):
                    continue
                doc = words.doc()[at]
                points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
                start, end = points[words.starts[at]] - points[o[doc]], points[words.ends[at + SPAN - 1]] - points[o[doc]]
                ds, de = np.diff(start, prepend=0), np.diff(end, prepend=0)
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) != 1) | (seed[1:] != seed[:-1]) | (ds[1:] > 255) | (de[1:] > 255)
                head = np.flatnonzero(new)
                ds[head] = de[head] = 0
                edges = np.append(head, len(at))
                packed = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(edges * x.itemsize), pa.py_buffer(x)]).cast(pa.binary()) for x in (ds.astype(np.uint8), de.astype(np.uint8), np.ascontiguousarray(whole))]
                who = pa.array(a + doc[head])
                part = (tn.mix(seed[head]) >> _U(64 - part_bits)).astype(np.int32)
                places = [pa.array(x[head].astype(np.int64)) for x in (at - words.first[doc], start, end)]
                yield pa.RecordBatch.from_arrays([pa.array(part), rows.take(who), ids.take(who), *places, *packed], ["part", "row", "doc_id", "word", "start", "end", "starts", "ends", "hashes"])
        tn.released()

    return run


def _compared(table: pa.Table) -> pa.Table:
    """The repeated windows of one part of the seeds, neighbours of one state together."""
    joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    column = lambda c: table.column(c).to_numpy().astype(np.int64)
    known = np.asarray(table.column("doc_id").is_valid())
    ids = table.column("doc_id").combine_chunks().fill_null(-(2**63)).to_numpy()
    hashes = joined("hashes", np.uint64)
    n = np.array([len(x) for x in table.column("starts").to_pylist()], np.int64)
    head = np.cumsum(n) - n
    run = np.repeat(np.arange(len(n)), n)
    ds, de = (np.cumsum(joined(c, np.uint8), dtype=np.int64) for c in ("starts", "ends"))
    start, end = column("start")[run] + ds - ds[head][run], column("end")[run] + de - de[head][run]
    word, row, doc, known = column("word")[run] + np.arange(len(run)) - head[run], column("row")[run], ids[run], known[run]
    order = np.lexsort((word, row, start, doc, known, hashes))
    sorted_hashes = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])[: len(order)])
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    spread = lambda x: np.maximum.reduceat(x[order], heads) - np.minimum.reduceat(x[order], heads)
    first, several = np.empty(len(order), np.int64), np.empty(len(order), bool)
    first[order] = order[heads][group]
    several[order] = ((spread(row) > 0) | (spread(word) >= SPAN))[group]
    here = (doc == doc[first]) & (known == known[first]) & (start == start[first])
    removed = ~here & ~((row == row[first]) & (word - word[first] < SPAN))
    keep = np.where(removed, first, np.arange(len(order)))
    at = np.flatnonzero(several)
    k, r, gone = keep[at], run[at], removed[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (r[1:] != r[:-1]) | (gone[1:] != gone[:-1]) | (doc[k[1:]] != doc[k[:-1]]) | (known[k[1:]] != known[k[:-1]])
    begin = np.flatnonzero(new)
    a, b, k = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at, k[begin]
    tn.released()
    return pa.table({"row": row[a], "doc_id": pa.array(doc[a], mask=~known[a]), "word": word[a], "last": word[b], "start": start[a], "end": end[b], "keep_id": pa.array(doc[k], mask=~known[k]), "keep_start": start[k], "removed": removed[a]})


def _texts(documents: DataFrame) -> DataFrame:
    return numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def spans(documents: DataFrame) -> DataFrame:
    """Every run of ``SPAN`` or more words that occurs twice: row (its number), doc_id, start, end (code points), n_words, keep (doc_id and start of where it stays), removed."""
    with Scratch(documents.sparkSession) as scratch:
        return scratch.keep(_spans(documents))


def _spans(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    docs = _texts(documents)
    seeds = stored(docs.mapInArrow(_seeded, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed"), "span-seeds")
    bits = min(MAP_BITS, max(ROW_BITS, (16 * seeds.count()).bit_length()))
    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    table = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << ROW_BITS - 3
    made = seeds.groupBy(F.shiftright(slot, ROW_BITS).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits"))
    for r in made.toLocalIterator():
        table[r["at"] * size : (r["at"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table)
    parts = min(20, max(3, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))
    found = docs.mapInArrow(_windowed(shared, bits, parts), "part int, row long, doc_id long, word long, start long, end long, starts binary, ends binary, hashes binary")
    each = stored(found.groupBy("part").applyInArrow(_compared, "row long, doc_id long, word long, last long, start long, end long, keep_id long, keep_start long, removed boolean"), "span-parts")
    shared.unpersist()
    order = Window.partitionBy("row").orderBy("word")
    before = lambda c: F.lag(c).over(order)
    new = before("word").isNull() | (before("last") + 1 != F.col("word")) | (before("removed") != F.col("removed")) | ~before("keep_id").eqNullSafe(F.col("keep_id"))
    each = each.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    words = (F.max("last") - F.min("word") + SPAN).cast("int").alias("n_words")
    keep = F.min_by(F.struct(F.col("keep_id").alias("doc_id"), F.col("keep_start").alias("start")), "word").alias("keep")
    runs = each.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), words, keep, F.first("removed").alias("removed"))
    return stored(runs.drop("run"), "spans")


def clusters(documents: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """The repeated passages: row (its number), doc_id, start, end (code points), n_words, first_doc_id, first_start (the passage of the cluster that stays), removed."""
    with Scratch(documents.sparkSession) as scratch:
        return _clusters(documents, percent, recall, scratch)


def _clusters(documents: DataFrame, percent: int, recall: float, scratch: Scratch) -> DataFrame:
    long = scratch.keep(spans(documents))
    docs = _texts(documents)
    found = stored(docs.mapInArrow(_units, "row long, doc_id long, start long, end long, n_words int, unit long"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    classes = stored(found.groupBy("unit").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "unit-classes")
    rows, bands = tune(percent, recall)
    keys = docs.mapInArrow(_signatures(rows, bands), "unit long, keys array<long>")
    keys = stored(keys.groupBy("unit").agg(F.first("keys").alias("keys")), "unit-keys")
    members = keys.select(F.explode("keys").alias("key"), F.col("unit").alias("item"), F.lit(0).cast("long").alias("weight"))

    def features(items: DataFrame) -> DataFrame:
        named = items.select(F.col("item").alias("unit"))
        reps = stored(classes.join(named, "unit").select(F.col("first.row").alias("row")).distinct(), "unit-docs")
        sets = by_rows(docs, reps).mapInArrow(_sets, "unit long, tokens array<long>").join(named, "unit", "left_semi")
        return sets.groupBy(F.col("unit").alias("item")).agg(F.first("tokens").alias("tokens"))

    labels = connected(verified_links(members, features, percent))
    named = classes.join(labels.select(F.col("id").alias("unit"), "component"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    groups = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("units")).filter("units > 1")
    named = stored(named.join(groups, "component").select("unit", "copies", "keep"), "unit-named")
    repeated = stored(join_hot(found, named, "unit", "copies", found.count()).filter("keep is not null"), "unit-repeated")
    scratch.keep(repeated)
    away = ~((F.col("row") == F.col("keep.row")) & (F.col("start") == F.col("keep.start")))
    whole = repeated.select("row", "doc_id", "start", "end", "n_words", F.struct("keep.doc_id", "keep.start").alias("keep"), away.alias("removed"))
    inside = (F.col("x.row") == F.col("y.row")) & (F.col("x.start") >= F.col("y.start")) & (F.col("x.end") <= F.col("y.end"))
    told = inside & (F.col("y.removed") | ~F.col("x.removed"))
    out = whole.unionByName(long.alias("x").join(whole.select("row", "start", "end", "removed").alias("y"), told, "left_anti"))
    return out.select("row", "doc_id", "start", "end", "n_words", F.col("keep.doc_id").alias("first_doc_id"), F.col("keep.start").alias("first_start"), "removed")


def op8(spark, sf_dir: str) -> DataFrame:
    """op8_paragraphs: the repeated passages of all documents."""
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
