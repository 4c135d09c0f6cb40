"""Benchmark decontamination by winnowing.

Documents and benchmark items are split into words; k-word hashes are winnowed (a hash is kept where it is the
minimum of some window of w consecutive hashes), fingerprints of both sides are joined, and every hit is extended to the windows of 13 words
around it. With k + w - 1 = 13 any span of 13 shared words holds a kept hash at the same
place on both sides, so no shared span of that length is lost. An item of fewer than 13 words is one window of its
own length n; such lengths get their own tier with k + w - 1 = n. A window around a hit occurs in the benchmark if its own 64-bit hash does too, so that
two hashes have to agree, and a long run of one word costs its length and not its product with the other side's.

Nulls and empty texts have no words and no hits. Every row is a document of its own, also if it repeats or has no doc_id; benchmark items without words match
nothing; rows of one item_id are one item with several texts; items without an id give hits but no name. Texts may be of any length; extra columns of either table are ignored
(``decontaminated`` keeps those of documents, whatever their names); an empty table gives no rows, an empty benchmark no hits.

The benchmark's hashes are shared with all tasks as sorted arrays while their counted number stays below ``share_limit``;
beyond it both sides' fingerprints, then windows, are joined by shuffles, with equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .storage import Scratch, numbered, stored

WINDOW = 13
#: Windows of the benchmark up to which its hashes go to every task: 20 bytes for each window, 8 for each fingerprint.
SHARE_LIMIT = 4_000_000
#: Row numbers (8 bytes each) up to which the rows to be removed go to every task.
REMOVED_LIMIT = 1_000_000
_U = np.uint64


def tier(n: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = n: half the guaranteed span goes to the hash, half to the window."""
    k = (n + 1) // 2
    return k, n - k + 1


def selected(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints that winnowing keeps for guaranteed span n; doc: each word's document."""
    k, w = tier(n)
    g = tn.grams(hashes, k)
    if len(g) == 0:
        return np.zeros(0, np.int64), g
    inside = doc[: len(g)] == doc[k - 1 :]
    span = len(hashes) - n + 1
    if span <= 0:
        return np.zeros(0, np.int64), g[:0]
    whole = doc[:span] == doc[n - 1 :]  # windows within one document
    low, size = g, 1
    while size < w:
        step = min(size, w - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    low = np.where(whole, low[:span], _U(0))
    keep = np.zeros(len(g), bool)
    for j in range(w):  # kept: the minimum of any window that covers it
        keep[j : j + span] |= whole & (low == g[j : j + span])
    at = np.flatnonzero(keep & inside)
    return at, g[at]


def _hashed(lengths: list[int] | None, what: str):
    """mapInArrow body: (id, span, hash, pos) of the kept fingerprints or of all windows; lengths None: a row's own span."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            data, offs = tn.buffers(batch.column("text"))
            for a, _, d, o in tn.chunks(data, offs):
                words = tn.Words(d, o, tn.ALNUM_WORDS)
                h, doc, counts = words.hashes(), words.doc(), np.diff(words.first)
                for n in lengths if lengths is not None else sorted({min(WINDOW, int(c)) for c in counts if c}):
                    at, g = selected(h, doc, n) if what == "prints" else windows(h, doc, n)
                    if lengths is None:
                        own = np.minimum(counts, WINDOW)[doc[at]] == n
                        at, g = at[own], g[own]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + doc[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(g.view(np.int64)), pa.array((at - words.first[doc[at]]).astype(np.int32))], ["id", "span", "hash", "pos"])
        tn.released()

    return run


HASHED = "id long, span int, hash long, pos int"


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of n words within a document."""
    g = tn.grams(hashes, n)
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    return at, g[at]


def around(hit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """First words of the windows of n words that hold a fingerprint at one of the places ``hit``."""
    k, _ = tier(n)
    span = len(doc) - n + 1
    if span <= 0 or not len(hit):
        return np.zeros(0, np.int64)
    steps = np.zeros(span + 1, np.int64)
    np.add.at(steps, np.maximum(hit - (n - k), 0), 1)
    np.add.at(steps, np.minimum(hit, span - 1) + 1, -1)
    at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    return at[doc[at] == doc[at + n - 1]]


def found_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Index:
    """The benchmark's hashes by span: sorted fingerprints, sorted window hashes, and the items of each window."""

    def __init__(self, prints: pa.Table, wins: pa.Table):
        self.names = sorted(set(wins["id"].to_pylist()) - {None})
        ids = wins["id"].combine_chunks()
        known = np.asarray(ids.is_valid())
        item = np.where(known, np.searchsorted(np.array(self.names, np.int64), ids.fill_null(0).to_numpy()), -1).astype(np.int32)
        span, hashes = wins["span"].to_numpy(), wins["hash"].to_numpy().view(_U)
        self.spans = {}
        for n in sorted(set(span.tolist())):
            h, i = hashes[span == n], item[span == n]
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            slots, first = np.unique(h, return_index=True)
            self.spans[n] = np.unique(prints["hash"].to_numpy().view(_U)[prints["span"].to_numpy() == n]), slots, np.append(first, len(h)), i

    def hits(self, h: np.ndarray, doc: np.ndarray):
        """For each span: (span, first words of occurring windows, their slots)."""
        for n, (prints, slots, _, _) in self.spans.items():
            at, g = selected(h, doc, n)
            start = around(at[found_in(g, prints)], doc, n)
            if len(start):
                g = tn.grams(h, n)[start]
                sure = found_in(g, slots)
                yield n, start[sure], np.searchsorted(slots, g[sure])

    def items(self, n: int, doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item) of the windows that documents hold."""
        _, _, first, item = self.spans[n]
        pairs = np.unique(np.column_stack([doc, slot]), axis=0)
        size = np.diff(first)[pairs[:, 1]]
        places = np.repeat(first[:-1][pairs[:, 1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.column_stack([np.repeat(pairs[:, 0], size), item[places]])
        return np.unique(out[out[:, 1] >= 0], axis=0)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any of the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def merged(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """For each document the runs of hit words (a, b), counted from its first word."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], hit])[: len(hit)]
    after = np.concatenate([hit, [False]])[1:]
    a = np.flatnonzero(hit & (~before | edge[:-1]))
    b = np.flatnonzero(hit & (~after | edge[1:])) + 1
    doc = np.searchsorted(first, a, "right") - 1
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True):
        out[d].append({"a": x - int(first[d]), "b": y - int(first[d])})
    return out


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
RESULT = "row long, doc_id long, n_words long, n_hit long, items array<long>, ranges array<struct<a:int,b:int>>"


def _result(batch, a: int, b: int, words: tn.Words, hit: np.ndarray, items: list[list[int]]):
    counts = np.diff(words.first)
    n_hit = np.bincount(words.doc()[hit], minlength=b - a).astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(n_hit), pa.array(items, pa.list_(pa.int64())), pa.array(merged(hit, words.first), RANGES)], ["row", "doc_id", "n_words", "n_hit", "items", "ranges"])


def _scan(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            data, offs = tn.buffers(batch.column("text"))
            for a, b, d, o in tn.chunks(data, offs):
                words = tn.Words(d, o, tn.ALNUM_WORDS)
                h, doc = words.hashes(), words.doc()
                hit, named = np.zeros(len(words), bool), [set() for _ in range(b - a)]
                for n, start, slot in index.hits(h, doc):
                    hit |= covered(start, start + n, len(words))
                    for k, i in index.items(n, doc[start], slot).tolist():
                        named[k].add(index.names[i])
                yield _result(batch, a, b, words, hit, [sorted(x) for x in named])
        tn.released()

    return run


def _candidates(batches):
    """(row, span, hash, pos) of the windows around the hits (span, pos) of a document."""
    for batch in batches:
        data, offs = tn.buffers(batch.column("text"))
        for i, found in enumerate(batch.column("found").to_pylist()):
            words = tn.Words(data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i], tn.ALNUM_WORDS)
            h, doc = words.hashes(), words.doc()
            for n in sorted({x["span"] for x in found}):
                start = around(np.array(sorted(x["pos"] for x in found if x["span"] == n), np.int64), doc, n)
                if len(start):
                    g = tn.grams(h, n)[start].view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(np.full(len(start), i))), pa.array(np.full(len(start), n, np.int32)), pa.array(g), pa.array(start.astype(np.int32))], ["row", "span", "hash", "pos"])


def _gathered(batches):
    for batch in batches:
        data, offs = tn.buffers(batch.column("text"))
        places, items = batch.column("places"), batch.column("items").to_pylist()
        for i in range(batch.num_rows):
            words = tn.Words(data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i], tn.ALNUM_WORDS)
            at = [(x["pos"], x["span"]) for x in places[i].as_py() or []]
            start = np.array([p for p, _ in at], np.int64)
            yield _result(batch, i, i + 1, words, covered(start, start + np.array([n for _, n in at], np.int64), len(words)), [sorted(items[i] or [])])


def contamination(documents: DataFrame, benchmark: DataFrame, share_limit: int = SHARE_LIMIT) -> DataFrame:
    """One row for each document: row (its number), doc_id, n_words, n_hit, items (with occurring windows), ranges (runs of hit words)."""
    docs = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc_id", "text")
    bench = benchmark.select(F.col("item_id").cast("long").alias("id"), "text")
    prints = stored(bench.mapInArrow(_hashed(None, "prints"), HASHED).select("span", "hash").distinct(), "bench-prints")
    wins = stored(bench.mapInArrow(_hashed(None, "windows"), HASHED).select("id", "span", "hash").distinct(), "bench-windows")
    if wins.count() <= share_limit:
        return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(Index(prints.toArrow(), wins.toArrow()))), RESULT)
    lengths = sorted(r["span"] for r in wins.select("span").distinct().collect())  # at most 13 values
    own = docs.select(F.col("row").alias("id"), "text").mapInArrow(_hashed(lengths, "prints"), HASHED).withColumnRenamed("id", "row")
    hits = own.join(prints, ["span", "hash"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("span", "pos")).alias("found"))
    near = stored(docs.select("row", "text").join(hits, "row").mapInArrow(_candidates, "row long, span int, hash long, pos int"), "bench-near")
    places = near.join(wins.select("span", "hash").distinct(), ["span", "hash"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("pos", "span")).alias("places"))
    named = near.select("row", "span", "hash").distinct().join(wins.filter("id is not null"), ["span", "hash"]).groupBy("row").agg(F.collect_set("id").alias("items"))
    return docs.join(places, "row", "left").join(named, "row", "left").mapInArrow(_gathered, RESULT)


def too_much():
    """The contract's rule: a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdict(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``'s rows."""
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), too_much().alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, share_limit: int = SHARE_LIMIT, removed_limit: int = REMOVED_LIMIT) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    with Scratch(documents.sparkSession) as scratch:
        gone = scratch.keep(stored(contamination(documents, benchmark, share_limit).filter(too_much()).select("row"), "bench-gone"))
        small = gone.count() <= removed_limit
    whole = numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")))
    kept = whole.join(F.broadcast(gone) if small else gone, "row", "left_anti")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in documents.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    """op4_winnowing: every document against the whole benchmark."""
    return verdict(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
