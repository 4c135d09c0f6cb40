"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs put every document labelled good before every one labelled bad; the weights w of the features minimise
the mean logistic loss log(1 + exp(-w . (f_good - f_bad))) of all these pairs, with a small ridge, by Newton steps. A document's strength is
w . f; the cut is a quantile of the training strengths, the one with the best training accuracy, and the score puts that
cut at ``CUT``: score = sigmoid(strength - quantile + logit(CUT)).

All labelled rows outside the held-out fold count, and all pairs of them: their features are stored once and each step reads them once. A pair's share of the gradient
depends on the difference of two strengths only and is smooth, so rows are summed by strength on a grid of ``FINE`` with cubic weights and the
pairs are taken grid point by grid point (relative error about 1e-7). The curvature only sets how fast the steps settle and uses cells of ``COARSE``.

Features come from the whole text only: shares of byte classes, word lengths, repetition of words, word pairs and
lines. Labels, language, source and ids are never features. Null and empty texts have features of zero and get a score
like any other. Labelled rows whose label is null are left out; of repeated labels for an id the lowest counts. Without labels
of both kinds every score is 0.5. Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .storage import Scratch, stored

RIDGE, CUT = 1e-3, 0.3
#: Steps of the grids of strengths.
FINE, COARSE = 1 / 16, 1 / 4
#: Labelled ids (8 bytes each) up to which the filter on documents goes to every task; beyond it features of all documents are joined.
SHARE_LIMIT = 1_000_000
#: Tasks of a step, and rows that one of them sums at once.
TASKS, ROWS = 32, 4096
#: Byte classes whose shares are features.
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b"#*$%&", b"|<>", b"!?", b".,;:", b"\"'()[]{}", b"@_=+/\\~^`-"]
FEATURES = len(GROUPS) + 1 + 8


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values each document has."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


_GROUP_OF = np.full(256, len(GROUPS), np.uint8)
for _i, _g in enumerate(GROUPS):
    _GROUP_OF[list(_g)] = _i
_LINES = tn.class_table(lambda b: b != 0x0A)
_LINES[0] = 0xFF


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each document of a chunk."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc_of = np.repeat(np.arange(n), size)
    shares = np.bincount(doc_of * (len(GROUPS) + 1) + _GROUP_OF[data], minlength=n * (len(GROUPS) + 1)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    words = tn.Words(data, offsets, tn.SPACE_WORDS)
    doc, count, h = words.doc(), np.diff(words.first), words.hashes()
    many = np.maximum(count, 1)
    length = (words.ends - words.starts).astype(np.float64)
    mean = np.bincount(doc, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / many - mean**2, 0))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pairs = tn.grams(h, 2)
    inside = doc[: len(pairs)] == doc[1:] if len(pairs) else np.zeros(0, bool)
    pair_doc = doc[: len(pairs)][inside]
    lines = tn.Words(data, offsets, _LINES)
    line_doc, n_lines = lines.doc(), np.diff(lines.first)
    return np.column_stack(
        [
            shares,
            np.log1p(count) / 10,
            mean / 20,
            spread / 20,
            np.bincount(doc[again], minlength=n) / many,
            1 - _distinct(pair_doc, pairs[inside], n) / np.maximum(np.bincount(pair_doc, minlength=n), 1),
            _distinct(doc, h, n) / many,
            1 - _distinct(line_doc, lines.hashes(), n) / np.maximum(n_lines, 1),
            (shares[:, 0] > 0.5 * (shares[:, 0] + shares[:, 1])).astype(float),
        ]
    )


def _features(batches):
    for batch in batches:
        data, offs = tn.buffers(batch.column("text"))
        for a, b, d, o in tn.chunks(data, offs):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(list(features(d, o)), pa.list_(pa.float64()))], ["doc_id", "features"])


def _training(batches):
    """(features, labels) of the rows of a training table, some at a time."""
    for batch in batches:
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for a in range(0, len(x), ROWS):
            yield x[a : a + ROWS], label[a : a + ROWS]


class Model:
    def __init__(self, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, cut: float | None):
        self.weights, self.mean, self.spread, self.cut = weights, mean, spread, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(1)  # row by row: equal texts have equal strengths

    def standard(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread).clip(-8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.full(len(x), 0.5)
        logit = (self.strength(x) - self.cut).clip(-30, 30) + np.log(CUT / (1 - CUT))
        p = 1 / (1 + np.exp(-logit))
        return np.where(self.strength(x) >= self.cut, np.maximum(p, CUT), np.minimum(p, np.nextafter(CUT, 0)))


def _by_cell(cell: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur and the sums of the rows of ``values`` in each."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[begin], np.add.reduceat(values[order], begin)


_UPPER = np.triu_indices(FEATURES)


def _sums(model: Model):
    """Sums by label and strength: of 1 and z at grid points (fine), of 1, z and the products of z in cells (coarse)."""

    def run(batches):
        total: dict[tuple[int, bool], np.ndarray] = {}
        for x, label in _training(batches):
            z = model.standard(x)
            s = model.strength(x)
            one = np.column_stack([np.ones(len(z)), z])
            left = np.floor(s / FINE)
            t = s / FINE - left
            weights = [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]
            point = np.concatenate([left + i for i in (-1, 0, 1, 2)]).astype(np.int64) * 2 + np.tile(label, 4)
            cell = np.round(s / COARSE).astype(np.int64) * 2 + label
            square = np.column_stack([one, z[:, _UPPER[0]] * z[:, _UPPER[1]]])
            for fine, keys, values in ((True, point, np.concatenate([one * v[:, None] for v in weights])), (False, cell, square)):
                for k, v in zip(*_by_cell(keys, values), strict=True):
                    if (int(k), fine) in total:
                        total[int(k), fine] += v
                    else:
                        total[int(k), fine] = v.copy()
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k // 2 for k, _ in keys], pa.int64()), pa.array([k % 2 for k, _ in keys], pa.int32()), pa.array([f for _, f in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))],
            ["place", "label", "fine", "sums"],
        )

    return run


def _moments(batches):
    n, first, second = np.zeros(2, np.int64), np.zeros(FEATURES), np.zeros(FEATURES)
    for x, label in _training(batches):
        n += np.bincount(label, minlength=2)
        first += x.sum(0)
        second += (x**2).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([first], pa.list_(pa.float64())), pa.array([second], pa.list_(pa.float64()))], ["bad", "good", "first", "second"])


def _total(found: pa.Table, fine: bool, label: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Strengths and sums of one grid and label, over all tasks."""
    mine = found.filter(pa.array((found["fine"].to_numpy() == fine) & (found["label"].to_numpy() == label)))
    place, sums = _by_cell(mine["place"].to_numpy(), np.array(mine["sums"].to_pylist()))
    return place * step, sums


def slope(found: pa.Table, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss of all pairs, from the sums of all tasks."""

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp((x[:, None] - y[None, :]).clip(-40, 40)))

    x, good = _total(found, True, 1, FINE)
    y, bad = _total(found, True, 0, FINE)
    pairs = good[:, 0].sum() * bad[:, 0].sum()
    p = below(x, y)
    gradient = -((p @ bad[:, 0]) @ good[:, 1:] - (good[:, 0] @ p) @ bad[:, 1:]) / pairs + RIDGE * weights
    x, good = _total(found, False, 1, COARSE)
    y, bad = _total(found, False, 0, COARSE)
    p = below(x, y)
    q = p * (1 - p)
    n = 1 + FEATURES
    cross = good[:, 1:n].T @ q @ bad[:, 1:n]
    own = np.zeros((FEATURES, FEATURES))
    own[_UPPER] = (q @ bad[:, 0]) @ good[:, n:] + (good[:, 0] @ q) @ bad[:, n:]
    own = np.triu(own) + np.triu(own, 1).T
    return gradient, (own - cross - cross.T) / pairs + RIDGE * np.eye(FEATURES)


def _strengths(model: Model):
    def run(batches):
        for x, label in _training(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(x)), pa.array(np.where(label == 0, 1, -1))], ["s", "gain"])

    return run


def _prefixes(batches):
    """Of a sorted partition: its first and last strength, total gain, the best gain of a beginning, its last strength and the one that follows."""
    first = last = at = after = best = None
    total, open_ = 0, False
    for batch in batches:
        s, gain = batch.column("s").to_numpy(), batch.column("gain").to_numpy()
        if not len(s):
            continue
        first = s[0] if first is None else first
        if open_:
            after, open_ = s[0], False
        sums = total + np.cumsum(gain)
        i = int(np.argmax(sums))
        if best is None or sums[i] > best:
            best, at, open_ = int(sums[i]), s[i], i + 1 == len(s)
            after = None if open_ else s[i + 1]
        total, last = int(sums[-1]), s[-1]
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "total": total, "best": best, "at": at, "after": after}], _PREFIX)


_PREFIX = pa.schema([("first", pa.float64()), ("last", pa.float64()), ("total", pa.int64()), ("best", pa.int64()), ("at", pa.float64()), ("after", pa.float64())])


def quantile(strengths: DataFrame) -> float:
    """The cut with the best accuracy among all those between different strengths; strengths: s and gain (1 for a bad row, -1 for a good one)."""
    each = strengths.groupBy("s").agg(F.sum("gain").alias("gain")).repartitionByRange("s").sortWithinPartitions("s")
    parts = sorted(each.mapInArrow(_prefixes, "first double, last double, total long, best long, at double, after double").toArrow().to_pylist(), key=lambda r: r["first"])
    before, best, cut = 0, 0, parts[0]["first"] - 1  # nothing is called bad
    for i, r in enumerate(parts):
        if before + r["best"] > best:
            best = before + r["best"]
            after = r["after"] if r["after"] is not None else parts[i + 1]["first"] if i + 1 < len(parts) else None
            cut = r["at"] + 1 if after is None else (r["at"] + after) / 2
        before += r["total"]
    return cut


def fit(rows: DataFrame) -> Model:
    """rows: a stored table of features and label (1 good, 0 bad); all of them count."""
    few = rows.select("features", "label").coalesce(TASKS)
    sums = few.mapInArrow(_moments, "bad long, good long, first array<double>, second array<double>").toArrow()
    bad, good = (int(sum(sums[c].to_pylist())) for c in ("bad", "good"))
    if not good or not bad:
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), np.ones(FEATURES), None)
    mean, square = (np.array(sums[c].to_pylist()).sum(0) / (good + bad) for c in ("first", "second"))
    spread = np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-6)
    model = Model(np.zeros(FEATURES), mean.round(12), spread.round(12), None)
    for _ in range(40):
        gradient, curvature = slope(few.mapInArrow(_sums(model), "place long, label int, fine boolean, sums array<double>").toArrow(), model.weights)
        step = np.linalg.solve(curvature, gradient)
        model.weights = model.weights - step / max(1.0, np.linalg.norm(step) / 5)
        if np.linalg.norm(step) < 1e-6:
            break
    model.weights = model.weights.round(8)  # the order of rows and tasks shows in later digits
    model.cut = quantile(few.mapInArrow(_strengths(model), "s double, gain long"))
    return model


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def train(documents: DataFrame, labels: DataFrame, share_limit: int = SHARE_LIMIT) -> Model:
    """Fit on all labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(documents.sparkSession):
        own = stored(own.groupBy("doc_id").agg(F.min("label").alias("label")), "ranking-labels")
        if own.count() <= share_limit:
            texts = texts.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")
        return fit(stored(texts.mapInArrow(_features, "doc_id long, features array<double>").join(own, "doc_id").select("features", "label"), "ranking-features"))


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            data, offs = tn.buffers(batch.column("text"))
            for a, b, d, o in tn.chunks(data, offs):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(model.score(features(d, o)))], ["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model), "doc_id long, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    """op7_ranking: every document scored by a model fitted on all labels outside the held-out fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
