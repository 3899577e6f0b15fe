"""Document quality: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Each whole text becomes ``len(STATISTICS)`` numbers: size, shares of kinds of bytes, and how words repeat. Cosines of
random projections of the standardised numbers approximate a Gaussian kernel. Ridge weights come from the normal
equations: each partition of labelled texts sums its products, and the sums of all partitions meet row by row. The
equations are kept per fold, so each labelled text is also scored by weights that it was not in; an isotonic fit of the
labels on those scores turns a score into a share of good texts.

All labelled rows are learned from; means and spreads are those of all texts. What reaches the driver is bounded by the
parameters: FOLDS * FEATURES rows of the equations and one row for each of STEPS score steps.

Null and empty texts have the statistics of a text without bytes and are scored by them. Labels other than 0 and 1 are
not learned from; several labels of one id are learned each for itself. With labels of one kind only, every score is
that label; with none, 0. Repeated rows are scored each for itself. An empty table gives an empty result. Other columns
of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import texts
from palimpsest.llm.jaccard import written

FEATURES = 256  # random Fourier features, besides a constant
WIDTH = 0.5  # the kernel's, as a share of the root of the number of statistics
RIDGE = 0.1
FOLDS = 3
STEPS = 1 << 14  # of scores from -1 to 2, for the isotonic fit
FAR = 6.0  # spreads from the mean beyond which a statistic counts as this far

STATISTICS = ("bytes", "words", "lines", "word_bytes", "distinct", "repeats", "symbol_ends", "double_stops", "stop_ends",
              "long_words", "lower", "upper", "digit", "stop", "comma", "symbol", "line_end", "blank", "other")
KINDS = 9
_KIND = np.full(256, 8, np.int32)  # bytes of other scripts and control bytes
_KIND[33:127] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[*b".!?"]], _KIND[[*b",;:'\"-()"]], _KIND[[10, 13]], _KIND[[32, 9]] = 3, 4, 6, 7


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; shares are logarithms, so that rare things tell apart too."""
    words = texts.Words(column)
    n, data = len(column), words.data
    n_bytes, n_words = np.diff(words.bounds), np.diff(words.of)
    kinds = np.bincount(np.repeat(np.arange(n) * KINDS, n_bytes) + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    text = np.repeat(np.arange(n), n_words)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n) / np.maximum(n_words, 1)
    _, once = np.unique(texts.mix(words.hashes ^ texts.mix(text.astype(np.uint64))), return_index=True)
    length = words.end - words.start
    again = np.zeros(len(text), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    last = _KIND[data[words.end - 1]] if len(text) else np.empty(0, np.int32)
    doubled = (length > 1) & (last == 3)
    doubled[doubled] = _KIND[data[words.end[doubled] - 2]] == 3
    distinct = np.bincount(text[once], minlength=n) / np.maximum(n_words, 1)
    shares = [per_word(again), per_word(last == 5), per_word(doubled), per_word(last == 3), per_word(length > 20)]
    shares += list((kinds / np.maximum(n_bytes, 1)[:, None]).T)
    return np.stack([np.log1p(n_bytes), np.log1p(n_words), np.log1p(kinds[:, 6]),
                     np.bincount(text, length, n) / np.maximum(n_words, 1), distinct,
                     *[np.log1p(200 * s) for s in shares]], 1)


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``fold`` (the same for equal texts) and ``stats`` of each row."""
    given = docs.select(docs[ident].alias("id"), F.pmod(F.xxhash64(docs[text].cast("string")), F.lit(FOLDS)).cast("int").alias(
        "fold"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch):
                rows = statistics(piece.column("text")).astype(np.float32)
                stats = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("fold"), stats], ["id", "fold", "stats"])
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fold int, stats binary")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float32).reshape(
        batch.num_rows, len(STATISTICS)).astype(float)


@dataclass(frozen=True)
class Kernel:
    """Standardisation and random projections: an approximate feature map of a Gaussian kernel."""
    mean: np.ndarray
    spread: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        random = np.random.Generator(np.random.Philox(11))
        turn = random.standard_normal((len(STATISTICS), FEATURES)) / (WIDTH * np.sqrt(len(STATISTICS)))
        shift = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.spread, -FAR, FAR)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(z), 1))])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    at: np.ndarray  # scores and the shares of good texts there
    share: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.kernel.features(stats) @ self.weights, self.at, self.share)


def standardise(measured: DataFrame) -> Kernel | None:
    """Mean and spread of each statistic over all rows."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(STATISTICS)))
        for batch in batches:
            rows = _rows(batch)
            total += [np.full(len(STATISTICS), len(rows)), rows.sum(0), (rows ** 2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(STATISTICS)), pa.int32()), *map(pa.array, total)],
                                         ["of", "n", "s", "q"])
    found = measured.select("stats").mapInArrow(sums, "of int, n double, s double, q double").groupBy("of").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("of").collect()
    if not found or not found[0].n:
        return None
    n, s, q = np.array([(r.n, r.s, r.q) for r in found]).T
    return Kernel(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-6)))


def normal_equations(learning: DataFrame, kernel: Kernel) -> np.ndarray:
    """Per fold the matrix of products of features, with one more column for their products with the label."""
    width = FEATURES + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            fold, label = batch.column("fold").to_numpy(), batch.column("label").to_numpy().astype(float)
            z = kernel.features(_rows(batch))
            for k in range(FOLDS):
                own = fold == k
                sums[k] += z[own].T @ np.hstack([z[own], label[own, None]])
        if sums.any():
            # Products are symmetric: row i begins at column i.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(FOLDS, dtype=np.int32), width)),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), FOLDS)),
                 pa.array([sums[k, i, i:].tobytes() for k in range(FOLDS) for i in range(width)], pa.binary())],
                ["fold", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.column("row").to_pylist())  # one order of summation, whatever order the rows came in
        total = np.sum([np.frombuffer(r) for r in rows], 0)
        return table.slice(0, 1).set_column(2, "row", pa.array([total.tobytes()], pa.binary()))
    schema = "fold int, i int, row binary"
    parts = learning.select("fold", "label", "stats").mapInArrow(products, schema)
    out = np.zeros((FOLDS, width, width + 1))
    for r in parts.groupBy("fold", "i").applyInArrow(add, schema).collect():
        out[r.fold, r.i, r.i:] = np.frombuffer(r.row)
    for k in range(FOLDS):
        square = out[k, :, :width]
        out[k, :, :width] = square + np.triu(square, 1).T
    return out


def _solve(sums: np.ndarray) -> np.ndarray:
    return np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(len(sums)), sums[:, -1])


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing shares nearest to good / total in squares weighted by total: neighbours that fall are pooled."""
    blocks: list[list[float]] = []  # number of rows, of good ones, of places
    for n, y in zip(total.tolist(), good.tolist()):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, y, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + y, blocks[-1][2] + size]
    return np.repeat([y / n for n, y, _ in blocks], [int(size) for *_, size in blocks])


def fit(measured: DataFrame, labels: DataFrame, ident: str = "doc_id", label: str = "label") -> Model | None:
    """A model from ``measured`` texts and ``labels``; None where no labelled text is known."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).select(
        F.col(ident).alias("id"), F.col(label).cast("int").alias("label"))
    learning = written(measured.join(known, "id").select("fold", "label", "stats"), "learning")
    kernel = standardise(measured)
    if kernel is None:
        return None
    sums = normal_equations(learning, kernel)
    if not sums.any():
        return None
    apart = np.stack([_solve(sums.sum(0) - sums[k]) for k in range(FOLDS)])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = (kernel.features(_rows(batch)) * apart[batch.column("fold").to_numpy()]).sum(1)
            step = ((np.clip(scores, -1, 2) + 1) / 3 * (STEPS - 1)).round().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("label")], ["step", "label"])
    counted = learning.mapInArrow(steps, "step int, label int").groupBy("step").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("step").collect()
    step, n, good = np.array([(r.step, r.n, r.good) for r in counted], float).T
    share = isotonic(n, good)
    # A block stands at the middle of its rows; between blocks the share rises in a line, so scores keep their order.
    edge = np.flatnonzero(np.concatenate([[True], np.diff(share) > 0]))
    at = np.add.reduceat(step * n, edge) / np.add.reduceat(n, edge) / (STEPS - 1) * 3 - 1
    return Model(kernel, _solve(sums.sum(0)), at, share[edge])


def score(measured: DataFrame, model: Model | None, ident: str = "doc_id") -> DataFrame:
    """``ident`` and ``score`` of each measured row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows) if model is None else model.score(_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])
    given = measured.select("id", "stats")
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double").withColumnRenamed(
        "id", ident)
