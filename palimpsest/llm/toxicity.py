"""Toxicity as multiple-instance learning: sentences are scored, documents carry the labels.

A text is cut into sentences after ``.``, ``!``, ``?`` and at line ends. A sentence's features are the distinct hash
buckets of its lower-cased words and of their beginnings of 4 to 6 bytes. Its score is a logistic function of the summed weights;
the text's score is the noisy-or of its sentences, 1 - prod(1 - p). Weights are learned by gradient steps on the
likelihood of the document labels alone, so the model itself finds which sentences carry a label. Each step hides a share
``HIDDEN`` of the features: a sentence is then recognised by a part of its words too.

The model is fitted on at most ``FIT_ROWS`` labelled rows of each label, those with the smallest hash of their id: a
documented bound, so the learner's input does not grow. Scoring covers every sentence of every whole text.

Null and empty texts have no sentence and score 0, as does everything when no row of label 1 is known. Labels other
than 0 and 1 are not learned from. Several labels of one document are learned each for itself. Repeated rows are scored
each for itself. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import texts

BUCKETS = 1 << 18  # weights of the model
FIT_ROWS = {0: 4000, 1: 2000}  # labelled rows of each label that the model is fitted on, at most
SUPPORT = 5  # a feature of fewer of those rows has no weight
STEPS = 700  # of BATCH rows each
BATCH = 256
BIAS = -10.0  # a sentence begins as clean: long texts have thousands of them
HIDDEN = 0.35  # share of the features that a step does not see
PREFIXES = (4, 5, 6)  # bytes

_STOPS = np.zeros(256, bool)
_STOPS[[ord("."), ord("!"), ord("?")]] = True
_LINE_ENDS = np.zeros(256, bool)
_LINE_ENDS[[10, 13]] = True


def featurize(column: pa.Array) -> tuple[texts.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the first word of each sentence; per feature its sentence and its bucket, distinct within a sentence."""
    words = texts.Words(column)
    n = len(words.hashes)
    opens = np.zeros(n, bool)
    opens[words.of[:-1][words.of[:-1] < words.of[1:]]] = True
    if n:
        ends_sentence = _STOPS[words.data[words.end - 1]]
        breaks = np.concatenate([[0], np.cumsum(_LINE_ENDS[words.data])])
        opens[1:] |= ends_sentence[:-1] | (breaks[words.start[1:]] > breaks[words.end[:-1]])
    first = np.flatnonzero(opens)
    sentence = np.cumsum(opens) - 1
    # A word's trailing punctuation is no part of it; a word of punctuation alone is left as it is.
    end = words.end.copy()
    for _ in range(6):
        trailing = (end - words.start > 1) & _PUNCTUATION[words.data[end - 1]] if n else np.empty(0, bool)
        end = end - trailing
    whole = words.prefix_hashes(end) % np.uint64(BUCKETS)
    buckets = [whole]
    for size in PREFIXES:
        short = words.prefix_hashes(np.minimum(end, words.start + size))
        buckets.append(texts.mix(short + np.uint64(size)) % np.uint64(BUCKETS))
    pairs = np.unique(np.concatenate([sentence] * len(buckets)).astype(np.uint64) * np.uint64(BUCKETS)
                      + np.concatenate(buckets))
    return words, first, (pairs // np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _sentence_scores(weights: np.ndarray, bias: float, sentence: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(sentence, weights[bucket], n) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample_labels(labels: DataFrame, ident: str = "doc_id", label: str = "label") -> DataFrame:
    """id and label of at most FIT_ROWS[label] rows of ``labels`` of each label, those with the smallest hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).select(
        F.col(ident).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = [known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS[value])
              for value in (0, 1)]
    return chosen[0].union(chosen[1])


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text",
        label: str = "label") -> np.ndarray | None:
    """Weights of all buckets and, last, the bias; None where no row of label 1 or none of label 0 is given.

    The sampled labels, bounded by FIT_ROWS, are broadcast to the texts; their features meet in one task that fits.
    """
    given = docs.select(docs[ident].alias("id"), docs[text].cast("string").alias("text")).filter(
        F.col("text").isNotNull()).join(F.broadcast(sample_labels(labels, ident, label)), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch):
                words, first, sentence, bucket = featurize(piece.column("text"))
                of = np.searchsorted(first, words.of)  # sentences of each text
                at = np.searchsorted(sentence, of)
                rows = [(sentence[a:b] - s).astype(np.int32).tobytes() for a, b, s in zip(at, at[1:], of)]
                cols = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), pa.array(np.diff(of), pa.int32()),
                     pa.array(rows, pa.binary()), pa.array(cols, pa.binary())], ["label", "n", "sentence", "bucket"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist() if r["n"]]
        rows.sort(key=lambda r: (r["label"], r["bucket"], r["sentence"]))  # whatever order the rows came in
        found = np.array([r["label"] for r in rows], float)
        if len(found) and found.min() != found.max():
            yield pa.RecordBatch.from_pydict({"weights": [_descend(rows, found).tobytes()]})
    featured = given.mapInArrow(features, "label int, n int, sentence binary, bucket binary")
    learned = featured.repartition(1).mapInArrow(descend, "weights binary").collect()
    return np.frombuffer(learned[0]["weights"]) if learned else None


def _descend(rows: list, labels: np.ndarray) -> np.ndarray:
    """Adaptive gradient steps on the noisy-or likelihood, a few hundred documents at a time, both labels alike."""
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    weights[-1] = BIAS
    seen = np.zeros(BUCKETS, np.int64)
    for r in rows:
        seen[np.unique(np.frombuffer(r["bucket"], np.int32))] += 1
    data = []
    for r in rows:
        sentence, bucket = np.frombuffer(r["sentence"], np.int32), np.frombuffer(r["bucket"], np.int32)
        known = seen[bucket] >= SUPPORT
        data.append((sentence[known], bucket[known], r["n"]))
    random = np.random.Generator(np.random.Philox(7))
    parts = max(1, len(data) // BATCH)
    for _ in range(-(-STEPS // parts)):
        for chosen in np.array_split(random.permutation(len(data)), parts):
            sizes = np.array([data[i][2] for i in chosen])
            base = np.concatenate([[0], np.cumsum(sizes)])
            sentence = np.concatenate([data[i][0] + base[k] for k, i in enumerate(chosen)])
            bucket = np.concatenate([data[i][1] for i in chosen])
            # A part of the features is hidden at each step, so that no sentence needs all of its words to be recognised.
            shown = random.random(len(bucket)) >= HIDDEN
            sentence, bucket = sentence[shown], bucket[shown]
            p = _sentence_scores(weights[:-1], weights[-1], sentence, bucket, base[-1])
            log_clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), base[:-1])
            clean = np.exp(log_clean)
            y = labels[chosen]
            # d(likelihood)/dz of a sentence: -p where the document is clean, p * clean / (1 - clean) where it is not
            pull = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
            slope = np.repeat(pull, sizes) * p / len(chosen)
            gradient = np.bincount(bucket, slope[sentence], BUCKETS) - 1e-5 * weights[:-1]
            gradient = np.append(gradient, slope.sum())
            squares += gradient ** 2
            weights += 0.5 * gradient / np.sqrt(squares) * (np.abs(gradient) > 0)
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``ident``, ``score`` and the sentence that offends most, where the text has a word:
    its code-point bounds ``worst_start`` and ``worst_end`` and its own score ``worst_score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch):
                words, first, sentence, bucket = featurize(piece.column("text"))
                of = np.searchsorted(first, words.of)
                if weights is None:
                    p = np.zeros(len(first))
                else:
                    p = _sentence_scores(weights[:-1], weights[-1], sentence, bucket, len(first))
                log_clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
                total = 1 - np.exp(np.minimum(log_clean[of[1:]] - log_clean[of[:-1]], 0))
                out = [None if a == b else int(a + p[a:b].argmax()) for a, b in zip(of.tolist(), of[1:].tolist())]
                letter = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before a byte
                last = np.append(first[1:], len(words.hashes)) - 1
                starts, ends = [], []
                for row, k in enumerate(out):
                    head = letter[words.bounds[row]]
                    starts.append(None if k is None else int(letter[words.start[first[k]]] - head))
                    ends.append(None if k is None else int(letter[words.end[last[k]]] - head))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(total), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                     pa.array([None if k is None else float(p[k]) for k in out], pa.float64())],
                    ["id", "score", "worst_start", "worst_end", "worst_score"])
    given = docs.select(docs[ident].alias("id"), docs[text].cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double, worst_start bigint, "
                                 "worst_end bigint, worst_score double").withColumnRenamed("id", ident)
