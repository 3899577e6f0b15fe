"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is bound into one vector: the first letter's
vector permuted twice times the second's permuted once times the third's. A text is the bundle, the sum, of the
vectors of all its trigrams; runs of anything but letters count as one blank, and case is folded. A language's
prototype is the bundle of its learning texts. A text takes the language whose prototype has the largest cosine with
the text's bundle.

Bundles are whole numbers, so prototypes do not depend on partitions or on the order of rows. Prototypes are one
vector per language and dimension: a table that does not grow with the corpus.

Null texts and texts without a letter are ``und`` with score 0; so is everything when no labelled text is given. Ties
go to the language that sorts first. Repeated rows are predicted each for itself and learned each once. Texts are
read whole, one at a time. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import texts

DIMENSIONS = 512
SEED = 20
FLOOR = 0.4  # a text under this share of a language's own mean trigram, for every language, is like no language
NOISE = 2.0  # standard deviations of chance that a text is allowed under the floor
_TRIGRAMS_AT_ONCE = 4096
_ITEMS: dict[int, np.ndarray] = {}
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def item(code: int) -> np.ndarray:
    """The random vector of a code point; the same in every process."""
    if code not in _ITEMS:
        bits = np.random.Generator(np.random.Philox(key=(SEED << 32) + code)).integers(0, 2, DIMENSIONS)
        _ITEMS[code] = (2 * bits - 1).astype(np.int8)
    return _ITEMS[code]


def bundles(given: list[str | None]) -> np.ndarray:
    """One row per text: the sum of its trigram vectors, zero where it has no letter."""
    return _counted(given)[0]


def _counted(given: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundles, and how many trigrams are in each."""
    out = np.zeros((len(given), DIMENSIONS))
    numbers = np.zeros(len(given), np.int64)
    lowered = [(value or "").lower() for value in given]
    codes = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out, numbers
    letter = _letters()[codes]
    ends = np.cumsum([len(value) + 1 for value in lowered])
    starts = ends - [len(value) + 1 for value in lowered]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)
    place = np.concatenate([[0], np.cumsum(keep)])
    codes = codes[keep]
    alphabet, ids = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    if len(codes) < 3:
        codes3 = np.empty(0, np.int64)
    else:
        ids = ids.astype(np.int32 if n < 1200 else np.int64)
        codes3 = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    distinct, counts, owner = [], [], []
    for row, (a, b) in enumerate(zip(starts.tolist(), (ends - 1).tolist())):
        a, b = int(place[a]), int(place[min(b, len(place) - 1)])
        if b - a >= 3 and codes3[a:b - 2].size:
            found, times = np.unique(codes3[a:b - 2], return_counts=True)
            numbers[row] = times.sum()
            distinct.append(found), counts.append(times), owner.append(np.full(len(found), row))
        elif b > a:  # fewer letters than a trigram: the letters themselves
            for code in codes[a:b].tolist():
                if code != 32:
                    out[row] += item(code)
    if not distinct:
        return out, numbers
    found, column = np.unique(np.concatenate(distinct), return_inverse=True)
    counts, owner = np.concatenate(counts), np.concatenate(owner)
    order = np.argsort(column, kind="stable")
    column, counts, owner = column[order], counts[order], owner[order]
    letters = np.stack([item(int(code)) for code in alphabet])
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    exact = np.float32 if counts.sum() < 1 << 23 else np.float64
    for a in range(0, len(found), _TRIGRAMS_AT_ONCE):
        b = min(a + _TRIGRAMS_AT_ONCE, len(found))
        first, second, third = found[a:b] // (n * n), found[a:b] // n % n, found[a:b] % n
        bound = (twice[first] * once[second] * letters[third]).astype(exact)
        low, high = np.searchsorted(column, [a, b])
        dense = np.zeros((len(given), b - a), exact)
        dense[owner[low:high], column[low:high] - a] = counts[low:high]
        out += dense @ bound
    return out, numbers


def _bundled(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in texts.slices(batch):
        yield piece, *_counted(piece.column("text").to_pylist())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all rows of ``labelled`` with a language: one whole-number vector for each language."""
    return {name: v[:DIMENSIONS] for name, v in _summed(labelled, text, lang).items()}


def learn_means(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The mean trigram vector of each language with a trigram, from all rows of ``labelled``."""
    return {name: v[:DIMENSIONS] / v[DIMENSIONS] for name, v in _summed(labelled, text, lang).items() if v[DIMENSIONS]}


def _summed(labelled: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Per language the sum of its bundles, then the number of its trigrams."""
    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece, rows, numbers in _bundled(batch):
                rows = np.column_stack([rows, numbers])
                langs = np.array(piece.column("lang").to_pylist(), object)
                for name in set(langs.tolist()):
                    sums[name] = sums.get(name, 0) + rows[langs == name].sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "bundle": [v.astype(np.int64).tolist()
                                                                            for v in sums.values()]})
    given = labelled.filter(F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = given.mapInArrow(accumulate, "lang string, bundle array<bigint>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(
        F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x dimensions, whatever the corpus
        found.setdefault(row["lang"], np.zeros(DIMENSIONS + 1))[row["at"]] = row["value"]
    return {name: vector for name, vector in sorted(found.items()) if vector[:DIMENSIONS].any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, then ``lang_pred`` and ``score`` (the cosine, 0 where negative).

    Columns of ``docs`` that are called like the added ones are not kept.
    """
    names = list(prototypes)
    unit = np.stack([prototypes[name] / np.linalg.norm(prototypes[name]) for name in names]) if names else None
    keep = [name for name in keep if name not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, rows, _ in _bundled(batch):
                size = np.linalg.norm(rows, axis=1)
                langs, scores = ["und"] * len(rows), np.zeros(len(rows))
                if names:
                    cosines = rows @ unit.T / np.maximum(size, 1e-12)[:, None]
                    best = cosines.argmax(1)
                    langs = [names[b] if s else "und" for b, s in zip(best.tolist(), size.tolist())]
                    scores = np.where(size > 0, np.clip(cosines[np.arange(len(rows)), best], 0, 1), 0.0)
                columns = [piece.column(f"k{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])
    given = docs.select(*(docs[name].alias(f"k{i}") for i, name in enumerate(keep)),
                        docs[text].cast("string").alias("text"))
    schema = ", ".join(f"k{i} {given.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = given.mapInArrow(predict, f"{schema}, lang_pred string, score double")
    return out.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)), "lang_pred", "score")


def select_known(docs: DataFrame, means: dict[str, np.ndarray], text: str = "text",
                 floor: float = FLOOR) -> DataFrame:
    """``docs`` less the rows without a letter and those like no language of ``means`` (of ``learn_means``); columns stay
    and no row leaves its task. Without means only rows without a letter go.

    A text's mean trigram vector is projected on a language's; for a text of that language the expectation is the square
    of the latter's length, whatever the length of the text, and for unrelated trigrams 0. Chance adds a standard
    deviation of the product of both lengths over the root of the dimensions, which falls with the number of trigrams.
    A text goes if for every language its projection is under ``floor`` of the expectation by more than ``NOISE``
    standard deviations. So texts of a few trigrams stay, as do those of less than one: they cannot be told from noise.
    """
    mean = np.stack(list(means.values())) if means else None
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = names[docs.columns.index(text)]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch, place):
                rows, numbers = _counted(piece.column(place).to_pylist())
                keep = (np.abs(rows).max(1, initial=0) > 0) | (numbers > 0)
                if mean is not None:
                    length = np.linalg.norm(mean, axis=1)
                    chance = np.outer(np.linalg.norm(rows, axis=1), length) / DIMENSIONS ** 0.5
                    least = floor * np.outer(numbers, length ** 2) - NOISE * chance
                    keep &= (numbers == 0) | (rows @ mean.T >= least).any(1)
                yield piece.filter(pa.array(keep))
    out = docs.toDF(*names)
    return out.mapInArrow(select, out.schema).toDF(*docs.columns)
