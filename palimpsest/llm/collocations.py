"""Phrase collocations: frequent phrases of 2 to 4 words, scored by how rarely their parts stand apart.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Everything
is counted per language. Each task counts in a burst trie: its shallow levels branch on the leading digits of the ids of
a phrase's first words, its leaves are hash containers of phrases with counts. A container that grows past ``BURST``
phrases bursts into children; a task's tries past ``LIMIT`` spill their largest subtrees whole, as runs sorted by prefix. Runs
meet by prefix partition, where equal phrases are summed.

Three passes over the texts count words, pairs, then triples and quadruples. A phrase cannot be more frequent than its
parts, so a pass counts only what a bit table of the frequent words, then pairs, lets through. The table has a fixed size
(``GATE_BITS``), whatever the corpus; what it lets through wrongly is counted exactly and dropped by its count. No frequent
phrase is lost.

A word is known by a 64-bit hash of its bytes and its language, a phrase by its words' hashes; two of them are taken for
one with a chance of 2^-64 per pair. Null and empty texts have no word. A null language is ``und``. Repeated rows count
each for itself. An empty table gives no phrase. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import texts
from palimpsest.llm.jaccard import written

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase that is a candidate
TOP = 2000  # phrases of a language in the report
COVER = 80  # percent of a phrase's occurrences that lie in one longer phrase, from which on it is dropped
BURST = 1 << 15  # phrases of a container
LIMIT = 1 << 19  # phrases of the tries of a task
DIGITS = 4  # levels of the trie, of 16 children each
GATE_BITS = 26  # the bit table has 2^26 bits: 8 MB
WINDOW = 1 << 20  # bytes that are cut into words at once

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _CUT.copy()
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = ["w1", "w2", "w3", "w4"]


class Container:
    """A hash table of phrases by open addressing, filled and probed by whole arrays."""

    def __init__(self, width: int, slots: int = 1 << 12):
        self.n = 0
        self.keys = np.zeros(slots, np.uint64)
        self.counts = np.zeros(slots, np.int64)
        self.words = np.zeros((slots, width), np.uint64)

    def add(self, keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        step = max(len(self.keys), BURST)
        for a in range(0, len(keys), step):
            part = slice(a, a + step)
            while 2 * (self.n + len(keys[part])) > len(self.keys):
                self._grow()
            self._put(keys[part], words[part], counts[part])

    def _put(self, keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            if free.any():
                self.keys[at[free]] = keys[left[free]]  # of several phrases at one slot, one stays
                won = np.flatnonzero(free)[self.keys[at[free]] == keys[left[free]]]
                self.words[at[won]] = words[left[won]]
                self.n += len(np.unique(at[won]))
            hit = self.keys[at] == keys[left]
            np.add.at(self.counts, at[hit], counts[left[hit]])
            left, at = left[~hit], (at[~hit] + 1) & int(mask)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.keys) - 1
        found = np.zeros(len(keys), bool)
        at = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            found[left] = held == keys[left]
            on = (held != 0) & (held != keys[left])
            left, at = left[on], (at[on] + 1) & mask
        return found

    def _grow(self) -> None:
        keys, words, counts = self.items()
        self.__init__(words.shape[1], 2 * len(self.keys))
        self._put(keys, words, counts)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = np.flatnonzero(self.keys)
        return self.keys[live], self.words[live], self.counts[live]


def prefix_of(words: np.ndarray) -> np.ndarray:
    """The 16 bits that the trie branches on: those of one word's id, or eight of each of the first two."""
    if words.shape[1] == 1:
        return (words[:, 0] >> np.uint64(48)).astype(np.int32)
    return ((words[:, 0] >> np.uint64(56) << np.uint64(8)) | (words[:, 1] >> np.uint64(56))).astype(np.int32)


def phrase_key(words: np.ndarray) -> np.ndarray:
    """One 64-bit value, never 0, for each row of word ids."""
    total = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        total = texts.mix(total * np.uint64(0xA0761D6478BD642F) + words[:, k] + np.uint64(k + 1))
    return np.maximum(total, np.uint64(1))


class Trie:
    """Counts of phrases of ``width`` words, one of ``share`` tries of a task. A node is a Container or a list of 16 nodes.

    ``beside`` more ids may be kept with each phrase; the trie does not branch on them.
    """

    def __init__(self, width: int, beside: int = 0, share: int = 1):
        self.limit = LIMIT // share
        self.branching = width
        self.width = width + beside
        self.root: Container | list = Container(self.width)

    def prefix(self, words: np.ndarray) -> np.ndarray:
        return prefix_of(words[:, :self.branching])

    def add(self, words: np.ndarray) -> None:
        if len(words):
            keys = phrase_key(words[:, :self.branching])
            self.root = self._add(self.root, 0, self.prefix(words), keys, words, np.ones(len(words), np.int64))

    def _add(self, node, depth, prefix, keys, words, counts):
        if isinstance(node, Container):
            node.add(keys, words, counts)
            if node.n <= BURST or depth == DIGITS:
                return node
            keys, words, counts = node.items()
            node, prefix = [Container(self.width) for _ in range(16)], self.prefix(words)
        digit = prefix >> (4 * (DIGITS - 1 - depth)) & 15
        order = np.argsort(digit, kind="stable")
        bounds = np.searchsorted(digit[order], np.arange(17))
        for d in range(16):
            rows = order[bounds[d]:bounds[d + 1]]
            if len(rows):
                node[d] = self._add(node[d], depth + 1, prefix[rows], keys[rows], words[rows], counts[rows])
        return node

    def size(self, node=None) -> int:
        node = self.root if node is None else node
        return node.n if isinstance(node, Container) else sum(map(self.size, node))

    def _runs(self, node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if isinstance(node, list):
            for child in node:
                yield from self._runs(child)
        elif node.n:
            keys, words, counts = node.items()
            order = np.lexsort((keys, self.prefix(words)))
            yield words[order], counts[order]

    def spill(self, everything: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of word ids and counts: all that is held, or the largest subtrees until half of the limit is left."""
        if everything or isinstance(self.root, Container):
            if everything or self.root.n > self.limit:
                root, self.root = self.root, Container(self.width)
                yield from self._runs(root)
            return
        sizes = [self.size(child) for child in self.root]
        if sum(sizes) <= self.limit:
            return
        for d in sorted(range(16), key=lambda d: -sizes[d]):
            if sum(sizes) <= self.limit // 2:
                break
            subtree, self.root[d], sizes[d] = self.root[d], Container(self.width), 0
            yield from self._runs(subtree)


def windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes of about WINDOW, the bounds of the texts in them, and the number of the first text. Windows end between
    texts or where a piece does, so a text of any length is cut a window at a time."""
    data, bounds = texts.utf8(column)
    a = 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        if b < len(data):
            text = bounds[np.searchsorted(bounds, b, "right") - 1]  # where the text at b begins
            if text > a:
                b = int(text)
            else:
                cut = np.flatnonzero(_CUT[data[a:b]])
                while not len(cut) and b < len(data):
                    b = min(b + WINDOW, len(data))
                    cut = np.flatnonzero(_CUT[data[a:b]])
                after = int(bounds[np.searchsorted(bounds, a, "right")])  # the text's end, if it comes first
                b = min(after, a + int(cut[-1]) + 1 if len(cut) else b)
        first = int(np.searchsorted(bounds, a, "right")) - 1
        last = int(np.searchsorted(bounds, b, "left"))
        yield data[a:b], np.clip(bounds[first:last + 1], a, b) - a, first
        a = b


def cut_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, the text of each, and a number that is one for words of one piece."""
    inside = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = texts.span_hashes(data, start, end)
    piece = np.cumsum(_CUT[data] | first[:-1])[start]
    return start, end, hashes, np.searchsorted(bounds, start, "right") - 1, piece


def _passed(gate: Broadcast, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - GATE_BITS)
    return (gate.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def gate(phrases: DataFrame, width: int) -> Broadcast:
    """A bit for the key of each phrase, in a table of fixed size."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns], 1)
            place = phrase_key(words) >> np.uint64(64 - GATE_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int32)),
                 pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["slot", "bits"])
    set_bits = phrases.select(*_WORDS[:width]).mapInArrow(bits, "slot int, bits bigint").groupBy("slot").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (GATE_BITS - 6), np.uint64)
    table[set_bits["slot"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(table)


def _count(docs: DataFrame, widths: tuple[int, ...], gates: tuple[Broadcast, ...]) -> DataFrame:
    """Runs of the tries of all tasks: prefix, the words' ids and a count.

    The first pass also gives each word's language and, without a word, each language's number of words. The last one
    gives the bytes of the words that may stand in a frequent pair.
    """
    schema = "prefix int, " + ", ".join(f"{w} bigint" for w in _WORDS[:max(widths)]) + ", n bigint"
    schema += ", lang string" if 1 in widths else ", word binary" if len(widths) > 1 else ""
    extra = schema.split(", ")[max(widths) + 2:]

    def rows(words: np.ndarray, counts: np.ndarray, last: pa.Array | None = None) -> pa.RecordBatch:
        given = [pa.array(words[:, k].view(np.int64)) for k in range(words.shape[1])]
        given += [pa.nulls(len(words), pa.int64())] * (max(widths) - len(given))
        arrays = [pa.array(prefix_of(words)), *given, pa.array(counts)]
        names = ["prefix", *_WORDS[:max(widths)], "n"]
        if extra:
            kind = pa.string() if 1 in widths else pa.binary()
            arrays.append(pa.nulls(len(words), kind) if last is None else last)
            names.append(extra[0].split()[0])
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {width: Trie(width, int(width == 1), len(widths)) for width in widths}  # a word's language beside it
        langs: dict[str, int] = {}
        totals: list[int] = []
        owner: dict[int, int] = {}  # language of a language's hash
        named = Container(1)

        def spilled(everything: bool) -> Iterator[pa.RecordBatch]:
            for width, trie in tries.items():
                for words, counts in trie.spill(everything):
                    if width > 1:
                        yield rows(words, counts)
                        continue
                    of = np.array([owner[h] for h in words[:, 1].tolist()], np.int64)
                    names = pa.array(list(langs), pa.string())
                    yield rows(words[:, :1], counts, names.take(pa.array(of)))

        for batch in batches:
            lang_hash = batch.column("lang_id").to_numpy(zero_copy_only=False).view(np.uint64)
            if 1 in widths:
                coded = batch.column("lang").dictionary_encode()
                for name in coded.dictionary.to_pylist():
                    if name not in langs:
                        langs[name] = len(langs)
                        totals.append(0)
                lang = np.array([langs[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                owner.update(zip(lang_hash.tolist(), lang.tolist()))
            for data, bounds, base in windows(batch.column("text")):
                start, end, hashes, text, piece = cut_words(data, bounds)
                text = text + base
                ids = texts.mix(hashes ^ lang_hash[text])
                if 1 in widths:
                    tries[1].add(np.stack([ids, lang_hash[text]], 1))
                    for k, c in enumerate(np.bincount(lang[text], minlength=len(langs)).tolist()):
                        totals[k] += c
                    continue
                frequent = _passed(gates[0], phrase_key(ids[:, None]))
                if len(ids) < 2:
                    continue
                pairs = np.stack([ids[:-1], ids[1:]], 1)
                open_pair = (piece[:-1] == piece[1:]) & frequent[:-1] & frequent[1:]
                if len(gates) > 1:
                    open_pair[open_pair] = _passed(gates[1], phrase_key(pairs[open_pair]))
                    seen = np.zeros(len(ids), bool)
                    seen[:-1] |= open_pair
                    seen[1:] |= open_pair
                    keys = phrase_key(ids[:, None])
                    keys, at = np.unique(keys[seen], return_index=True)
                    at = np.flatnonzero(seen)[at]
                    fresh = at[~named.has(keys)]
                    if len(fresh):
                        named.add(phrase_key(ids[fresh, None]), ids[fresh, None], np.ones(len(fresh), np.int64))
                        yield rows(ids[fresh, None], np.zeros(len(fresh), np.int64),
                                   texts.take_spans(_LOWER[data], start[fresh], end[fresh]))
                        if named.n > LIMIT // 4:
                            named = Container(1)
                for width in widths:
                    n = len(ids) - width + 1
                    if n <= 0:
                        continue
                    stands = piece[:n] == piece[width - 1:]
                    for k in range(width - 1):
                        stands = stands & open_pair[k:n + k]
                    at = np.flatnonzero(stands)
                    tries[width].add(np.stack([ids[at + k] for k in range(width)], 1))
            yield from spilled(False)
        yield from spilled(True)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(totals), pa.int32()), pa.nulls(len(totals), pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(list(langs), pa.string())], ["prefix", "w1", "n", "lang"])
    return docs.mapInArrow(run, schema)


def _merged(runs: DataFrame, width: int, *carried: str) -> DataFrame:
    """Sums of equal phrases; runs meet by prefix partition and nowhere else."""
    return runs.repartition("prefix").groupBy("prefix", *_WORDS[:width], *carried).agg(F.sum("n").alias("f"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, ...]:
    """Tables of the words, the pairs, and the triples and quadruples that occur ``least`` times or more.

    The first has ``lang``, ``w1``, ``f`` and, with a null ``w1``, each language's number of words; the second ``w1``,
    ``w2``, ``f``; the last ``w1`` to ``w4`` and ``f`` and, with a null ``w2``, the bytes ``word`` of a word.
    """
    name = F.coalesce(docs[lang].cast("string"), F.lit("und"))
    given = docs.select(docs[text].cast("string").alias("text"), F.xxhash64(name).alias("lang_id"))
    with_lang = docs.select(docs[text].cast("string").alias("text"), F.xxhash64(name).alias("lang_id"), name.alias("lang"))
    words = written(_merged(_count(with_lang, (1,), ()), 1, "lang").filter(
        (F.col("f") >= least) | F.col("w1").isNull()).drop("prefix"), "words")
    first = gate(words.filter(F.col("w1").isNotNull()), 1)
    pairs = written(_merged(_count(given, (2,), (first,)), 2).filter(F.col("f") >= least).drop("prefix"), "pairs")
    second = gate(pairs, 2)
    longer = _merged(_count(given, (3, 4), (first, second)), 4, "word").filter(
        (F.col("f") >= least) | F.col("w2").isNull()).drop("prefix")
    return words, pairs, written(longer, "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    words, pairs, longer = frequent(docs, text, lang, least)
    spelled = longer.filter(F.col("w2").isNull()).select("w1", F.col("word").cast("string").alias("word"))
    single = words.filter(F.col("w1").isNotNull())
    listed = [pairs.select(F.array("w1", "w2").alias("ids"), "f"),
              longer.filter(F.col("w3").isNotNull()).select(
                  F.filter(F.array(*_WORDS), lambda w: w.isNotNull()).alias("ids"), "f")]
    phrases = listed[0].union(listed[1])
    counts = single.select(F.array("w1").alias("ids"), "f").union(phrases)

    # A phrase goes where a longer one that holds it is nearly as frequent. Only phrases of three and four words hold others.
    size = F.size("ids")
    inner = listed[1].select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> "
        "transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")).alias("ids"))
    covered = inner.groupBy("ids").agg(F.max("f").alias("longer"))
    wide = "decimal(38, 0)"
    kept = phrases.join(covered, "ids", "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer").cast(wide) < COVER * F.col("f").cast(wide))).select(
        "ids", F.col("f").alias("a"))

    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size)})
    parts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(
        counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    parts = parts.withColumn("score", F.expr(
        "(cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))) div (cast(l as decimal(20, 0)) + r)"))
    scored = parts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    place = scored.select("ids", "a", "cut", F.posexplode("ids").alias("pos", "w1"))
    phrase = place.join(spelled, "w1").groupBy("ids", "a", "cut").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    totals = words.filter(F.col("w1").isNull()).select("lang", F.col("f").alias("n"))
    known = phrase.withColumn("w1", F.col("ids")[0]).join(single.select("w1", "lang"), "w1")
    # Each task keeps its own first rows of a language before any meet, and only those are joined by language.
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    first = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.col("rank").cast("bigint")).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("bigint").alias("score"))
