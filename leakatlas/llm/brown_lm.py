"""Language-model scores by a Brown class bigram model.

log10 P(text) = sum over its words, and an end token, of
log10 P(class | class before) + log10 P(word | class). Classes come from
exchange clustering: a word moves to the class that raises the likelihood of
the class bigrams most. The rounds are synchronous: Spark sums, for each word,
how often each class stands before and after it, over the bigrams of all
training texts; the moves are decided on these sums, in each round for a part
of the words, as moves of neighbours at the same time could undo each other.

Every word that occurs LEAST times and more is clustered. The SEEDED most frequent
are clustered first, on the driver, the others as part of the rest; then all
others join the class that suits them best and all words move, in tasks, against
the table of class bigrams. A turn that lowers the likelihood is taken back and the
next ones take half as many words. It ends when a pass over all words moves less
than FEW of them, or after 2 ROUNDS turns. Beginning and end of a text are one
class, rarer words share the rest class, in which each has its own count
and unseen words share one more; so every text has a probability above 0.
Transitions are smoothed by DELTA.

Counts cover all words of all training texts. Tasks hold the counts of the LOOKUP
most frequent words, and of all clustered ones if these are more (about 25 bytes
each); all other words of a text are counted by a join, once per text and word. Words are known by 64-bit fingerprints.

Null and empty texts are the end token alone. A null id is part of training.
Repeated rows count each time. Without training texts every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakatlas.llm.shared import bounded_batches, stored
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, utf8, words

LEAST = 5
SEEDED = 4096
CLASSES = 64
LOOKUP = 1 << 19
ROUNDS = 8
FEW = 0.01
SPREAD = 64  # tasks over which the neighbours of each seeded word are dealt
DELTA = 0.5
HELD_ROWS, HELD_SUMS = 1 << 17, 1 << 14  # bigrams, and sums of words, that a task works on together
HELD_TOKENS = 1 << 21  # counted in a task before it hands on
HELD_PAIRS = 1 << 18  # neighbours dealt together; their arrays take about 150 bytes a pair
BUCKET_ROWS = 1 << 19  # pairs of neighbours in a bucket, about, before equal ones are summed
END, REST = 0, 1  # class numbers, and numbers of these two symbols


def _spot(h: np.ndarray, shift: FIELD) -> np.ndarray:
    """The leading bits, ascending with signed ``h``."""
    return ((h.view(FIELD) ^ FIELD(1 << 63)) >> shift).astype(np.int64)


@dataclass
class Lookup:
    """Fingerprints (ascending) and counts of frequent words; symbol numbers of the clustered ones, else REST."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    n_symbols: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands, and whether it does."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        shift, begins, closed = self.index
        at = begins[_spot(h, shift)].astype(np.int64)
        behind = np.flatnonzero(closed[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[closed[at[behind]] < h[behind]]
        at = np.minimum(at, len(self.words) - 1)
        return at, self.words[at] == h

    @cached_property
    def index(self) -> tuple[FIELD, np.ndarray, np.ndarray]:
        """Where the words of each range of leading bits begin, two ranges a word and more; the words, closed by the greatest value."""
        bits = (2 * len(self.words)).bit_length()
        shift = FIELD(64 - bits)
        begins = np.searchsorted(_spot(self.words, shift), np.arange(1 << bits)).astype(np.int32)
        return shift, begins, np.append(self.words, np.iinfo(np.int64).max)

    def plain(self) -> dict:
        """The fields as they are shipped to tasks."""
        return {f.name: getattr(self, f.name) for f in fields(self)}


def word_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (signed, so that Spark can hold it) and text number of every word."""
    start, end, doc = words(data, at)
    return Fingerprints(data, byte_values(29, fold_case=True)).span(start, end).view(np.int64), doc


def symbol_rows(keys: np.ndarray, doc: np.ndarray, n: int, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text closed by END, and the places of these ENDs."""
    at, found = lookup.find(keys)
    symbols = np.where(found, lookup.symbols[at], REST) if len(lookup.words) else np.full(len(keys), REST)
    ends = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    out = np.full(len(keys) + n, END, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = symbols
    return out, ends


def _summed(parts: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(place, np.concatenate(weights)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])


def _counted(texts: DataFrame, count) -> DataFrame:
    """(key, n) summed over the keys that ``count`` finds in each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights, held = [], [], 0
        for whole in batches:
            for batch in chunks(whole):
                keys, n = np.unique(count(*utf8(batch.column("text"))), return_counts=True)
                parts.append(keys)
                weights.append(n)
                held += len(keys)
                if held > HELD_TOKENS:
                    yield _summed(parts, weights)
                    parts, weights, held = [], [], 0
        if parts:
            yield _summed(parts, weights)

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of up to ``limit`` most frequent words: all from a count on, found by a histogram of at most 1,024 bins."""
    bins = counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))
    cut, held = None, 0
    for row in sorted(bins.groupBy("bin").count().collect(), reverse=True):
        held += row["count"]
        if held > limit:
            break
        cut = row["bin"]
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = bins.filter(F.col("bin") >= cut).select("key", "n").toArrow()
    return top["key"].to_numpy(), top["n"].to_numpy()


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """The class part of the log likelihood."""
    return float(_plogp(bigrams).sum() - _plogp(bigrams.sum(0)).sum() - _plogp(bigrams.sum(1)).sum())


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, movable: np.ndarray, n_classes: int) -> np.ndarray:
    """One round. ``before`` and ``after``: symbols x classes, sums of neighbours; ``own``: how often a symbol follows itself."""
    classes = classes.copy()
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, classes, after)
    numbers = np.arange(n_classes)
    for w in movable:
        a, s = classes[w], own[w]
        left, right = before[w].copy(), after[w].copy()
        # Stale sums of neighbours that moved in this round must not take more than there is.
        left[a] -= s
        right[a] -= s
        rest = table.copy()
        rest[a, :] -= right
        rest[:, a] -= left
        rest[a, a] -= s
        rest = np.maximum(rest, 0)
        rows, columns = rest.sum(1), rest.sum(0)
        down = _plogp(rest + right[None, :]) - _plogp(rest)
        across = _plogp(rest + left[:, None]) - _plogp(rest)
        diagonal = rest[numbers, numbers]
        gain = down.sum(1) - down[numbers, numbers] + across.sum(0) - across[numbers, numbers]
        gain += _plogp(diagonal + right + left + s) - _plogp(diagonal)
        gain -= _plogp(rows + right.sum() + s) - _plogp(rows) + _plogp(columns + left.sum() + s) - _plogp(columns)
        gain[[END, REST]] = -np.inf
        b = int(np.argmax(gain))
        if b != a and gain[b] > gain[a] + 1e-9:
            rest[b, :] += right
            rest[:, b] += left
            rest[b, b] += s
            table, classes[w] = rest, b
    return classes


def move_gains(classes: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Words x classes: the likelihood with each word alone in another class, up to a constant for each word.

    ``before`` and ``after``: words x classes, sums of neighbours, a word's own among them.
    """
    number = np.arange(len(classes))
    left, right = before.astype(np.float64), after.astype(np.float64)
    left[number, classes] -= own
    right[number, classes] -= own
    gain = np.zeros(left.shape)
    # Cells of the row, then of the column, that the word adds to: only those of its neighbours' classes change.
    for mine, other, cells in ((right, left, table.T), (left, right, table)):
        word, c = np.nonzero(mine)
        if not len(word):
            continue
        n, home = mine[word, c], classes[word]
        rest = cells[c].astype(np.float64)
        rest[np.arange(len(word)), home] -= n
        inside = np.flatnonzero(c == home)
        rest[inside] -= other[word[inside]]
        rest[inside, home[inside]] -= own[word[inside]]
        rest = np.maximum(rest, 0)
        added = _plogp(rest + n[:, None]) - _plogp(rest)
        added[np.arange(len(word)), c] = 0
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[first]] += np.add.reduceat(added, first)
    diagonal = np.tile(np.diagonal(table).astype(np.float64), (len(classes), 1))
    diagonal[number, classes] -= right[number, classes] + left[number, classes] + own
    diagonal = np.maximum(diagonal, 0)
    gain += _plogp(diagonal + right + left + own[:, None]) - _plogp(diagonal)
    for mine, totals in ((right, table.sum(1)), (left, table.sum(0))):
        n = mine.sum(1) + own
        rest = np.tile(totals.astype(np.float64), (len(classes), 1))
        rest[number, classes] -= n
        gain -= _plogp(rest + n[:, None]) - _plogp(rest)
    return gain


def _best_moves(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that move and their new classes; ``rows``: word, slot and sum, all of a word."""
    w, slot, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    n_classes = len(table)
    names, place = np.unique(w, return_inverse=True)
    width = 2 * n_classes + 1
    sums = np.bincount(place * width + slot, n, len(names) * width).reshape(-1, width)
    now = classes[names].astype(np.int64)
    gain = move_gains(now, sums[:, :n_classes], sums[:, n_classes : 2 * n_classes], sums[:, -1], table)
    gain[:, END] = -np.inf
    gain[:, REST] = -np.inf  # a word in the rest joins a class in any case
    best = gain.argmax(1)
    at = np.arange(len(names))
    moves = (best != now) & (gain[at, best] > gain[at, now] + 1e-9)
    return names[moves], best[moves]


PACKED = "words binary, sides binary, starts binary, others binary, counts binary"


def _packed_row(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    of = keys >> 32
    first = np.flatnonzero(np.diff(of, prepend=-1))
    arrays = [(of[first] >> 1).astype(np.int32), (of[first] & 1).astype(np.int8), first.astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32 if not len(n) or n.max() < 1 << 31 else np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[c.split()[0] for c in PACKED.split(", ")])


def packed(rows: DataFrame) -> DataFrame:
    """Rows (k, n), k = (2 w + side) * 2**32 + other, in partitions by w and in order of k, as few rows of flat arrays.

    A row holds whole groups of a word and side, or a part of one: the groups' words
    and sides, where each begins, and their neighbours and counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append((b.column("k").to_numpy(), b.column("n").to_numpy()))
            size += b.num_rows
            if size > HELD_ROWS:
                yield _packed_row(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield _packed_row(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(run, PACKED)


def _planes(x: np.ndarray) -> bytes:
    """32-bit values by bytes: all first ones, all second ones, and so on; the last are mostly zero and shrink in a shuffle."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1).astype(np.int64)


DEALT = "bucket int, side int, words binary, others binary, counts binary"


def _dealt(before: np.ndarray, after: np.ndarray, size: int, seeded: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of each pair of neighbours from both sides, a row of flat arrays for each bucket: steps of words, others, counts."""
    for side, w, other in ((1, before, after), (0, after, before)):
        keys = np.sort(w * size + other)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(np.append(first, len(keys)))
        w, other = np.divmod(keys[first], size)
        # The neighbours of seeded words are dealt over SPREAD buckets, those of another word stay together.
        deal = np.where(w < seeded, (mix(other.view(FIELD)) % FIELD(SPREAD)).view(np.int64), 0)
        bucket = (mix((w * SPREAD + deal).view(FIELD)) % FIELD(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, w, other, n = bucket[order], w[order], other[order], n[order]
        begin = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        columns = [], [], []
        for a, b in zip(begin, np.append(begin[1:], len(bucket)), strict=True):
            columns[0].append(_planes(np.diff(w[a:b], prepend=0)))
            columns[1].append(_planes(other[a:b]))
            columns[2].append(n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.int64).tobytes())
        made = [pa.array(bucket[begin].astype(np.int32)), pa.array(np.full(len(begin), side, np.int32)), *(pa.array(c, pa.binary()) for c in columns)]
        yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in DEALT.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of the rows of :func:`_dealt`, which come in order of their buckets; one bucket is held at a time."""

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        n = np.add.reduceat(n[order], first)
        k = k[first]
        for a in range(0, len(k), HELD_ROWS):
            yield _packed_row(k[a : a + HELD_ROWS], n[a : a + HELD_ROWS])

    held, now = [], None
    for b in batches:
        for bucket, side, w, other, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if held and bucket != now:
                yield from out(held)
                held = []
            now = bucket
            w, other = np.cumsum(_from_planes(w)), _from_planes(other)
            n = np.frombuffer(n, np.uint8 if len(n) == len(other) else np.int64).astype(np.int64)
            held.append((((2 * w + side) << 32) + other, n))
    if held:
        yield from out(held)


def neighbour_rows(texts: DataFrame, lookup: Lookup, seeded: int, n_words: int) -> DataFrame:
    """The rows of :func:`packed` of all texts; buckets are as many as the words ask for."""
    shipped = texts.sparkSession.sparkContext.broadcast(lookup.plain())  # plain values: workers need no module
    buckets = 1 + 2 * n_words // BUCKET_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(**shipped.value)
        held, size = [], 0
        for whole in batches:
            for batch in chunks(whole):
                data, at = utf8(batch.column("text"))
                rows, _ = symbol_rows(*word_keys(data, at), batch.num_rows, known)
                held.append((np.concatenate([[END], rows[:-1]]), rows))
                size += len(rows)
                if size > HELD_PAIRS:
                    yield from _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), known.n_symbols, seeded, buckets)
                    held, size = [], 0
        if held:
            yield from _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), known.n_symbols, seeded, buckets)

    return texts.mapInArrow(run, DEALT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gathered, PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """w, side, other and n of the rows of :func:`packed`, one packed row at a time."""
    for b in batches:
        for w, side, first, other, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            other = np.frombuffer(other, np.int32).astype(np.int64)
            n = np.frombuffer(n, np.int32 if len(n) == 4 * len(other) else np.int64).astype(np.int64)
            sizes = np.diff(np.append(np.frombuffer(first, np.int32), len(other)))
            yield np.repeat(np.frombuffer(w, np.int32).astype(np.int64), sizes), np.repeat(np.frombuffer(side, np.int8).astype(np.int64), sizes), other, n


class Neighbours:
    """How often each symbol stands after (side 1) or before (0) each other one: ``rows`` of :func:`packed`."""

    def __init__(self, rows: DataFrame, n_classes: int):
        self.rows, self.n_classes = rows, n_classes
        self.context = rows.sparkSession.sparkContext

    def sums(self, classes: np.ndarray, least: int = 0, parts: int = 1, part: int = 0) -> DataFrame:
        """(w, slot, n) over the classes of neighbours, in parts: before, after, and last the word itself after itself.

        Of words from ``least`` on whose number leaves ``part`` when divided by ``parts``.
        """
        shipped, n_classes = self.context.broadcast(classes.astype(np.uint16)), self.n_classes
        width = 2 * n_classes + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shipped.value
            for w, side, other, n in unpacked(batches):
                if least or parts > 1:
                    chosen = (w >= least) & (w % parts == part)
                    w, side, other, n = w[chosen], side[chosen], other[chosen], n[chosen]
                twice = np.flatnonzero((w == other) & (side == 1))
                b = _summed([w * width + side * n_classes + now[other], w[twice] * width + width - 1], [n, n[twice]])
                key = b.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key // width), pa.array((key % width).astype(np.int32)), b.column("n")], names=["w", "slot", "n"])

        return self.rows.mapInArrow(run, "w long, slot int, n long")

    def table(self, classes: np.ndarray) -> np.ndarray:
        """Class bigrams."""
        shipped, n_classes = self.context.broadcast(classes.astype(np.uint16)), self.n_classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = shipped.value, np.zeros(n_classes * n_classes)
            for w, side, other, n in unpacked(batches):
                after = side == 1
                held += np.bincount(now[w[after]].astype(np.int64) * n_classes + now[other[after]], n[after], len(held))
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].astype(np.int64))], names=["key", "n"])

        got = self.rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(n_classes * n_classes)
        out[got["key"].to_numpy()] = got["n"].to_numpy()
        shipped.destroy()
        return out.reshape(n_classes, n_classes)

    def folded(self, seeded: int) -> DataFrame:
        """(k, n) of :func:`packed` with all symbols from ``seeded`` on as the rest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, side, other, n in unpacked(batches):
                b = _summed([((2 * np.where(w < seeded, w, REST) + side) << 32) + np.where(other < seeded, other, REST)], [n])
                yield pa.RecordBatch.from_arrays(b.columns, names=["k", "n"])

        return self.rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))

    def moves(self, classes: np.ndarray, table: np.ndarray, least: int, parts: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Words (chosen as for :meth:`sums`) that another class suits better, and these classes."""
        shipped = self.context.broadcast((classes.astype(np.uint16), table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, cells = shipped.value
            rows, held = [], 0

            def out():
                w, c = _best_moves(rows, now, cells)
                return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int32))], names=["w", "class"])

            for b in batches:
                columns = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("w", "slot", "n"))
                if not len(columns[0]):
                    continue
                rows.append(columns)
                held += len(columns[0])
                if held > HELD_SUMS:
                    # The rows of the last word may go on in the next batch.
                    cut = int(np.searchsorted(columns[0], columns[0][-1]))
                    if cut:
                        tail = tuple(c[cut:] for c in columns)
                        rows[-1] = tuple(c[:cut] for c in columns)
                        yield out()
                        rows, held = [tail], len(tail[0])
            if rows:
                yield out()

        got = self.sums(classes, least, parts, part).repartition("w").sortWithinPartitions("w").mapInArrow(run, "w long, class int").toArrow()
        shipped.destroy()
        return got["w"].to_numpy(), got["class"].to_numpy()


@dataclass
class Model:
    lookup: Lookup
    classes: np.ndarray  # of symbols
    transition: np.ndarray  # log10, classes x classes
    class_totals: np.ndarray
    rest_types: int
    total: int  # tokens
    types: int


def settled(neighbours: Neighbours, classes: np.ndarray, table: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and their bigrams, after all words of the rest have joined a class and few words still move."""
    parts = 2
    for turn in range(parts):
        outside = classes == REST
        outside[REST] = False
        if not outside.any():
            break
        w, c = neighbours.moves(classes, table, SEEDED + 2, parts, turn)
        classes[w] = c
        table = neighbours.table(classes)
    value, part, moved, turns = likelihood(table), 0, 0, 2 * rounds
    while turns > 0:
        turns -= 1
        w, c = neighbours.moves(classes, table, REST + 1, parts, part)
        trial = classes.copy()
        trial[w] = c
        cells = neighbours.table(trial)
        if likelihood(cells) < value:
            parts, part, moved = 2 * parts, 0, 0
            continue
        classes, table, value = trial, cells, likelihood(cells)
        moved += len(w)
        part += 1
        if part == parts:
            if moved < FEW * (len(classes) - 2):
                break
            part = moved = 0
    return classes, table


def train(texts: DataFrame, classed: int | None = None, n_classes: int = CLASSES, lookup_words: int = LOOKUP, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the column ``text``, and the counts (key, n) of all its words.

    ``classed`` clusters up to so many words only, of those that tasks hold.
    """
    counts = stored(_counted(texts, lambda data, at: word_keys(data, at)[0]), "brown-words")
    n_types, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_texts = texts.count()
    keys, n = most_frequent(counts, lookup_words)
    if classed is None and (n >= LEAST).sum() < counts.filter(F.col("n") >= LEAST).count():
        top = counts.filter(F.col("n") >= LEAST).toArrow()
        keys, n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    rank = np.argsort(-n, kind="stable")
    if classed is None:
        limit = int((n >= LEAST).sum())
    else:  # words of equal count stand or fall together
        limit = min(classed, len(rank))
        if 0 < limit < len(rank):
            limit = int((n > n[rank[limit]]).sum())
    symbols = np.full(len(keys), REST, np.int64)
    symbols[rank[:limit]] = np.arange(limit) + 2
    lookup = Lookup(keys, n, symbols, limit + 2)
    size = lookup.n_symbols
    # Symbols are numbered by frequency: the first ones have neighbours enough for many tasks.
    seeded = min(size, SEEDED + 2)
    neighbours = Neighbours(stored(neighbour_rows(texts, lookup, seeded, n_words + n_texts), "brown-neighbours"), n_classes)
    # To begin with, seeded words of like frequency are dealt over all classes in turn, the others are in the rest.
    classes = np.full(size, REST, np.int64)
    classes[END] = END
    classes[2:seeded] = 2 + np.arange(seeded - 2) % max(1, n_classes - 2)

    seeds = neighbours
    if size > seeded:
        word = F.shiftright("k", 33)
        dealt = F.when(word < seeded, F.pmod(F.xxhash64("k"), F.lit(SPREAD))).otherwise(0)
        few = neighbours.folded(seeded).repartition(word, dealt).sortWithinPartitions("k")
        seeds = Neighbours(stored(packed(few), "brown-seeds"), n_classes)
    for turn in range(rounds):
        got = seeds.sums(classes).groupBy("w", "slot").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros((seeded, 2 * n_classes + 1))
        sums[got["w"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
        before, after = sums[:, :n_classes], sums[:, n_classes:-1]
        classes[:seeded] = exchange(classes[:seeded], before, after, sums[:, -1], np.arange(2 + turn % 2, seeded, 2), n_classes)
    table = neighbours.table(classes)
    if size > seeded:
        classes, table = settled(neighbours, classes, table, rounds)
    transition = np.log10((table + DELTA) / (table.sum(1, keepdims=True) + DELTA * n_classes))
    class_totals = np.bincount(classes[symbols], n, n_classes)
    class_totals[REST] = n_words - class_totals[2:].sum()
    return Model(lookup, classes, transition, class_totals, n_types - limit, n_words + n_texts, n_types + (n_texts > 0)), counts


def score(documents: DataFrame, model: Model, counts: DataFrame, n_end: int, key: str = "doc_id", held_out: str = "held_out", text: str = "text") -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast({**vars(model), "lookup": model.lookup.plain()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = Model(**{**shipped.value, "lookup": Lookup(**shipped.value["lookup"])})
        number = TaskContext.get().partitionId() << 40
        lookup = m.lookup
        log_count = np.log10(lookup.counts + 1.0)
        with np.errstate(divide="ignore"):
            emit = np.where(lookup.symbols == REST, log_count, np.log10(lookup.counts) - np.log10(m.class_totals[m.classes[lookup.symbols]])) if len(lookup.words) else log_count
        rest_scale = np.log10(m.class_totals[REST] + m.rest_types + 1.0)
        for whole in batches:
            for batch in chunks(whole):
                data, at = utf8(batch.column("text"))
                n = batch.num_rows
                keys, doc = word_keys(data, at)
                rows, ends = symbol_rows(keys, doc, n, lookup)
                steps = m.transition[m.classes[np.concatenate([[END], rows[:-1]])], m.classes[rows]]
                walked = np.concatenate([[0.0], np.cumsum(steps)])
                transitions = np.diff(np.concatenate([[0.0], walked[ends + 1]]))
                place, found = lookup.find(keys)
                known = doc[found]
                base = np.bincount(known, log_count[place[found]], n)
                emitted = np.bincount(known, emit[place[found]], n)
                in_rest = doc[~found | (lookup.symbols[place] == REST)] if len(lookup.words) else doc
                emitted -= rest_scale * np.bincount(in_rest, minlength=n)
                far, far_doc = keys[~found], doc[~found]
                cut = np.searchsorted(far_doc, np.arange(n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.array(far))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(n)),
                        batch.column("key"),
                        batch.column("held_out"),
                        pa.array(np.bincount(doc, minlength=n) + 1),
                        pa.array(np.bincount(known, minlength=n)),
                        pa.array(base),
                        pa.array(transitions + emitted),
                        tail,
                    ],
                    names=["row", "key", "held_out", "n_tokens", "n_found", "base", "score", "tail"],
                )
                number += n

    source = documents.select(F.col(key).alias("key"), F.col(held_out).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    parts = stored(source.mapInArrow(run, f"row long, key {kind}, held_out boolean, n_tokens long, n_found long, base double, score double, tail array<long>"), "brown-parts")
    rare = parts.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    tails = rare.join(counts.withColumnsRenamed({"key": "word", "n": "c"}), "word").groupBy("row").agg(F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_sum"))
    zero = F.lit(0)
    ended = float(np.log10(n_end + 1.0))
    scale = float(np.log10(model.total + 1.0 * (model.types + 1)))
    seen, log_sum = F.coalesce("seen", zero), F.coalesce("log_sum", zero.cast("double"))
    return parts.join(tails, "row", "left").select(
        F.col("key").alias(key),
        F.col("held_out").alias(held_out),
        "n_tokens",
        (F.col("n_found") + seen + F.lit(int(n_end > 0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_sum + ended - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + log_sum).alias("score"),
    )


def score_documents(documents: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    bounded_batches(documents.sparkSession)
    marked = documents.select(F.col(key), F.col(text).cast("string").alias(text), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = marked.filter("not held_out").select(F.col(text).alias("text"))
    model, counts = train(training)
    scored = score(marked, model, counts, training.count(), key, "held_out", text)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
