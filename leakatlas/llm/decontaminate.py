"""Benchmark decontamination: passages within a few edits of a benchmark item.

1. Pieces. An item of n bytes that may have k edits is cut into k + 1 pieces of
   8 bytes and more. k edits leave one piece at least as it is, so every match
   holds a piece verbatim, wherever in a text or word it begins.
2. Places. Where a text holds a piece, the item can begin only up to k bytes off
   the place that the offset of the piece gives. Of the n - 7 strings of 8 bytes
   of the item at least n - 7 - 8 k must be around there; an edit destroys 8 of
   them at most. Places that overlap are one stretch of text.
3. The edit distance of the item to all parts of a stretch is computed exactly; up
   to MAX_EDITS of the item's bytes is a match, with its span.

None of these steps loses a match: recall is 1 at every length and share of edits
up to MAX_EDITS (tested against brute force). CGK walks with bit sampling, of
which any number of keys finds a share only, are not used.

Places are gathered by text, item and a grid of the item's size, with the least and
the greatest begin, so that repetitive texts and items need no more memory.

A to Z count as a to z; distances are over bytes. Items come in blocks of about
BLOCK_BYTES / 2, each of which all documents pass; the driver holds one block at a
time, and beyond one block the matches are written block by block. Items of less than 8 bytes match
nothing, items under 24 bytes only exactly. Null and empty texts hold nothing.
Several places of one item are several rows: from the left, the first end of a
match or a better one up to 2 k bytes on, then anew behind it. Rows are
independent: repeated rows give repeated matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakatlas.llm.shared import shared_folder, stored
from leakatlas.llm.text import FIELD, chunks, mix, utf8

GRAM = 8
MAX_EDITS = 0.08  # pieces have GRAM bytes and more up to this share
HELD_PLACES = 1 << 18  # looked at together
MERGED_STEPS = 16
BLOCK_BYTES = 8 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def edits_allowed(n: int) -> int:
    return int(MAX_EDITS * n) if n >= 24 else 0


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes, one to one."""
    n = max(0, len(data) - GRAM + 1)
    packed = np.zeros(n, FIELD)
    for j in range(GRAM):
        packed = (packed << FIELD(8)) | data[j : j + n]
    return mix(packed)


def end_distances(pattern: bytes, text: bytes | memoryview) -> Iterator[int]:
    """For each byte of ``text`` the least edit distance of ``pattern`` to any part that ends behind it.

    Columns of the table are bit vectors of vertical differences.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, distance = full, 0, m
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(horizontal | up) & full, up & horizontal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        yield distance
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(vertical | rise) & full, rise & vertical


def least_edits(pattern: bytes, text: bytes | memoryview) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    best, end = len(pattern), 0
    for j, distance in enumerate(end_distances(pattern, text), 1):
        if distance < best:
            best, end = distance, j
    return best, end


def places(pattern: bytes, text: bytes, edits: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, edits) of the matches in ``text`` from the left; none overlap."""
    text, base = memoryview(text), 0
    while len(text) - base >= len(pattern) - edits:
        best, end, last = edits + 1, 0, len(text)
        for j, distance in enumerate(end_distances(pattern, text[base:]), base + 1):
            if distance < best:
                if best > edits:
                    last = j + 2 * edits
                best, end = distance, j
            if j >= last or not best:
                break
        if best > edits:
            return
        # No part before ``end`` is as near, so the nearest part of the bytes up to there ends there.
        _, back = least_edits(pattern[::-1], text[max(base, end - len(pattern) - edits) : end][::-1])
        yield end - back, end, best
        base = end


def groups(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([np.diff(x) != 0 for x in columns], 0)]))


def least_and_greatest(doc: np.ndarray, item: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row a text, item and cell, ascending, with the least ``low`` and the greatest ``high``."""
    if not len(doc):
        return doc, item, cell, low, high
    order = np.lexsort((cell, item, doc))
    doc, item, cell = doc[order], item[order], cell[order]
    new = groups(doc, item, cell)
    return doc[new], item[new], cell[new], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)


class Matcher:
    """All items of a block, ready for search."""

    def __init__(self, items: list[bytes]):
        self.items = [FOLD[np.frombuffer(t, np.uint8)].tobytes() for t in items]
        self.size = np.array([len(t) for t in self.items], np.int64)
        self.edits = np.array([edits_allowed(len(t)) for t in self.items], np.int64)
        self.own: list[np.ndarray] = []
        parts = []  # of each item: first and last strings of its pieces, item, offset, length
        for i, t in enumerate(self.items):
            own = grams(np.frombuffer(t, np.uint8))
            self.own.append(np.unique(own))
            if len(own):
                cut = len(t) * np.arange(self.edits[i] + 2) // (self.edits[i] + 1)
                parts.append((own[cut[:-1]], own[cut[1:] - GRAM], np.full(len(cut) - 1, i), cut[:-1], np.diff(cut)))
        if not parts:
            parts = [(np.zeros(0, FIELD), np.zeros(0, FIELD), *[np.zeros(0, np.int64)] * 3)]
        head, tail, item, offset, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Pieces of one item that read alike are one entry with the least and the greatest of their offsets.
        columns = [x[np.lexsort((offset, tail, length, item, head))] for x in (head, tail, item, offset, length)]
        new = groups(columns[0], columns[1], columns[2], columns[4])
        last = np.append(new[1:], len(head)) - 1 if len(head) else new
        head, self.tail, self.item, self.near, self.length = (x[new] for x in columns)
        self.far = columns[3][last]
        self.heads, first = np.unique(head, return_index=True)
        self.first = np.append(first, len(head)).astype(np.int64)
        bits = max(16, min(26, int(np.ceil(np.log2(64 * len(self.heads) + 1)))))
        self.shift = FIELD(64 - bits)
        self.marked = np.zeros(1 << bits, bool)
        self.marked[self.heads >> self.shift] = True

    def pieces(self, strings: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, cell, least, greatest begin of the item by the offsets of a piece), for each piece that a text holds.

        Cells are a grid of the item's size, so alike pieces reach two cells at most.
        """
        place = np.flatnonzero(self.marked[strings >> self.shift])
        if not len(self.heads) or not len(place):
            return
        head = np.minimum(np.searchsorted(self.heads, strings[place]), len(self.heads) - 1)
        same = self.heads[head] == strings[place]
        place, head = place[same], head[same]
        ends = np.cumsum(self.first[head + 1] - self.first[head])
        done = 0
        while done < len(place):
            held = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, held + HELD_PLACES, "right")))
            n = self.first[head[done:stop] + 1] - self.first[head[done:stop]]
            which = np.repeat(np.arange(done, stop), n)
            entry = self.first[head[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            begin = place[which]
            doc = np.searchsorted(at, begin, "right") - 1
            whole = begin + self.length[entry] <= at[doc + 1]
            begin, doc, entry = begin[whole], doc[whole], entry[whole]
            alike = strings[begin + self.length[entry] - GRAM] == self.tail[entry]
            begin, doc, entry = begin[alike], doc[alike], entry[alike]
            item, low, high = self.item[entry], begin - self.far[entry], begin - self.near[entry]
            size = self.size[item]
            one, two = low // size, high // size
            over = two > one
            yield least_and_greatest(
                *(
                    np.concatenate(x)
                    for x in (
                        (doc, doc[over]),
                        (item, item[over]),
                        (one, two[over]),
                        (low, (two * size)[over]),
                        (np.where(over, two * size - 1, high), high[over]),
                    )
                )
            )
            done = stop

    def stretches(self, strings: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, low, high): parts of texts that can hold the item, ascending; those of an item do not overlap."""
        cells: list[tuple[np.ndarray, ...]] = []
        for found in self.pieces(strings, at):
            cells.append(found)
            if len(cells) == MERGED_STEPS:
                cells = [least_and_greatest(*(np.concatenate(x) for x in zip(*cells, strict=True)))]
        if not cells:
            return
        doc, item, _, start, last = least_and_greatest(*(np.concatenate(x) for x in zip(*cells, strict=True)))
        if not len(doc):
            return
        size, edits = self.size[item], self.edits[item]
        low, high = np.maximum(at[doc], start - edits), np.minimum(at[doc + 1], last + size + edits)
        need = size - GRAM + 1 - edits * GRAM
        held: tuple[int, int, int, int] | None = None
        for d, i, a, b, least in zip(*(x.tolist() for x in (doc, item, low, high, need)), strict=True):
            own, here = self.own[i], strings[a : max(a, b - GRAM + 1)]
            if (own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here).sum() < least:
                continue
            if held and held[:2] == (d, i) and a <= held[3]:
                held = (d, i, held[2], max(b, held[3]))
            else:
                if held:
                    yield held
                held = (d, i, a, b)
        if held:
            yield held

    def search(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits) of all matches, places within the text."""
        data = FOLD[data]
        out: list[tuple[int, int, int, int, int]] = []
        for doc, item, low, high in self.stretches(grams(data), at):
            shift = low - int(at[doc])
            for begin, end, edits in places(self.items[item], data[low:high].tobytes(), int(self.edits[item])):
                out.append((doc, item, shift + begin, shift + end, edits))
        return out


def matches(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, start, end, edits: one row per passage of ``documents`` that matches a benchmark item."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // BLOCK_BYTES))
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, start int, `end` int, edits int"
    if n_blocks == 1:
        out = source.mapInArrow(_search(items.withColumn("n", F.lit(1))), schema)
    else:
        # Repeated rows are one with a number, so that ids spread the copies of a text over the blocks.
        counted = stored(items.groupBy("item", "text").agg(F.count("*").cast("int").alias("n")), "items")
        folder = shared_folder(documents.sparkSession, "matches")
        for block in range(n_blocks):
            own = counted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
            source.mapInArrow(_search(own), schema).write.parquet(f"{folder}/block={block}")
        out = documents.sparkSession.read.schema(schema).parquet(*[f"{folder}/block={b}" for b in range(n_blocks)])
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "start", "end", "edits")


def _search(block: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The search for all items of a block, as many times as ``n`` says."""
    own = block.orderBy("item", "text").toArrow()
    names, texts, times = own["item"].combine_chunks(), [t.encode() for t in own["text"].to_pylist()], own["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(texts)
        for whole in batches:
            for batch in chunks(whole):
                found = matcher.search(*utf8(batch.column("text")))
                if found:
                    rows = np.array(found, np.int64)
                    doc, which, start, end, edits = np.repeat(rows, times[rows[:, 1]], 0).T
                    ints = [pa.array(x.astype(np.int32)) for x in (start, end, edits)]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), names.take(pa.array(which)), *ints], names=["key", "item", "start", "end", "edits"])

    return run
