"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The encoder never replays merges. An Aho-Corasick automaton over the reversed
tokens gives, for each place of a word, the longest token that begins there.
The encoder takes it if it is compatible with the token before it, else the
next shorter token that is a prefix of it, else it goes back one token; places
from which no way led on are marked, so that each is tried once. A pair of
tokens is compatible if merging the two texts together would never have merged
across their border. Results equal those of the merges.

Nulls and empty texts have no tokens. Texts of any length are encoded whole;
rows are independent, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from leakatlas.llm.text import chunks, worker_cache

CACHED_WORDS = 200_000  # words and their pieces in a generation of the cache; there are two
PLAIN_END = "\u0250"  # letters below are the same in every version of Unicode
WORD_END = "</w>"
# The white space of the tokenizer's normalizer and its split pattern.
WHITE = "".join(map(chr, (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 32)))
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizer file: ids, merges, special tokens. Read on the driver, a few MB."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
    return {"vocab": model["vocab"], "merges": merges, "special": special}


class Cache:
    """What was found lately: when one generation is full it becomes the old one, and what is asked again moves on."""

    def __init__(self, size: int):
        self.size, self.ids, self.texts = size, {}, {}
        self.old: tuple[dict, dict] = ({}, {})

    def turn(self) -> None:
        if len(self.ids) > self.size:
            self.old, self.ids, self.texts = (self.ids, self.texts), {}, {}

    def put(self, word: str, make) -> tuple[str, str]:
        """The pair of ``word``, which the young generation lacks."""
        pair = (self.old[0][word], self.old[1][word]) if word in self.old[0] else make(word)
        self.ids[word], self.texts[word] = pair
        return pair


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        vocab, self.special = vocabulary["vocab"], vocabulary["special"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        marks = byte_characters()
        self.inner = [vocab[c] for c in marks]
        self.last = [vocab[c + WORD_END] for c in marks]
        self.inner_marks = dict(enumerate(map(chr, self.inner)))
        spelling: list[str] = [""] * size  # of base symbols
        for i in (*self.inner, *self.last):
            spelling[i] = chr(i)
        self.rank = [-1] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(vocabulary["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = r
            self.rank[whole], self.halves[whole] = r, (left, right)
            spelling[whole] = spelling[left] + spelling[right]
        by_spelling = {s: i for i, s in enumerate(spelling) if s}
        self.length = [len(s) for s in spelling]
        self.shorter = [-1] * size
        self.matcher = ahocorasick.Automaton()
        for s, i in by_spelling.items():
            self.matcher.add_word(s[::-1], i)
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in by_spelling:
                    self.shorter[i] = by_spelling[s[:n]]
                    break
        self.matcher.make_automaton()
        self.table: dict[tuple[int, int], bool] = {}
        names = [""] * size
        for name, i in (*vocab.items(), *self.special.items()):
            names[i] = name
        self.blob = "".join(names)
        self.offsets = [0]
        for name in names:
            self.offsets.append(self.offsets[-1] + len(name))
        self.words = Cache(CACHED_WORDS)
        self.pieces = regex.compile(PIECES)
        self.marked = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging never crosses the border between ``a`` and ``b``; kept in a table."""
        known = self.table.get((a, b))
        if known is None:
            known = self.table[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Back in time: the border's neighbours are undone, latest merge first. At equal ranks
        # the merge further left came first, hence the one more on the right side.
        before = len(self.merge_rank)
        while True:
            if self.merge_rank.get((a, b), before) < before:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.halves[a][1]
            else:
                before, b = self.rank[b] + 1, self.halves[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece, its last byte closed by the word end."""
        raw = word.encode("utf-8")
        backward = chr(self.last[raw[-1]]) + raw[-2::-1].decode("latin-1").translate(self.inner_marks)
        # Places count from the end of the word. The matcher gives the longest token of a place first.
        longest = dict(list(self.matcher.iter(backward))[::-1])
        length, shorter, table = self.length, self.shorter, self.table
        closed: set[int] = set()
        out: list[int] = []
        place = len(raw) - 1
        token, before = longest[place], -1
        while True:
            end = place - length[token]
            if end in closed:
                holds = False
            elif before < 0:
                holds = True
            else:
                holds = table.get((before, token))
                if holds is None:
                    holds = self.compatible(before, token)
            if holds:
                out.append(token)
                if end < 0:
                    return out
                place, before, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(place)
                token = out.pop()
                before = out[-1] if out else -1
                place += length[token]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts, a space between them."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of ordinary text (with -1) and special tokens (with their id)."""
        if self.marked is None or "<" not in text:
            yield text, -1
            return
        for part in self.marked.split(text):
            if part:
                yield part, self.special.get(part, -1)

    def normal(self, text: str) -> list[str]:
        """Composed, lower-cased, cut at white space; no piece of the pattern holds white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        for c in WHITE[:5] if text.isascii() else WHITE[:-1]:
            if c in text:
                text = text.replace(c, " ")
        return list(filter(None, text.replace("\u03a3", "\u03c3").lower().split(" ")))

    def piece(self, piece: str) -> tuple[str, str]:
        ids = self.encode_word(piece)
        return " ".join(map(str, ids)), self.decode(ids)

    def word(self, word: str) -> tuple[str, str]:
        """Ids and texts of the pieces of ``word``. A piece by itself is a word of one piece, so both share the cache."""
        if word.isalpha() and max(word) < PLAIN_END:
            return self.piece(word)
        found = self.pieces.findall(word)
        if len(found) == 1:
            return self.piece(word)
        ids, texts = self.words.ids, self.words.texts
        for p in found:
            if p not in ids:
                self.words.put(p, self.piece)
        return " ".join([ids[p] for p in found]), " ".join([texts[p] for p in found])

    def encode_decode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        if len(self.table) > 4 * CACHED_WORDS:
            self.table.clear()
        ids, names = [], []
        for part, special in self.segments(text):
            if special >= 0:
                ids.append(str(special))
                names.append(self.decode([special]))
                continue
            words = self.normal(part)
            self.words.turn()
            for w in set(words).difference(self.words.ids):
                if w not in self.words.ids:  # it may have come as a piece of another since
                    self.words.put(w, self.word)
            if words:
                ids.append(" ".join(map(self.words.ids.__getitem__, words)))
                names.append(" ".join(map(self.words.texts.__getitem__, words)))
        return " ".join(ids), " ".join(names)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_decode(text)[0].split()]

    def forget(self) -> None:
        """Gives back what was found for words and pairs; the vocabulary stays."""
        self.words = Cache(self.words.size)
        self.table.clear()


def encode_texts(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``df``'s rows with n_tokens, ids_sha256, decoded_sha256 and, on request, ids and decoded.

    All other columns are kept except those that bear one of these names.
    """
    shipped = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    key = "bpe_" + hashlib.md5(path.encode()).hexdigest()
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    names = [c.split()[0] for c in extra.split(", ")]
    kept = [c for c in df.columns if c not in names and c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(key, lambda: Codec(shipped.value))
        try:
            for whole in batches:
                for batch in chunks(whole, "__text"):
                    n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
                    for value in batch.column("__text").to_pylist():
                        ids, decoded = codec.encode_decode(value or "")
                        n.append(ids.count(" ") + 1 if ids else 0)
                        ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                        text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                        if with_ids:
                            all_ids.append(np.array(ids.split(), np.int32))
                            texts.append(decoded)
                    columns = [batch.column(c) for c in kept]
                    made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                    if with_ids:
                        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                        made += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + made, names=kept + names)
        finally:
            codec.forget()  # the worker goes on to other stages, beside the memory that those take

    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    head = source.drop("__text").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in head), extra])
    return source.mapInArrow(run, schema)
