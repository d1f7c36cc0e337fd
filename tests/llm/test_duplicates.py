"""Near duplicates, repeated passages, decontamination: against plain brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakatlas.llm import decontaminate, minmax_dedup, suffix_dedup
from leakatlas.llm.components import components

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows, percent):
    nodes = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in nodes if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(nodes):
        for j, o in nodes[:a]:
            if s and o and i is not None and j is not None and 100 * len(s & o) >= percent * len(s | o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in nodes), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, plain, percent):
    got = minmax_dedup.near_duplicates(docs, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(plain, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies(spark):
    """A group in which few members are alike directly, and a group alike only in part."""
    rng = random.Random(9)
    base = prose(50, 200).split()
    rows, words = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = f"w{i}"
    for i in range(100, 160):
        words = list(base)
        for k in range(rng.randint(1, 8)):
            words[rng.randrange(200)] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(frame, 85).collect()), key=str)
    assert got == plain_components(rows, 85)


def test_near_duplicates_empty(no_docs, docs):
    assert minmax_dedup.near_duplicates(no_docs).count() == 0
    assert minmax_dedup.near_duplicates(docs.filter("doc_id between 600 and 602")).filter("kept and n_shingles = 0").count() == 3


def test_min_max_values_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(pool[:2000]), np.unique(pool[1000:])]
    _, marks = minmax_dedup.signatures(np.concatenate(sets), np.array([0, 2000, 4000]))
    bits = np.unpackbits(marks.view(np.uint8), axis=1).reshape(2, minmax_dedup.PLANES, -1)[:, :, : 2 * minmax_dedup.PERMUTATIONS]
    agree = (bits[0] == bits[1]).all(0).mean()
    assert abs(agree - (1 / 3 + 2 / 3 / 2**minmax_dedup.PLANES)) < 0.12


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 900)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_cut(rows, length):
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone[: len(b)]))
        out.append((i, len(b), sum(gone[: len(b)]), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [40, 400])
def test_cut_repeats(docs, plain, length):
    rows = [(i, (t or "").encode()) for i, t in plain if t is None or len(t) < 20_000]
    part = docs.filter("text is null or length(text) < 20000")
    cut = suffix_dedup.cut_repeats(part, length=length)
    assert cut.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut.collect()), key=str) == plain_cut(rows, length)


def test_cut_repeats_random(spark):
    """Short alphabets, periods, overlaps and places at the edges of texts."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        parts = [rng.choice(("ab" * rng.randint(1, 30), "xyz" * 20, "".join(rng.choice("ab") for _ in range(rng.randint(1, 60))), f"unique {i} {rng.random()}", "shared passage, the same in many texts " * 2)) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (12, 33, 70):
        got = suffix_dedup.cut_repeats(frame, length=length).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain_cut([(i, t.encode()) for i, t in rows], length)


def test_cut_arrays_are_of_small_chunks():
    """A batch of 16 MB is cut a chunk at a time; its numpy arrays took about 24 bytes for each byte of 8 MB."""
    texts = ["ab" * 2000] * 4000
    asked = pa.array([[{"start": 10, "end": 510}]] * len(texts), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), asked], names=["text", "asked"])
    tracemalloc.start()
    rows = 0
    for out in suffix_dedup.cut_batches(iter([batch]), []):
        rows += out.num_rows
        assert set(out.column("n_removed").to_pylist()) == {500} and set(out.column("n_spans").to_pylist()) == {1}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 40 << 20


def test_cut_repeats_empty(no_docs):
    assert suffix_dedup.cut_repeats(no_docs).count() == 0


def edited(rng, data, n):
    data = bytearray(data)
    for _ in range(n):
        kind, i = rng.random(), rng.randrange(len(data))
        if kind < 0.34:
            data[i] = rng.choice(b"etaoin ")
        elif kind < 0.67:
            data.insert(i, rng.choice(b"etaoin "))
        else:
            del data[i]
    return bytes(data)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)  # begins anywhere
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return min(row)


def test_least_edits():
    rng = random.Random(8)
    for _ in range(60):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        b = edited(rng, a, rng.randint(0, 6)) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        distance, end = decontaminate.least_edits(a, b)
        assert distance == plain_distance(a, b) == plain_distance(a, b[:end])


def test_recall_and_exactness(spark):
    rng = random.Random(11)
    items = [(i, prose(1000 + i, rng.randint(20, 60))) for i in range(80)]
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "short")], "item_id long, text string")
    rows, want = [], {}
    for i, text in items:
        for k, share in enumerate((0, 0.02, 0.05, 0.08)):
            changed = edited(rng, text.encode(), int(share * len(text)))
            rows.append((4 * i + k, prose(2000 + i, 50) + " " + changed.decode() + " " + prose(3000 + i, 50)))
            want[4 * i + k] = i
    rows += [(5000 + i, prose(4000 + i, 300)) for i in range(50)] + [(6000, None), (6001, ""), (6002, items[0][1].upper())]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    texts = dict(rows)
    for k, least in enumerate((1.0, 1.0, 0.95, 0.85)):
        hit = {r.doc_id for r in found if r.doc_id in want and r.doc_id % 4 == k and r.item_id == want[r.doc_id]}
        assert len(hit) / len(items) >= least
    assert any(r.doc_id == 6002 and r.item_id == 0 and r.edits == 0 for r in found)
    assert not any(5000 <= r.doc_id <= 6001 or r.item_id >= 900 for r in found)
    for r in found:
        item = dict(items)[r.item_id].encode()
        part = texts[r.doc_id].encode()[r.start : r.end].lower()
        assert plain_distance(item, part) == r.edits <= decontaminate.edits_allowed(len(item))


def test_blocks_of_items_find_the_same(spark, monkeypatch, docs):
    bench = spark.createDataFrame([(i, prose(i, 130)[50:250]) for i in range(20)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect()), key=str) == one
    assert one and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.filter(F.lit(False)), bench).count() == 0


def found_in(items, texts):
    """(text, item, begin, end, edits) that the matcher finds in texts given as bytes."""
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return sorted(tuple(map(int, m)) for m in decontaminate.Matcher(items).search(data, at))


def plain_ends(a, b):
    """The least distance of ``a`` to a part of ``b`` that ends behind each byte."""
    column, out = list(range(len(a) + 1)), []
    for y in b:
        diagonal, column[0] = column[0], 0
        for i, x in enumerate(a, 1):
            diagonal, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, diagonal + (x != y))
        out.append(column[-1])
    return out


def plain_matches(items, texts):
    out = []
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            edits, base = decontaminate.edits_allowed(len(item)), 0
            while len(item) >= decontaminate.GRAM:
                ends = plain_ends(item, text[base:])
                first = next((j for j, n in enumerate(ends) if n <= edits), None)
                if first is None:
                    break
                near = ends[first : first + 2 * edits + 1]
                best = min(near)
                end = base + first + near.index(best) + 1
                begin = max(b for b in range(base, end + 1) if plain_ends(item, text[b:end] or b" ")[-1] == best)
                out.append((d, i, begin, end, best))
                base = end
    return sorted(out)


def test_all_lengths_are_found_at_the_limit():
    rng = random.Random(21)
    for size, n in ((24, 60), (100, 60), (390, 60), (1000, 40), (4000, 20)):
        items = [prose(7000 + size + i, size).encode()[:size] for i in range(n)]
        edits = decontaminate.edits_allowed(size)
        texts = [prose(8000 + i, 20).encode() + b" " + edited(rng, t, edits) + b" " + prose(9000 + i, 20).encode() for i, t in enumerate(items)]
        hits = {(d, i) for d, i, *_ in found_in(items, texts)}
        assert {(i, i) for i in range(n)} <= hits, size


def test_matches_are_those_of_brute_force():
    rng = random.Random(22)
    for letters in (b"ab", b"abcdefgh "):
        items = [bytes(rng.choice(letters) for _ in range(rng.choice((5, 8, 15, 23, 24, 25, 37, 38, 50, 63, 80)))) for _ in range(14)]
        texts = []
        for _ in range(12):
            parts = []
            for t in rng.sample(items, 3):
                parts += [bytes(rng.choice(letters) for _ in range(rng.randint(0, 12))), edited(rng, t, rng.randint(0, decontaminate.edits_allowed(len(t)) + 1))]
            texts.append(b"".join(parts))
        texts += [b"", items[3] * 3, items[9][1:] + items[9][:-1], b"a" * 60]
        items += [b"a" * 24, items[3]]
        assert found_in(items, texts) == plain_matches(items, texts)


def test_repetitive_texts_need_bounded_memory():
    """A megabyte of one character, and of a short period, against items that read alike."""
    for unit in (b"a", b"abcab ", b"0123456789abcdef-"):
        item, text = (unit * 3000)[:3000], (unit * (1 << 20))[: 1 << 20]
        data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        matcher = decontaminate.Matcher([item])
        strings = decontaminate.grams(data)
        tracemalloc.start()
        stretches = list(matcher.stretches(strings, at))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 << 20
        assert stretches == [(0, 0, 0, len(text))]
    texts = [b"a" * 10_000, b"ab" * 3000, b"b" * 50]
    assert found_in([b"a" * 3000], texts) == [(0, 0, 3000 * k, 3000 * (k + 1), 0) for k in range(3)] == found_in([b"a" * 3000], texts[:1])


def test_blocks_repeat_rows_as_one_block_does(spark, monkeypatch):
    text = prose(77, 40)
    bench = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (4, prose(78, 40))], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + text), (10, "x " + text), (11, None)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    assert len(one) == 6
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == one


def test_matches_begin_inside_words():
    rng = random.Random(23)
    items = [prose(7500 + n, n).encode()[:n] for n in (24, 60, 100, 230, 390)]
    unspaced = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)).encode() for n in (20, 60, 130)]
    texts, want = [], []
    for i, item in enumerate(items + unspaced):
        for before, after in ((b'<p class="question-text">', b"</p>"), (b"label:", b""), (b"x" * 200, b"x" * 200)):
            want.append((len(texts), i, len(before), len(before) + len(item), 0))
            texts.append(before + item + after)
    for i, item in enumerate(unspaced, len(items)):
        other = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(77)).encode()
        want.append((len(texts), i, len(other), len(other) + len(item), 0))
        texts.append(other + item + other)
        texts.append(other + edited(rng, item, decontaminate.edits_allowed(len(item))) + other)
        assert any(m[:2] == (1, i) for m in found_in(items + unspaced, texts[-2:]))
    assert set(want) <= set(found_in(items + unspaced, texts))
