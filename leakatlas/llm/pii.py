"""Personal identifiers: fixed patterns, and others found by bootstrapping from their contexts.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed
patterns, leftmost and without overlaps per kind, in time linear in the text.

These are the seeds of a bootstrapped extraction. The words before and after a
mention are its lexical patterns: the last one or two words on the left, the
next one or two on the right, ASCII letters folded. Candidates are spans of
looser form that the base left (local phone numbers, card-like numbers, defanged
and IPv6 addresses, ``name (at) host``). Patterns and instances (normalised
values) make a graph, scored in rounds of joins:

- a pattern is trusted for a kind if at least ``SUPPORT`` different known
  instances of the kind stand in it and they fill it in at least ``TRUST`` of
  its occurrences: known mentions / (all occurrences in the corpus + 1),
  whatever stands there; so common contexts earn no trust;
- a candidate becomes known if 1 - product(1 - trust) over its trusted patterns
  reaches ``ACCEPT``, or if its value is a known value written in another form.
  Its kind must allow its form; the best kind counts, the first listed on ties.

New instances raise the trust of their patterns; rounds end when none is added.

Occurrences of patterns are counted over all texts. Only patterns that could
earn trust are wanted; a bitmap of their hashes, of a fixed size, goes to the
tasks that read the texts, and the counts it lets through are joined exactly.
Values leave the tasks as hashes only.

Null texts and empty ones have no spans. Every row is judged by itself, rows
with equal or null keys too; repeated texts count as often as they occur, but
support counts different values. An empty table gives an empty result. Spans
count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakatlas.llm.shared import broadcast_if_small, stored
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, utf8, words

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
TRUST = 0.5
ACCEPT = 0.9
BITMAP_BITS = 22

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
SPACED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
BEFORE_AT = re.compile(r"[\w.%+-]+ ?\Z")
AFTER_AT = re.compile(r" ?[\w-]+(?:\.[\w-]+| ?[(\[]dot[)\]] ?[\w-]+)*", re.IGNORECASE)
AROUND_AT = 255
LOOSE_IP = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\.)[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}")
LOOSE_NUMBER = re.compile(r"[0-9(][0-9 ()./-]{5,38}[0-9]")
OPENS, CLOSES = "\"'<[(", "\"'>]),.;:!?"
MENTIONS = "array<struct<kind:int,kinds:int,first:int,past:int,instance:bigint,patterns:array<bigint>>>"


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From every ``@``: back over the local part, not beyond the last match, and on over the labels."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        low = found.end() if found else at + 1
        if found:
            out.append((start, low))
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base match, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) == 4 and all(octet(p) for p in parts):
            out.append((1, m.start(), m.end()))
    for m in SPACED.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kinds as bits, start, end) of looser forms that overlap no base match, leftmost first, without overlaps."""
    found = []
    for m in AT.finditer(text):
        low = max(0, m.start() - AROUND_AT)
        before = BEFORE_AT.search(text[low : m.start()])
        after = AFTER_AT.match(text[m.end() : m.end() + AROUND_AT])
        if before and after:
            found.append((low + before.start(), m.end() + after.end(), 1))
    found += [(m.start(), m.end(), 2) for m in LOOSE_IP.finditer(text) if any(c.isdigit() for c in m.group())]
    for m in LOOSE_NUMBER.finditer(text):
        n = sum("0" <= c <= "9" for c in m.group())
        kinds = 8 * (7 <= n <= 15) + 4 * (12 <= n <= 19)
        if kinds:
            found.append((m.start(), m.end(), kinds))
    spans = sorted((s, e) for _, s, e in taken)
    out, last, i = [], 0, 0
    for s, e, kinds in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        whole = (s == 0 or text[s - 1].isspace() or text[s - 1] in OPENS) and (e == len(text) or text[e].isspace() or text[e] in CLOSES)
        while i < len(spans) and spans[i][1] <= s:
            i += 1
        if whole and s >= last and not any(s < b for _, b in takewhile(lambda x: x[0] < e, islice(spans, i, None))):  # noqa: B023
            out.append((kinds, s, e))
            last = e
    return out


def instance(value: str, numeric: bool) -> int:
    """A hash of the value without case and, for numbers, without anything but digits."""
    plain = "".join(c for c in value if "0" <= c <= "9") if numeric else value.lower()
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def _contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and text of every word, and its hash alone and with the word before it (0 for the first of a text)."""
    start, end, doc = words(data, at)
    one = Fingerprints(data, byte_values(11, fold_case=True)).span(start, end) if len(start) else np.zeros(0, FIELD)
    two = np.zeros(len(one), FIELD)
    if len(one) > 1:
        with np.errstate(over="ignore"):
            two[1:] = np.where(doc[1:] == doc[:-1], mix(mix(one[:-1]) + one[1:]), FIELD(0))
    return start, doc, one, two


def _sided(keys: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + FIELD(side)).view(np.int64)


def _patterns(first: np.ndarray, past: np.ndarray, text: np.ndarray, data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """The hashes of the contexts of spans (bytes ``first`` to ``past`` of text number ``text``)."""
    start, doc, one, two = _contexts(data, at)
    out: list[list[int]] = [[] for _ in first]
    left = np.searchsorted(start, first, "right") - 2
    right = np.searchsorted(start, past - 1, "right")
    for side, word, keys, beyond in ((1, left, one, 0), (2, left, two, 0), (3, right, one, 0), (4, right + 1, two, 1)):
        inside = (word - beyond >= 0) & (word < len(start))
        inside[inside] = (doc[word[inside]] == text[inside]) & (doc[word[inside] - beyond] == text[inside]) & (keys[word[inside]] != 0)
        for i, key in zip(np.flatnonzero(inside), _sided(keys[word[inside]], side).tolist(), strict=True):
            out[i].append(key)
    return out


def _mentions(texts: list[str]) -> list[list[dict]]:
    """Of every text its base matches (kind) and candidates (kind -1, kinds as bits), with instance and patterns."""
    out: list[list[dict]] = []
    for text in texts:
        base = base_spans(text)
        made = [{"kind": k, "kinds": 1 << k, "first": s, "past": e, "instance": instance(text[s:e], k in (2, 3))} for k, s, e in base]
        made += [{"kind": -1, "kinds": ks, "first": s, "past": e, "instance": instance(text[s:e], ks >= 4)} for ks, s, e in candidates(text, base)]
        out.append(made)
    held = [i for i, m in enumerate(out) if m]
    if held:
        raw = [texts[i].encode() for i in held]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        first, past, text = [], [], []
        for n, i in enumerate(held):
            # Byte of every code point that begins or ends a mention.
            begins = np.append(np.flatnonzero((data[at[n] : at[n + 1]] & 0xC0) != 0x80), at[n + 1] - at[n]) + at[n]
            first += [begins[m["first"]] for m in out[i]]
            past += [begins[m["past"]] for m in out[i]]
            text += [n] * len(out[i])
        patterns = iter(_patterns(np.array(first), np.array(past), np.array(text), data, at))
        for i in held:
            for m in out[i]:
                m["patterns"] = next(patterns)
    return out


def with_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, and ``mentions``."""
    kept = [c for c in df.columns if c != text]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("kinds", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                found = _mentions([(t or b"").decode("utf-8", "replace") for t in batch.column("__text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(kept))), pa.array(found, kind)], names=[*(f"k{i}" for i in range(len(kept))), "mentions"])

    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), f"mentions {MENTIONS}"])
    return source.mapInArrow(run, schema).toDF(*kept, "mentions")


def occurrences(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern of ``wanted`` stands anywhere in the texts, whatever it encloses."""
    spark, slots = df.sparkSession, 1 << BITMAP_BITS
    # At most slots / 64 rows of one word each.
    place = F.shiftrightunsigned("pattern", 64 - BITMAP_BITS)
    marks = wanted.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")).collect()
    filled = np.zeros(slots // 64, np.int64)
    for r in marks:
        filled[r.w] = r.bits
    bitmap = spark.sparkContext.broadcast(filled.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for whole in batches:
            for batch in chunks(whole, "__text"):
                _, doc, one, two = _contexts(*utf8(batch.column("__text")))
                follows = np.zeros(len(doc), bool)  # a word of the same text comes next
                follows[:-1] = doc[1:] == doc[:-1]
                leads = np.zeros(len(doc), bool)  # a word of the same text comes before
                leads[1:] = follows[:-1]
                third = np.zeros(len(doc), bool)
                third[2:] = doc[2:] == doc[:-2]
                found = []
                for side, keys, where in ((1, one, follows), (2, two, follows & (two != 0)), (3, one, leads), (4, two, third)):
                    sided = _sided(keys[where], side)
                    slot = (sided.view(FIELD) >> FIELD(64 - BITMAP_BITS)).astype(np.int64)
                    found.append(sided[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1])
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts.astype(np.int64), pa.int64())], names=["pattern", "n"])

    seen = df.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, "pattern long, n long")
    return seen.groupBy("pattern").agg(F.sum("n").alias("total")).join(wanted.select("pattern"), "pattern")


def bootstrap(rows: DataFrame, df: DataFrame, text: str, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind) of every candidate that becomes known; ``rows`` holds ``mentions`` of the texts of ``df``."""
    m = rows.select(F.explode("mentions").alias("m")).select("m.*")
    edges = m.select("kind", "kinds", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind", "kinds").agg(F.count("*").alias("n"))
    edges = stored(edges, "pii-edges")
    # Only patterns with a candidate and enough different values can ever matter.
    values = edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    wanted = stored(values.groupBy("pattern").agg(F.count("*").alias("v"), F.min("kind").alias("k")).filter(f"v >= {support} and k = -1").select("pattern"), "pii-wanted")
    seeds = m.filter("kind >= 0").select("instance", "kind").distinct()
    forms = m.filter("kind = -1").select("instance", "kinds").distinct()
    allowed = F.call_function("shiftright", F.col("kinds"), F.col("kind")).bitwiseAND(1) == 1
    # Known values in another form.
    known = stored(forms.join(seeds, "instance").filter(allowed).groupBy("instance").agg(F.min("kind").alias("kind")).select("instance", "kind"), "pii-known")
    if wanted.isEmpty():
        return known
    live = stored(edges.join(broadcast_if_small(wanted, "pii-wanted"), "pattern"), "pii-live")
    totals = stored(occurrences(df, text, wanted), "pii-totals")
    fixed = live.filter("kind >= 0").select("pattern", "kind", "instance", "n")
    loose = live.filter("kind = -1").select("pattern", "instance", "kinds", "n")
    n_known = known.count()
    while True:
        gained = loose.join(broadcast_if_small(known, "pii-known"), "instance").filter(allowed).select("pattern", "kind", "instance", "n")
        mass = fixed.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.countDistinct("instance").alias("v"))
        sure = mass.join(totals, "pattern").withColumn("trust", F.least("n", "total") / (F.col("total") + 1)).filter((F.col("v") >= support) & (F.col("trust") >= trust))
        met = loose.join(broadcast_if_small(sure.select("pattern", "kind", "trust"), "pii-trusted"), "pattern").filter(allowed)
        # An instance may stand in a pattern in several forms; each pattern speaks once.
        met = met.groupBy("instance", "kind", "pattern").agg(F.max("trust").alias("trust")).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        new = met.filter(F.col("score") >= accept).groupBy("instance").agg(F.min(F.struct(-F.col("score"), "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"))
        known = stored(known.unionByName(new.join(known, "instance", "left_anti")), "pii-known")
        before, n_known = n_known, known.count()
        if n_known == before:
            return known


def find_identifiers(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, and two arrays of (kind, first, past) by kind and place: ``base`` and ``spans`` (all)."""
    kept = [c for c in df.columns if c != text]
    plain = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    rows = stored(with_mentions(df.select(*plain, F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))), "pii-mentions")
    known = bootstrap(rows, df.select(F.col(f"`{text}`").alias("text")), "text")
    m = rows.select("row", F.explode(F.filter("mentions", lambda x: x["kind"] == -1)).alias("m")).select("row", "m.*").withColumnRenamed("kind", "of")
    allowed = F.call_function("shiftright", F.col("kinds"), F.col("kind")).bitwiseAND(1) == 1
    found = m.join(broadcast_if_small(known, "pii-accepted"), "instance").filter(allowed).groupBy("row").agg(F.collect_list(F.struct("kind", "first", "past")).alias("found"))
    base = F.array_sort(F.transform(F.filter("mentions", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["past"].alias("past"))))
    every = rows.withColumn("base", base).join(broadcast_if_small(found, "pii-found"), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<kind:int,first:int,past:int>>"))))
    return every.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["past"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
