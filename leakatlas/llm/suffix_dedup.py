"""Repeated passages by content-sampled anchors, refined by fingerprints (not by bucket pointers, see README).

Every string of LENGTH bytes that occurs at two places or more, in one text or
in two, is found; matches never cross texts.

1. Suffixes are sampled by content: of the places in a LENGTH-byte string at
   which a GRAM-byte string fits, the one with the least hash is its anchor. So
   equal strings have equal anchors at equal offsets, and a string occurs again
   only if the GRAM bytes at its anchor do. Texts give about one anchor for each
   150 bytes, with the run of strings that share it.
2. Anchors fall into buckets by their GRAM bytes; buckets of one are done.
3. Each bucket is refined by the identifiers of the buckets at later offsets,
   here fingerprints of the bytes there, put together from those of shorter
   ones: first the whole run. Anchors that stay together have all their strings
   in common. One of each class goes on, and only from buckets with two or more.
4. Recursively, runs are cut into blocks of ever fewer offsets (BLOCKS), down to
   single strings. A block's bucket is refined by the identifiers of the bytes
   that all of its strings share (its core) and of all their bytes (its hull):
   equal hulls decide the block, a core that occurs once ends it, any other goes
   on to smaller blocks, again one of each class.

Each step sorts only what the last left open. Keys carry the bucket's identifier
beside the new one, 128 bits together, so a chance match needs both to collide.
No group is gathered: buckets are counted, and a bucket with a third of all
anchors is as many narrow rows.

Null and empty texts have no strings. A repeated row, or a row whose text occurs
elsewhere, is removed as a whole if it has LENGTH bytes. Rows are known by id and
text; rows alike in both get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakatlas.llm.shared import broadcast_if_small, stored
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, utf8

LENGTH = 400
ORDER_BYTES = 16
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
ANCHOR_FIELDS = "pos int, back int, span int, gram long, whole long"


def gram_bytes(length: int) -> int:
    return max(1, length // 4)


def _long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, place, first string's distance before it, further strings, gram and whole-run fingerprints."""
    gram = gram_bytes(length)
    width, order = length - gram + 1, min(ORDER_BYTES, gram)
    sizes = np.diff(at)
    edge = np.zeros(len(data) + 1, np.int32)
    long_enough = sizes >= length
    np.add.at(edge, at[:-1][long_enough], 1)
    np.add.at(edge, at[1:][long_enough] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(FIELD), none.astype(FIELD)
    finger = Fingerprints(data, byte_values(23, fold_case=False))
    spot = np.arange(len(data) - order + 1)
    least = (finger.span(spot, spot + order) & FIELD(0xFFFFFFFF00000000)) | spot.astype(FIELD)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least[place] & FIELD(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(place) != 1)]))
    low, high = place[fresh], place[np.concatenate([fresh[1:], [len(place)]]) - 1]
    anchor = anchor[fresh]
    back = anchor - low
    with np.errstate(over="ignore"):
        whole = mix(finger.span(low, high + length) + back.astype(FIELD))
    return np.searchsorted(at, low, "right") - 1, anchor, back, high - low, finger.span(anchor, anchor + gram), whole


def sampled(documents: DataFrame, length: int) -> DataFrame:
    """id, digest and the ANCHOR_FIELDS of every anchor; ``documents`` has id, digest, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                data, at = utf8(batch.column("text"))
                doc, place, back, span, gram, run_key = anchors(data, at, length)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("digest").take(rows),
                        *(pa.array(x.astype(np.int32)) for x in (place - at[doc], back, span)),
                        pa.array(_long(gram)),
                        pa.array(_long(run_key)),
                    ],
                    names=["id", "digest", "pos", "back", "span", "gram", "whole"],
                )

    return documents.mapInArrow(run, f"id long, digest long, {ANCHOR_FIELDS}")


REQUEST = "gram long, pos int, back int, span int, first int, last int, weight int"
BLOCKS = (64, 16, 4, 1)


def _wanted_texts(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``rows`` (id, digest, ...) name, each with the list of its rows."""
    fields = [c for c in rows.columns if c not in ("id", "digest")]
    listed = rows.groupBy("id", "digest").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    ids = broadcast_if_small(rows.select("id", "digest").distinct(), "suffix-ids", 200_000)
    return documents.join(ids, ["id", "digest"], "left_semi").join(listed, ["id", "digest"])


def blocks(documents: DataFrame, requests: DataFrame, size: int, length: int) -> DataFrame:
    """The blocks of ``size`` offsets of all requests: core and hull, and the offsets that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                data, at = utf8(batch.column("text"))
                asked = batch.column("asked")
                doc = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
                flat = asked.flatten()
                gram, pos, back, span, first, last, weight = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7))
                low, high = np.maximum(back - span, first), np.minimum(back, last)
                count = high // size - low // size + 1
                which = np.repeat(np.arange(len(doc)), count)
                block = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + (low // size)[which]
                finger = Fingerprints(data, byte_values(23, fold_case=False))
                place = (at[doc] + pos)[which]
                near, far = block * size, block * size + size - 1
                core = finger.span(place - near, place - far + length)
                inside = (place - far >= at[doc][which]) & (place - near + length <= at[doc + 1][which])
                ids, digests = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).astype(FIELD)[doc][which] for c in ("id", "digest"))
                with np.errstate(over="ignore"):
                    alone = mix(mix(mix(ids) + digests) + pos[which].astype(FIELD)) + block.astype(FIELD)
                hull = np.where(inside, finger.span(np.where(inside, place - far, 0), np.where(inside, place - near + length, 0)), alone)
                rows = pa.array(doc[which])
                ints = (pos[which], back[which], span[which], np.maximum(near, low[which]), np.minimum(far, high[which]), weight[which], block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("digest").take(rows), pa.array(gram[which]), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(_long(core)), pa.array(_long(hull))],
                    names=["id", "digest", "gram", "pos", "back", "span", "first", "last", "weight", "block", "core", "hull"],
                )

    return _wanted_texts(documents, requests).select("id", "digest", "text", "asked").mapInArrow(run, f"id long, digest long, {REQUEST}, block int, core long, hull long")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, digest, start, end of byte ranges that repeated strings cover; they may overlap. ``documents`` as ``keyed`` gives it."""
    found = stored(sampled(documents, length), "suffix-anchors")
    classes = found.groupBy("gram", "whole").agg(F.count("*").alias("n"))
    buckets = classes.groupBy("gram").agg(F.sum("n").alias("in_bucket"), F.count("*").alias("classes")).filter("in_bucket > 1")
    classes = stored(classes.join(buckets, "gram").select("gram", "whole", "n", "classes"), "suffix-classes")
    members = stored(found.join(classes, ["gram", "whole"]), "suffix-members")
    spans = members.filter("n > 1").select("id", "digest", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") - F.col("back") + F.col("span") + length).alias("end"))
    one = F.struct("id", "digest", "pos", "back", "span")
    requests = (
        members.filter("classes > 1")
        .groupBy("gram", "whole")
        .agg(F.min(one).alias("r"), F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"))
        .select("gram", "r.*", (F.col("r.back") - F.col("r.span")).alias("first"), F.col("r.back").alias("last"), "weight")
    )
    for size in [b for b in BLOCKS if b == 1 or 2 * b <= length]:  # strings of a block must share bytes
        rows = stored(blocks(documents, requests.select("id", "digest", *[f.split()[0] for f in REQUEST.split(", ")]), size, length), "suffix-blocks")
        one = F.struct("id", "digest", "pos", "back", "span", "first", "last")
        same = rows.groupBy("gram", "block", "core", "hull").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"), F.min(one).alias("r"))
        cores = same.groupBy("gram", "block", "core").agg(F.count("*").alias("hulls"))
        same = stored(same.join(cores, ["gram", "block", "core"]).filter("n > 1 or hulls > 1"), "suffix-hulls")
        # Members of classes of two and more are decided already; of the others, equal hulls are.
        decided = rows.filter("weight = 1").join(same.filter("n > 1").select("gram", "block", "core", "hull"), ["gram", "block", "core", "hull"])
        spans = spans.union(decided.select("id", "digest", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + length).alias("end")))
        requests = same.filter("hulls > 1").select("gram", "r.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    return spans


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, digest, text: what the steps above read."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(value).alias("digest"), value.alias("text"))


def cut_batches(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.RecordBatch]:
    """``others``, the kept text and ADDED of rows with text and ``asked``, the ranges to cut; arrays are of one chunk of texts."""
    for whole in batches:
        for batch in chunks(whole):
            data, at = utf8(batch.column("text"))
            asked = batch.column("asked")
            doc = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + at[doc] for i in range(2))
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(data)]
            begins[inner] = gone[inner]
            sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, begins)]
            left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            made = [
                pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()),
                pa.array(np.diff(at)),
                *(pa.array(s[at[1:]] - s[at[:-1]]) for s in sums),
                pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, "text", *ADDED])


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """All columns of ``df`` with repeated bytes cut from ``text``, plus n_bytes, n_removed, n_spans, kept_sha256.

    Characters that a cut splits are dropped from the text, not from the digest.
    """
    kept = [c for c in df.columns if c not in ADDED]
    spans = stored(repeated_spans(keyed(df, key, text), length), "suffix-spans")
    per_text = spans.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("asked"))
    ids = broadcast_if_small(spans.select("id", "digest").distinct(), "suffix-cut", 200_000)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept) if c != text], value.alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(value).alias("digest"))
    others = [f"k{i}" for i, c in enumerate(kept) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_batches(batches, others)

    with_spans = rows.join(ids, ["id", "digest"], "left_semi").join(per_text, ["id", "digest"])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in others), "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    cut = with_spans.select(*others, "text", "asked").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    whole = rows.join(ids, ["id", "digest"], "left_anti").select(*others, "text", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    back = [F.col("text").alias(text) if c == text else F.col(f"k{i}").alias(c) for i, c in enumerate(kept)]
    return cut.union(whole).select(*back, *ADDED)
