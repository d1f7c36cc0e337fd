"""MinHash near-duplicates with min-max hashing.

A text is the set of its distinct word shingles. Under each of PERMUTATIONS
hash functions both the least and the greatest value are kept, so that half the
evaluations give a signature of the same length; minimum and maximum each agree
with the Jaccard similarity of two sets, and their mean varies less. ROWS values
make a band; texts that share a band are candidates. At similarity 0.8 a pair
is missed with probability (1 - 0.8^7)^42, 5e-5; at 0.85 it is 9e-8.

Equal sets are one node from the start. In each bucket a hub is compared with
all members: the node whose buckets are the fullest, as the original of many
copies is. Then nodes already connected need no comparison, and in every bucket
that still holds several components further hubs, taken outside its largest
component, are compared with all members of other components, more of them in
each round, until each bucket is one component or all its pairs are decided. So
no pair of a bucket is left out, and a group of n near copies of one text costs
about n comparisons. A few bits of every signature value are compared first: a
pair goes on to the full sets unless its sizes exclude a link or so few values
agree that a link has odds below ODDS; the same pair of several buckets goes on
from the first only. Members of buckets that the first hubs leave mixed get a
second signature for this test, of 2 x LONG values with one bit each, computed
for them alone; it tells similarities 0.05 apart. Where copies of copies are
alike within that distance below the threshold, the pairs that pass still grow
faster than their group.

Null, empty and wordless texts have no shingles and link with nothing; fewer
than five words are one shingle. A null id links with nothing. Rows with equal
ids are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakatlas.llm.components import components
from leakatlas.llm.shared import broadcast_if_small, stored
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, utf8, words

SHINGLE = 5
ROWS, BANDS = 7, 42
PERMUTATIONS = ROWS * BANDS // 2
PLANES = 4  # bits kept of every signature value
PLANE = -(-2 * PERMUTATIONS // 64)  # 64-bit words for one bit of all values
LONG = 1024  # permutations of the long signature, of which one bit a value is kept
ODDS = 1e-6
FIRST_HUBS, HUB_GROWTH = 8, 8


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts one after another, and where each text's begin."""
    start, end, doc = words(data, at)
    h = Fingerprints(data, byte_values(17, fold_case=True)).span(start, end)
    n = len(at) - 1
    n_words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - SHINGLE + 1), FIELD)
        for j in range(SHINGLE):
            rolled = mix(rolled * FIELD(5) + h[j : j + len(rolled)])
        sets = []
        for i in range(n):
            count = n_words[i]
            if count >= SHINGLE:
                sets.append(np.unique(rolled[first[i] : first[i + 1] - SHINGLE + 1]))
            elif count:
                one = np.array([count], FIELD)
                for x in h[first[i] : first[i + 1]]:
                    one = mix(one * FIELD(7) + x)
                sets.append(one)
            else:
                sets.append(np.zeros(0, FIELD))
    return (np.concatenate(sets) if sets else np.zeros(0, FIELD)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and PLANES bits of every signature value, packed (n x PLANES * PLANE); zeros for empty sets."""
    n = len(at) - 1
    filled = np.flatnonzero(at[1:] > at[:-1])
    out = np.zeros((2 * PERMUTATIONS, n), FIELD)
    seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=FIELD) * FIELD(0xA0761D6478BD642F)) | FIELD(1)
    with np.errstate(over="ignore"):
        if len(filled):
            begin = at[:-1][filled]
            for j in range(PERMUTATIONS):
                x = values * seeds[2 * j]
                x ^= x >> FIELD(32)
                x *= seeds[2 * j + 1]
                out[j, filled] = np.minimum.reduceat(x, begin)
                out[PERMUTATIONS + j, filled] = np.maximum.reduceat(x, begin)
        bands = np.tile(np.arange(1, BANDS + 1, dtype=FIELD)[:, None], (1, n))
        for r in range(ROWS):
            bands = mix(bands * FIELD(31) + out[r * BANDS : (r + 1) * BANDS])
        spread = mix(out).T
        bits = np.zeros((n, PLANES, 64 * PLANE), np.uint8)
        for plane in range(PLANES):
            bits[:, plane, : 2 * PERMUTATIONS] = (spread >> FIELD(plane)) & FIELD(1)
    return bands.T, np.packbits(bits, axis=2).reshape(n, -1).view(np.int64)


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def listed(table: np.ndarray) -> pa.Array:
    """Rows of a table as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), _as_long(table.reshape(-1)))


def set_prints(values: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two sums over each set that together name it."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, FIELD), np.cumsum(mix(values + FIELD(s)))]) for s in (1, 2)]
        return [_as_long(s[at[1:]] - s[at[:-1]]) for s in sums]


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("__text"))


def profiles(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, set_a and set_b (a fingerprint of the set), bands, marks of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                values, at = shingle_sets(*utf8(batch.column("__text")))
                bands, marks = signatures(values, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(at)), *set_prints(values, at), listed(bands), listed(marks)],
                    names=["id", "n_shingles", "set_a", "set_b", "bands", "marks"],
                )

    return _texts(documents, key, text).mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, bands array<long>, marks array<long>")


def full_sets(documents: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id and shingles of the documents whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                values, at = shingle_sets(*utf8(batch.column("__text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _as_long(values))], names=["id", "shingles"])

    wanted = broadcast_if_small(ids, "minmax-wanted", 200_000)
    return _texts(documents, key, text).join(wanted, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def long_marks(documents: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id, set_a, set_b and the long signature of the documents whose id is in ``ids``: one bit of each of 2 * LONG values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 2 * LONG + 1, dtype=FIELD) * FIELD(0xD1B54A32D192ED03)) | FIELD(1)
        for whole in batches:
            for batch in chunks(whole, "__text"):
                values, at = shingle_sets(*utf8(batch.column("__text")))
                set_a, set_b = set_prints(values, at)
                filled = np.flatnonzero(at[1:] > at[:-1])
                bits = np.zeros((2 * LONG, len(at) - 1), np.uint8)
                with np.errstate(over="ignore"):
                    for j in range(LONG if len(filled) else 0):
                        x = values * seeds[2 * j]
                        x ^= x >> FIELD(32)
                        x *= seeds[2 * j + 1]
                        for k, least in ((j, np.minimum), (LONG + j, np.maximum)):
                            bits[k, filled] = mix(least.reduceat(x, at[:-1][filled])) & FIELD(1)
                packed = np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), set_a, set_b, listed(packed)], names=["id", "set_a", "set_b", "marks"])

    wanted = broadcast_if_small(ids, "minmax-wanted", 200_000)
    return _texts(documents, key, text).join(wanted, "id", "left_semi").mapInArrow(run, "id long, set_a long, set_b long, marks array<long>")


def least_agreement(percent: int, n: int, planes: int) -> int:
    """The values of ``n`` with equal bits below which a link at ``percent`` has odds under ODDS; other values agree by chance."""
    p, total = percent / 100 + (1 - percent / 100) / 2**planes, 0.0
    for k in range(n + 1):
        total += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) if p < 1 else k == n
        if total > ODDS:
            return k
    return n


def possible(percent: int, n: int = 2 * PERMUTATIONS, planes: int = PLANES) -> Column:
    """Whether u and v (columns nu, nv, mu, mv) may be linked, by ``planes`` bits of each of ``n`` signature values."""
    words, differ = -(-n // 64), F.lit(0)
    for i in range(words):
        other = F.lit(0).cast("long")
        for plane in range(planes):
            at = plane * words + i
            other = other.bitwiseOR(F.col("mu")[at].bitwiseXOR(F.col("mv")[at]))
        differ = differ + F.bit_count(other)
    return (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (n - differ >= least_agreement(percent, n, planes))


def confirmed(pairs: DataFrame, documents: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    likely = stored(pairs, "minmax-likely")
    if likely.isEmpty():
        return likely
    ids = likely.select(F.col("u").alias("id")).union(likely.select(F.col("v").alias("id"))).distinct()
    sets = stored(full_sets(documents, ids, key, text), "minmax-sets")
    links = (
        likely.join(sets.toDF("v", "sv").hint("shuffle_hash"), "v")
        .join(sets.toDF("u", "su").hint("shuffle_hash"), "u")
        .withColumn("shared", F.size(F.array_intersect("su", "sv")))
        .filter(100 * F.col("shared") >= percent * (F.size("su") + F.size("sv") - F.col("shared")))
        .select("u", "v")
    )
    return stored(links, "minmax-links")


def near_duplicates(documents: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of every row; links are pairs with ``percent`` similarity or more."""
    rows = stored(profiles(documents, key, text), "minmax-profiles")
    nodes = stored(
        rows.filter("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min_by(F.struct("id", "bands", "marks"), "id").alias("x")).select("set_a", "set_b", "n_shingles", "x.*"),
        "minmax-nodes",
    )
    member = nodes.select("id", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(member.join(sizes, "bucket"), "minmax-members")
    fullness = members.groupBy("id").agg(F.sum("n").alias("fullness"))
    first = members.join(fullness, "id").groupBy("bucket").agg(F.max(F.struct("fullness", -F.col("id"))).alias("h")).select("bucket", (-F.col("h.col2")).alias("hub"))
    members = stored(members.join(first, "bucket").filter("id <> hub").select("bucket", "id", "hub"), "minmax-members")
    narrow = nodes.select("id", "n_shingles", "marks")
    pairs = members.select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    pairs = pairs.join(narrow.toDF("u", "nu", "mu"), "u").join(narrow.toDF("v", "nv", "mv"), "v").filter(possible(percent)).select("u", "v")
    roots = stored(components(confirmed(pairs, documents, percent, key, text)), "minmax-roots")
    members, hubs, finer = members.select("bucket", "id"), FIRST_HUBS, None
    while True:
        labelled = members.join(roots.toDF("id", "root"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("label"))
        classes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        mixed = classes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1").select("bucket", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("others"))
        unsettled = stored(labelled.join(mixed, "bucket"), "minmax-unsettled")
        if unsettled.isEmpty():
            break
        if finer is None:  # members of later rounds are among those of the first
            long = long_marks(documents, unsettled.select("id").distinct(), key, text).dropDuplicates(["id", "set_a", "set_b"])
            finer = stored(nodes.select("id", "set_a", "set_b", "n_shingles", "bands").join(long, ["id", "set_a", "set_b"]).drop("set_a", "set_b"), "minmax-finer")
        unsettled = unsettled.join(finer, "id")
        outside = F.col("label") != F.col("top")
        sure = unsettled.filter(outside).groupBy("bucket").agg(F.min("id").alias("sure"))
        drawn = outside & ((F.pmod(F.xxhash64("id", F.lit(hubs)), F.col("others")) < hubs) | (F.col("id") == F.col("sure")))
        dealt = stored(unsettled.join(sure, "bucket").withColumn("is_hub", drawn), "minmax-dealt")
        chosen = dealt.filter("is_hub").select("bucket", F.col("id").alias("u"), F.col("label").alias("lu"), F.col("n_shingles").alias("nu"), F.col("marks").alias("mu"), F.col("bands").alias("bu"))
        other = dealt.select("bucket", F.col("id").alias("v"), F.col("label").alias("lv"), F.col("n_shingles").alias("nv"), F.col("marks").alias("mv"), F.col("bands").alias("bv"), F.col("is_hub").alias("hv"))
        earliest = F.element_at(F.filter("bu", lambda x, i: x == F.col("bv")[i]), 1) == F.col("bucket")
        once = ~F.col("hv") | (F.col("u") < F.col("v"))
        pairs = other.join(chosen, "bucket").filter((F.col("lu") != F.col("lv")) & once & possible(percent, 2 * LONG, 1) & earliest).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = confirmed(pairs, documents, percent, key, text)
        members = stored(dealt.filter("not is_hub").select("bucket", "id"), "minmax-members")
        if not links.isEmpty():
            roots = stored(components(roots.toDF("u", "v").union(links)), "minmax-roots")
        hubs *= HUB_GROWTH
    labels = nodes.join(roots.toDF("id", "root"), "id", "left").select("set_a", "set_b", F.col("n_shingles").alias("size"), F.coalesce("root", "id").alias("component"))
    same = (F.col("rows.set_a") == F.col("labels.set_a")) & (F.col("rows.set_b") == F.col("labels.set_b")) & (F.col("n_shingles") == F.col("size")) & (F.col("n_shingles") > 0)
    joined = rows.alias("rows").join(labels.alias("labels"), same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
