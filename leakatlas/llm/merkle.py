"""A Merkle manifest of a table, its leaves placed by ranks in bitmaps.

Every row is a leaf: the hash of its columns. The leaves of a group ascend by
key; runs of ``FAN`` consecutive nodes become the hash of their concatenated
digests, until one node, the group's root, is left. The group roots, ordered by
group, are hashed to the root of all in the same way.

No sort puts the leaves in order. Per group, the keys are held as compressed
bitmaps: containers of 1,024 keys, of which only the 64-bit words with a bit are
kept. Partial bitmaps of a container are merged by OR before and after the
shuffle. Directories of popcounts lie above them: one in the container, over its
words, and one for each of the higher digits of the key, over at most 2**14
siblings each. The rank of a key is the sum of the directory entries on its way
plus the popcount of the bits before its own. Rank / FAN names a leaf's run and
the remainder its slot; runs are gathered as arrays of slots under that name, and
so is every level above, which has a FAN-th of the rows.

Rows of one group and key follow each other by the first 60 bits of their leaf,
and alike rows by a number given to each stored row. Both are ranked by bitmaps
in the same way, so a key that a third of all rows share is never in one task. A
null key counts as the least long. A null group is the first one. An empty table
has no manifest rows. Null columns are written ``-``, others as the number of
their bytes, a colon and the value, so that values never run into each other;
other columns of the table are not read.

Proofs are taken down the levels a run at a time: all leaves of a run share what
lies above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakatlas.llm.shared import stored

FAN = 16
CONTAINER_BITS = 10
LEVEL_BITS = 14  # digits of the directories above the containers; four of them cover a long
LEAST_KEY = -(2**63)
HOT_ROWS = 8192  # a container with more rows, and more than a HOT_PARTS-th of all, is joined in parts
HOT_PARTS = 10_000


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: every column as ``-`` or its byte count, a colon and its value."""

    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return sha256(*[written(c) for c in columns])


# ---- ranks ----


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _bitmaps(counted: DataFrame, group: list[str]) -> DataFrame:
    """(group, container, words, held): the words of each container that are not zero, and its number of rows.

    ``counted`` holds (group, k, n): every key once, with its number of rows. A word
    is (w, bits, n, more): its place, its bits, its rows and, of keys with
    several rows, (bit, further rows).
    """
    bit = F.col("k").bitwiseAND(63).cast("int")
    return (
        counted.select(
            *group,
            F.shiftright("k", CONTAINER_BITS).alias("container"),
            F.shiftright("k", 6).bitwiseAND((1 << CONTAINER_BITS - 6) - 1).cast("int").alias("w"),
            _shifted(_long(1), bit).alias("bits"),
            "n",
            F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("further"))).alias("more"),
        )
        .groupBy(*group, "container", "w")
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"), F.collect_list("more").alias("more"))
        .groupBy(*group, "container")
        .agg(F.array_sort(F.collect_list(F.struct("w", "bits", "n", "more"))).alias("words"), F.sum("n").alias("held"))
    )


def _directories(bitmaps: DataFrame, group: list[str]) -> DataFrame:
    """``bitmaps`` plus ``before``: the rows of the group in lower containers, by sums over siblings level by level."""
    levels = -(-(64 - CONTAINER_BITS) // LEVEL_BITS)
    names = [f"p{i}" for i in range(levels)]  # the number of the container without its last i digits
    placed = bitmaps.withColumnRenamed("container", names[0])
    tables = [placed.select(*group, *[F.shiftright(names[0], LEVEL_BITS * i).alias(n) for i, n in enumerate(names)], F.col("held").alias("n"))]
    for i in range(1, levels):
        tables.append(tables[-1].groupBy(*group, *names[i:]).agg(F.sum("n").alias("n")))
    above = None
    for i in reversed(range(levels)):
        parent = [*group, *names[i + 1 : i + 2]]
        siblings = Window.partitionBy(*parent).orderBy(names[i]).rowsBetween(Window.unboundedPreceding, -1)
        here = tables[i].select(*parent, names[i], F.coalesce(F.sum("n").over(siblings), _long(0)).alias("before"))
        if above is not None:
            here = here.join(above, parent).select(*parent, names[i], (F.col("before") + F.col("up")).alias("before"))
        above = here.select(*group, names[i], F.col("before").alias("up"))
    return placed.join(above, [*group, names[0]]).select(*group, F.col(names[0]).alias("container"), "words", "held", F.col("up").alias("before"))


def ranked(rows: DataFrame, group: list[str], key: str, rank: str) -> DataFrame:
    """``rows`` plus ``rank`` (rows of the group with a smaller key) and ``__same`` (rows with this group and key).

    ``group`` columns are not null; a null key counts as the least long.
    """
    k = F.coalesce(F.col(key).cast("long"), _long(LEAST_KEY))
    counted = rows.groupBy(*group, k.alias("k")).agg(F.count("*").alias("n"))
    index = stored(_directories(stored(_bitmaps(counted, group), "rank-bitmaps"), group), "rank-index")
    asked = rows.withColumn("container", F.shiftright(k, CONTAINER_BITS))
    on = [*group, "container"]

    # Containers of keys with very many rows: fewer than HOT_PARTS, so that their list can be sent around.
    hot_rows = max(HOT_ROWS, (index.agg(F.sum("held")).first()[0] or 0) // HOT_PARTS)
    hot = index.filter(F.col("held") > hot_rows).select(*on, F.ceil(F.col("held") / HOT_ROWS).cast("int").alias("__parts"))
    if hot.isEmpty():
        found = asked.join(index, on)
    else:
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col("__parts"), F.lit(1))).cast("int")
        asked = asked.join(F.broadcast(hot), on, "left").withColumn("__part", part).drop("__parts")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
        found = asked.join(index.join(F.broadcast(hot), on, "left").withColumn("__part", copies).drop("__parts"), [*on, "__part"])

    w, bit = F.shiftright(k, 6).bitwiseAND((1 << CONTAINER_BITS - 6) - 1).cast("int"), k.bitwiseAND(63).cast("int")
    found = found.withColumn("__w", w).withColumn("__bit", bit).withColumn("__below", F.bitwise_not(_shifted(_long(-1), F.col("__bit"))))

    def further(word: Column, of: Column) -> Column:
        return F.aggregate(F.filter(word["more"], lambda m: of(m["bit"])), _long(0), lambda acc, m: acc + m["further"])

    def held(word: Column) -> Column:
        own = F.bit_count(word["bits"].bitwiseAND(F.col("__below"))).cast("long") + further(word, lambda b: b < F.col("__bit"))
        return F.when(word["w"] < F.col("__w"), word["n"]).when(word["w"] == F.col("__w"), own).otherwise(_long(0))

    before = F.col("before") + F.aggregate("words", _long(0), lambda acc, word: acc + held(word))
    same = F.aggregate(F.filter("words", lambda word: word["w"] == F.col("__w")), _long(1), lambda acc, word: acc + further(word, lambda b: b == F.col("__bit")))
    return found.select(*rows.columns, before.alias(rank), same.alias("__same"))


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, row, node, ...) plus ``at``: the place among the leaves of its tree."""
    first = stored(ranked(leaves, ["tree"], "key", "at"), "manifest-ranks")
    tied = first.filter("__same > 1").drop("__same").withColumn("__key", F.coalesce("key", _long(LEAST_KEY))).withColumn("__head", F.conv(F.substring("node", 1, 15), 16, 10).cast("long"))
    if tied.isEmpty():
        return first.drop("__same")
    by_leaf = stored(ranked(tied, ["tree", "__key"], "__head", "at2").drop("__same"), "manifest-ties")
    by_row = ranked(by_leaf, ["tree", "__key", "__head"], "row", "at3")
    return first.filter("__same = 1").drop("__same").unionByName(by_row.withColumn("at", F.col("at") + F.col("at2") + F.col("at3")).select(*leaves.columns, "at"))


# ---- levels ----


def _levels(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs above ``nodes`` (tree, at, node, carried), and (tree, top).

    A level holds (tree, run, slots): the FAN nodes or fewer of a run in order of
    their slot; that of the leaves also ``cargo``, what they carry. A tree of one
    node has a run 0 of one slot, which is not hashed any more.
    """
    levels: list[DataFrame] = []
    tops = None
    while True:
        slot = F.struct((F.col("at") % FAN).cast("int").alias("slot"), "node", *carried)
        runs = nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("run")).agg(F.array_sort(F.collect_list(slot)).alias("s"))
        cargo = [F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in carried])).alias("cargo")] if carried else []
        runs = stored(runs.select("tree", "run", F.transform("s", lambda x: x["node"]).alias("slots"), *cargo), "manifest-runs")
        alone = (F.col("run") == 0) & (F.size("slots") == 1)
        done = runs.filter(alone).select("tree", F.col("slots")[0].alias("top"))
        tops = done if tops is None else tops.union(done)
        levels.append(runs)
        nodes, carried = runs.filter(~alone).select("tree", F.col("run").alias("at"), F.sha2(F.array_join("slots", ""), 256).alias("node")), []
        if nodes.isEmpty():
            return levels, tops


def _siblings(slots: Column, slot: Column) -> Column:
    """The other digests of a run, those on the left and those on the right of ``slot``."""
    return F.struct(F.array_join(F.slice(slots, F.lit(1), slot), "").alias("left"), F.array_join(F.slice(slots, slot + 2, F.lit(FAN)), "").alias("right"))


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The runs of the lowest level plus ``up``: what lies beside the way from a run to the end, and the columns of ``ends``.

    ``ends`` (tree, up, ...) continues above the tops of the trees. Levels are
    joined from the top down, on the run's own name.
    """
    extra = [c for c in ends.columns if c != "tree"]
    above = None  # (tree, run, extra) of the runs of the level in hand that lie below another run
    for i, runs in reversed(list(enumerate(levels))):
        if above is None:
            here = runs.join(ends, "tree")
        else:
            topmost = runs.filter("run = 0").join(above.filter("run = 0"), "tree", "left_anti").join(ends, "tree")
            here = runs.join(above, ["tree", "run"]).unionByName(topmost)
        if i == 0:
            return here
        alone = (F.col("run") == 0) & (F.size("slots") == 1)
        below = here.filter(~alone).select("tree", "run", "slots", *extra, F.posexplode("slots").alias("slot", "node"))
        joined = F.concat(F.array(_siblings(F.col("slots"), F.col("slot"))), F.col("up"))
        # A tree of one node has ended: its run below is the topmost one.
        above = stored(below.select("tree", (F.col("run") * FAN + F.col("slot")).alias("run"), *[joined.alias("up") if c == "up" else c for c in extra]), "manifest-paths")
    return here


def _leaves_with_paths(runs: DataFrame, kept: list[str]) -> DataFrame:
    """One row a leaf: its cargo, ``kept`` and ``path``, what lies beside its way to the root."""
    alone = (F.col("run") == 0) & (F.size("slots") == 1)
    path = F.when(alone, F.col("up")).otherwise(F.concat(F.array(_siblings(F.col("slots"), F.col("slot"))), F.col("up")))
    return runs.select("run", "slots", "up", *kept, F.posexplode("cargo").alias("slot", "c")).select("c.*", *kept, F.col("slots")[F.col("slot")].alias("leaf"), path.alias("path"))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digests beside the way, level by level from left to right, concatenated."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), "")


def _ordered(groups: DataFrame) -> DataFrame:
    """``groups`` (tree, ...) plus ``at``, its place in order of ``tree``: ranges in order, then places within each."""
    cut = stored(groups.repartitionByRange("tree").withColumn("__part", F.spark_partition_id()), "manifest-groups")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("n"))  # one row a range
    first = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), _long(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("tree")) - 1
    return cut.withColumn("__within", within).join(F.broadcast(first), "__part").select(*groups.columns, (F.col("__first") + F.col("__within")).cast("long").alias("at"))


def manifest(df: DataFrame, key: str, group: str, columns: list[str], found: list[Column] | None = None, when: Column | None = None) -> DataFrame:
    """Key, leaf, subroot, root, path, folded_root and verified of every row.

    ``columns`` make the leaf. Where ``when`` holds, ``found`` (as many columns) is
    what a later reader sees; ``folded_root`` follows from that and the path, and
    ``verified`` says whether it is the root.
    """
    now = F.when(F.coalesce(when, F.lit(False)), leaf(found)) if found is not None and when is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first
    leaves = df.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), leaf([F.col(f"`{c}`") for c in columns]).alias("node"), now.alias("now"))
    levels, tops = _levels(_placed(stored(leaves, "manifest-leaves")), ["key", "now"])

    subroots = _ordered(tops).select(F.lit("").alias("tree"), "at", F.col("top").alias("node"), F.col("tree").alias("of"))
    upper, root = _levels(subroots, ["of"])
    found_root = root.first()
    root_text = F.lit(found_root.top if found_root else None).cast("string")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    ends = _leaves_with_paths(_paths(upper, root.select("tree", nothing.alias("up"))), []).select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("up"))

    runs = _paths(levels, stored(ends, "manifest-ends"))
    rows = _leaves_with_paths(runs, ["subroot"])
    rows = rows.withColumn("root", root_text).withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return rows.select(F.col("key").alias(key), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
