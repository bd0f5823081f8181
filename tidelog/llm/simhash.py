"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of ``SEGMENT_BITS`` bits and mapped to the vector of its
per-segment bit counts. The Manhattan distance of two such vectors never exceeds the Hamming distance
of their fingerprints, so the pairs within ``budget`` bits are among the pairs of vectors within
``budget``. That range join runs on a grid: the segments form ``2 * budget`` groups, a distance of
``budget`` leaves at least half the groups without any, and every choice of half the groups is one
projection whose cells hold the vectors that agree there.

Two fingerprints within the budget also agree in every bit of some half, so the nodes of a cell are told
apart by the bits of its half first. Each spot, the nodes of a cell that agree there, gets up to ``HUBS``
hubs, and every node of it is held against these: against the Manhattan bound, then against the
fingerprint itself. A spot is settled once any two of its nodes are connected or one of them was a hub.
So the nodes outside the largest component of a spot are its next hubs. Where there are more of these than
``HUBS``, the nodes of the spot go to meeting points, all fingerprints that differ in half the budget of
bits at most, and two nodes are within the budget exactly if they share one. At each step a node costs a
fixed number of rows, whatever the size of its group; equal fingerprints are one node, so copies cost
nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import map_rows, settled, table
from tidelog.llm.components import components
from tidelog.llm.simhash_kernel import fingerprint

#: Bits of one segment, 1 or 2. A segment of 2 keeps 1.5 bits of information in its count, a segment of 1 all of it.
SEGMENT_BITS = 2
BUDGET = 4
#: Nodes of a spot that all its nodes are held against at a time, two at least.
HUBS = 4

#: Nodes whose cells one task lays out.
NODES = 1 << 15
#: What names a spot: the number of the half and the bits there.
SPOT = ["number", "half"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row; a null or empty text has the fingerprint zero."""

    def kernel(columns: list) -> list:
        ids, texts = columns
        return [ids, [fingerprint(t, width) for t in texts]]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, ["doc_id", "text"], SCHEMA)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _halves(budget: int) -> list[tuple[int, ...]]:
    if budget not in (2, 4):
        raise ValueError("a budget of 2 or 4 bits, which divides 64 bits into twice as many groups")
    return list(combinations(range(2 * budget), budget))


def embedded(fp: Column, segment_bits: int = SEGMENT_BITS) -> Column:
    """The bit counts of all segments in unary, in the place of the segments.

    The Manhattan distance of two vectors of counts is the number of bits in which their codes differ.
    """
    if segment_bits == 1:
        return fp
    if segment_bits != 2:
        raise ValueError("segments have 1 or 2 bits")
    even = F.lit(int("01" * 32, 2))
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(nodes: DataFrame, budget: int = BUDGET, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``key, fp``: the cells of every node, one for each half of the groups of segments.

    The upper half of a key is the number of the half, the lower the counts there in unary.
    """
    width = 32 // budget
    part = lambda k: F.shiftrightunsigned("code", width * k).bitwiseAND(F.lit((1 << width) - 1))
    coded = nodes.select("fp", embedded(F.col("fp"), segment_bits).alias("code"))
    coded = coded.select("fp", *(part(k).alias(f"g{k}") for k in range(2 * budget)))
    keys = []
    for n, half in enumerate(_halves(budget)):
        key = F.lit(n).cast("long")
        for k in half:
            key = F.shiftleft(key, width).bitwiseOR(F.col(f"g{k}"))
        keys.append(key)
    return coded.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _hubs() -> Column:
    """Up to ``HUBS`` nodes of a group: the least, the greatest and those with the least of some hashes."""
    drawn = (F.min_by("fp", F.xxhash64("fp", F.lit(n))) for n in range(HUBS - 2))
    return F.array_distinct(F.array(F.min("fp"), F.max("fp"), *drawn))


def _spots(nodes: DataFrame, budget: int, segment_bits: int) -> DataFrame:
    """``number, half, fp, n, free, hubs``: the nodes of every spot that has several, with its size, the bits in which they differ and its hubs."""
    width = 32 // budget
    # a node has as many cells as there are halves, so a table of nodes that is one small file is too much for one task
    placed = cells(nodes.repartition(-(-nodes.count() // NODES) or 1, "fp"), budget, segment_bits)
    shared = settled(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "cells")
    kept = settled(placed.hint("merge").join(shared, "key"), "placed")  # occupied cells grow with the input: never broadcast
    masks = F.array(*(F.lit(_signed(sum((1 << width) - 1 << width * k for k in half))) for half in _halves(budget)))
    number = F.shiftright("key", 32).cast("int")
    split = kept.select(number.alias("number"), F.col("fp").bitwiseAND(F.get(masks, number)).alias("half"), "fp")
    spots = split.groupBy("number", "half").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("free"), _hubs().alias("hubs"))
    return settled(split.hint("merge").join(spots.where("n > 1"), SPOT), "spots")


def _held(pairs: DataFrame, budget: int, segment_bits: int) -> DataFrame:
    """``u, v``: the pairs ``fp, hub`` within the Manhattan bound and within the budget, each once."""
    u, v = F.col("fp"), F.col("hub")
    near = (_differ(embedded(u, segment_bits), embedded(v, segment_bits)) <= budget) & (_differ(u, v) <= budget)
    return pairs.where((u != v) & near).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def _through_points(nodes: DataFrame, budget: int) -> DataFrame:
    """``u, v``: links of the different ``nodes(fp, free)`` through meeting points; partners differ in bits of ``free`` only."""
    steps = [sum(1 << b for b in bits) for n in range(budget // 2 + 1) for bits in combinations(range(64), n)]
    met = nodes.select("fp", "free", F.explode(F.array(*(F.lit(_signed(m)) for m in steps))).alias("step"))
    met = met.where(F.col("step").bitwiseAND(F.bitwise_not("free")) == 0).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("at"))
    points = met.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return met.hint("merge").join(points, "at").where("fp <> v").select(F.col("v").alias("u"), F.col("fp").alias("v")).distinct()


def _linked(nodes: DataFrame, budget: int, segment_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the first hubs, the components they make, and the links that are still needed."""
    members = _spots(nodes, budget, segment_bits)
    first = settled(_held(members.select("fp", F.explode("hubs").alias("hub")), budget, segment_bits), "links")
    roots = settled(components(first), "roots")
    unsettled = members.where(F.size("hubs") < F.col("n") - 1).join(roots, F.col("fp") == F.col("u"), "left")
    unsettled = settled(unsettled.select(*SPOT, "fp", "free", "hubs", F.coalesce("v", "fp").alias("root")), "unsettled")
    largest = unsettled.groupBy(*SPOT, "root").agg(F.count("*").alias("n")).groupBy(*SPOT).agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    others = unsettled.join(largest, SPOT).where((F.col("root") != F.col("largest")) & ~F.array_contains("hubs", F.col("fp")))
    order = Window.partitionBy(*SPOT).orderBy("fp")
    ranked = others.select(*SPOT, "fp").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS + 1)
    ranked = settled(ranked, "next-hubs")
    hubs = ranked.where(F.col("rank") <= HUBS).select(*SPOT, F.col("fp").alias("hub"))
    more = settled(_held(unsettled.hint("merge").join(hubs, SPOT), budget, segment_bits), "links")
    many = ranked.where(F.col("rank") > HUBS).select(*SPOT)
    if not many.isEmpty():
        loose = unsettled.join(many, SPOT, "left_semi").groupBy("fp").agg(F.bit_or("free").alias("free"))
        more = more.unionAll(settled(_through_points(loose, budget), "links"))
    return first, roots, more


def links(nodes: DataFrame, budget: int = BUDGET, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``u, v``: pairs of different fingerprints of ``nodes(fp)`` within ``budget`` bits.

    Not all of them, but enough that any two nodes that all of them connect are connected.
    """
    first, _, more = _linked(nodes, budget, segment_bits)
    return first.unionAll(more)


def groups(nodes: DataFrame, budget: int = BUDGET, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``u, v``: for each fingerprint of ``nodes(fp)`` that is linked the least of its component, for that itself."""
    _, roots, more = _linked(nodes, budget, segment_bits)
    found = roots if more.isEmpty() else components(roots.unionAll(more))
    return found.unionAll(found.select(F.col("v").alias("u"), "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = BUDGET, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text, ...)``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over
    fingerprints that differ in at most ``budget`` bits, itself included. Null and empty texts have the
    fingerprint zero and are linked like any other. Rows with a null id get a fingerprint, no component,
    and link nothing. Repeated rows come out as often as they went in; an empty table gives no rows.
    Other columns are ignored.
    """
    marked = settled(fingerprints(docs, width), "fingerprints")
    nodes = settled(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    grouped = groups(nodes.select("fp"), budget, segment_bits).withColumnRenamed("u", "fp")
    least = nodes.join(grouped, "fp").groupBy("v").agg(F.min("first").alias("least"))
    linked = grouped.join(least, "v").select("fp", "least")
    resolved = nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(resolved, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with its columns, one of each group of near-duplicates: the one with the smallest id.

    Of rows that share that id the first by text stays; rows with a null id all stay.
    """
    known = docs.where("doc_id is not null")
    keep = near_duplicates(known, **options).where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text", *(F.xxhash64(c) for c in docs.columns if c not in ("doc_id", "text")))
    best = known.join(keep, "doc_id", "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return best.select(*docs.columns).unionAll(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
