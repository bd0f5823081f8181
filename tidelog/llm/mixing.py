"""Mixing sources to target token weights by entropy balancing.

The rates ``w`` of documents minimise the sum of ``w log w - w`` under one constraint a source, that the
words taken come to its target, and the bounds 0 and ``MOST``. The dual is convex with one multiplier a
source, and the solution is tilted exponentially in the document's size:
``w = min(MOST, exp(multiplier * size / mean))``. Newton steps on the logarithm of the words taken, kept
inside a bracket that halves where a step leaves it, run as aggregates over the counts of documents by
source and size, a table whose length does not grow with copies. A source that is wanted whole ``MOST``
times needs none.

Documents of one source and size share a rate, so rounding works on their counts: by systematic rounding
a copy falls on every whole number of the running sum of rates, in the order of size. What is left of a
source's target is made up by single copies, each of the size nearest to the rest. The copies of one
source and size are dealt in the same way to its strata, of about ``STRATUM`` documents by a hash, so that
no task numbers more. Sums are of integers and decimals, so reruns agree to the last digit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import settled, table

#: No document is taken more often.
MOST = 3
#: Sources weigh 1, 2, 3, repeating, in the order of their names, null last.
CYCLE = 3
#: Rates are multiples of this.
GRAIN = 1 << 24
STEPS, TOLERANCE, REPAIRS = 60, 1e-6, 6
#: Documents of a stratum, which one window numbers.
STRATUM = 1 << 9

#: The source as a column that is never null and sorts by code point, null last.
KEY = "_source"


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, its words; 0 for null and empty texts."""
    text = F.rtrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x"))
    return docs.withColumn("size", words.cast("long"))


def _keyed(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.withColumn(KEY, F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)))


def targets(counts: DataFrame) -> DataFrame:
    """``_source, source_size, mean, least, target`` from ``counts(_source, size, n)``.

    Water-filling: sources share the whole by weight, those above ``MOST`` times their size stop there and
    the others share the rest, until none is above. Sources fill up in the order of size by weight, so one
    running sum over the table of sources finds which do.
    """
    by = counts.groupBy(KEY).agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    everything = Window.partitionBy()
    weighed = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col(KEY))) - 1) % CYCLE + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(KEY))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what the sources before leave, shared by the weights of this one and those after
    rest = weighed.withColumn("left", F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    rest = rest.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("left") * F.col("weight") > F.col("source_size") * MOST * F.col("open")
    found = rest.withColumn("full", full).withColumn("first", F.max(F.when(~F.col("full"), F.struct("open", "left"))).over(everything))
    share = F.col("first.left") * F.col("weight") / F.col("first.open")
    return found.select(
        KEY,
        "source_size",
        F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(1.0).alias("mean"),
        F.coalesce("least", F.lit(1)).alias("least"),
        F.when(F.col("full") | (F.col("source_size") == 0), F.col("source_size") * MOST).otherwise(share).cast("double").alias("target"),
    )


def _rate(tilt: Column) -> Column:
    """The rate of a document in units of ``GRAIN``, a whole number."""
    exponent = F.least(tilt * F.col("size") / F.col("mean"), F.lit(math.log(MOST)))
    return F.least(F.round(F.exp(exponent) * GRAIN).cast("long"), F.lit(MOST * GRAIN))


def tilts(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``tilt``, the multiplier of each source's constraint."""
    empty, whole = F.col("source_size") == 0, F.col("target") >= F.col("source_size") * MOST
    most = F.lit(math.log(MOST)) * F.col("mean") / F.col("least")  # takes the least document, so every one, MOST times
    state = wanted.select(
        "*",
        F.when(~empty & whole, most).otherwise(0.0).alias("tilt"),
        (F.when(F.col("source_size") > 0, F.least(F.lit(0.0), F.ln(F.col("target") / F.col("source_size")))).otherwise(0.0) * F.col("mean") / F.col("least")).alias("low"),
        most.alias("high"),
        (empty | whole).alias("done"),
    )
    state = settled(state, "tilts")
    for _ in range(STEPS):
        rated = counts.join(state.where("not done").select(KEY, "tilt", "mean"), KEY).withColumn("rate", _rate(F.col("tilt")))
        words = (F.col("rate") * F.col("size")).cast("decimal(38,0)") * F.col("n")
        slope = F.when(F.col("rate") < MOST * GRAIN, words * F.col("size")).otherwise(F.lit(0).cast("decimal(38,0)"))
        got = rated.groupBy(KEY).agg(F.sum(words.cast("decimal(38,0)")).alias("words"), F.sum(slope.cast("decimal(38,0)")).alias("slope"))
        joined = state.join(got, KEY, "left").withColumns({c: F.col(c).cast("double") / GRAIN for c in ("words", "slope")})
        gap = F.col("words") - F.col("target")
        joined = joined.withColumns({
            "done": F.col("done") | F.col("words").isNull() | (F.abs(gap) <= F.col("target") * TOLERANCE) | (F.col("high") - F.col("low") < 1e-12),
            "low": F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")),
        })
        step = F.col("tilt") - F.try_divide(F.col("words") * F.ln(F.col("words") / F.col("target")) * F.col("mean"), F.col("slope"))
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        moved = F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = settled(joined.withColumn("tilt", moved).drop("words", "slope"), "tilts")
        if state.where("not done").isEmpty():
            break
    return state.drop("low", "high", "done")


def mixture(sized: DataFrame) -> DataFrame:
    """``sized``, documents with ``source`` and ``size``, with ``source_size, target, copies, taken`` added.

    ``taken`` is ``copies * size``, 3 sizes at most; a document of size 0 has one copy. Null is a source of
    its own, after all others. Repeated rows count each; which of the documents of one source and size get
    one copy more follows from a hash of their columns, so only rows that are equal throughout are
    interchangeable. An empty table gives no rows. Columns of ``sized`` with the names added are replaced.
    """
    docs = _keyed(sized.drop("source_size", "target", "copies", "taken"))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    drawn = docs.withColumn("_draw", F.xxhash64(*hashed))
    narrow = settled(drawn.select(KEY, "size", "_draw"), "drawn")
    counts = settled(narrow.groupBy(KEY, "size").agg(F.count("*").alias("n")), "counts")
    shares = settled(_shares(counts, settled(tilts(counts, targets(counts)), "state")), "shares")
    # a table of its own, so that Spark knows its size when it chooses the join
    crowded = settled(counts.where(F.col("n") > STRATUM).select(KEY, "size", F.ceil(F.col("n") / STRATUM).cast("long").alias("_strata")), "crowded")
    cell = [KEY, "size", "_stratum"]
    dealt = settled(_dealt(_cut(narrow, crowded).groupBy(*cell).agg(F.count("*").alias("n")), shares), "dealt")
    cut = _cut(drawn, crowded).repartition(*cell)  # else the window takes over the join's partitions, in which a crowded cell is one task
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("_draw"))).drop("_draw")
    extra = (F.col("_rank") <= F.pmod(F.col("_k"), F.col("_n"))).cast("long")
    found = ranked.join(dealt, cell).withColumn("copies", F.expr("_k div _n") + extra)
    found = found.withColumn("taken", F.col("copies") * F.col("size"))
    return found.select(*(c for c in docs.columns if c != KEY), "source_size", "target", "copies", "taken")


def _cut(drawn: DataFrame, crowded: DataFrame) -> DataFrame:
    """``drawn`` with the ``_stratum`` of each document."""
    joined = drawn.join(crowded, [KEY, "size"], "left")
    return joined.withColumn("_stratum", F.pmod("_draw", F.coalesce("_strata", F.lit(1)).cast("long"))).drop("_strata")


def _shares(cells: DataFrame, state: DataFrame) -> DataFrame:
    """``cells(_source, size, n)`` with ``_k`` copies for all of the cell, and what ``state`` knows of the source."""
    rated = cells.join(state, KEY).withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("tilt"))).otherwise(F.lit(GRAIN)))
    source = Window.partitionBy(KEY)  # a row for each size
    end = F.sum(F.col("n") * F.col("rate")).over(source.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    half, units = GRAIN // 2, GRAIN.bit_length() - 1
    rounded = rated.withColumn("end", end).withColumn(
        "_k", F.shiftright(F.col("end") + half, units) - F.shiftright(F.col("end") - F.col("n") * F.col("rate") + half, units)
    )
    rounded = rounded.withColumn("_k", F.when(F.col("size") > 0, F.col("_k")).otherwise(F.col("n")))
    for _ in range(REPAIRS):
        rest = F.round(F.col("target")).cast("long") - F.sum(F.col("_k") * F.col("size")).over(source)
        rounded = rounded.withColumn("rest", rest)
        more = F.col("rest") > 0
        room = F.when(more, F.col("_k") < MOST * F.col("n")).otherwise(F.col("_k") > 0)
        off = F.abs(F.abs("rest") - F.col("size"))
        fits = room & (F.col("size") > 0) & (off < F.abs("rest"))
        rounded = rounded.withColumn("best", F.min(F.when(fits, F.struct(off.alias("off"), "size"))).over(source))
        here = F.coalesce(F.col("best.size") == F.col("size"), F.lit(False))
        rounded = rounded.withColumn("_k", F.col("_k") + F.when(here, F.when(more, 1).otherwise(-1)).otherwise(0))
    return rounded.select(KEY, "size", F.col("n").alias("_all"), F.col("_k").alias("_copies"), "source_size", "target")


def _dealt(strata: DataFrame, shares: DataFrame) -> DataFrame:
    """``strata(_source, size, _stratum, n)`` with ``_n`` documents and ``_k`` copies each, in proportion to the documents."""
    order = Window.partitionBy(KEY, "size").orderBy("_stratum").rowsBetween(Window.unboundedPreceding, 0)
    joined = strata.join(shares, [KEY, "size"]).withColumn("_end", F.sum("n").over(order))
    upto = lambda end: F.expr(f"cast(_copies as decimal(19, 0)) * cast({end} as decimal(19, 0)) div _all")
    return joined.select(KEY, "size", "_stratum", F.col("n").alias("_n"), (upto("_end") - upto("(_end - n)")).alias("_k"), "source_size", "target")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with its columns; documents without words stay once."""
    own = {c: f"_own_{c}" for c in ("size", "source_size", "target", "copies", "taken") if c in docs.columns}
    found = mixture(sizes(docs.withColumnsRenamed(own)))
    copied = found.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = settled(sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "sized")
    return mixture(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")
