"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space is one blank. An item of ``m`` characters may lie in a document
with up to ``k = floor(rate * m)`` edits. It is cut into ``k + 1`` pieces, of which any such occurrence
has one unchanged, so an automaton over all pieces finds every place to look at. There, Myers'
bit-parallel algorithm gives the least edit distance of the item to any part of the surroundings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import SLICE, map_rows, settled, table

#: Edits a character of an item may take: 20 in 250, three or four changed words.
RATE = 0.08
#: Characters of items that one automaton is built for and the driver holds at once; more items are searched in as many passes.
BLOCK_CHARS = 4_000_000

FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` cut into ``k + 1`` parts of nearly equal length, each with its offset."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letters(item: str) -> dict[str, int]:
    """For each character the bits of its places in ``item``."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def least_distance(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """The least edit distance of the pattern to any part of ``text``; ``most + 1`` if it is above ``most``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, most + 1
    left = len(text)
    get = masks.get
    for c in text:
        left -= 1
        equal = get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        if score - left > best:  # no later place can get below the best
            break
        plus <<= 1
        minus <<= 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
    return min(best, score) if score <= most else best


class Finder:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        import ahocorasick

        self.items = [(item_id, text, budget(text, rate), letters(text)) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text, k, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(where)))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of every item in ``text``; with ``first`` of one of them at most."""
        if not self.any:
            return []
        text = normal(text)
        spots: dict[int, list[int]] = defaultdict(list)
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                spots[number].append(end + 1 - length - offset)
        found = []
        for number, starts in spots.items():
            item_id, item, k, masks = self.items[number]
            m, best = len(item), k + 1
            for a, b in _stretches(sorted(set(starts)), k, m + k, len(text)):
                best = min(best, least_distance(masks, m, text[a:b], k))
                if not best:
                    break
            if best <= k:
                found.append((item_id, best))
                if first:
                    break
        return found


def _stretches(starts: list[int], before: int, after: int, end: int) -> Iterator[tuple[int, int]]:
    """The surroundings of ``starts``, in one piece where they overlap."""
    a = b = None
    for s in starts:
        x, y = max(0, s - before), min(end, s + after)
        if b is None:
            a, b = x, y
        elif x <= b:
            b = max(b, y)
        else:
            yield a, b
            a, b = x, y
    if b is not None:
        yield a, b


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of bounded size; items without words or id are left out, repeated ones count once."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        if item := normal(text):
            block.append((item_id, item))
            size += len(item)
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance``: every document that holds an item, with the least number of edits.

    Whole texts are searched. Null and empty texts hold nothing; items without words match nothing.
    Repeated documents come out as often as they went in, an item id with several texts with each that
    is found. Empty tables give no rows. Other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(block: list[tuple[int, str]]) -> DataFrame:
        finder = _lazy(block, rate)

        def kernel(columns: list) -> list:
            hits = [(i, item, d) for i, t in zip(*columns) for item, d in finder().find(t)]
            return [list(c) for c in zip(*hits)] if hits else [[], [], []]

        return map_rows(narrow, kernel, ["doc_id", "text"], FOUND)

    found = None
    for block, last in _with_last(blocks(benchmark)):
        here = search(block)
        if not last:  # the block's items are done with before those of the next come
            here = settled(here, "leaks")
        found = here if found is None else found.unionAll(here)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def _with_last(parts: Iterator) -> Iterator[tuple]:
    """Each of ``parts`` and whether it is the last."""
    held = None
    for part in parts:
        if held is not None:
            yield held, False
        held = part
    if held is not None:
        yield held, True


def _lazy(block: list[tuple[int, str]], rate: float):
    """The finder of ``block``, built once in each worker task."""
    made: list[Finder] = []

    def finder() -> Finder:
        if not made:
            made.append(Finder(block, rate))
        return made[0]

    return finder


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with its columns, that hold no item of ``benchmark``."""
    at = docs.columns.index("text")
    for block, last in _with_last(blocks(benchmark)):
        finder = _lazy(block, rate)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    clean = [not finder().find(t, first=True) for t in part.column(at).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = settled(docs, "clean")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
