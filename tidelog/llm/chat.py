"""Chat formatting by token-level assembly.

The template is ``<s>role[INST]text[/INST]`` for each turn and ``</s>`` after the last. Each segment,
role or text, is encoded on its own, and the reserved ids of the four control strings are spliced
between the segments, so no merge crosses a border and no text can produce a reserved id. The loss mask
marks the text of assistant turns: +1 where such a segment starts, -1 where it ends, summed up.
Control strings in a segment are escaped, so that the rendered text can be read back as well as the ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import arrow_schema, map_rows, table

VOCABULARY = "byte_bpe_50k.tiktoken"
OPEN, BODY, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, BODY, SHUT, END)
#: Roles whose text is learned.
LEARNED = ("assistant",)

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\|)")


def escape(text: str) -> str:
    r"""``\`` becomes ``\\`` and a control string gets a ``\`` behind its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Encodes turns to ids and a mask, and reads those back."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.ids = {c: self.first + n for n, c in enumerate(CONTROLS)}

    def turn(self, role: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        role = role or ""
        segments = [[self.ids[OPEN]], self.encoding.encode_ordinary(escape(role)), [self.ids[BODY]], self.encoding.encode_ordinary(escape(text or "")), [self.ids[SHUT]]]
        ends = np.cumsum([len(s) for s in segments])
        delta = np.zeros(ends[-1] + 1, np.int8)
        if role in LEARNED:
            delta[ends[2]] += 1
            delta[ends[3]] -= 1
        return np.concatenate([np.array(s, np.int32) for s in segments]), np.cumsum(delta[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def render(self, ids: np.ndarray) -> str:
        """The formatted text of ``ids``."""
        out, start = [], 0
        for at in np.flatnonzero(ids >= self.first):
            out += [self.text(ids[start:at]), CONTROLS[ids[at] - self.first]]
            start = at + 1
        return "".join([*out, self.text(ids[start:])])

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
        """Role, text and text under the mask of one turn, read from its ids."""
        marks = np.flatnonzero(ids >= self.first)
        if [CONTROLS[k - self.first] for k in ids[marks]] != [OPEN, BODY, SHUT] or marks[0] != 0 or marks[-1] != len(ids) - 1:
            raise ValueError("not one turn")
        role, text = ids[1 : marks[1]], ids[marks[1] + 1 : marks[2]]
        return unescape(self.text(role)), unescape(self.text(text)), unescape(self.text(ids[mask > 0]))


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = re.findall(r"<s>(.*?)\[INST\](.*?)\[/INST\]", rendered, re.DOTALL)
    return [(unescape(role), unescape(text)) for role, text in turns]


_templates: dict[str, Template] = {}


def template(vocabulary: str = VOCABULARY) -> Template:
    """One template for each worker process."""
    if vocabulary not in _templates:
        _templates[vocabulary] = Template(vocabulary)
    return _templates[vocabulary]


TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())),
])


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, turn, input_ids, loss_mask``: the tokens of every turn of ``conversations(conv_id, turn, role, text)``.

    A conversation's tokens are those of its turns in order and the id of ``</s>``. Null roles and texts
    are empty. Rows are encoded where they lie, so a long conversation is spread over tasks. Repeated rows
    are turns of their own, each as often as it comes; an empty table gives no rows. Other columns are ignored.
    """

    def kernel(columns: list) -> list:
        made = [template(vocabulary).turn(role, text) for role, text in zip(columns[2], columns[3])]
        return [columns[0], columns[1], [i for i, _ in made], [m for _, m in made]]

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    return map_rows(rows, kernel, ["conv_id", "turn", "role", "text"], TURNS)


DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])


class _Reader:
    """Reads one conversation turn by turn and keeps running digests, not its text."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, len(END), 1
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, own: Template, ids: np.ndarray, mask: np.ndarray) -> None:
        role, text, learned = own.read(ids, mask)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.turns, self.loss_chars = self.turns + 1, self.loss_chars + len(learned)
        self.chars, self.tokens = self.chars + len(own.render(ids)), self.tokens + len(ids)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


def digests(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation, read back from the tokens of its turns.

    Turns go by ``turn``, null last; equal turns by their tokens. Rows with a null ``conv_id`` are one
    conversation. Repeated turns count each. An empty table gives no rows. The turns of a conversation stream
    through one task, a batch at a time, as a running digest needs them in order.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "input_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema, current, out = template(vocabulary), arrow_schema(DIGEST), None, []
        for batch in batches:
            ids, masks = batch.column(2), batch.column(3)
            for row, conv_id in enumerate(batch.column(0).to_pylist()):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.row())
                    current = _Reader(conv_id)
                current.add(own, ids[row].values.to_numpy(), masks[row].values.to_numpy())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if current is not None:
            out.append(current.row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts are made of control strings."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = f"{END}{BODY} ok {SHUT}"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return digests(formatted(told.unionByName(extra))).drop("n_tokens")


def _escaped_sql(column: str) -> str:
    sql = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in CONTROLS:
        sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
    return sql


ORACLE_SQL = f"""
WITH told AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, t, r, '{END}{BODY} ok {SHUT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST({len(END)} + sum({len(OPEN + BODY + SHUT)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
