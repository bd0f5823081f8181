"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A record is ``length (8 bytes), checksum of these 8 (4), payload, checksum of the payload (4), 0x0A``,
numbers little-endian; checksums are CRC-32, masked as ``rotate right by 15, add 0xA282EAD8`` so that a
checksum stored in a payload does not check itself. A payload is ``1 byte: bytes of a token id, 1 byte:
has a document id, document id (8), token ids``. Files are written by Spark's own writer, so a lost
executor leaves no half file and any file system Spark knows will do. Their names, then the records in
them, follow the order of document ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import shared_folder, table

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Folders of the records and of their index within that of a data set.
RECORDS, INDEXED = "records", "index"
#: Bytes of text for one file of records. A file is read back as one cell, of half that size or so, and a
#: task holds several copies of up to 64 MB of them; executors with more memory than 1.5 GB a core can take more.
FILE_BYTES = 16 << 20
#: Words whose ids a worker keeps, then it starts anew.
CACHE = 200_000
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
SLICE_BYTES = 2 << 20
#: Bytes of records that a task hands on at a time; a longer record goes alone or with those before it.
OUT_BYTES = 1 << 20
#: For files on a local file system: its own checksums, in a second file for each, would repeat those of records and
#: Parquet pages, and each file takes processes that set its mode, started by executors. Other file systems don't see these options.
WITHOUT_SIDE_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_HEAD = struct.Struct("<Q")
_CHECK = struct.Struct("<I")
_PAYLOAD = struct.Struct("<BBq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CHECK.pack(masked(head)), payload, _CHECK.pack(masked(payload)), b"\n"))


def unframe(data: bytes | memoryview, at: int) -> tuple[bytes | memoryview, int]:
    """The payload of the record at ``at`` and where the next begins; ValueError if it is damaged."""
    head = data[at : at + 8]
    if len(head) < 8 or _CHECK.unpack_from(data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + _HEAD.unpack(head)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 5 or _CHECK.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 5


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _PAYLOAD.pack(width, doc_id is not None, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = _PAYLOAD.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size)


#: ASCII punctuation, and how many different runs of it a worker keeps the ids of.
PUNCTUATION, TAILS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 4096
#: A word of Latin letters, in lower case, and ASCII punctuation behind it: the tokenizer's own split of such a piece.
_WORD = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, whose lengths sum to ``most`` at most; a longer row is a range of its own."""
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


class Encoder:
    """Encodes texts piece by piece: the tokenizer never joins what ASCII white space separates.

    Arrow splits the texts and looks up which pieces are alike, so each different piece of a column is
    encoded once and its ids are copied to where it stands. Most pieces are a word with punctuation behind
    it; the two parts go to the tokenizer's model as its own normalizer and splitter would hand them on, all
    others to the tokenizer. Ids of words are kept, whatever punctuation was behind them, in two halves of
    ``capacity``: when the later is full, the earlier goes, but for the words that came up again meanwhile.
    """

    def __init__(self, path: str, end_id: int = END_ID, capacity: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.dtype, self.capacity = f"<u{self.width}", capacity
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.packer = lru_cache(4096)(lambda n: struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack)
        self.direct = self._splits_words()

    def _splits_words(self) -> bool:
        """Whether the model, given words and punctuation apart, agrees with the tokenizer on pieces of all kinds."""
        heads = ["a", "The", "QU\u00c9", "stra\u00dfe", "na\u00efve", "\u00f8re", "re", "s", "\u00ffz", "don"]
        tails = ["", ".", "'", "''", "###", "_", "!?", "&&&", ")", "$", "-", "<>", "`~|", '"/', "*+,:;=@[]^{}%\\("]
        for piece in (h + t for h in heads for t in tails):
            head, tail = _WORD.match(piece.lower()).groups()
            if self._word(head) + self._tail(tail.encode()) != self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids):
                return False
        return True

    def _bytes(self, ids: list[int]) -> bytes:
        return self.packer(len(ids))(*ids)

    def _word(self, head: str) -> bytes:
        if not head.isascii():
            head = head.encode().decode("latin-1").translate(self.letters)
        return self._bytes([token.id for token in self.model.tokenize(head)])

    def _tail(self, tail: bytes) -> bytes:
        if (ids := self.tails.get(tail)) is None:
            ids = self._bytes([token.id for token in self.model.tokenize(tail.decode())])
            if len(self.tails) < TAILS:
                self.tails[tail] = ids
        return ids

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        half = max(1, self.capacity // 2)
        if len(self.known) >= half:
            self.earlier, self.known = self.known, {}
        known, earlier, tails, out, rest = self.known, self.earlier, self.tails, [], []
        for piece in pieces:
            head = piece.rstrip(PUNCTUATION)
            tail = piece[len(head) :]
            word = head.lower()  # ASCII letters only
            if (ids := known.get(word)) is not None:
                pass
            elif (ids := earlier.get(word)) is not None:
                if len(known) < half:
                    known[word] = ids
            elif self.direct and (word.isalpha() or _WORD.match(head.decode().lower())):  # of bytes, isalpha is of ASCII
                ids = self._word(head.decode().lower())
                if len(known) < half:
                    known[word] = ids
            else:
                rest.append((len(out), piece.decode()))
                out.append(b"")
                continue
            if tail:
                ids += tails.get(tail) or self._tail(tail)
            out.append(ids)
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            coded = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (place, _), c in zip(some, coded):
                out[place] = self._bytes(c.ids)
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string column and the end id, as bytes; null texts count as empty."""
        texts = pc.fill_null(texts, "")
        for first, last in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
            split = pc.ascii_split_whitespace(texts.slice(first, last - first))  # as bytes.split, but empty pieces
            words = split.flatten().dictionary_encode()
            pieces = words.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            ids = pa.array(self._pieces(pieces.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
            if not len(ids):
                yield from [self.end] * (last - first)
                continue
            _, places, data = ids.buffers()
            places = np.frombuffer(places, np.int64)[ids.offset :][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            data = memoryview(data) if data else b""
            for start, stop in zip(places, places[1:]):
                yield bytes(data[start:stop]) + self.end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """``encode_column`` of a list."""
        return list(self.encode_column(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())))


_encoders: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """One encoder for each worker process; ``vocabulary`` is the name of a public file or a path."""
    if (vocabulary, end_id) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[vocabulary, end_id] = Encoder(path, end_id)
    return _encoders[vocabulary, end_id]


def write(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> str:
    """Write ``docs(doc_id, text, ...)`` as records in ascending order of ids; returns the folder.

    The records lie in its folder ``records``, in files of about ``file_bytes`` bytes of text each, however
    many partitions ``docs`` has. Null and empty texts give the end id alone. Null ids come first; of equal
    ids the order follows from a hash of the text.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    files = max(1, -(-size // file_bytes))
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, end_id)
        for batch in batches:
            framed, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1))):
                framed.append(frame(pack(doc_id, ids, encoder.width))[:-1])
                size += len(framed[-1])
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["value"])
                    framed, size = [], 0
            if framed:
                yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["value"])

    written = ordered.mapInArrow(run, "value binary")
    # the line writer puts the bytes as they are, and a line feed, the record's last byte, behind them
    written.select(F.col("value").cast("string").alias("value")).write.options(lineSep="\n", **WITHOUT_SIDE_FILES).text(f"{folder}/{RECORDS}")
    return folder


INDEX = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of ``folder``, read from its files and written beside them, in its folder ``index``.

    ``file, offset, length`` say where a record lies, ``before`` how many ids of its file come before it;
    ``n_tokens, ids_crc32`` are of the ids read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm.common import arrow_schema

        schema = arrow_schema(INDEX)
        for batch in batches:
            for row in range(batch.num_rows):
                file, data = batch.column(0)[row].as_py(), memoryview(batch.column(1)[row].as_buffer())
                out, at, before = [], 0, 0
                while at < len(data):
                    payload, after = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    out.append((file, at, after - at, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    at = after
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{RECORDS}").select("path", "content")
    files.mapInArrow(run, INDEX).write.options(**WITHOUT_SIDE_FILES).parquet(f"{folder}/{INDEXED}")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index that lies beside the records of ``folder``."""
    return spark.read.schema(INDEX).parquet(f"{folder}/{INDEXED}")


def placed(found: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record of an ``index``; ``start`` counts all ids before it."""
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = totals.select("file", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")


def read_at(spark: SparkSession, file: str, offset: int, length: int) -> tuple[int | None, list[int]]:
    """The document id and token ids of one record, read by its place in the index."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length)))
    finally:
        stream.close()
    doc_id, ids = unpack(unframe(data, 0)[0])
    return doc_id, ids.tolist()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write ``docs``, read the files back, and return one row for each document, from the files.

    ``doc_id, start, n_tokens, ids_crc32`` and the record's ``file, offset, length``. An empty table
    gives no rows.
    """
    return placed(index(docs.sparkSession, write(docs, vocabulary, end_id)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
