"""Token ids as length-delimited binary records with a separate offset index.

A file is a sequence of frames, all numbers little-endian:

    u32 length of the payload
    u32 masked CRC-32 of the four length bytes
        payload: u8 flags (1: doc_id is null, 2: ids are u32), i64 doc_id, ids (u16 or u32)
    u32 masked CRC-32 of the payload
    u8  0x0A

The mask rotates the checksum and adds a constant, so that a frame that itself
holds frames does not verify by accident. Ids take two bytes where the
vocabulary allows it. Files are written by Spark's own writer and committer, so
a task that is run again leaves no second copy, on any file system Spark knows.
The index has one row per record (file number, offset, length, first token), so
a reader can permute records without scanning the files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.base import Known, gathered, running_total, spans, text_parts, worker_cache
from edgewise.plans.scratch import Scratch

MASK = 0xA282EAD8
#: Bytes of text whose distinct pieces are worked out together; a longer text is a batch alone.
BATCH_BYTES = 8 << 20
#: Bytes of known pieces a worker keeps.
KNOWN_BYTES = 24 << 20
#: Records per batch that is handed on.
WRITTEN = 512
#: White space as the vocabulary's own splitter sees it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OTHER = [c for c in SPACE if c not in " \n"]  # the first four are ASCII

INDEX = "file_no int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, first long"


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<Bq", (doc_id is None) + 2 * wide, doc_id or 0) + ids
    size = struct.pack("<I", len(payload))
    return b"".join(
        (size, struct.pack("<I", mask(zlib.crc32(size))), payload, struct.pack("<I", mask(zlib.crc32(payload))), b"\n")
    )


def unframe(data, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document, ids (u32) and the offset behind the frame at `at`; raises on damage."""
    size = bytes(data[at : at + 4])
    if len(size) < 4 or mask(zlib.crc32(size)) != struct.unpack_from("<I", data, at + 4)[0]:
        raise ValueError(f"damaged length at offset {at}")
    length = struct.unpack("<I", size)[0]
    payload = data[at + 8 : at + 8 + length]
    if len(payload) < length or mask(zlib.crc32(payload)) != struct.unpack_from("<I", data, at + 8 + length)[0]:
        raise ValueError(f"damaged record at offset {at}")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")
    return None if flags & 1 else doc_id, ids, at + 8 + length + 5


class Pieces:
    """Ids of texts, put together from the ids of their white-space delimited pieces.

    The vocabulary's splitter always breaks between a visible character and white
    space, and what it does after the break depends on the following characters
    only. Pieces can therefore be encoded one by one and joined. Each distinct piece of a
    batch is encoded once, and not at all if it is still known from an earlier one.
    """

    slow = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def __init__(self, tokenizer, kind: str, known: Known | None = None):
        self.tokenizer, self.kind = tokenizer, kind
        self.known = known or Known(kind)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a piece without its own line feed had a space before it
        return self.ids_of([w if w[:1] == "\n" else " " + w for w in words])

    @staticmethod
    def plain(text: str) -> bool:
        """Whether white space stands alone between visible characters, so that cutting at it is enough."""
        if any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[-1] in SPACE or text[0] in SPACE:
            return False
        return not any(c + " " in text or c + "\n" in text for c in (OTHER[:4] if text.isascii() else OTHER))

    def encode_all(self, texts) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow string array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain, held, ends = [], [], [0]  # other texts: their pieces by number, and where each text ends
        own: dict[str, int] = {}
        for text in texts:
            text = text.as_py()
            plain.append(bool(text) and self.plain(text))
            if not plain[-1]:
                # runs of white space: each piece with all of the run before it
                held.extend(own.setdefault(p, len(own)) for p in self.slow.findall(text))
            ends.append(len(held))
        simple = texts.filter(pa.array(plain, pa.bool_()))
        lists = pc.split_pattern(pc.replace_substring(simple, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        first = cuts[:-1]
        flat, starts, sizes = self.known.ids(coded.dictionary, self._words)
        # the piece that opens a text has nothing before it
        opening = coded.dictionary.take(pa.array(codes[first])).to_pylist()
        codes[first] = len(sizes) + np.arange(len(first))
        others = np.array(held, np.int64) + len(sizes) + len(opening)
        more, more_sizes = self.ids_of(opening + list(own))
        starts = np.concatenate([starts, len(flat) + np.cumsum(more_sizes) - more_sizes])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])
        at = 0
        for i, whole in enumerate(plain):
            if whole:
                chosen, at = codes[cuts[at] : cuts[at + 1]], at + 1
            else:
                chosen = others[ends[i] : ends[i + 1]]
            yield gathered(flat, starts[chosen], sizes[chosen])

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return next(self.encode_all(pa.array([text], pa.string()))).tobytes()


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int, parts: int | None = None) -> None:
    """Encode `docs(doc_id, text)` and write them in ascending doc_id order.

    A null text has the end id only. Null ids come first; rows of one doc_id are
    ordered by the hash of their text.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = keyed.repartitionByRange(parts or text_parts(docs), "doc_id", "_tie").sortWithinPartitions(
        "doc_id", "_tie", "text"
    )

    def encode(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        held = worker_cache("pieces")
        if vocabulary not in held:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
            tokenizer = Tokenizer.from_file(vocabulary)
            size = max(tokenizer.get_vocab_size(), end_id + 1)
            kind = "<u2" if size <= 1 << 16 else "<u4"
            held[vocabulary] = tokenizer, kind, Known(kind, KNOWN_BYTES)
        pieces = Pieces(*held[vocabulary])
        wide = pieces.kind == "<u4"
        end = np.array([end_id], pieces.kind).tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            names = batch.column("doc_id").to_pylist()
            for low, high in spans(np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), BATCH_BYTES):
                ids = pieces.encode_all(texts.slice(low, high - low))
                frames: list[bytes] = []
                for name, own in zip(names[low:high], ids, strict=True):
                    frames.append(frame(name, own.tobytes() + end, wide))
                    if len(frames) == WRITTEN:
                        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                        frames = []
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                pa.default_memory_pool().release_unused()

    # the text writer puts out the bytes of a string as they are, and the line feed of the frame
    frames = ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "frame binary")
    frames.select(F.expr("substring(frame, 1, length(frame) - 1)").cast("string").alias("value")).write.text(path)


def scan_records(spark, path: str) -> DataFrame:
    """Index rows of all records under `path`; every checksum is verified.

    `first` counts the ids of the file before the record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                number, at, first, rows = int(re.search(r"part-(\d+)", name)[1]), 0, 0, []
                data = memoryview(content)
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((number, at, after - at, doc_id, len(ids), zlib.crc32(ids.tobytes()), first))
                    at, first = after, first + len(ids)
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
                yield frame.astype({"doc_id": "Int64"})

    return files.mapInPandas(walk, INDEX)


def index_records(spark, path: str, scratch: Scratch) -> DataFrame:
    """The offset index with `start`, the ids of all records before, in doc_id order."""
    scanned = scratch.write(scan_records(spark, path)).df
    totals = scanned.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    starts = running_total(totals, "file_no", "_n", "_start")
    return scanned.join(starts, "file_no").withColumn("start", F.col("_start") + F.col("first")).drop("_start", "first")


def read_shuffled(spark, path: str, index: DataFrame, seed: int) -> DataFrame:
    """`(position, doc_id, ids)` of all records in a random order given by `seed`.

    Each file is read once; records are cut out by the index and spread by their
    place in the permutation, so no reader holds more than one file.
    """
    wanted = index.groupBy("file_no").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file_no"), "content")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content, offsets in zip(batch["file_no"], batch["content"], batch["offsets"], strict=True):
                data = memoryview(content)
                rows = [(number, int(o), *unframe(data, int(o))[:2]) for o in offsets]
                frame = pd.DataFrame(rows, columns=["file_no", "offset", "doc_id", "ids"]).astype({"doc_id": "Int64"})
                yield frame.assign(ids=[x.astype("int64") for x in frame["ids"]])

    cut_out = files.join(wanted, "file_no").mapInPandas(cut, "file_no int, offset long, doc_id long, ids array<long>")
    return cut_out.withColumn("position", F.xxhash64(F.lit(seed), "file_no", "offset")).orderBy("position").drop("file_no", "offset")


def token_records(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write `docs` to the shared folder and return the index read back from the files.

    Nulls and empty texts give a record of the end id alone, repeated rows give
    repeated records, an empty table gives no file and no row. Other columns of
    `docs` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "records")
    path = scratch.path("records")
    write_records(docs, path, vocabulary, end_id)
    return index_records(docs.sparkSession, path, scratch).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "file_no", "offset", "length"
    )
