"""Removal of passages that repeat, by Rabin-Karp hashes of every word window.

Every window of `span` consecutive words gets a rolling 64-bit hash; Spark counts
the hashes over the whole table, and the words that a repeated window covers are
merged into maximal intervals.

The windows of a block of documents travel as packed arrays, one row per block
and hash range: hash (8 bytes) and place in the block (3 bytes). A hash range
holds about BUCKET windows, so a counting task works on arrays of a bounded size
however the words are distributed. A window that repeats inside a block is
known to repeat there, and is sent once, marked; so a passage that fills a third
of all rows sends each of its windows once per block.

A block is named by its partition and its number in it, over rows in a fixed order:
a map task that runs again after a lost executor gives the same blocks, names and
ranges, so that what is left of the first run fits to what the second one gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

SPAN = 35
#: Windows per hash range and characters per block.
BUCKET = 1_500_000
BLOCK_CHARS = 8_000_000

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window inside one document, with the place of its first word.

    `words` are the word hashes of documents one after the other. With prefix sums
    of word * B^-i, a window is a difference times a power of B.
    """
    n = len(words)
    if n < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(INVERSE, n), out=sums[1:])
    out = (sums[span:] - sums[:-span]) * powers(BASE, n)[: n - span + 1]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    ends = np.repeat(np.cumsum(lengths), lengths)[: n - span + 1]
    inside = np.flatnonzero(np.arange(n - span + 1) + span <= ends)
    return out[inside], inside


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, chars = [], 0
    for batch in batches:
        held.append(batch)
        chars += int(batch["text"].str.len().sum())
        if chars >= size:
            yield pd.concat(held, ignore_index=True)
            held, chars = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pack(texts: DataFrame, span: int, ranges: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Windows of `texts(doc_id, tie, text)` as one row per block and hash range.

    `hashes` and `places` are packed. One more row per block, in a range of its own
    kind (`ranges` and above), has its documents and the `known` places of windows
    that repeat inside the block. The rows are sorted within their partitions, so the
    same input gives the same blocks.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import xxhash
        from pyspark import TaskContext

        digest, part = xxhash.xxh64_intdigest, TaskContext.get().partitionId()
        for number, block in enumerate(_blocks(batches, block_chars)):
            name = f"{part}-{number}"
            lengths, parts = [], []
            for text in block["text"]:
                words = text.encode("utf-8", "surrogatepass").split()
                lengths.append(len(words))
                parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
            counts = np.array(lengths, np.int64)
            hashes, places = window_hashes(np.concatenate(parts), counts, span)
            del parts
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], places[order]
            first = np.ones(len(hashes), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(hashes)))
            sure = sizes > 1
            known = places[np.repeat(sure, sizes)].astype("<u4")
            # of equal hashes one is sent; the mark says that the hash repeats anyway
            hashes, places = hashes[starts], places[starts].astype("<u4")
            owner = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(ranges + 1))
            rows = [(name, ranges + zlib.crc32(name.encode()) % ranges, None, None, known.tobytes())]
            for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                a, b = cuts[r], cuts[r + 1]
                # sorted hashes as differences, byte planes apart: the high ones are zeros
                steps = np.diff(hashes[a:b], prepend=np.uint64(0))
                marked = places[a:b] << np.uint32(1) | sure[a:b].astype(np.uint32)
                rows.append((name, r, planes(steps), planes(marked), None))
            ids = block["doc_id"].astype("Int64")
            docs = pd.DataFrame({"at": np.cumsum(counts) - counts, "doc_id": ids, "tie": block["tie"], "n_words": counts})
            out = pd.DataFrame(rows, columns=["block", "range", "hashes", "places", "known"])
            out["docs"] = [docs.to_dict("records")] + [None] * (len(rows) - 1)
            yield out

    # the text comes last: it is looked at only where the hashes of two texts are equal
    return texts.sortWithinPartitions("doc_id", "tie", "text").mapInPandas(
        windows,
        "block string, range int, hashes binary, places binary, known binary,"
        " docs array<struct<at:long,doc_id:long,tie:long,n_words:long>>",
    )


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


HITS = "block string, places binary, known binary, docs array<struct<at:long,doc_id:long,tie:long,n_words:long>>"


def repeated(packed: DataFrame) -> DataFrame:
    """`(block, places, known, docs)`: places of hashes that are marked or come from several blocks.

    Rows that carry a block's documents pass through.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["hashes"].isna().all():
            return pdf[["block", "places", "known", "docs"]]
        hashes = [np.cumsum(unplanes(h, np.uint64), dtype=np.uint64) for h in pdf["hashes"]]
        marked = [unplanes(p, np.uint32) for p in pdf["places"]]
        sizes = [len(h) for h in hashes]
        every, marks = np.concatenate(hashes), np.concatenate(marked)
        order = np.argsort(every, kind="stable")
        ranked, sure = every[order], (marks[order] & 1).astype(bool)
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        runs = np.diff(np.append(starts, len(ranked)))
        many = np.repeat((runs > 1) | np.logical_or.reduceat(sure, starts), runs)
        found = np.zeros(len(every), bool)
        found[order] = many
        out, at = [], 0
        for block, own, n in zip(pdf["block"], marked, sizes, strict=True):
            # one byte string per block; a marked place is known to its block
            hit = (own >> np.uint32(1))[found[at : at + n] & (own & 1 == 0)]
            at += n
            if len(hit):
                out.append((block, np.sort(hit).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "places"]).assign(known=None, docs=None)

    return packed.groupBy("range").applyInPandas(count, HITS)


def intervals(hits: DataFrame, span: int) -> DataFrame:
    """`(doc_id, tie, n_words, spans)`: maximal removal intervals `[from, to)` of each document."""
    # bounded by the windows of one block
    joined = hits.groupBy("block").agg(
        F.collect_list("places").alias("more"), F.first("known", True).alias("known"), F.first("docs", True).alias("docs")
    )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for known, docs, more in zip(batch["known"], batch["docs"], batch["more"], strict=True):
                frame = pd.DataFrame([x.asDict() if hasattr(x, "asDict") else x for x in docs])
                places = np.concatenate([np.frombuffer(b, "<u4") for b in (known, *(more if more is not None else ()))]).astype(np.int64)
                places.sort()
                at = frame["at"].to_numpy(np.int64)
                owner = np.searchsorted(at, places, side="right") - 1
                # a place whose predecessor is of another document or too far away opens an interval
                opens = np.ones(len(places), bool)
                opens[1:] = (owner[1:] != owner[:-1]) | (places[1:] > places[:-1] + span)
                a = np.flatnonzero(opens)
                b = np.append(a[1:], len(places)) - 1 if len(a) else a
                own = owner[a]
                low, high = places[a] - at[own], places[b] + span - at[own]
                cuts = np.searchsorted(own, np.arange(len(frame) + 1))
                spans = [np.stack([low[x:y], high[x:y]], 1).tolist() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "tie": frame["tie"], "n_words": frame["n_words"], "spans": spans})

    return joined.select("known", "docs", "more").mapInPandas(
        merge, "doc_id long, tie long, n_words long, spans array<array<long>>"
    )


#: One list of disjoint spans in order, of `lists`.
UNION = """aggregate(array_sort(flatten(lists)), cast(array() as array<array<bigint>>), (done, s) ->
    if(size(done) > 0 and done[size(done) - 1][1] >= s[0],
       concat(slice(done, 1, size(done) - 1), array(array(done[size(done) - 1][0], greatest(done[size(done) - 1][1], s[1])))),
       concat(done, array(s))))"""


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tie", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, span: int = SPAN, bucket: int = BUCKET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`(doc_id, tie, n_words, spans)` of documents with a repeated window; `tie` is the text's hash.

    `spans` are word ranges `[from, to)`, disjoint and in order. Null texts and texts
    below `span` words have none. Rows of one doc_id and text are given once.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-total // (6 * bucket)))
    texts = _keyed(docs).where("text is not null").select("doc_id", "tie", "text")
    hits = scratch.write(repeated(pack(texts, span, ranges, block_chars))).df
    found = scratch.write(intervals(hits, span).where(F.size("spans") > 0)).df
    # equal rows have equal spans, so the set holds one list
    every = found.groupBy("doc_id", "tie").agg(F.max("n_words").alias("n_words"), F.collect_set("spans").alias("lists"))
    return every.select("doc_id", "tie", "n_words", F.expr(f"if(size(lists) = 1, lists[0], {UNION})").alias("spans"))


def without_repeats(docs: DataFrame, span: int = SPAN, **sizes) -> DataFrame:
    """Per row of `docs(doc_id, text)`: the kept words, joined by one space.

    Columns doc_id, n_words, n_removed, kept. A null text has no words; an empty
    table gives no rows; repeated rows get a row each. Other columns are not read.
    """
    spans = repeated_spans(docs, span, **sizes).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "spans")
    rows = _keyed(docs.select("doc_id", "text"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["tie"] == F.col("_t")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                kept, at = [], 0
                for low, high in spans if spans is not None else ():
                    kept += words[at:low]
                    at = high
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return joined.select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")
