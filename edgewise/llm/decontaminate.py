"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. A
window is `SPAN` consecutive words of a benchmark item, or the whole item if it
is shorter. Of each window of W consecutive k-gram hashes the smallest (the
last one of equals) is kept as a fingerprint, with k + W - 1 = SPAN. The choice
depends on the words of the window only, so wherever a window occurs in a
document, document and item keep the same k-gram of it: joining fingerprints
misses no shared window. A hit carries the words around its k-gram, as far as a
window can reach, and is extended to both sides on the words themselves, so a
hash collision adds nothing.

Items shorter than SPAN are fingerprinted whole; documents look for them with
n-grams of exactly those lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

SPAN = 13
GRAM = 8
#: Bits of the filter that spares documents' fingerprints the shuffle: 2 MB at any benchmark size.
FILTER_BITS = 24

#: Lower-cases A-Z and blanks every ASCII character that is neither letter nor digit.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` in UTF-8, lower-cased in A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if isinstance(text, str) else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive word hashes, mixed."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def whole_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words, apart from those of the winnowed k-grams."""
    return gram_hashes(hashes, n) ^ np.uint64(n)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of every `width` consecutive values, the last of equals."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(views)) + width - 1 - views.argmin(axis=1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: A fingerprint with the words a window that holds it can reach, and where its k-gram starts among them.
HIT = "fp long, at long, size int, lead int, words string"


def _hit(words: list[bytes], fp: int, start: int, stop: int, reach: int) -> tuple:
    low = max(0, start - reach)
    return _signed(fp), start, stop - start, start - low, b" ".join(words[low : stop + reach]).decode()


def item_prints(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """`(item_id, whole, fp, at, size, lead, words)` of the benchmark; `whole` marks items below `span`."""

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                words = words_of(text)
                hashes, n = word_hashes(words), len(words)
                if 0 < n < span:
                    rows.append((item, True, *_hit(words, int(whole_hashes(hashes, n)[0]), 0, n, 0)))
                else:
                    grams = gram_hashes(hashes, gram)
                    for p in winnow(grams, span - gram + 1).tolist():
                        rows.append((item, False, *_hit(words, int(grams[p]), p, p + gram, span - gram)))
            yield pd.DataFrame(rows, columns=["item_id", "whole", "fp", "at", "size", "lead", "words"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInPandas(prints, "item_id string, whole boolean, " + HIT)


def _filter(prints: DataFrame) -> bytes:
    """Bits `fp mod 2^FILTER_BITS` of all prints: at most 512 rows of 4 kB come to the driver."""
    place = F.pmod("fp", F.lit(1 << FILTER_BITS))
    pages = prints.groupBy(F.floor(place / 32768).alias("page")).agg(F.expr(f"bitmap_construct_agg(pmod(pmod(fp, {1 << FILTER_BITS}), 32768))").alias("bits"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for row in pages.collect():
        out[row["page"] * 4096 : row["page"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)


def document_prints(docs: DataFrame, bits: bytes, short: list[int], span: int, gram: int) -> DataFrame:
    """`(doc_id, tie, n_words, hits)`: fingerprints of each document that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(shared.value, np.uint8)

        def passing(fps: np.ndarray) -> np.ndarray:
            low = fps & np.uint64((1 << FILTER_BITS) - 1)
            return np.flatnonzero(table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)

        for batch in batches:
            counts, hits = [], []
            for text in batch["text"]:
                words = words_of(text)
                hashes, own = word_hashes(words), []
                grams = gram_hashes(hashes, gram)
                kept = winnow(grams, span - gram + 1)
                fps = grams[kept]
                for i in passing(fps):
                    own.append(_hit(words, int(fps[i]), int(kept[i]), int(kept[i]) + gram, span - gram))
                for n in short:
                    runs = whole_hashes(hashes, n)
                    for p in passing(runs):
                        own.append(_hit(words, int(runs[p]), int(p), int(p) + n, 0))
                counts.append(len(words))
                hits.append([dict(zip(("fp", "at", "size", "lead", "words"), x, strict=True)) for x in own])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tie": batch["tie"], "n_words": counts, "hits": hits})

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInPandas(prints, f"doc_id long, tie long, n_words long, hits array<struct<{HIT.replace(' long', ':long').replace(' int', ':int').replace(' string', ':string')}>>")


def extend(pairs: DataFrame, span: int) -> DataFrame:
    """`(row, item_id, low, high)`: shared runs of at least a window around each pair of hits."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, item, whole, at, size, lead, mine, other_lead, theirs in batch.itertuples(index=False):
                a, b = mine.split(" "), theirs.split(" ")
                if a[lead : lead + size] != b[other_lead : other_lead + size]:
                    continue
                left, right = 0, size
                while left < min(lead, other_lead) and a[lead - left - 1] == b[other_lead - left - 1]:
                    left += 1
                while lead + right < len(a) and other_lead + right < len(b) and a[lead + right] == b[other_lead + right]:
                    right += 1
                if left + right >= span or whole:
                    rows.append((row, item, at - left, at + right))
            yield pd.DataFrame(rows, columns=["row", "item_id", "low", "high"])

    chosen = pairs.select("row", "item_id", "whole", "at", "size", "lead", "words", "i_lead", "i_words")
    return chosen.mapInPandas(grow, "row long, item_id string, low long, high long")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of `docs(doc_id, text)`: words, words inside a window of an item, items, verdict.

    Columns doc_id, tie (hash of the text), n_words, n_hit, n_items, items_sha256,
    items (sorted ids), contaminated (n_hit > 0 and 20 * n_hit >= n_words). Null
    and empty texts have no words and no hits; items without words hit nothing; a
    repeated row gets its row again; empty tables give no rows and no hits.
    Item ids are compared and sorted as strings. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    prints = scratch.write(item_prints(items, span, gram)).df
    # fewer than `span` lengths
    short = sorted(r["size"] for r in prints.where("whole").select("size").distinct().collect())
    found = scratch.write(
        document_prints(docs, _filter(prints), short, span, gram).withColumn("row", F.monotonically_increasing_id())
    ).df
    hits = found.where(F.size("hits") > 0).select("row", F.inline("hits"))
    theirs = prints.select("fp", "item_id", "whole", F.col("lead").alias("i_lead"), F.col("words").alias("i_words")).distinct()
    spans = scratch.write(extend(hits.join(theirs, "fp"), span).distinct()).df
    # the union of the ranges of a row: each range adds what lies behind all earlier ends
    order = Window.partitionBy("row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spans.select("row", "low", "high").distinct()
    behind = F.greatest(F.col("low"), F.coalesce(F.max("high").over(order), F.lit(0)))
    covered = (
        ranges.withColumn("_new", F.greatest(F.col("high") - behind, F.lit(0)))
        .groupBy("row")
        .agg(F.sum("_new").alias("n_hit"))
    )
    named = spans.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.select("row", "doc_id", "tie", "n_words")
        .join(covered, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "tie",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", items_of).cast("binary"), 256).alias("items_sha256"),
            items_of.alias("items"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """`docs` without the contaminated rows; all columns are kept."""
    found = contamination(docs, items, span, gram).where("contaminated")
    gone = found.select(F.col("doc_id").alias("_ew_id"), F.col("tie").alias("_ew_tie")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_ew_id"]) & (F.xxhash64(docs["text"]) == gone["_ew_tie"])
    return docs.join(gone, same, "left_anti")
