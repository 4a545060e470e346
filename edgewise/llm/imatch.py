"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency, counted over all
documents, lies in a band. A document keeps its distinct terms of the lexicon,
sorted, and hashes them once for each of several random subsets of the lexicon;
an edit changes the hashes of those subsets only that hold a changed term. A subset
that holds all of a long document's terms would change with any edit, so subsets
come in levels, each with half the terms of the one before, and a document uses
the levels in which a subset has about one of its terms or less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.base import text_parts
from edgewise.llm.decontaminate import word_hashes, words_of
from edgewise.plans.scratch import Scratch

#: Band of ln(documents / document frequency).
LOW_IDF, HIGH_IDF = 2.0, 9.0
#: A larger lexicon is not sent to every task (8 bytes a term): the terms of the texts are joined to it.
MAX_TERMS = 3_000_000
SUBSETS = 36
#: Levels of a fingerprint, so that documents of somewhat different length share one.
LEVELS = 3
#: Terms of a document that a subset of its first level holds on average.
SHARE = 0.75
#: Distinct terms a task counts before it hands them on.
HELD_TERMS = 1_000_000

ODD = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words."""
    found = np.unique(word_hashes(list(set(words_of(text)))))
    return found


def document_frequency(docs: DataFrame) -> DataFrame:
    """`(term, df)` over all documents; `term` is the word's 64-bit hash as a signed long."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str) and text:
                    held.append(terms_of(text))
                    n += len(held[-1])
                if n > HELD_TERMS:
                    terms, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"term": terms.view(np.int64), "n": counts})
                    held, n = [], 0
        if held:
            terms, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"term": terms.view(np.int64), "n": counts})

    return docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, scratch: Scratch, low: float, high: float) -> DataFrame:
    """`(term)`, the hashes of the terms in the IDF band."""
    counted = scratch.write(document_frequency(docs)).df
    n = docs.count()
    return scratch.write(counted.where((F.col("df") >= n * math.exp(-high)) & (F.col("df") <= n * math.exp(-low))).select("term")).df


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Printer:
    """Fingerprints against one lexicon; without one, of terms that are known to be in it."""

    def __init__(self, terms: np.ndarray | None, subsets: int):
        self.terms = np.empty(0, np.uint64) if terms is None else terms
        with np.errstate(over="ignore"):
            self.salts = mix(np.arange(1, subsets + 1, dtype=np.uint64) * ODD)[:, None]
        self.subsets = subsets

    def sign(self, text: str) -> tuple[int, np.ndarray]:
        """First level and a hash for each subset of the levels from there (0: no term); level 0 without words."""
        return self.sign_terms(self.kept(terms_of(text)))

    def kept(self, found: np.ndarray) -> np.ndarray:
        """Those of the sorted terms that are in the lexicon, or all if none is."""
        if len(found) and len(self.terms):
            at = np.searchsorted(self.terms, found)
            known = found[self.terms[np.minimum(at, len(self.terms) - 1)] == found]
            return known if len(known) else found  # a text outside of the band stands for all its terms
        return found

    def sign_terms(self, found: np.ndarray) -> tuple[int, np.ndarray]:
        out = np.zeros((LEVELS, self.subsets), np.uint64)
        if not len(found):
            return 0, out
        level = max(1, round(math.log2(len(found) / SHARE)))
        with np.errstate(over="ignore"):
            for low in range(0, len(found), 4096):  # long documents in blocks
                drawn = mix(found[None, low : low + 4096] ^ self.salts)
                # where the draw falls below 1 / 2^level the term is in the subset; its low bits stand for it
                named = mix(drawn)
                for i in range(LEVELS):
                    out[i] += np.where(drawn >> np.uint64(64 - level - i) == 0, named | np.uint64(1 << 40), np.uint64(0)).sum(axis=1)
        return level, out & np.uint64(0xFFFFFF) | (out != 0).astype(np.uint64) << np.uint64(24)

    def text(self, signed: tuple[int, np.ndarray]) -> str:
        """The level and six hexadecimal digits a subset; dashes where it has no term."""
        level, hashes = signed
        return f"{level:02d}:" + "".join(f"{h & 0xFFFFFF:06x}" if h else "------" for h in hashes.ravel().tolist())


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal hashes among subsets that hold a term of either; levels both have."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    same = either = 0
    for i in range(LEVELS):
        j = a[0] + i - b[0]
        if 0 <= j < LEVELS:
            x, y = a[1][i], b[1][j]
            same += int(((x == y) & (x != 0)).sum())
            either += int(((x != 0) | (y != 0)).sum())
    return same / either if either else float(np.array_equal(a[1], b[1]) and a[0] == b[0])


ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edit(text: str, following: str) -> str:
    """`text` with its last third replaced by the beginning of the next one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Signed:
    """Rows with fingerprints, made at once where a task has the lexicon."""

    schema = ROW

    def __init__(self, terms: np.ndarray, subsets: int):
        self.printer = Printer(terms, subsets)
        self.own = self.printer.sign

    def row(self, doc_id, text: str, own, following: str, theirs) -> tuple:
        edited = edit(text, following)
        changed = self.printer.sign(edited)
        return (doc_id, len(text), digest(edited), self.printer.text(own), self.printer.text(changed), likeness(own, changed), likeness(own, theirs))


class Listed:
    """Rows with the terms of the text, the edited text and the next text, to be joined to the lexicon."""

    schema = "doc_id long, n_chars long, edited_sha256 string, own array<long>, changed array<long>, theirs array<long>"

    @staticmethod
    def own(text: str) -> np.ndarray:
        return terms_of(text)

    def row(self, doc_id, text: str, own, following: str, theirs) -> tuple:
        edited = edit(text, following)
        return (doc_id, len(text), digest(edited), *(x.view(np.int64) for x in (own, terms_of(edited), theirs)))


def _joined(rows: DataFrame, band: DataFrame, subsets: int) -> DataFrame:
    """The rows of `Listed`, numbered by (part, at), with their fingerprints."""
    each = rows.select("part", "at", F.explode(F.array_distinct(F.concat("own", "changed", "theirs"))).alias("term"))
    met = each.join(band, "term", "left_semi").groupBy("part", "at").agg(F.collect_list("term").alias("known"))  # terms of three texts

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def values(x) -> np.ndarray:
            return np.empty(0, np.uint64) if x is None else np.sort(np.asarray(x, np.int64).view(np.uint64))

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                printer = Printer(values(r.known), subsets)
                own, changed, theirs = (printer.sign_terms(printer.kept(values(x))) for x in (r.own, r.changed, r.theirs))
                out.append((_plain(r.doc_id), r.n_chars, r.edited_sha256, printer.text(own), printer.text(changed), likeness(own, changed), likeness(own, theirs)))
            yield _result(out)

    return rows.join(met, ["part", "at"], "left").drop("part", "at").mapInPandas(sign, ROW)


def _plain(doc_id):
    return None if pd.isna(doc_id) else int(doc_id)


def _result(rows: list[tuple], schema: str = ROW, **more) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    return frame.assign(**more)


def fingerprints(
    docs: DataFrame,
    low: float = LOW_IDF,
    high: float = HIGH_IDF,
    subsets: int = SUBSETS,
    parts: int | None = None,
) -> DataFrame:
    """Per row of `docs(doc_id, text)`: its fingerprint, and that of its edited text.

    The edit replaces the last third by the beginning of the next document in
    descending doc_id order (after the last comes the first; null ids last, equal ids
    by the hash of their text; a lone document follows itself). Null texts are empty;
    texts without a term of the lexicon are told by all their terms, those without a
    word have a fingerprint of dashes, alike to each other only. Repeated rows get a row each. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "imatch")
    band = lexicon(docs, scratch, low, high)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), "_tie"]
    ordered = keyed.repartitionByRange(parts or text_parts(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    if band.count() > MAX_TERMS:
        return _joined(_followed(ordered, Listed, Listed.schema, scratch), band, subsets)
    terms = np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(terms)
    return _followed(ordered, lambda: Signed(shared.value, subsets), ROW, scratch).drop("part", "at")


def _followed(ordered: DataFrame, maker, schema: str, scratch: Scratch) -> DataFrame:
    """The row that `maker()` makes of each text and the one after it, with its place (part, at)."""
    n = schema.count(",")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, last, at = TaskContext.get().partitionId(), maker(), None, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                own = made.own(text)
                if last is None:
                    yield _result([(_plain(doc_id),) + (None,) * n], schema, part=part, at=-1, kind="head", text=text)
                else:
                    rows.append(made.row(*last, text, own))
                last = (_plain(doc_id), text, own)
            yield _result(rows, schema, part=part, at=range(at, at + len(rows)), kind="row", text=None)
            at += len(rows)
        if last is not None:
            yield _result([(last[0],) + (None,) * n], schema, part=part, at=-1, kind="tail", text=last[1])

    walked = scratch.write(ordered.mapInPandas(follow, schema + ", part int, at long, kind string, text string")).df
    # one number per partition
    filled = sorted(r["part"] for r in walked.where("kind = 'head'").select("part").collect())
    done = walked.where("kind = 'row'").drop("kind", "text")
    if not filled:
        return done
    following = ordered.sparkSession.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next int")
    tails = walked.where("kind = 'tail'").select("part", "doc_id", "text").join(following, "part")
    heads = walked.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("then"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = maker()
        for batch in batches:
            each = zip(batch["doc_id"].astype("Int64"), batch["text"], batch["then"], strict=True)
            rows = [made.row(_plain(d), text, made.own(text), then, made.own(then)) for d, text, then in each]
            yield _result(rows, schema, part=batch["part"], at=-1)

    ends = tails.join(heads, "next").select("part", "doc_id", "text", "then").mapInPandas(close, schema + ", part int, at long")
    return done.unionByName(ends)
