"""Source divergence audit by chunk factorization.

How far is the vocabulary of a source from that of its language, and from each
other source of the language? Terms are runs of ASCII letters and non-ASCII
characters, A-Z lower-cased. They never reach over ASCII white space, so a text
is a bag of white-space chunks and nothing else about it matters:

1. every document is counted as chunks; a task adds up the counts of a batch of
   documents per language, chunk and source before anything is shuffled;
2. the counts are brought together by chunk and sorted, so that each globally distinct
   chunk is cut into terms once;
3. its terms are joined back to its counts and added up per language, term and
   source, within blocks of neighbouring chunks and then, by term, over all of them.

A term counts if `min_docs` documents of the language have it. For that a
chunk needs at most `min_docs` of its documents as witnesses: if it has that
many, so has every term in it; if it has fewer, all are named, and the union over
the chunks of a term is complete. So witness lists are bounded and the test is exact.

All counts of a term, one a source and block, meet in a row. The result has one row per
pair of sources of a language, so their number is small against the data, and the
list of groups may pass through the driver.

Rows are documents of their own, equal rows too. They are numbered by partition
and position, so the input must be read in a fixed order, as files are; write a
shuffled input first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.llm.base import gathered, spans
from edgewise.plans.scratch import Scratch

SCALE = 1_000_000_000
MIN_DOCS = 3
RANKS = 200
#: Bytes of text that are counted together; a longer text is a batch alone.
BATCH_BYTES = 32 << 20
#: Rows of one batch that is handed on, and of one block of neighbouring chunks.
ROWS = 50_000
BLOCK = 200_000
#: Cells (sources x terms) of one block of the comparison.
CELLS = 1 << 19

#: Lower-cases A-Z and blanks every ASCII character that is not a letter.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = "lang_no int, groups array<int>, counts array<long>, docs array<long>"


def group_list(docs: DataFrame) -> list[tuple[str, str]]:
    """All (lang, source) pairs in order; nulls are ''."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return sorted((r["lang"], r["source"]) for r in named.distinct().collect())


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _rows(name: str, names, item: np.ndarray, group: np.ndarray, n: np.ndarray, w_item: np.ndarray, witness: np.ndarray, lang_of: np.ndarray, min_docs: int) -> Iterator:
    """A row for each item and language, from counts sorted by item and group and witnesses by item and language.

    Both have the same items and languages, as each count comes from a document.
    """
    import pyarrow as pa

    lang = lang_of[group]
    rows = _starts(item, lang)
    ends = np.append(rows, len(item))
    w_rows = _starts(w_item)
    sizes = np.minimum(np.diff(np.append(w_rows, len(witness))), min_docs)
    w_ends = np.concatenate([[0], np.cumsum(sizes)])
    witness = gathered(witness, w_rows, sizes)
    for low in range(0, len(rows), ROWS):
        high = min(low + ROWS, len(rows))
        a, b = slice(ends[low], ends[high]), slice(w_ends[low], w_ends[high])
        cuts = pa.array((ends[low : high + 1] - ends[low]).astype(np.int32))
        columns = {
            name: names.take(pa.array(item[rows[low:high]])),
            "lang_no": pa.array(lang[rows[low:high]].astype(np.int32)),
            "groups": pa.ListArray.from_arrays(cuts, pa.array(group[a].astype(np.int32))),
            "counts": pa.ListArray.from_arrays(cuts, pa.array(n[a].astype(np.int64))),
            "docs": pa.ListArray.from_arrays(pa.array((w_ends[low : high + 1] - w_ends[low]).astype(np.int32)), pa.array(witness[b])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def chunk_counts(docs: DataFrame, groups: list[tuple[str, str]], min_docs: int) -> DataFrame:
    """`(chunk, lang_no, groups, counts, docs)`: counts per group, and up to `min_docs` documents as witnesses."""
    numbers, lang_of = {g: i for i, g in enumerate(groups)}, _langs(groups)[1]
    shared = docs.sparkSession.sparkContext.broadcast((numbers, lang_of))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        numbers, lang_of = shared.value
        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.fromiter((numbers[k] for k in keys), np.int64, batch.num_rows)
            texts = pc.fill_null(batch.column("text"), "")
            for low, high in spans(np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), BATCH_BYTES):
                lists = pc.ascii_split_whitespace(texts.slice(low, high - low))
                coded = lists.flatten().dictionary_encode()
                # documents in the order of their groups: then the counts of a chunk are in that order too
                order = np.argsort(group[low:high], kind="stable")
                place = np.empty(high - low, np.int64)
                place[order] = np.arange(high - low)
                key = coded.indices.to_numpy().astype(np.int64) * (high - low) + np.repeat(place, lists.value_lengths().to_numpy())
                blank = pc.index(coded.dictionary, pa.scalar("")).as_py()  # before leading white space
                if blank >= 0:
                    key = key[key // (high - low) != blank]
                key, n = np.unique(key, return_counts=True)
                chunk, doc = np.divmod(key, high - low)
                own = group[low:high][order][doc]
                parts = _starts(chunk, own)
                if len(parts):
                    lang = lang_of[own]
                    totals = np.add.reduceat(n, parts)
                    yield from _rows("chunk", coded.dictionary, chunk[parts], own[parts], totals, chunk * (lang_of[-1] + 1) + lang, seen + low + order[doc], lang_of, min_docs)
            seen += batch.num_rows

    named = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text")
    )
    return named.mapInArrow(count, "chunk string, " + COUNTS)


def _langs(groups: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the number of each group's language; groups are sorted by it."""
    langs = sorted({lang for lang, _ in groups})
    places = {lang: i for i, lang in enumerate(langs)}
    return langs, np.array([places[lang] for lang, _ in groups], np.int64)


def term_counts(parts: DataFrame, groups: list[tuple[str, str]], min_docs: int) -> DataFrame:
    """`(lang_no, term, groups, counts)` of the terms that `min_docs` documents of their language have.

    A group may come several times in a row.
    """
    lang_of = _langs(groups)[1]

    def add(rows) -> Iterator:
        """Counts and witnesses of the terms of a block that ends with a chunk."""
        import pyarrow as pa

        coded = rows.column("chunk").combine_chunks().dictionary_encode()
        numbers: dict[bytes, int] = {}
        cut = [[numbers.setdefault(t, len(numbers)) for t in c.translate(FOLD).split()] for c in coded.dictionary.cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        terms = np.fromiter((t for c in cut for t in c), np.int64, int(sizes.sum()))
        chunk = coded.indices.to_numpy()
        # the terms of a chunk, joined to each row of the chunk
        row = np.repeat(np.arange(len(chunk)), sizes[chunk])
        term = gathered(terms, (np.cumsum(sizes) - sizes)[chunk], sizes[chunk])
        if not len(term):
            return

        def joined(name: str):
            column = rows.column(name).combine_chunks()
            each = column.value_lengths().to_numpy().astype(np.int64)
            return column.flatten().to_numpy(), (np.cumsum(each) - each)[row], each[row]

        held, starts, each = joined("groups")
        key = np.repeat(term, each) * len(lang_of) + gathered(held, starts, each)
        n = gathered(rows.column("counts").combine_chunks().flatten().to_numpy(), starts, each)
        order = np.argsort(key, kind="stable")
        first = _starts(key[order])
        item, group = np.divmod(key[order][first], len(lang_of))
        docs, starts, each = joined("docs")
        lang = rows.column("lang_no").to_numpy()[row]
        owner, doc = np.repeat(term * (lang_of[-1] + 1) + lang, each), gathered(docs, starts, each)
        by_doc = np.lexsort((doc, owner))
        distinct = by_doc[_starts(owner[by_doc], doc[by_doc])]
        names = pa.array(list(numbers), pa.binary()).cast(pa.string())
        yield from _rows("term", names, item, group, np.add.reduceat(n[order], first), owner[distinct], doc[distinct], lang_of, min_docs)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                rows = pa.Table.from_batches(held)
                chunks = rows.column("chunk").combine_chunks().dictionary_encode().indices.to_numpy()
                # sorted by chunk: the last one may go on in the next batch
                end = int(np.searchsorted(chunks, chunks[-1]))
                yield from add(rows.slice(0, end)) if end else ()
                held = rows.slice(end).to_batches()
                size = rows.num_rows - end
        if size:
            yield from add(pa.Table.from_batches(held))

    by_chunk = parts.repartition("chunk").sortWithinPartitions("chunk")
    by_term = by_chunk.mapInArrow(cut, "term string, " + COUNTS)
    # a row for each block that has the term, of one entry a source and `min_docs` witnesses at most
    whole = by_term.groupBy("lang_no", "term").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("groups", "counts", "docs")])
    return whole.where(F.size(F.array_distinct("docs")) >= min_docs).drop("docs")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals below 9 * 10^13.

    Long division in two digits, of 10^5 and 10^4, as the product need not fit into 64 bits.
    """
    top = (counts + 1) * 100_000
    high = top // total
    return 1 + high * 10_000 + (top - high * total) * 10_000 // total


def _compare(rows: DataFrame, groups: list[tuple[str, str]], terms: dict[int, int], totals: dict[int, int], ranks: int) -> DataFrame:
    """Partial results of blocks of terms: sums for pairs of groups, and each group's leading terms."""
    members = [[i for i, g in enumerate(groups) if g[0] == lang] for lang in _langs(groups)[0]]
    shared = rows.sparkSession.sparkContext.broadcast((members, terms, totals))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        members, terms, totals = shared.value
        sums: dict[int, np.ndarray] = {}
        best: dict[int, list[tuple[int, bytes]]] = {}

        def leading(found: list) -> list:
            return sorted(found, key=lambda x: (-x[0], x[1]))[:ranks]

        def block(lang: int, names: list[bytes], row: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
            own = np.array(members[lang])
            v = terms[lang]
            count = np.zeros((len(own), len(names)), np.int64)
            np.add.at(count, (np.searchsorted(own, group), row), n)
            size = np.array([totals.get(int(g), 0) + v for g in own], np.int64)
            p = shares(count, size[:, None])
            q = shares(count.sum(axis=0), np.int64(size.sum() - v * (len(own) - 1)))
            held = sums.setdefault(lang, np.zeros((len(own), len(own)), np.int64))
            for i in range(len(own)):
                held[i] += ((p[i] - p) ** 2 // p).sum(axis=1)
                at = np.flatnonzero((count[i] > 0) & (p[i] > q))
                f = (p[i, at] - q[at]) ** 2 // q[at]
                if len(at) > ranks:  # none below the value at the last rank can lead
                    least = np.partition(f, len(f) - ranks)[len(f) - ranks]
                    at, f = at[f >= least], f[f >= least]
                if len(at):
                    old = best.get(int(own[i]), [])
                    best[int(own[i])] = leading(old + [(int(x), names[j]) for x, j in zip(f, at, strict=True)])

        for batch in batches:
            lang_no = batch.column("lang_no").to_numpy()
            for lang in np.unique(lang_no).tolist():
                width = max(1, CELLS // len(members[lang]))
                places = np.flatnonzero(lang_no == lang)
                for low in range(0, len(places), width):
                    part = batch.take(pa.array(places[low : low + width]))
                    lists = part.column("groups")
                    row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                    names = part.column("term").cast(pa.binary()).to_pylist()
                    block(lang, names, row, lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy())

        out = [[], [], [], []]
        for lang, held in sums.items():
            own = members[lang]
            for i, j in np.argwhere(~np.eye(len(own), dtype=bool)).tolist():
                for column, x in zip(out, (own[i], own[j], None, int(held[i, j])), strict=True):
                    column.append(x)
        for group, found in best.items():
            for value, term in found:
                for column, x in zip(out, (group, None, term.decode(), value), strict=True):
                    column.append(x)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["group", "other", "term", "value"])

    return rows.mapInArrow(run, "group int, other int, term string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """`(lang, source, part, item, value, rank)` for every group (lang, source) of `docs`.

    Part `pair` has each other source of the language with the divergence of the group
    from it, part `term` the `ranks` terms that the group has most above its language.
    Nulls in text, lang and source are read as ''. A group without terms has its
    pairs too; a language of one source has none; without any kept term their value is 0.
    Equal values are ranked by the bytes of the item. An empty table gives no row. Other
    columns are ignored. Sums are exact up to 9 * 10^13 terms a language.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    groups = group_list(docs)
    listed = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "group int, lang string, source string")
    rows = scratch.write(term_counts(chunk_counts(docs, groups, min_docs), groups, min_docs)).df
    terms = {r["lang_no"]: r["n"] for r in rows.groupBy("lang_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = rows.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy(F.col("x.groups").alias("g"))
    totals = {r["g"]: r["n"] for r in each.agg(F.sum("x.counts").alias("n")).collect()}
    found = scratch.write(_compare(rows, groups, terms, totals, ranks)).df

    others = listed.select(F.col("group").alias("other"), "lang", F.col("source").alias("item"))
    pairs = listed.join(others, "lang").where("group <> other")  # the rows of the result, one each
    sums = found.where("other is not null").groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # a task hands on `ranks` terms a group at most, and the limit is applied before the shuffle again
    top = Window.partitionBy("group").orderBy(F.desc("value"), "term")
    leading = found.where("term is not null").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= ranks)
    leading = leading.join(F.broadcast(listed), "group").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(leading)
