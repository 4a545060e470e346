"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A directory addresses shards by a prefix of the hash bits of a row's key. A
bucket over the byte limit splits on the next bit, all others stay as they are,
so the prefix is long only where the data is dense. The splits are not made one
after the other: the bytes of every prefix of every length follow from one
histogram over long prefixes, and the shard of a row is its shortest prefix that
fits. Only cells that do not fit even at the histogram's depth are counted again
with more bits. At the end of the hash, rows of one and the same hash are left;
they go to numbered overflow pages. A single row above the limit is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

#: Bits of the hash: 15 hexadecimal digits of MD5, so that they fit a long.
HASH_BITS = 60
RESULT = ("bytes", "depth", "shard", "shard_bytes")
#: Equal rows that are numbered together.
COPIES = 4096
#: Bits of the histogram beyond those that an even spread would need.
SPARE_BITS = 6


def key_hash(key: Sequence[str]) -> Column:
    """Leading 60 bits of the MD5 of the key columns (nulls as a mark of their own)."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth of the shard of each cell `(cell, bytes, n)` of `high` bits; null if none of its prefixes fits.

    A single row above the limit fits alone. Prefixes shorter than `low` bits are known not to fit.
    """
    levels = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    fit = (
        levels.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bucket_bytes"), F.sum("n").alias("_n"))
        .where((F.col("bucket_bytes") <= limit) | (F.col("_n") == 1))
    )
    # a fitting bucket is a shard if the bucket one bit shorter does not fit
    parent = fit.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"))
    top = fit.withColumn("_p", F.expr("shiftright(prefix, 1)")).join(parent, ["depth", "_p"], "left_anti")
    shards = top.select("depth", "prefix", "bucket_bytes")
    # cells of a shard: one join per level at most, as an equality on (depth, prefix)
    return levels.join(shards, ["depth", "prefix"]).select("cell", "depth", "prefix", "bucket_bytes")


def extendible_shards(rows: DataFrame, key: Sequence[str], size: Column, limit: int) -> DataFrame:
    """`key` columns of every row with the shard it belongs to.

    Result: the key columns, `bytes` (the row's size), `depth` (bits of the
    shard's prefix), `shard` (those bits as text, with `.page` for overflow pages)
    and `shard_bytes`. Null keys and null sizes (0) are rows like any other;
    repeated rows are kept; an empty table has no shards. Only the key and the size are
    read; a key column with the name of a result column comes back as `key_<name>`.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    names = [f"key_{c}" if c in RESULT else c for c in key]
    own = [f"_key{i}" for i in range(len(names))]
    base = scratch.write(
        rows.select(*[F.col(c).alias(k) for c, k in zip(key, own, strict=True)], F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"), key_hash(key).alias("_hash"))
    ).df
    key = own
    total = base.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    even = max(1, -(-total // max(1, limit))).bit_length()
    low, high, found, open_rows = 0, min(HASH_BITS, even + SPARE_BITS), [], base
    while True:
        cell = F.expr(f"shiftright(_hash, {HASH_BITS - high})")
        cells = open_rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        leaves = scratch.write(_leaves(cells, low, high, limit)).df
        placed = open_rows.withColumn("cell", cell).join(leaves, "cell", "left")
        out = scratch.write(placed).df
        found.append(out.where("depth is not null").drop("cell", "_hash"))
        open_rows = out.where("depth is null").select(*key, "bytes", "_hash")
        if high == HASH_BITS or open_rows.isEmpty():
            break
        low, high = high + 1, min(HASH_BITS, high + 12)
    named = [
        f.select(
            *key,
            "bytes",
            "depth",
            F.expr("if(depth = 0, '', lpad(conv(prefix, 10, 2), depth, '0'))").alias("shard"),
            F.col("bucket_bytes").alias("shard_bytes"),
        )
        for f in found
    ]
    result = named[0]
    for more in named[1:]:
        result = result.unionByName(more)
    if high == HASH_BITS:
        result = result.unionByName(_overflow(open_rows, key, limit))
    return result.withColumnsRenamed(dict(zip(own, names, strict=True)))


def _overflow(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Pages for rows that share all hash bits.

    Equal rows are counted, not gathered: `limit / bytes` of them make a page. The
    pages of one hash are told apart by their key and size.
    """
    copies = rows.groupBy(*key, "_hash", "bytes").agg(F.count(F.lit(1)).alias("n"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    # many copies are made by many tasks, a block each
    blocks = copies.withColumn("_per", per_page).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("_b") * COPIES
    each = blocks.withColumn("_i", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
    page = F.floor(F.col("_i") / F.col("_per")).cast("long")
    return each.select(
        *key,
        "bytes",
        F.lit(HASH_BITS).alias("depth"),
        F.concat_ws(".", F.lpad(F.conv("_hash", 10, 2), HASH_BITS, "0"), F.hex(F.xxhash64(*key, "bytes")), page.cast("string")).alias("shard"),
        (F.least(F.col("_per"), F.col("n") - page * F.col("_per")) * F.col("bytes")).alias("shard_bytes"),
    )


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: bits, depth, bytes and rows."""
    return assigned.groupBy("shard", "depth").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")
    )
