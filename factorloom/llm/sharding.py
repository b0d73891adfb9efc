"""Shards of bounded bytes by extendible hashing, in DataFrame operations only.

Every row has a 60-bit hash of its key. A bucket is a prefix of that hash. A
bucket that holds more bytes than the limit is split on the next bit, others
stay as they are, so the buckets are the leaves of a binary trie over prefixes.

The directory is found a few bits at a time: one aggregation gives the bytes of
every prefix of ``step`` more bits below the prefixes that are still too large,
and sums over those cells give all the shorter prefixes. Its rows, not the
texts, are what later rounds work on. A row finds its bucket by a join with
each round's cells, by broadcast while these are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import durable, fresh, quoted

HASH_BITS = 60
#: Cells of a round that may be broadcast; a cell is about 40 bytes.
BROADCAST_CELLS = 1 << 17


def key_hash(*keys: Column) -> Column:
    """The first 60 bits of the MD5 of the keys as text, null keys as empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _round(rows: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """For each prefix of ``high`` bits: the least depth over ``low`` (or 0) at which its bucket fits.

    A bucket of a single hash value fits too, as no bit splits it; ``overflow``
    marks it if it is too large.
    """
    cells = rows.groupBy(F.expr(f"shiftright(h, {HASH_BITS - high})").alias("cell")).agg(
        F.sum("size").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last")
    )
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    fits = (
        levels.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .filter((F.col("bytes") <= max_bytes) | (F.col("first") == F.col("last")))
        .select("depth", "prefix", (F.col("bytes") > max_bytes).alias("overflow"))
    )
    return (
        levels.select("cell", "depth", "prefix")
        .join(fits, ["depth", "prefix"], "left")
        .groupBy("cell")
        .agg(
            F.min(F.when(F.col("overflow").isNotNull(), F.struct("depth", "overflow"))).alias("leaf"),
        )
        .select("cell", F.col("leaf.depth").alias("depth"), F.col("leaf.overflow").alias("overflow"))
    )


def directory(rows: DataFrame, max_bytes: int, step: int = 12) -> list[tuple[int, DataFrame, int]]:
    """Rounds of the directory of ``rows`` (h, size): the prefix bits, the cells (cell, depth, overflow), how many.

    ``depth`` is null where the cell is still too large; a later round has it.
    """
    rounds: list[tuple[int, DataFrame, int]] = []
    low = 0
    while low < HASH_BITS:
        high = min(low + step, HASH_BITS)
        cells = durable(_round(rows, low, high, max_bytes))
        counts = cells.agg(F.count("*"), F.count("depth")).first()
        rounds.append((high, cells, counts[0]))
        if counts[0] == counts[1]:
            break
        open_cells = cells.filter(F.col("depth").isNull()).select("cell")
        if counts[0] - counts[1] <= BROADCAST_CELLS:
            open_cells = F.broadcast(open_cells)
        rows = rows.join(open_cells, F.expr(f"shiftright(h, {HASH_BITS - high})") == F.col("cell"), "left_semi")
        low = high
    return rounds


def shard(df: DataFrame, keys: list[str], size: Column, max_bytes: int, step: int = 12) -> DataFrame:
    """``df`` with the shard of each row: ``depth`` bits, ``prefix`` (the bits as a number), ``page``; and ``n_bytes``.

    A shard is a (depth, prefix, page). Its rows have at most ``max_bytes``
    bytes, unless it is a single row that is larger by itself. ``page`` is 0
    but where one key value alone is over the limit: no bit splits its rows, so
    they go to numbered overflow pages, by running sums inside the partitions
    they are read in, never gathered. Rows with null keys count as one key;
    null sizes as 0. Repeated rows are kept, each with its bytes. Of an empty
    table nothing comes out. Columns of ``df`` that are called like a new
    column are replaced by it.
    """
    h, b = fresh(df, "_hash", "_bytes")
    rows = df.withColumns({h: key_hash(*map(quoted, keys)), b: F.coalesce(size, F.lit(0)).cast("long")})
    rounds = directory(rows.select(F.col(h).alias("h"), F.col(b).alias("size")), max_bytes, step)
    found, flags = [], []
    out = rows
    overflows = 0
    for high, cells, n in rounds:
        cell, depth, flag = fresh(out, "_cell", "_depth", "_overflow")
        overflows += cells.filter("overflow").count()
        cells = cells.filter(F.col("depth").isNotNull()).toDF(cell, depth, flag)
        out = out.join(
            F.broadcast(cells) if n <= BROADCAST_CELLS else cells,
            F.expr(f"shiftright({h}, {HASH_BITS - high})") == F.col(cell),
            "left",
        ).drop(cell)
        found.append(F.col(depth))
        flags.append(F.col(flag))
    if not found:
        found, flags = [F.lit(0)], [F.lit(False)]
    depth, over, page = fresh(out, "_at", "_over", "_page")
    out = out.withColumns({depth: F.coalesce(*found), over: F.coalesce(*flags)})
    prefix = F.expr(f"shiftright({h}, {HASH_BITS} - {depth})")
    if overflows:
        out = out.withColumn(page, F.lit(0).cast("long")).filter(~F.col(over)).unionByName(
            _paged(out.filter(F.col(over)), h, b, page, max_bytes)
        )
    else:
        out = out.withColumn(page, F.lit(0).cast("long"))
    new = {
        "depth": F.col(depth).cast("int"),
        "prefix": prefix,
        "page": F.col(page),
        "n_bytes": F.col(b),
    }
    keep = [quoted(c) for c in df.columns if c.lower() not in new]
    return out.select(*keep, *[v.alias(k) for k, v in new.items()])


def _paged(rows: DataFrame, h: str, b: str, page: str, max_bytes: int) -> DataFrame:
    """Overflow pages of the rows of hash values that are over the limit by themselves.

    Rows of over half the limit have a page each. Others are laid end to end
    within their read partition and cut every half limit: a page is what starts
    in one such half, so it's under the limit.
    """
    row, part, start = fresh(rows, "_row", "_part", "_start")
    half = max(1, max_bytes // 2)
    large = F.col(b) > half
    rows = rows.withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn(part, F.shiftright(F.col(row), 33))
    before = Window.partitionBy(h, part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.coalesce(F.sum(F.when(large, F.lit(0)).otherwise(F.col(b))).over(before), F.lit(0)))
    slot = F.when(large, F.col(row) * 2 + 1).otherwise(
        (F.shiftleft(F.col(part).cast("long"), 33) + F.floor(F.col(start) / half)) * 2
    )
    return rows.withColumn(page, slot + 2).drop(row, part, start)
