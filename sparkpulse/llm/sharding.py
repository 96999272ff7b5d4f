"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a row's hash. A bucket that holds more bytes than the limit
splits on its next bit, and only that bucket; all others keep their depth. Work on the directory goes over
byte sums of hash cells, never over texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of hash in use: 15 hexadecimal digits of an MD5 sum, which DuckDB and Spark compute alike.
BITS = 60
#: Bits settled in one round over the cells, after the first.
ROUND_BITS = 12
#: Production limit of one shard, in bytes of text as UTF-8.
SHARD_BYTES = 16 * 1024 * 1024


def hash_bits(key):
    """The first 60 bits of the MD5 sum of a key's text as a long; a null key counts as an empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Leaves (depth, prefix, n_bytes) of the directory for rows (h, n_bytes).

    A round sums bytes by cell and adds the cells up over their shorter prefixes. The first has twice as many cells as
    there would be full buckets, so that they grow with the table; the others part what is still too large by its next
    ROUND_BITS bits. A bucket exists where its parent was too large, and is a leaf where it fits itself.
    Buckets still too large after 60 bits hold equal hashes, which no bit can part: they stay whole.
    """
    leaves, depth, still = None, 0, None
    whole = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    top = min(max(-(-int(whole) // max(limit, 1)), 1).bit_length() + 1, BITS)
    while True:
        rows = sized if still is None else sized.join(still, F.shiftright("h", BITS - depth) == F.col("open_prefix"), "left_semi")
        cells = rows.groupBy(F.shiftright("h", BITS - top).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        levels = cells.select("n_bytes", "cell", F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("depth"))
        sums = written(
            levels.groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes")),
            "shard-buckets")
        split = sums.where(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        below = sums.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi").select("depth", "prefix", "n_bytes")
        exists = below.where(F.col("depth") > depth) if depth else below.where("depth > 0").unionByName(sums.where("depth = 0"))
        found = exists.where((F.col("n_bytes") <= limit) | (F.col("depth") == BITS))
        leaves = found if leaves is None else leaves.unionByName(found)
        still = exists.where((F.col("depth") == top) & (F.col("n_bytes") > limit)).select(F.col("prefix").alias("open_prefix"))
        if top == BITS or still.isEmpty():
            return leaves
        depth, top = top, min(top + ROUND_BITS, BITS)


def assign_shards(df: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_bytes, shard (its prefix as a string of bits; '' is the undivided whole), depth, shard_bytes.

    Null keys hash as empty strings and null texts have 0 bytes. Rows that repeat a key share its shard. A shard
    exceeds the limit only if it holds one key alone. An empty table gives no rows. Further columns are left out.
    """
    sized = df.select(F.col(key).alias("doc_id"), hash_bits(F.col(key)).alias("h"),
                      F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    sized = written(sized, "shard-sizes")
    leaves = written(directory(sized, limit), "shard-directory")
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").limit(BITS + 1).collect()]
    keyed = leaves.select(F.col("depth"), F.col("prefix"), F.col("n_bytes").alias("shard_bytes"))
    # a row belongs to exactly one leaf: probe each depth that occurs (61 at most), then keep the match
    probes = sized.select("*", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths])).alias("p")) if depths else sized.select(
        "*", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")).alias("p"))
    placed = probes.select("doc_id", "n_bytes", F.col("p.depth").alias("depth"), F.col("p.prefix").alias("prefix")).join(keyed, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")
