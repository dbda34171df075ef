"""K-d tree sharding: recursive splits at weighted medians along the widest dimension, until leaves reach the target bytes.

Dimensions are numbers of the text alone, so equal texts have equal
coordinates and share a leaf whatever their number. Each level finds, for all
its nodes at once, the widest dimension (as a share of the table's extent) and
the byte-weighted median in it, by histograms: one pass finds the dimension, and
passes of BINS bins each narrow down the median of a 52-bit key, the
quantised coordinate followed by hash bits that order ties. What reaches the
driver is BINS rows a node and pass, whatever the table. The tree is then a
CASE expression, so placing rows needs neither a join nor a shuffle.

The law held is ``bytes``: shard sizes as near equal as groups of equal texts
allow.

Defined cases: null text has size 1 like the empty one and shares its leaf; a
null doc_id sorts first in its shard; repeated rows get slots of their own; an
empty table gives no rows; if there are fewer distinct texts than shards, some
shards stay empty; other columns are ignored by ``assign`` and carried by
``write``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

SHARDS = 16
#: Bits of the key: of the coordinate, then of the tie-breaking hash; and of a histogram's bins.
VALUE_BITS, TIE_BITS, BIN_BITS = 26, 26, 13
#: (name, expression of size, characters, 64-bit hash of the text), each in [0, 1).
DIMENSIONS = ("log_size", "wide_share", "hash_high", "hash_low")


@dataclass
class Split:
    dimension: str
    key: int  # rows whose key is at most this go left


def coordinates(text: Column) -> dict[str, Column]:
    """The dimensions of a text: its size, its share of bytes beyond one a character, and two places of its hash."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    h = F.xxhash64(raw)
    chars = F.coalesce(F.char_length(text), F.lit(0))
    unit = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND((1 << 26) - 1) / F.lit(float(1 << 26))
    return {"log_size": F.log2(size + 1.0) / 32.0, "wide_share": (size - chars) / (size + 1.0), "hash_high": unit(38), "hash_low": unit(12)}


def key(value: Column, tie: Column) -> Column:
    return F.shiftleft(F.floor(value * float(1 << VALUE_BITS)).cast("long"), TIE_BITS).bitwiseOR(tie)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and a key for each dimension."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    tie = F.shiftrightunsigned(F.xxhash64(raw, F.lit(1)), 30).bitwiseAND((1 << TIE_BITS) - 1)
    keys = [key(c, tie).alias(f"key_{name}") for name, c in coordinates(F.col("text")).items()]
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("crc"), *keys)


def route(splits: dict[int, Split], column=lambda d: F.col(f"key_{d}")) -> Column:
    """The node in which a row ends: nodes are numbered from 1, the children of n are 2n and 2n + 1."""

    def below(n: int) -> Column:
        if n not in splits:
            return F.lit(n)
        s = splits[n]
        return F.when(column(s.dimension) <= F.lit(s.key), below(2 * n)).otherwise(below(2 * n + 1))

    return below(1)


def grow(groups: DataFrame, shards: int) -> dict[int, Split]:
    """Splits of a tree with shards leaves (a power of two). groups: size and keys, a row per distinct text."""
    splits: dict[int, Split] = {}
    extents = groups.agg(*[f(f"key_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = {d: max(1, (extents[f"hi_{d}"] or 0) - (extents[f"lo_{d}"] or 0)) for d in DIMENSIONS}
    level = [1]
    while len(level) < shards:
        placed = groups.withColumn("node", route(splits))
        widths = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(f"key_{d}") - F.min(f"key_{d}")).alias(d) for d in DIMENSIONS]).collect()
        widest = {r["node"]: max(DIMENSIONS, key=lambda d: r[d] / whole[d]) for r in widths}
        goal = {r["node"]: r["bytes"] / 2 for r in widths}
        chosen = F.coalesce(*[F.when(F.col("node") == n, F.col(f"key_{d}")) for n, d in widest.items()]) if widest else F.lit(0).cast("long")
        keyed = placed.select("node", "size", chosen.alias("key"))
        prefix, before = dict.fromkeys(widest, 0), dict.fromkeys(widest, 0)
        shift = VALUE_BITS + TIE_BITS
        while shift > 0 and widest:  # each pass fixes BIN_BITS more of every node's median
            shift -= BIN_BITS
            inside = F.coalesce(*[F.when(F.col("node") == n, F.shiftright("key", shift + BIN_BITS) == p) for n, p in prefix.items()])
            bins = keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).orderBy("node", "bin").collect()
            for n in widest:
                own = [r for r in bins if r["node"] == n]
                total = before[n]
                for r in own:
                    prefix[n] = r["bin"]
                    if total + r["bytes"] >= goal[n] or r is own[-1]:
                        # at the last bit the side is chosen that leaves the halves nearer to equal
                        if shift == 0 and r is not own[0] and goal[n] - total < total + r["bytes"] - goal[n]:
                            prefix[n] = own[own.index(r) - 1]["bin"]
                        break
                    total += r["bytes"]
                before[n] = total
        for n in level:
            splits[n] = Split(widest.get(n, DIMENSIONS[0]), prefix.get(n, 0))
        level = [c for n in level for c in (2 * n, 2 * n + 1)]
    return splits


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, a row per document."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    keyed = materialise(with_keys(docs))
    splits = grow(keyed, shards)
    placed = keyed.select("doc_id", "size", "crc", (route(splits) - shards).cast("int").alias("shard"))
    return _slots(placed).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless slots by doc_id in each shard, without a task per shard: range partitions are numbered inside, then offset by the rows before them."""
    n = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("size")]
    ranged = placed.repartitionByRange(n, *order, F.rand(7)).sortWithinPartitions(*order)
    numbered = materialise(ranged.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    heads = numbered.groupBy("part", "shard").agg(F.min("id").alias("first"), F.count("*").alias("rows"))  # a row for each partition and shard edge
    before = heads.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).drop("rows")
    return numbered.join(F.broadcast(before), ["part", "shard"]).withColumn("slot", F.col("id") - F.col("first") + F.col("before"))


def write(docs: DataFrame, out: str, shards: int = SHARDS) -> None:
    """docs, all columns, in folders shard=0 to shard=n-1 under out (several files each)."""
    keyed = materialise(with_keys(docs))
    splits = grow(keyed, shards)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    tie = F.shiftrightunsigned(F.xxhash64(raw, F.lit(1)), 30).bitwiseAND((1 << TIE_BITS) - 1)
    dims = coordinates(F.col("text"))
    name = f"shard_{uuid.uuid4().hex[:8]}" if "shard" in {c.lower() for c in docs.columns} else "shard"
    docs.withColumn(name, (route(splits, lambda d: key(dims[d], tie)) - shards).cast("int")).write.partitionBy(name).parquet(out)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
