"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table with a prime number of
slots. The shards take turns; at its turn a shard claims the first slot in its order that is
free. Shards differ by at most one slot, and when a shard comes or goes most slots keep their
owner. A document is placed by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narracode.llm.tables import keyed

#: Slots of the table: a prime, and more than a hundred times the number of shards.
TABLE_SLOTS = 65_537
DEFAULT_SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _digest(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * part : 8 * part + 8], 16)


def lookup_table(shards: list[str], slots: int = TABLE_SLOTS) -> list[int]:
    """The number of the owning shard for every slot. The work depends on the number of slots
    alone, which is a setting and not a size of the data."""
    if not shards:
        raise ValueError("there are no shards")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and no fewer than the shards")
    if len(set(shards)) < len(shards):
        raise ValueError("names of shards must differ")
    # a preference order walks the table from an offset with a step; the prime makes it visit all
    at = [_digest(name, 0) % slots for name in shards]
    step = [_digest(name, 1) % (slots - 1) + 1 if slots > 1 else 0 for name in shards]
    owner = [-1] * slots
    claimed = 0
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            claimed += 1
            if claimed == slots:
                return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = TABLE_SLOTS) -> DataFrame:
    """``_slot, _shard`` with one row per slot, made from one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    listed = spark.range(1).select(F.posexplode(owners).alias("_slot", "_k"))
    return listed.select("_slot", F.get(names, F.col("_k").cast("int")).alias("_shard"))


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = TABLE_SLOTS) -> DataFrame:
    """``doc_id, slot, shard`` of every row.

    The slot is the first 32 bits of the md5 of the id, modulo the number of slots. The table
    has ``slots`` rows whatever the data, so it is broadcast. Documents do not move. Copies of
    an id share a shard; a missing id is placed as the empty string. The text is not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")
    placed = docs.select("doc_id", slot.alias("slot"))
    table = table_frame(docs.sparkSession, shards or DEFAULT_SHARDS, slots)
    joined = placed.join(F.broadcast(table), F.col("slot") == F.col("_slot"), "left")
    return joined.select("doc_id", "slot", F.col("_shard").alias("shard"))


def write_shards(
    docs: DataFrame, path: str, shards: list[str] | None = None, slots: int = TABLE_SLOTS, parts_per_shard: int = 8
) -> None:
    """Write whole rows below one folder per shard. A shard's rows are dealt over
    ``parts_per_shard`` tasks by the hash of their key, so no task holds a whole shard. The
    folder's column is ``shard``, with underscores before it if the rows have such a column."""
    column = "shard"
    while column in docs.columns:
        column = f"_{column}"
    rows = keyed(docs)
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")
    table = table_frame(docs.sparkSession, shards or DEFAULT_SHARDS, slots)
    named = rows.join(F.broadcast(table), slot == F.col("_slot"))
    part = F.pmod(F.xxhash64("_id", "_h"), F.lit(parts_per_shard))
    dealt = named.repartition(F.col("_shard"), part)
    dealt.select("_row.*", F.col("_shard").alias(column)).write.partitionBy(column).parquet(path)
