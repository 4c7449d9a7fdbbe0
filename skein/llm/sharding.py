"""Shards by fixed virtual slots: records hash into 4096 slots, a versioned map gives each slot a shard, and edits of the map move slots.

A record's slot depends on its doc_id alone, so only the small map changes when shards are added or relieved. The main path is
DataFrame operations; the driver handles the map, which has 4096 rows a version whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import column, new_path, saved

SLOTS = 4096
#: Parts of a virtual slot that are numbered apart, so that a slot's rows do not meet in one task.
PARTS = 16
#: Bytes that a record takes beside its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot. Each edit gives the next version."""

    version: int
    owners: tuple[int, ...]

    @property
    def shards(self) -> int:
        return max(self.owners) + 1

    @classmethod
    def of(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """The map for so many shards, the same for everybody: one shard, grown one by one."""
        if not 1 <= shards <= slots:
            raise ValueError("there must be 1 to as many shards as slots")
        out = cls(1, (0,) * slots)
        while out.shards < shards:
            out = out.grown()
        return out

    def grown(self) -> SlotMap:
        """One more shard, which takes its share of slots from the shards with most; no slot moves between others."""
        owners, new = list(self.owners), self.shards
        counts = [owners.count(s) for s in range(new)]
        held: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(owners):
            held[shard].append(slot)
        for n in range(len(owners) // (new + 1)):
            giver = max(range(new), key=lambda s: (counts[s], -s))
            slot = held[giver].pop((n * 7919) % len(held[giver]))
            counts[giver] -= 1
            owners[slot] = new
        return SlotMap(self.version + 1, tuple(owners))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """The same shards with slots moved from the heaviest to the lightest until they are within tolerance or no move helps."""
        owners, loads = list(self.owners), [0] * self.shards
        for slot, shard in enumerate(owners):
            loads[shard] += slot_bytes.get(slot, 0)
        mean = sum(loads) / len(loads)
        for _ in range(4 * len(owners)):
            high, low = max(range(len(loads)), key=loads.__getitem__), min(range(len(loads)), key=loads.__getitem__)
            gap = loads[high] - loads[low]
            if gap <= tolerance * mean:
                break
            fits = [s for s, shard in enumerate(owners) if shard == high and 0 < slot_bytes.get(s, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap - 2 * slot_bytes[s]), s))
            owners[slot] = low
            loads[high] -= slot_bytes[slot]
            loads[low] += slot_bytes[slot]
        return SlotMap(self.version + 1, tuple(owners))

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, virtual_slot, shard."""
        owners = F.split(F.lit(",".join(map(str, self.owners))), ",").cast("array<int>")
        return spark.range(1).select(F.lit(self.version).alias("version"), F.posexplode(owners).alias("virtual_slot", "shard"))


def store(spark: SparkSession, maps: list[SlotMap], path: str) -> None:
    """Adds versions of a map to a table."""
    for m in maps:
        m.frame(spark).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("version int, virtual_slot int, shard int").parquet(path).filter(F.col("version") == version).drop("version")


def virtual_slot(doc_id: F.Column, slots: int = SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, and place, which counts the rows of a part of a slot from 0."""
    doc_id, text = docs["`doc_id`"].cast("long"), docs["`text`"].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(
        column(docs, "doc_id", "long"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(doc_id).alias("virtual_slot"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
    )
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return saved(rows.withColumn("place", F.row_number().over(order).cast("long") - 1), "records")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, rows, bytes: at most 4096 rows."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def assigned(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law (key), shard, slot, grown_shard, virtual_slot, slot_bytes of every row of docs.

    doc_id and the number of shards decide the shard; grown_shard is that with one more shard, and equals shard or the new one.
    slot numbers a shard's rows from 0 without gaps. Texts count whole: a null text has no bytes and checksum 0. Null ids are one
    key. Repeated rows each have a slot. An empty table gives none. Extra columns are not read.
    """
    spark = docs.sparkSession
    now = SlotMap.of(shards)
    path = new_path(spark, "slot-map")
    store(spark, [now, now.grown()], path)
    owners = load(spark, path, now.version).join(load(spark, path, now.version + 1).withColumnRenamed("shard", "grown_shard"), "virtual_slot")
    rows = records(docs)
    parts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(F.broadcast(owners), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(slot_bytes(rows).drop("rows")), "virtual_slot").drop("n")
    out = rows.join(F.broadcast(parts), ["virtual_slot", "part"])  # at most 4096 x 16 rows
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard", "virtual_slot", F.col("bytes").alias("slot_bytes"))
