"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots, bytes and rows are summed per slot, and a small table says which
shard owns each slot. The hash never changes; rebalancing edits the table. Every edit makes a new
version, and all versions are kept in one Parquet table, so a reader can name the map it used.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesloom.operators.materialize import materialize

SLOTS = 8192
OVERHEAD_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """Owner of each slot, with a version number that every edit raises."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt round."""
        return cls(1, shards, tuple(i % shards for i in range(slots)))

    def moved(self, moves: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version, with ``moves`` (slot -> shard) applied."""
        owner = tuple(moves.get(slot, shard) for slot, shard in enumerate(self.owner))
        return SlotMap(self.version + 1, shards or self.shards, owner)

    def rebalanced(self, load: dict[int, int]) -> SlotMap:
        """Move slots from the heaviest shard to the lightest until no move narrows their gap.

        ``load``: bytes per slot; slots it lacks weigh nothing. A move takes the slot nearest to half
        the gap; if every slot of the heaviest shard is wider than the gap, a swap of one of its
        slots with one of the lightest shard's is tried. The sum of squares falls with each edit, so it ends.
        """
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            if load.get(slot):
                held[shard].append((load[slot], slot))
        total = [sum(size for size, _ in slots) for slots in held]
        for slots in held:
            slots.sort()
        moves: dict[int, int] = {}
        while True:
            high, low = total.index(max(total)), total.index(min(total))
            gap = total[high] - total[low]
            edit = _best_edit(held[high], held[low], gap)
            if edit is None:
                return self.moved(moves) if moves else self
            give, take = edit
            for entry, source, target in ((give, high, low), (take, low, high)):
                if entry is not None:
                    held[source].remove(entry)
                    bisect.insort(held[target], entry)
                    total[source] -= entry[0]
                    total[target] += entry[0]
                    moves[entry[1]] = target

    def grown(self, load: dict[int, int]) -> SlotMap:
        """One more shard, which takes slots from the others and nothing else moves."""
        new, moves = self.shards, {}
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            held[shard].append((load.get(slot, 0), slot))
        total = [sum(size for size, _ in slots) for slots in held]
        goal, got = sum(total) // (self.shards + 1), 0
        for slots in held:
            slots.sort()
        while got < goal:
            high = total.index(max(total))
            fitting = bisect.bisect_right(held[high], (goal - got, len(self.owner)))
            if not fitting or not held[high][fitting - 1][0]:
                break
            size, slot = held[high].pop(fitting - 1)
            total[high] -= size
            got += size
            moves[slot] = new
        return self.moved(moves, self.shards + 1)


def _best_edit(
    heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int
) -> tuple[tuple[int, int], tuple[int, int] | None] | None:
    """The move, or else the swap, that leaves the smaller gap; None if nothing narrows it."""
    best, left = None, gap
    for give in _around(heavy, gap / 2):
        if abs(gap - 2 * give[0]) < left and give[0]:
            best, left = (give, None), abs(gap - 2 * give[0])
    if best is None:
        for give in heavy:
            for take in _around(light, give[0] - gap / 2):
                shift = give[0] - take[0]
                if shift > 0 and abs(gap - 2 * shift) < left:
                    best, left = (give, take), abs(gap - 2 * shift)
    return best


def _around(slots: list[tuple[int, int]], size: float) -> list[tuple[int, int]]:
    at = bisect.bisect_left(slots, (size, -1))
    return slots[max(0, at - 1) : at + 1]


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 and virtual slot of each row.

    A null text has no bytes (size 8, checksum of nothing: 0). Rows with a null or repeated id are
    spread by their text's checksum; whole rows that repeat share a slot. Columns besides
    doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD_BYTES).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), crc), F.lit(slots)).cast("int").alias("vslot"),
    )


def save_versions(spark: SparkSession, maps: list[SlotMap]) -> DataFrame:
    """The maps as a written table: version, shards, vslot, shard (a row per version and slot)."""
    rows = [(m.version, m.shards, slot, shard) for m in maps for slot, shard in enumerate(m.owner)]
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("version", "shards", "vslot", "shard")])
    return materialize(spark.createDataFrame(rows, schema))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every row in a shard, sizes near equal (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot (place in its shard, gapless from 0, by virtual
    slot, then id, then checksum; among whole rows that repeat, any order), grown_shard (null: the
    map follows the data, so id and shard count alone do not decide), virtual_slot, map_version. An empty table
    gives no rows. Slot totals (one row per virtual slot, whatever the data's size) are the only
    thing the driver sees. The rows are numbered inside their virtual slot, and a slot starts where those before
    it in its shard end; so no task holds a shard.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, slots))
    totals = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    load, count = {}, {}
    for r in totals.collect():  # at most one row per virtual slot
        load[r["vslot"]], count[r["vslot"]] = r["bytes"], r["n"]
    first = SlotMap.even(shards, slots)
    current = first.rebalanced(load)
    versions = save_versions(spark, [first, current] if current is not first else [first])
    starts, filled = [], [0] * shards
    for slot, owner in enumerate(current.owner):
        starts.append((slot, filled[owner]))
        filled[owner] += count.get(slot, 0)
    start = spark.createDataFrame(starts, "start_slot int, start long")
    owners = versions.where(F.col("version") == current.version).drop("version", "shards")
    placed = owners.join(F.broadcast(start), F.col("vslot") == F.col("start_slot")).drop("start_slot")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within))
    return numbered.join(F.broadcast(placed), "vslot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard"),
        (F.col("start") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.lit(current.version).alias("map_version"),
    )
