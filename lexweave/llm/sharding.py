"""Sharding through fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots; the bytes and rows of each slot
are aggregated, and a small versioned map, stored beside the data, says which shard holds which slot.
Rebalancing edits that map: slots move, records are never hashed again. The law is `bytes`: shard sizes
near equal.

Groups are equal texts. A text's hash decides its slot, so copies share a slot and thus a shard, as long
as they hold no more bytes than a slot does on average. The groups that do, fewer than there are slots,
are named in the map and spread over all slots by doc_id, for no shard could hold them and be near equal.
Where even one record repeats that often, its place in the table spreads it: a number written with the row,
so that `shard` and `write_shards` of one numbered table agree on every row.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 4096


@dataclass
class SlotMap:
    """Which shard holds each virtual slot, and the texts and records (by hash) that are spread over slots.
    Bounded by the fixed number of slots."""

    version: int
    shards: int
    owner: list[int]
    moved: list[int] = field(default_factory=list)
    spread_texts: list[int] = field(default_factory=list)
    spread_records: list[int] = field(default_factory=list)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to a folder of JSON lines; earlier versions stay readable, none is replaced."""
        try:
            known = SlotMap.versions(spark, folder)
        except Exception as error:  # the first version makes the folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = []
        if self.version in known:
            raise ValueError(f"version {self.version} is already in {folder}")
        spark.createDataFrame([(self.version, json.dumps(asdict(self)))], "version int, map string").coalesce(1).write.mode("append").json(folder)

    @staticmethod
    def versions(spark: SparkSession, folder: str) -> list[int]:
        return sorted(r["version"] for r in spark.read.schema("version int, map string").json(folder).select("version").collect())

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A version, the latest by default."""
        rows = spark.read.schema("version int, map string").json(folder)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise LookupError(f"no version {version if version is not None else ''} of the slot map in {folder}")
        return SlotMap(**json.loads(found["map"]))


def _source(docs: DataFrame, whole: bool, text: str, doc_id: str) -> tuple[Column, Column, Column]:
    """The id, body and row number of docs, or with `whole` of a table that common.numbered made."""
    own = (lambda c: F.col(f"all.`{c}`")) if whole else (lambda c: F.col(f"`{c}`"))
    return own(doc_id).cast("long"), F.coalesce(own(text).cast("string"), F.lit("")), F.col("row") if whole else F.monotonically_increasing_id()


def record_hash(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def virtual_slot(doc_id: Column, text_hash: Column, slot_map: SlotMap | None, row: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; without a map of every text by its hash alone."""
    spread = lambda values: F.array(*[F.lit(x).cast("long") for x in values]) if values else F.array().cast("array<long>")
    record = record_hash(doc_id, text_hash)
    by = text_hash
    if slot_map and slot_map.spread_texts:
        by = F.when(F.array_contains(spread(slot_map.spread_texts), text_hash), record).otherwise(by)
    if slot_map and slot_map.spread_records:
        by = F.when(F.array_contains(spread(slot_map.spread_records), record), F.xxhash64(record, row)).otherwise(by)
    return F.pmod(by, F.lit(slots)).cast("int")


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Largest slot first onto the lightest shard; ties go to the lower number."""
    heap, owner = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        total, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (total + loads.get(slot, 0), shard))
    return SlotMap(1, shards, owner)


def rebalanced(old: SlotMap, loads: dict[int, int], shards: int) -> SlotMap:
    """The next version, for as many or more shards: slots leave the fullest shards for the emptiest
    while that narrows the gap; all others keep their place."""
    totals = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    owner = list(old.owner)
    for slot, shard in enumerate(owner):
        totals[shard] += loads.get(slot, 0)
        held[shard].append(slot)
    for h in held:
        h.sort(key=lambda s: (loads.get(s, 0), s))
    moved = []
    for _ in range(len(owner)):
        top, low = max(range(shards), key=lambda s: (totals[s], -s)), min(range(shards), key=lambda s: (totals[s], s))
        gap = totals[top] - totals[low]
        pick = next((s for s in reversed(held[top]) if 0 < loads.get(s, 0) < gap), None)
        if pick is None:
            break
        held[top].remove(pick)
        held[low].append(pick)
        held[low].sort(key=lambda s: (loads.get(s, 0), s))
        owner[pick] = low
        totals[top] -= loads[pick]
        totals[low] += loads[pick]
        moved.append(pick)
    return SlotMap(old.version + 1, shards, owner, moved, old.spread_texts, old.spread_records)


def measured(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", whole: bool = False) -> DataFrame:
    """row, doc_id, size, text_crc32, text_hash of every row. A null text has no bytes (crc32 of nothing: 0);
    size is its UTF-8 bytes plus 1."""
    ident, body, row = _source(docs, whole, text, doc_id)
    return docs.select(row.alias("row"), ident.alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("text_hash"))


def spread_of(rows: DataFrame, slots: int = SLOTS) -> SlotMap:
    """A map without owners: the texts, and of those the records, with more bytes than a slot has on
    average. rows: as measured() gives them."""
    bar = (rows.agg(F.sum("size")).first()[0] or 0) / slots
    heavy = lambda table, key: sorted(r["h"] for r in table.groupBy(key.alias("h")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > bar) & (F.col("n") > 1)).collect())
    texts = heavy(rows, F.col("text_hash"))
    if not texts:
        return SlotMap(0, 0, [])
    hot = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in texts], "text_hash long")), "text_hash", "left_semi")
    return SlotMap(0, 0, [], [], texts, heavy(hot, record_hash(F.col("doc_id"), F.col("text_hash"))))


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot: at most as many rows as there are slots."""
    return {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}


def plan(docs: DataFrame, shards: int = 8, *, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS) -> SlotMap:
    """The first version of a table's map, from its slots' bytes."""
    rows = written(measured(docs, text=text, doc_id=doc_id))
    return _planned(rows, shards, slots)


def _planned(rows: DataFrame, shards: int, slots: int) -> SlotMap:
    spread = spread_of(rows, slots)
    placed = rows.withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_hash"), spread, F.col("row"), slots))
    made = first_map({s: b for s, (b, _) in slot_loads(placed).items()}, shards, slots)
    made.spread_texts, made.spread_records = spread.spread_texts, spread.spread_records
    return made


def shard(docs: DataFrame, shards: int = 8, *, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS, slot_map: SlotMap | None = None, map_folder: str | None = None, whole: bool = False) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, vslot, shard, slot (its place in the shard, gapless
    from 0, by virtual slot, then doc_id).

    Null texts and ids are ordinary rows; rows that repeat get neighbouring places; an empty table
    gives no rows; other columns are ignored. A slot_map given is used as it is; else one is made, and
    with a map_folder stored there as version 1 and read back. With `whole` docs is what common.numbered
    made of a table, which write_shards then puts in the same shards.
    """
    spark = docs.sparkSession
    rows = written(measured(docs, text=text, doc_id=doc_id, whole=whole))
    if slot_map is None:
        slot_map = _planned(rows, shards, slots)
        if map_folder:
            slot_map.save(spark, map_folder)
            slot_map = SlotMap.load(spark, map_folder)
    owners = slot_map.owner
    slots = len(owners)
    rows = written(rows.withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_hash"), slot_map, F.col("row"), slots)))
    loads = slot_loads(rows)
    base, used = [0] * slots, [0] * (max(owners) + 1)
    for s in range(slots):
        base[s] = used[owners[s]]
        used[owners[s]] += loads.get(s, (0, 0))[1]
    place = spark.createDataFrame([(s, owners[s], base[s]) for s in range(slots)], "vslot int, shard int, base long")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    numbered = rows.withColumn("within", within)  # one window group a virtual slot, thousands in all
    return numbered.join(F.broadcast(place), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("within") - 1).alias("slot"))


def write_shards(docs: DataFrame, folder: str, slot_map: SlotMap, *, text: str = "text", doc_id: str = "doc_id", whole: bool = False) -> str:
    """Whole rows as Parquet, one folder a shard. Gives the name of the folders' column: `shard`, with
    as many underscores behind it as keep it apart from the table's own columns. With `whole` docs is a
    numbered table, and every row goes where `shard` says; else copies of one spread record, which are alike,
    may change places among themselves."""
    names = docs.schema["all"].dataType.names if whole else docs.columns
    taken, name = {c.lower() for c in names}, "shard"
    while name in taken:
        name += "_"
    ident, body, row = _source(docs, whole, text, doc_id)
    slot = virtual_slot(ident, F.xxhash64(body), slot_map, row, len(slot_map.owner))
    owner = F.element_at(F.array(*[F.lit(s) for s in slot_map.owner]), slot + 1).alias(name)
    docs.select("all.*" if whole else "*", owner).write.partitionBy(name).parquet(folder)
    return name
