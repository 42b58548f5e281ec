"""Sharding by balanced label propagation.

Documents linked by a hub (here: an equal text) should share a shard. Each round every hub names the shard that most of
its documents are in (of those with room), the documents elsewhere want to go there, and as many may as the quotas allow:
what a shard gives away and has free bounds what it takes. Then all documents, unlinked ones last, are numbered in their
shard, and what stands above the shard's exact share fills the shards below theirs, so that sizes are at most one apart.

Driver state is two tables of shards by shards. Numbering is two-level: within a range partition, then across partitions.

Defined results: a null text has size 1 and counts as empty; a null id is carried through; repeated rows are copies; other
columns of the input are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, partitions_for, text_or_empty

ROUNDS = 6


def quotas(sizes: np.ndarray, wants: np.ndarray, capacity: int) -> np.ndarray:
    """The share of each wanted flow (from, to) that may go, so that no shard comes to hold more than ``capacity``."""
    share = np.ones_like(wants, float)
    for _ in range(8):
        flow = wants * share
        room = np.maximum(capacity - sizes + flow.sum(1), 0)
        into = flow.sum(0)
        share = share * np.minimum(1, room / np.maximum(into, 1e-9))[None, :]
    return share


def propagate(nodes: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (row, hub, shard), moved towards their hubs' shards; rows that share a hub are linked."""
    uniform = lambda c, k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    for k in range(rounds):
        sizes = np.zeros(shards)
        for r in nodes.groupBy("shard").count().collect():
            sizes[r["shard"]] = r["count"]
        full = [s for s in range(shards) if sizes[s] >= capacity]
        counts = nodes.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        open_ = ~F.col("shard").isin(full) | (F.col("n") > 1) if full else F.lit(True)
        target = counts.groupBy("hub").agg(F.max_by("shard", F.struct(open_.cast("int"), "n", F.xxhash64("hub", "shard"))).alias("to"), F.sum("n").alias("all"))
        step = durable(nodes.join(durable(target, "targets"), "hub"), "wants")  # of stored tables: rows of a large hub can be split
        wants = np.zeros((shards, shards))
        for r in step.where("shard <> to").groupBy("shard", "to").count().collect():
            wants[r["shard"], r["to"]] = r["count"]
        if not wants.any():
            break
        share = quotas(sizes, wants, capacity)
        allowed = F.array(*(F.lit(float(x)) for x in share.ravel()))[F.col("shard") * shards + F.col("to")]
        by = F.when(F.col("all") * 4 <= capacity, uniform("hub", k)).otherwise(uniform("row", k))
        nodes = durable(step.select("row", "hub", F.when((F.col("shard") != F.col("to")) & (by < allowed), F.col("to")).otherwise(F.col("shard")).alias("shard")), "nodes")
    return nodes


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``: the place of each in its shard, from 0, in the given order."""
    ranged = rows.repartitionByRange(partitions_for(rows), F.col("shard"), *order).sortWithinPartitions("shard", *order)
    placed = ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("at", 33))  # a row's place in its partition
    each = durable(placed, "ranks")
    parts = each.groupBy("pid", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = parts.select("pid", "shard", (before - F.col("first")).alias("shift"))
    return each.join(ranks, ["pid", "shard"]).withColumn("rank", F.col("at") + F.col("shift")).drop("pid", "at", "shift")


def leveled(rows: DataFrame, held: list[int], shards: int) -> DataFrame:
    """Exact sizes: ``rank`` within the share is the slot; the others fill the free slots, in order."""
    n = sum(held)
    share = [n // shards + (s < n % shards) for s in range(shards)]
    over, free, start = {}, [], 0
    for s in range(shards):
        if held[s] > share[s]:
            over[s], start = start - share[s], start + held[s] - share[s]
    at = 0
    for s in range(shards):
        if held[s] < share[s]:
            free.append((at, s, held[s] - at))
            at += share[s] - held[s]
    pick = lambda values: F.array(*map(F.lit, values))[F.col("shard")]
    extra = F.col("rank") + pick([over.get(s, 0) for s in range(shards)]).cast("long")
    moved_to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, shift in free:
        moved_to, slot = F.when(extra >= first, F.lit(s)).otherwise(moved_to), F.when(extra >= first, extra + shift).otherwise(slot)
    inside = F.col("rank") < pick(share)
    return rows.withColumn("new", F.when(inside, F.col("shard")).otherwise(moved_to)).withColumn("slot", F.when(inside, F.col("rank")).otherwise(slot)).withColumn("shard", F.col("new")).drop("new")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    text = text_or_empty()
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hub"), F.monotonically_increasing_id().alias("row"))
    base = durable(base, "base")
    total = base.count()
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    hubs = durable(base.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub"), "hubs")
    nodes = durable(base.join(hubs, "hub", "left_semi").select("row", "hub", start.alias("shard")), "nodes")
    moved = propagate(nodes, shards, total // shards)
    rows = base.join(moved.select("row", F.col("shard").alias("to")), "row", "left")
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("to", start).alias("shard"), F.col("to").isNull().alias("single"), F.xxhash64("hub", F.lit(1)).alias("o"), "row")
    ranked = durable(numbered(rows, [F.col("single"), F.col("o"), F.col("row")]), "ranked")
    held = [0] * shards
    for r in ranked.groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    done = leveled(ranked, held, shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
