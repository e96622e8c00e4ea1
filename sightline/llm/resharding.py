"""Resharding by minimum-cost flow: new capacities are met by moving the fewest bytes, affected files are rewritten.

The rows of every old shard are dealt to blocks by a hash. Sizes of shards and capacities form a transport problem whose
flow says how many bytes go from each old shard to each new one. A shard's blocks are laid on a line, largest first, and
cut at the flows; what stays comes first, so the cuts fall between small blocks. Then the files of every new shard that
gains or loses blocks are written anew, and the others are left as they are.

Only sums per shard reach the driver (old x new numbers). Blocks are a Spark table of (old shards x blocks) rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sightline.llm.common import stored
from sightline.session import recovery_directory

BLOCKS = 512  # blocks of an old shard: the unit of a move
FILE_BYTES = 128 << 20  # of text in a file; larger shards have several
#: Shards the flow is solved for on the driver, old and new together.
MAX_SHARDS = 2000


def capacities(total: int, shards: int) -> list[int]:
    """Capacities that sum to ``total`` and differ by one at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def minimum_cost_flow(sizes: Mapping[int, int], room: Mapping[int, int], cost=None) -> dict[tuple[int, int], int]:
    """Amounts (old, new) -> bytes that place all sizes in the room at least cost; by default a byte that moves costs 1.

    What costs nothing is sent first; then successive shortest paths with potentials (Dijkstra). Ties go to the smallest
    shard numbers, so the flow is a function of its arguments. Costs are at least 0. The room has to hold the sizes.
    """
    if any(amount < 0 for amount in [*sizes.values(), *room.values()]) or sum(sizes.values()) > sum(room.values()):
        raise ValueError("The new shards cannot hold the old ones.")
    if len(sizes) + len(room) > MAX_SHARDS:
        raise ValueError(f"More than {MAX_SHARDS} shards.")
    price = cost or (lambda old, new: int(old != new))
    left, free = dict(sizes), dict(room)
    flow: dict[tuple[int, int], int] = {}
    for i, j in sorted((i, j) for i in sizes for j in room if price(i, j) == 0):
        amount = min(left[i], free[j])
        flow[i, j], left[i], free[j] = amount, left[i] - amount, free[j] - amount
    high = dict.fromkeys([("old", i) for i in sizes] + [("new", j) for j in room], 0)
    for start in sorted(sizes):
        while left[start]:
            distance, before, queue = {("old", start): 0}, {}, [(0, 0, start)]
            while queue:
                d, side, at = heapq.heappop(queue)
                node = ("new" if side else "old", at)
                if d > distance[node]:
                    continue
                if side:  # take back a unit that an old shard sent here
                    steps = [(("old", i), -price(i, at)) for i in sorted(sizes) if flow.get((i, at))]
                else:
                    steps = [(("new", j), price(at, j)) for j in sorted(room)]
                for other, weight in steps:
                    further = d + weight + high[node] - high[other]
                    if further < distance.get(other, float("inf")):
                        distance[other], before[other] = further, node
                        heapq.heappush(queue, (further, int(other[0] == "new"), other[1]))
            ends = [(distance[node] + high[node], node[1]) for node in distance if node[0] == "new" and free[node[1]]]
            path, node = [], ("new", min(ends)[1])
            far = max(distance.values())
            for known in high:
                high[known] += distance.get(known, far)
            end = node[1]
            while node in before:
                path.append((before[node], node))
                node = before[node]
            amount = min([left[start], free[end], *[flow[(b[1], a[1])] for a, b in path if a[0] == "new"]])
            for a, b in path:
                edge, sign = ((a[1], b[1]), 1) if a[0] == "old" else ((b[1], a[1]), -1)
                flow[edge] = flow.get(edge, 0) + sign * amount
            left[start] -= amount
            free[end] -= amount
    return {edge: amount for edge, amount in sorted(flow.items()) if amount}


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus one, the row's end; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def plan_blocks(blocks: DataFrame, room: Mapping[int, int], cost=None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """new shard, first slot and file of every block of blocks(old int, block int, bytes long, rows long).

    A block goes where the middle of its bytes lies. ``file`` numbers the files of all shards from 0.
    """
    totals = blocks.groupBy("old").agg(F.sum("bytes").alias("bytes"))
    sizes = {r["old"]: r["bytes"] for r in totals.limit(MAX_SHARDS + 1).collect()}  # more are refused below
    flow = minimum_cost_flow(sizes, room, cost)
    spans, at = [], dict.fromkeys(sizes, 0)
    for old, new in sorted(flow, key=lambda edge: (edge[0], edge[0] != edge[1], edge[1])):
        spans.append((old, new, 2 * at[old], 2 * (at[old] + flow[old, new])))
        at[old] += flow[old, new]
    pieces = blocks.sparkSession.createDataFrame(spans, "old int, shard int, low long, high long")
    line = Window.partitionBy("old").orderBy(F.desc("bytes"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = blocks.withColumn("middle", 2 * F.sum("bytes").over(line) - F.col("bytes"))
    dealt = laid.join(F.broadcast(pieces), "old").where("middle >= low and middle < high")  # bounded by MAX_SHARDS
    inside = Window.partitionBy("shard").orderBy("old", "block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.select(
        "old", "block", "shard", "rows", "bytes", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"),
        F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / file_bytes).cast("int").alias("part"))
    # At most old shards x blocks rows, so one task numbers the files.
    return stored(ahead.withColumn("file", F.dense_rank().over(Window.orderBy("shard", "part")) - 1))


def placements(rows: DataFrame, columns: list[str], old: Column, shards: int, text: str, key: str, blocks: int,
               file_bytes: int, room: Mapping[int, int] | None, cost) -> tuple[DataFrame, DataFrame]:
    """row (the columns named), placed and shard of every row, dealt by file, in the order of slots; and the plan of the blocks."""
    keyed = rows.select(
        F.struct(*columns).alias("row"), row_size(F.col(text)).alias("size"), F.coalesce(old, F.lit(0)).cast("int").alias("old"),
        F.pmod(F.crc32(F.concat_ws(":", F.col(key).cast("string"), checksum(F.col(text)).cast("string")).cast("binary")),
               F.lit(blocks).cast("long")).cast("int").alias("block"))
    sums = stored(keyed.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    if room is None:
        room = dict(enumerate(capacities(sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], shards)))
    plan = plan_blocks(sums, room, cost, file_bytes)
    files = (plan.agg(F.max("file")).first()[0] or 0) + 1
    placed = keyed.join(F.broadcast(plan.select("old", "block", "shard", "ahead", "file")), ["old", "block"])
    dealt = placed.repartitionById(files, F.col("file"))
    order = Window.partitionBy("shard", "file", "old", "block").orderBy(f"row.{key}", checksum(F.col(f"row.{text}")))
    numbered = dealt.select("row", F.struct(
        "size", "old", F.col("shard"), (F.col("ahead") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        (F.col("old") != F.col("shard")).alias("moved")).alias("placed"), "shard")
    return numbered, plan


def reshard(rows: DataFrame, old: Column, shards: int, text: str = "text", key: str = "doc_id", blocks: int = BLOCKS,
            file_bytes: int = FILE_BYTES, room: Mapping[int, int] | None = None, cost=None) -> DataFrame:
    """Write the rows in their new shards and return what the files hold: all columns of ``rows`` and the struct ``placed``.

    ``old`` is the number of the shard a row lies in now. New shards are 0 to shards - 1, of equal capacity unless ``room``
    names them. placed: size (bytes of the text plus 1), old, shard, slot (gapless from 0 in each shard), moved (the shard
    is another). A null text has no bytes, a null old shard counts as 0, an empty table gives an empty table. Rows of one
    shard are ordered by (old, block, key, checksum of the text); equal rows may take each other's slot. An input column
    named ``placed`` is replaced; all other names are free, as the row travels in a struct. Copies of a text are not kept
    together: that would move more bytes than the capacities ask for.

    Texts are shuffled once, by file of about ``file_bytes``; a shard that holds a third of all bytes is cut into blocks
    and files like any other. A long text is never cut: a shard is full to within half a block at each of its cuts.
    """
    columns = [name for name in rows.columns if name != "placed"]
    numbered, _ = placements(rows, columns, old, shards, text, key, blocks, file_bytes, room, cost)
    return _reread(numbered, f"{recovery_directory(rows.sparkSession)}/shards-{uuid.uuid4().hex}").select("row.*", "placed")


def _reread(numbered: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard and read the rows back from the files."""
    numbered.write.partitionBy("shard").parquet(path)
    return numbered.sparkSession.read.schema(numbered.schema).parquet(path)


def reshard_folder(spark: SparkSession, folder: str, shards: int, text: str = "text", key: str = "doc_id", **options) -> dict[int, str]:
    """Reshard the table under ``folder`` (one folder ``shard=k`` per shard) and return the folder of every new shard.

    Shards that neither gain nor lose a block keep their folder and are not written. The others are written under a new
    folder beside the old ones, which stay as they were: a run that dies leaves the old table whole. New shards without
    rows are left out.
    """
    rows = spark.read.parquet(folder)
    columns = [name for name in rows.columns if name != "shard"]
    numbered, plan = placements(rows, columns, F.col("shard"), shards, text, key, options.get("blocks", BLOCKS),
                                options.get("file_bytes", FILE_BYTES), options.get("room"), options.get("cost"))
    moves = plan.where("old <> shard").select("old", "shard").distinct().collect()  # pairs of shards only
    affected = {number for move in moves for number in move}
    held = {row["shard"] for row in plan.select("shard").distinct().collect()}
    fresh = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    if affected:
        numbered.where(F.col("shard").isin(sorted(affected))).select("row.*", "shard").write.partitionBy("shard").parquet(fresh)
    return {number: f"{fresh if number in affected else folder.rstrip('/')}/shard={number}" for number in sorted(held)}
