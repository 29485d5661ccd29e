"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Old shards are sources, new shards sinks; keeping a byte costs nothing, moving it costs one. The flow says how many bytes go
from where to where. Inside an old shard rows stand in blocks from large to small; the flow's amounts are cut from that
order, what stays first, so cuts fall among small rows. Then files that hold moved rows are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docketflow.session import materialise, scratch_path

#: Rows that one block holds on average.
BLOCK_ROWS = 4_000
#: Old and new shards a plan may have; the flow between them is solved on the driver.
MAX_SHARDS = 2_000


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def least_moves(sizes: dict[int, int], capacities: dict[int, int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards at least cost: successive shortest paths between shards.

    Capacities must add up to at least the sizes.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("capacities are too small")
    if len(sizes) + len(capacities) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    left, room, flow = dict(sizes), dict(capacities), {}

    def push(old: int, new: int, amount: int) -> None:
        flow[old, new] = flow.get((old, new), 0) + amount
        if not flow[old, new]:
            del flow[old, new]

    for i in sorted(sizes):  # arcs without cost are shortest paths already
        amount = min(left[i], room.get(i, 0)) if i in room and cost(i, i) == 0 else 0
        if amount:
            push(i, i, amount)
            left[i], room[i] = left[i] - amount, room[i] - amount
    while any(left.values()):
        # Bellman-Ford from all old shards with bytes left; a flow arc may be taken back at minus its cost
        far = {("old", i): (0, None) for i, n in left.items() if n}
        changed = True
        while changed:
            changed = False
            for i in sorted(sizes):
                if ("old", i) in far:
                    for j in sorted(capacities):
                        d = far["old", i][0] + cost(i, j)
                        if ("new", j) not in far or d < far["new", j][0]:
                            far["new", j], changed = (d, ("old", i)), True
            for i, j in sorted(flow):
                if ("new", j) in far:
                    d = far["new", j][0] - cost(i, j)
                    if ("old", i) not in far or d < far["old", i][0]:
                        far["old", i], changed = (d, ("new", j)), True
        end = min((far["new", j][0], j) for j in room if room[j] and ("new", j) in far)[1]
        path, at = [("new", end)], far["new", end][1]
        while at is not None:
            path.append(at)
            at = far[at][1]
        path.reverse()
        amount = min(left[path[0][1]], room[end], *[flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "new"])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                push(a[1], b[1], amount)
            else:
                push(b[1], a[1], -amount)
        left[path[0][1]] -= amount
        room[end] -= amount
    return flow


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null, and 8 more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def identified(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files with ``_file`` and ``_row``, which name a row the same way in every read."""
    return spark.read.parquet(path).select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """Shard and slot of each row: ``rows`` (``_file, _row, size, old_shard``, stored) with ``shard, slot``.

    Shards get nearly equal bytes and the moved bytes are the fewest for that, up to a row per cut. Slots count from 0 in
    each shard without gaps. An empty table gives an empty one. Which of the rows move depends on a hash of their places.
    """
    sums = rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(MAX_SHARDS + 1).collect()
    sizes = {r.old_shard: r.bytes for r in sums}
    flow = least_moves(sizes, equal_capacities(sum(sizes.values()), shards))
    buckets = max(1, -(-sum(r.n for r in sums) // BLOCK_ROWS))

    # where each cut of an old shard ends: what stays comes first, then receivers in order
    cuts = []
    for i in sorted(sizes):
        end = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            end += flow[i, j]
            cuts.append((i, end, j))
    cuts_of = {i: [(end, j) for o, end, j in cuts if o == i] for i in sizes}
    table = F.create_map(*[x for i, c in cuts_of.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(e).cast("bigint").alias("end"), F.lit(j).alias("shard")) for e, j in c]))]) if cuts else None

    block = ["old_shard", "_class", "_bucket"]
    placed = rows.withColumns({"_class": F.length(F.bin("size")), "_bucket": F.pmod(F.xxhash64("_file", "_row"), F.lit(buckets))})
    order = [F.col("_class").desc(), "_bucket"]
    blocks = placed.groupBy(*block).agg(F.sum("size").alias("_bytes"))
    blocks = blocks.withColumn("_before", F.sum("_bytes").over(Window.partitionBy("old_shard").orderBy(*order)) - F.col("_bytes")).drop("_bytes")
    inside = F.sum("size").over(Window.partitionBy(*block).orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = placed.withColumn("_inside", inside).join(blocks, block).withColumn("_middle", F.col("_before") + F.col("_inside") + F.expr("size div 2"))
    if table is None:
        shard = F.lit(0)
    else:
        own = table[F.col("old_shard")]
        # the first cut that ends beyond the row's middle
        shard = F.coalesce(F.element_at(F.filter(own, lambda c: c["end"] > F.col("_middle")), 1)["shard"], F.element_at(own, -1)["shard"])
    given = materialise(middle.withColumn("shard", shard.cast("int")).drop("_before", "_inside", "_middle"), "assigned")

    counts = given.groupBy("shard", *block).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("old_shard", *order)) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("shard", *block).orderBy("_file", "_row")) - 1
    slots = given.withColumn("_number", number).join(first, ["shard", *block]).withColumn("slot", (F.col("_first") + F.col("_number")).cast("bigint"))
    return materialise(slots.drop("_class", "_bucket", "_first", "_number"), "slots")


def rewrite(spark: SparkSession, path: str, assigned: DataFrame, to: str, every: bool = True) -> None:
    """Write the rows of ``path`` with ``shard, slot`` into one folder per shard under ``to``.

    With ``every=False`` only rows of files that lose or gain one are written: files all of whose rows stay can be kept.
    """
    if not every:
        touched = assigned.filter("shard <> old_shard").select("_file").distinct()
        assigned = assigned.join(touched, "_file", "left_semi")
    rows = identified(spark, path)
    clash = {"shard", "slot"} & {c.lower() for c in rows.columns}
    rows = rows.withColumnsRenamed({c: f"original_{c}" for c in rows.columns if c.lower() in clash})
    # the side with the texts is never small: a sort-merge join at every size
    rows.hint("merge").join(assigned.select("_file", "_row", "shard", "slot"), ["_file", "_row"]).drop("_file", "_row").write.partitionBy("shard").parquet(to)


def reshard(spark: SparkSession, path: str, old_shard: Column, shards: int, text: str = "text", to: str | None = None) -> DataFrame:
    """Plan, write and read back: rows of the Parquet files at ``path`` with ``shard`` and ``slot``.

    ``old_shard`` gives the present shard (int; null counts as 0). Rows that repeat are rows of their own. Columns that are
    called ``shard`` or ``slot`` come back as ``original_shard``, ``original_slot``.
    """
    rows = identified(spark, path).select("_file", "_row", row_size(text).alias("size"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"))
    assigned = assign(materialise(rows, "rows"), shards)
    to = to or scratch_path(spark, "shards")
    rewrite(spark, path, assigned, to)
    if not assigned.limit(1).count():
        return identified(spark, path).drop("_file", "_row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).limit(0)
    return spark.read.option("basePath", to).parquet(to)
