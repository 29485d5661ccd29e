"""Merkle manifest of a table: a tree of digests per group, one root over all groups, and a proof for every row.

Rows are leaves, ordered by key within their group. Every ``arity`` consecutive nodes become the hash of their digests, the last run
being shorter, until one node is left: the group's subroot. Subroots, ordered by group, form one more tree in the same way.

Digests travel by time-forward processing. A node's label is its level and its place in it; children come before parents in label
order, and a priority queue ordered by label hands each digest on to the parent that will need it. Across the table the queue
is external: Spark's shuffle, which spills and sorts, delivers nodes in label order to blocks of consecutive nodes. A block is as many
levels deep as fit ``BLOCK`` nodes; inside it the queue is a heap. Each round so climbs several levels, and the number of
rounds is the logarithm of the largest group to the base ``BLOCK``. A second sweep takes the labels in reverse: every node hands its
children the rest of their proofs, from the root down to the leaves. A group with a third of all rows is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketflow.operators.ranking import exact_rank
from docketflow.session import materialise

#: Nodes of a block at most.
BLOCK = 512
DIGEST = 32


def field(column: str | Column) -> Column:
    """A value as a leaf's input: its UTF-8 bytes' count, a colon and the value, or a dash for null."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    """A row's digest, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run of digests, which are hashed as lowercase hexadecimal text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def levels_up(nodes: int, arity: int, whole: bool, depth: int) -> int:
    """How many levels a block climbs: its full depth, or in a tree of one block until one node is left."""
    if not whole:
        return depth
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // arity), levels + 1
    return levels


def climb(digests: list[bytes], arity: int, levels: int) -> list[list[bytes]]:
    """All nodes of a block by level, each sent to its parent through a queue ordered by label."""
    out: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue = [(0, place, digest) for place, digest in enumerate(digests)]
    while queue:
        level, place, digest = heappop(queue)
        out[level].append(digest)
        last = place % arity == arity - 1 or not queue or queue[0][0] != level
        if level < levels and last:
            heappush(queue, (level + 1, place // arity, joined(out[level][place // arity * arity :])))
    return out


def descend(nodes: list[list[bytes]], arity: int, suffix: bytes) -> list[bytes]:
    """The leaves' proofs in a block whose top node's proof is ``suffix``: the reversed sweep.

    A proof has, from the leaf upwards, each level's place in its run, the number of the run's others, and their digests.
    """
    queue = [(-(len(nodes) - 1), 0, suffix)] if nodes[0] else []
    out = []
    while queue:
        level, place, rest = heappop(queue)
        if level == 0:
            out.append(rest)
            continue
        run = nodes[-level - 1][place * arity : place * arity + arity]
        for own in range(len(run)):
            others = run[:own] + run[own + 1 :]
            heappush(queue, (level + 1, place * arity + own, bytes([own, len(others)]) + b"".join(others) + rest))
    return out


def steps_of(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """A proof's levels from the leaf upwards: the node's place in its run, and the others' digests."""
    at = 0
    while at < len(proof):
        place, others = proof[at], proof[at + 1]
        at += 2
        yield place, [proof[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(others)]
        at += DIGEST * others


def folded(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    for place, others in steps_of(proof):
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def siblings_digest(proof: bytes) -> bytes:
    """The digest of all siblings' digests, level by level from the leaf upwards."""
    return joined([other for _, others in steps_of(proof) for other in others])


def _depth(arity: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


NODE = "_g string, _i bigint, _n bigint, digest binary"


def _block_nodes(table: pa.Table, arity: int, depth: int) -> tuple[pa.Table, list[list[bytes]]]:
    """A block's rows in order, and its nodes by level."""
    table = table.sort_by("_i")
    n = table.column("_n")[0].as_py()
    return table, climb(table.column("digest").to_pylist(), arity, levels_up(n, arity, n <= arity**depth, depth))


class _Forest:
    """The stored rounds of one tree per group: nodes ``_g, _i`` (place from 0), ``_n`` (nodes of the group), ``digest``."""

    def __init__(self, nodes: DataFrame, arity: int, name: str):
        self.arity, self.depth, self.name = arity, _depth(arity), name
        self.size = arity**self.depth
        self.rounds = [nodes]
        while (self.rounds[-1].agg(F.max("_n")).first()[0] or 0) > 1:
            self.rounds.append(materialise(self._climbed(self.rounds[-1]), name))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("_block", F.floor(F.col("_i") / F.lit(self.size)))

    def _climbed(self, nodes: DataFrame) -> DataFrame:
        arity, depth, size = self.arity, self.depth, self.size

        def up(table: pa.Table) -> pa.Table:
            table, found = _block_nodes(table, arity, depth)
            n = table.column("_n")[0].as_py()
            return pa.table([table.column("_g").slice(0, 1), pa.array([table.column("_i")[0].as_py() // size], pa.int64()),
                             pa.array([-(-n // size)], pa.int64()), pa.array([found[-1][0]], pa.binary())], ["_g", "_i", "_n", "digest"])

        return self._blocks(nodes.select("_g", "_i", "_n", "digest")).groupBy("_g", "_block").applyInArrow(up, NODE)

    def tops(self) -> DataFrame:
        """``_g, digest``: each group's last node."""
        return self.rounds[-1].select("_g", "digest")

    def proofs(self, tops: DataFrame) -> DataFrame:
        """The first round's rows with ``proof`` and the other columns of ``tops`` (``_g, proof, ...``: what lies above the tops)."""
        above = tops.withColumn("_i", F.lit(0).cast("bigint"))
        for k in range(len(self.rounds) - 2, -1, -1):
            above = self._descended(self._blocks(self.rounds[k]), above)
            if k:
                above = materialise(above.drop("_n", "digest"), f"{self.name}-proofs")
        return above

    def _descended(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        arity, depth = self.arity, self.depth
        handed = [c for c in above.columns if c not in ("_g", "_i", "proof")]

        def down(left: pa.Table, right: pa.Table) -> pa.Table:
            table, found = _block_nodes(left.drop_columns(["_block"]), arity, depth)
            proofs = descend(found, arity, right.column("proof")[0].as_py())
            out = table.append_column("proof", pa.array(proofs, pa.binary()))
            for c in handed:
                out = out.append_column(c, pa.array([right.column(c)[0].as_py()] * len(proofs), right.schema.field(c).type))
            return out

        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.drop("_block").schema.fields]
        kinds += ["proof binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in above.select(*handed).schema.fields)]
        return nodes.groupBy("_g", "_block").cogroup(above.withColumnRenamed("_i", "_block").groupBy("_g", "_block")).applyInArrow(down, ", ".join(kinds))


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", arity: int = 2, carried: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof``, and ``carried`` columns worked out from the row; digests and proofs are binary.

    ``columns`` are what a leaf is made of. Rows of one group are ordered by key, null first, and rows of one key by digest;
    the null group comes first, others by their UTF-8 bytes. Equal rows are as many leaves. ``group`` is a string. Other columns
    are not read; ``key`` and ``carried`` may not bear the name of a result column or begin with an underscore. An empty table gives an empty one.
    """
    carried = carried or {}
    names = [key, *carried]
    bad = {n for n in names if n.startswith("_") or n.lower() in ("leaf", "digest", "subroot", "root", "proof")}
    if bad or len(set(map(str.lower, names))) < len(names):
        raise ValueError(f"choose other names than {sorted(bad) or names}")
    if not 2 <= arity <= 255:
        raise ValueError("runs have 2 to 255 nodes")
    # groups as text that sorts null first and tells it from the empty text
    named = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = docs.select(named.alias("_g"), F.col(key).alias(key), leaf(*columns).alias("digest"), *[v.alias(k) for k, v in carried.items()])
    ranked = exact_rank(leaves, ["_g"], [key, "digest"], "_i", total="_n").withColumn("_i", F.col("_i") - 1)
    trees = _Forest(materialise(ranked, "leaves"), arity, "nodes")
    groups = exact_rank(trees.tops().withColumnRenamed("_g", "_of"), [], ["_of"], "_i", total="_n").select(
        F.lit("").alias("_g"), (F.col("_i") - 1).alias("_i"), "_n", "digest", "_of")
    top = _Forest(materialise(groups, "subroots"), arity, "tops")
    root = top.tops().select("_g", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    if len(top.rounds) == 1:  # at most one group: its subroot is the root
        above = top.rounds[0].select("_of", "digest", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    else:
        above = top.proofs(root)
    above = materialise(above.select(F.col("_of").alias("_g"), "proof", F.col("digest").alias("subroot"), "root"), "groups")
    if len(trees.rounds) == 1:  # no group has more than one row
        below = trees.rounds[0].join(above, "_g")
    else:
        below = trees.proofs(above)
    return below.select(key, F.col("digest").alias("leaf"), "subroot", "root", "proof", *carried)


def verified(rows: DataFrame, leaf: str = "leaf", proof: str = "proof", out: str = "folded_root", siblings: str = "siblings_digest") -> DataFrame:
    """``rows`` with the root that ``leaf`` and ``proof`` lead to and with the digest of the proof's siblings, both binary; null stays null."""
    taken = {c.lower() for c in rows.columns} & {out.lower(), siblings.lower()}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}: choose other names for the output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(leaf).to_pylist(), batch.column(proof).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([None if a is None or b is None else folded(a, b) for a, b in pairs], pa.binary()),
                pa.array([None if b is None else siblings_digest(b) for _, b in pairs], pa.binary())], [*batch.schema.names, out, siblings])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{out}` binary, `{siblings}` binary")
