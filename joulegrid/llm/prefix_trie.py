"""The trie of conversations' prefixes, finished in sorted shards around a skeleton of range-partition splitters.

A turn becomes a token of fixed width (half of a SHA-256 of role and text, and the text's length), so a conversation is a
path of tokens, sorting paths puts every node's members side by side, and texts are not moved again. Paths are range
partitioned by (path, conv_id), so any number of equal conversations is dealt to several shards. A node with members in
more than one shard is a prefix of the first path of the later one: the trie of these first paths, the skeleton, is
broadcast. Each shard walks its sorted paths with a stack and finishes all other nodes; of skeleton nodes it gives partial
aggregates, which are reduced by node and then summed up along the skeleton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid import shared
from joulegrid.llm.common import give_back, settle

#: Characters of a token: 32 of the hash, 8 of the length.
TOKEN = 40
#: Splitter paths together are at most so long, as they are broadcast.
SKELETON_BYTES = 64 << 20
#: Joined ids of a node are passed on in parts of about so many characters.
PART = 1 << 18
SHARD = "kind string, node long, shard int, part int, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def token() -> Column:
    """A turn's token: equal for equal role and text, nulls being empty, and for no others."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(said, 1, 32), F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))


def paths(conversations: DataFrame, shared_turns: int = 6, block: int = 100) -> DataFrame:
    """conv_id and path of every rebuilt conversation: the first h turns of its block's first one, then its own after h."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), token().alias("token")).where("conv_id IS NOT NULL")
    own = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "token"))), lambda x: x["token"]), "").alias("own"))
    own = settle(own.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared_turns))
    firsts = own.where("conv_id = first_id").select("first_id", F.substring("own", 1, TOKEN * (shared_turns - 1)).alias("first"))
    width = (F.col("h") * TOKEN).cast("int")
    rebuilt = F.concat(F.substring(F.coalesce("first", F.lit("")), F.lit(1), width), F.substring(F.col("own"), width + 1, F.lit((1 << 31) - 1)))
    return own.join(firsts, "first_id", "left").select("conv_id", rebuilt.alias("path"))


def split(path: str) -> list[str]:
    return [path[k : k + TOKEN] for k in range(0, len(path), TOKEN)]


class Skeleton:
    """The trie of splitter paths. Node 0 is the root; a node's number is greater than its parent's."""

    def __init__(self, splitters: list[str]):
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.depth, self.last = [-1], [0], [""]
        for path in splitters:
            at = 0
            for t in split(path):
                key = (at, t)
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.last.append(t)
                at = self.child[key]


def length_of(last: str) -> int:
    return int(last[32:], 16) if last else 0


class Open:
    """A node of the shard whose members are still coming."""

    __slots__ = ("children", "closed", "conv", "ends", "leaves", "members", "parts", "saved", "skeleton", "token")

    def __init__(self, token: str, skeleton: int | None):
        self.token, self.skeleton = token, skeleton
        self.conv, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[str] = []
        self.parts = hashlib.sha256() if skeleton is None else 0
        self.closed: list[tuple] = []


class Shard:
    """Walks sorted paths; rows of ``SHARD`` come out as nodes close."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.trie, self.shard, self.stack, self.before, self.rows = skeleton, shard, [Open("", 0)], [], []

    def flush(self, node: Open, end: bool) -> None:
        """Pass on the ids of the conversations that end at a node, in order."""
        if not node.ends:
            return
        joined = ",".join(node.ends)
        node.ends = []
        if node.skeleton is None:
            node.parts.update((joined if end else joined + ",").encode())
        else:
            self.rows.append(("ends", node.skeleton, self.shard, node.parts, None, None, None, None, None, None, None, joined))
            node.parts += 1

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        self.flush(node, True)
        own = max(0, node.members - 1) * length_of(node.token)
        if node.skeleton is not None:
            self.rows.append(("part", node.skeleton, self.shard, None, node.conv, None, None, node.members, node.children, node.leaves, node.saved, None))
        else:
            node.leaves += node.children == 0
            node.saved += own
        for child in node.closed:
            self.rows.append((*child[:6], node.conv, *child[7:]))
        if not self.stack:
            return
        above = self.stack[-1]
        above.members += node.members
        if node.conv is not None and (above.conv is None or node.conv < above.conv):
            above.conv = node.conv
        if node.skeleton is None:
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            row = ("node", above.skeleton, self.shard, None, node.conv, depth, None, node.members, node.children, node.leaves, node.saved, node.parts.hexdigest())
            # A child's row names its parent by the least member, known once all of them have come; of a skeleton node, later.
            (self.rows if above.skeleton is not None else above.closed).append(row)

    def add(self, path: str, conv: int) -> None:
        now = split(path)
        common = 0
        while common < min(len(now), len(self.before)) and now[common] == self.before[common]:
            common += 1
        while len(self.stack) > common + 1:
            self.close()
        for t in now[common:]:
            above = self.stack[-1].skeleton
            self.stack.append(Open(t, self.trie.child.get((above, t)) if above is not None else None))
        self.before = now
        node = self.stack[-1]
        node.members += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends.append(str(conv))
        if len(node.ends) >= PART // 16:
            self.flush_open(node)

    def flush_open(self, node: Open) -> None:
        """A full part goes on; the last id is kept back, as it is not known whether a comma follows."""
        last = node.ends.pop()
        self.flush(node, False)
        node.ends = [last]

    def end(self) -> None:
        while self.stack:
            self.close()


def trie(conversations: DataFrame, shared_turns: int = 6, block: int = 100, shard_rows: int = 200_000) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie.

    Rows without a conv_id belong to no conversation and are left out. Turns of one number are ordered by their tokens,
    so repeated rows are repeated turns; null turns come first, null roles and texts are empty. c % 100 keeps the sign
    of c, as in SQL. A table without conversations has no nodes. Further columns are not read. Of one conversation 40
    characters a turn come together, whatever the length of its texts. The digest of a node's ids is sequential by its
    definition, so the ids of one node are hashed in one task, in parts as they come; nothing of them is held.
    """
    spark = conversations.sparkSession
    rebuilt = settle(paths(conversations, shared_turns, block))
    n = rebuilt.count()
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows))
    ordered = shared.settle(rebuilt.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id"))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.record_batch([b.column("path").slice(0, 1)], ["path"])
                return

    splitters = settle(ordered.select("path").mapInArrow(first, "path string").distinct())
    size = splitters.agg(F.coalesce(F.sum(F.length("path")), F.lit(0))).first()[0]
    if size > SKELETON_BYTES:
        raise ValueError(f"splitter paths have {size} characters; fewer shards are needed")
    skeleton = Skeleton(sorted(r["path"] for r in splitters.collect()))
    sent = spark.sparkContext.broadcast(skeleton)
    names = [c.strip().split(" ")[0] for c in SHARD.split(",")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string()]

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Shard(sent.value, TaskContext.get().partitionId())

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*here.rows, strict=True), kinds, strict=True)], names)
            here.rows = []
            return batch

        some = False
        for b in it:
            some = some or b.num_rows > 0
            for path, conv in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                here.add(path, conv)
                if len(here.rows) >= 8192:
                    yield out()
        if some:
            here.end()
            yield out()
        give_back()

    found = settle(ordered.mapInArrow(walk, SHARD))
    top = skeleton_rows(spark, skeleton, found)
    least = F.broadcast(top.select(F.col("node").alias("above"), F.col("conv_id").alias("above_id")))
    nodes = found.where("kind = 'node'").join(least, F.col("node") == F.col("above"), "left")
    rest = nodes.select("conv_id", "depth", F.coalesce("above_id", "parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return rest.unionByName(top.select(*OUT))


def skeleton_rows(spark, skeleton: Skeleton, found: DataFrame) -> DataFrame:
    """The skeleton's nodes: partial aggregates reduced by node, then summed up from the leaves of the skeleton."""
    parts = found.where("kind = 'part'").groupBy("node").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    digests = {r["node"]: r["ends"] for r in end_digests(found).collect()}
    held = {r["node"]: r for r in parts.collect()}
    n = len(skeleton.parent)
    children, leaves, saved = ([held[k][c] for k in range(n)] for c in ("n_children", "n_leaves", "saved"))
    for k in range(n - 1, -1, -1):
        leaves[k] += children[k] == 0
        saved[k] += max(0, held[k]["n_convs"] - 1) * length_of(skeleton.last[k])
        if k:
            above = skeleton.parent[k]
            children[above] += 1
            leaves[above] += leaves[k]
            saved[above] += saved[k]
    none = hashlib.sha256().hexdigest()
    rows = [(k, held[k]["conv_id"], skeleton.depth[k], held[skeleton.parent[k]]["conv_id"] if k else None, held[k]["n_convs"], children[k], leaves[k], saved[k], digests.get(k, none)) for k in range(n)]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 8, pa.string()], strict=True)], ["node", *OUT])
    return spark.createDataFrame(table)


def end_digests(found: DataFrame) -> DataFrame:
    """node and the digest of its ids, whose parts stand in order of shards."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in it:
            for k, ids in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if k != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            done.append((node, state.hexdigest()))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends"])

    ends = found.where("kind = 'ends'").select("node", "shard", "part", "ends")
    return ends.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ends").mapInArrow(run, "node long, ends string")
