"""The trie of shared conversation beginnings, as level-order tries of prefix shards.

A turn is known by the SHA-256 of its role and text and its number of words, so texts are
read once and never shuffled. A conversation is one row of turn digests. Chained digests
name its prefixes: a node of the trie is a prefix, wherever its conversations lie.
Conversations with the same turns become one sequence with a weight.

* Prefixes that more than a limit of distinct sequences hold are the heavy upper levels
  (a prefix-closed set: a thousandth of the sequences, 16 at least and 50,000 at most).
  Their counts come from one aggregation with partial sums, so a common first turn or a
  common conversation is a few rows of a task.
* Below them each sequence belongs to the shard of its first prefix that is not heavy.
  Shards are dealt to buckets by hash. A bucket becomes one forest in level order: a LOUDS
  bit vector (a one for each child, a zero after each node's children) and label arrays.
  Parents are ranks in the bit vector, numbers of children are gaps between its zeros,
  and n_leaves and saved_tokens are rolled up by np.add.at over the levels in reverse.
* Shard roots add what is below them to all heavy prefixes above, by one aggregation.

``ends_sha256`` hashes ids in order, which SHA-256 can only do one after the other; ids of
a node are joined in blocks of 65,536 consecutive ids first, and the blocks of a node are
streamed through the hash, so memory is bounded by a block.

Cases. Rows without a conv_id belong to no conversation and are left out. Null roles and
texts are empty. Turns of a conversation that tie, or have no number, are in the order of
their digests; repeated rows are turns of their own. Heads come from the conversation
c - c % 20, with % as in SQL. A rebuilt conversation without turns ends at the root. An
empty table has no members and so no row. The digests of one conversation are held
together in a task, about 60 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
NONE_SHA = hashlib.sha256(b"").hexdigest()
_DIGEST = 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, tokens): turns in order, the first of a conversation at 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "key", "tokens")


def rebuilt(turns: DataFrame, every: int = 20, most_head: int = 4) -> DataFrame:
    """(conv_id, turns): the head of the first of each ``every`` conversations, then its own turns after as many."""
    turn = F.struct("pos", "key", "tokens")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("own"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most_head)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most_head).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of all prefixes: the empty one is the root, each other hashes the one before and the turn."""
    for batch in batches:
        prefixes = []
        for keys in batch.column("keys").to_pylist():
            name, names = b"", [b""]
            for key in keys:
                name = hashlib.blake2b(name + key, digest_size=_DIGEST).digest()
                names.append(name)
            prefixes.append(names)
        columns = {
            "conv_id": batch.column("conv_id"),
            "node": pa.array([p[-1] for p in prefixes], pa.binary()),
            "prefixes": pa.array(prefixes, pa.list_(pa.binary())),
            "tokens": batch.column("tokens"),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) of rows (node, ids) that are sorted by node and block."""
    node, state = None, hashlib.sha256()
    done: list[tuple[bytes, str]] = []

    def out():
        rows = pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in done], pa.binary()), "ends": pa.array([s for _, s in done], pa.string())})
        done.clear()
        return rows

    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
        yield out()
    if node is not None:
        done.append((node, state.hexdigest()))
    yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the comma-joined conv_ids of each node of ends (node, conv_id), ascending."""
    blocks = ends.groupBy("node", F.shiftright("conv_id", 16).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = blocks.select("node", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return joined.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(_streamed_hashes, "node binary, ends string")


class Louds:
    """A forest in level order, of rows (sequence, level, label). Node 0 stands above the roots.

    bits: ones for the children of each node, and a zero after them. levels: where each
    level's nodes begin. row_node: the node of each row.
    """

    def __init__(self, level: np.ndarray, sequence: np.ndarray, label: np.ndarray):
        self.row_node = np.zeros(len(level), dtype=np.int64)
        order = np.argsort(level, kind="stable")
        edges = np.searchsorted(level[order], np.arange(1, (int(level.max()) if len(level) else 0) + 2))
        at = np.zeros(int(sequence.max()) + 1 if len(sequence) else 0, dtype=np.int64)
        self.levels, parents = [0, 1], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            parent = at[sequence[rows]]
            _, first, node = np.unique(label[rows], return_index=True, return_inverse=True)
            by_parent = np.argsort(parent[first], kind="stable")
            rank = np.empty(len(first), dtype=np.int64)
            rank[by_parent] = np.arange(len(first))
            self.row_node[rows] = at[sequence[rows]] = self.levels[-1] + rank[node]
            parents.append(parent[first][by_parent])
            self.levels.append(self.levels[-1] + len(first))
        n = self.levels[-1]
        children = np.bincount(np.concatenate(parents), minlength=n)
        self.bits = np.ones(2 * n - 1, dtype=bool)
        self.bits[np.cumsum(children + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The parent of each node from 1 on: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def children(self) -> np.ndarray:
        """Number of children of each node."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled_up(self, value: np.ndarray) -> np.ndarray:
        """Sums of value over each node's subtree."""
        total, parent = value.copy(), np.r_[0, self.parents()]
        for a, b in list(zip(self.levels[1:-1], self.levels[2:], strict=True))[::-1]:
            np.add.at(total, parent[a:b], total[a:b])
        return total


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one bucket's shards. Rows: least conv_id of a sequence, weight, hash of its ends, prefixes, tokens, and top, the depth of its last heavy prefix."""
    table = table.combine_chunks()
    column = {c: table.column(c).to_numpy() for c in ("conv_id", "weight", "top")}
    lists = table.column("prefixes").combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(sequence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tokens = np.zeros(len(sequence), dtype=np.int64)
    tokens[depth > 0] = table.column("tokens").combine_chunks().flatten().to_numpy()
    below = depth > column["top"][sequence]
    names = lists.flatten().filter(pa.array(below))
    label = np.frombuffer(b"".join(names.to_pylist()), dtype=f"V{_DIGEST}").view(f"S{_DIGEST}")
    label = np.ascontiguousarray(label).view(">u8").reshape(-1, 2)
    label = np.unique(label, axis=0, return_inverse=True)[1].ravel()
    sequence, depth, tokens = sequence[below], depth[below], tokens[below]
    tree = Louds(depth - column["top"][sequence], sequence, label)
    n = tree.levels[-1]
    convs, least, own, deep = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(convs, tree.row_node, column["weight"][sequence])
    np.minimum.at(least, tree.row_node, column["conv_id"][sequence])
    own[tree.row_node], deep[tree.row_node] = tokens, depth
    some = np.zeros(n, np.int64)
    some[tree.row_node] = sequence
    children, parent = tree.children(), np.r_[0, tree.parents()]
    leaves = tree.rolled_up((children == 0).astype(np.int64))
    saved = tree.rolled_up(np.maximum(convs - 1, 0) * own)
    ends = np.full(n, NONE_SHA, dtype=object)
    last = depth == lengths[sequence] - 1
    ends[tree.row_node[last]] = table.column("ends").to_numpy()[sequence[last]]
    roots = np.arange(n) < tree.levels[2]
    paths = [lists[int(some[i])].as_py()[: int(column["top"][some[i]]) + 1] if root else None for i, root in enumerate(roots)]
    out = {
        "conv_id": least,
        "depth": deep,
        "parent_conv_id": pa.array(least[parent], mask=roots),
        "n_convs": convs,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "ends_sha256": pa.array(ends, pa.string()),
        "path": pa.array(paths, pa.list_(pa.binary())),
    }
    return pa.table(out).slice(1)


def _heavy(prefixed: DataFrame, limit: int) -> DataFrame:
    """(name, parent, depth, conv_id, n_convs, tokens, path) of the root and of prefixes of more than ``limit`` sequences."""
    rows = prefixed.select("conv_id", "weight", "prefixes", "tokens", F.posexplode("prefixes").alias("depth", "name"))
    one = F.struct("conv_id", F.try_element_at("prefixes", F.col("depth")).alias("parent"), F.coalesce(F.try_element_at("tokens", F.col("depth")), F.lit(0)).alias("tokens"))
    rows = rows.select("name", "depth", "weight", F.when(F.col("depth") > 0, one).otherwise(F.struct("conv_id", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("tokens"))).alias("one"))
    found = rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("weight").alias("n_convs"), F.min("depth").cast("long").alias("depth"), F.min("one").alias("one"))
    found = found.where((F.col("n") > limit) | (F.col("depth") == 0)).select("name", "one.parent", "depth", "one.conv_id", "n_convs", "one.tokens")
    paths = prefixed.select("conv_id", "prefixes").join(found, "conv_id")
    return paths.select("name", "parent", "depth", "conv_id", "n_convs", "tokens", F.slice("prefixes", F.lit(1), (F.col("depth") + 1).cast("int")).alias("path"))


def _upper_nodes(heavy: DataFrame, roots: DataFrame, ends: DataFrame) -> DataFrame:
    """The heavy nodes, with what shard roots and heavy nodes below them add."""
    below = roots.select(F.explode("path").alias("name"), "n_leaves", "saved_tokens")
    inside = heavy.select(F.explode("path").alias("name"), F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens"))
    sums = below.unionByName(inside).groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = roots.select(F.element_at("path", -1).alias("name")).unionByName(heavy.where("depth > 0").select(F.col("parent").alias("name"))).groupBy("name").agg(F.count("*").alias("n_children"))
    above = heavy.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = heavy.join(sums, "name").join(children, "name", "left").join(above, "parent", "left").join(ends, F.col("name") == F.col("node"), "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, share: int = 1000, least_limit: int = 16, most_limit: int = 50_000) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text), a row each."""
    lists = rebuilt(turn_rows(conversations.select("conv_id", "turn", "role", "text")))
    keyed = lists.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.tokens").alias("tokens"))
    all_ = written(keyed.mapInArrow(_chained, "conv_id long, node binary, prefixes array<binary>, tokens array<long>"), "prefixes")
    weighed = written(all_.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "weights")
    several = end_hashes(all_.select("node", "conv_id").join(weighed.where("weight > 1").select("node"), "node", "left_semi"))
    single = weighed.where("weight = 1").select("node", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    ends = written(several.unionByName(single), "ends")
    prefixed = written(all_.select("conv_id", "prefixes", "tokens").join(weighed.join(ends, "node"), "conv_id"), "sequences")
    n = prefixed.count()
    limit = min(max(n // share, least_limit), most_limit)
    heavy = written(_heavy(prefixed, limit), "heavy")
    names = prefixed.select("conv_id", F.posexplode("prefixes").alias("depth", "name"))
    tops = names.join(heavy.select("name"), "name", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("top"))
    dealt = prefixed.join(tops, "conv_id").where(F.size("prefixes") > F.col("top") + 1)
    bucket = F.pmod(F.xxhash64(F.element_at("prefixes", F.col("top") + 2)), F.lit(-(-max(n, 1) // (4 * limit))))
    sharded = dealt.select(bucket.alias("bucket"), "conv_id", "weight", "ends", "prefixes", "tokens", "top")
    nodes = written(sharded.groupBy("bucket").applyInArrow(_shard_nodes, _NODE + ", path array<binary>"), "nodes")
    roots = nodes.where("path IS NOT NULL")
    above = heavy.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    topmost = roots.withColumn("parent", F.element_at("path", -1)).join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    return nodes.where("path IS NULL").select(*COLUMNS).unionByName(topmost.select(*COLUMNS)).unionByName(_upper_nodes(heavy, roots, ends).select(*COLUMNS))
