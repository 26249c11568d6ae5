"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles. Its signature has ``chunks *
width`` components, each the low 16 bits of one minimum hash; the distance of two
signatures is the number of components in which they differ.

Pigeonhole: signatures within distance ``chunks * (errors + 1) - 1`` have a chunk in
which at most ``errors`` components differ. Every chunk is therefore indexed once
for each way of blanking ``errors`` of its components, and two documents that share
an index key are candidates. No pair within that distance is missed. The number of
chunks follows from the wanted similarity, so that a pair exactly at it shares no
key with probability below ``MISS``; no filter on the distance is applied after.

Which pairs are compared. Equal sets are joined by hash first and go on as one
document. Within a key, the hub is the document that shares the most keys with others,
and the rest are compared with it on the full sets: as many comparisons as rows. What
is similar enough is linked, and links make components.

What the hubs leave open. Let x and y be similar enough, in different components, and
both compared with hub H. The group of H has a centre: the items that more than half of
a few of its members hold. (Any set would give right results; this one leaves the least
outside.) Order all items so that those outside of the centre come first, rare ones
before, then by hash. Of two similar sets, the first items in this order, as many as
one may lack and one more, have an item in common. Either that item is outside of the
centre, and the pair meets in it; the smaller set can lack less than the larger, and the
places of the item and the sizes bound what can follow. Or nothing outside is common;
then the overlap is at most the smaller part inside of the centre, and the sizes tell
whether that can do. The second comparison takes just those pairs.

A meeting of more than ``_SPLIT`` members is not paired at all. It elects a hub of its
own, the member nearest to the centre, and is compared with that; what is then open
goes through the same again, with the centre of the new group. So a large group costs
rows, not pairs, and no link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import release, written
from panelwright.llm.textwords import SPACE_WORDS, mix, ngram_hashes, words_of

U64 = np.uint64
MISS = 1e-5
#: Ids that are sent to all executors at most: 16 MB of them.
MOST_BROADCAST = 1_000_000
#: Members that a centre is taken from, apart from the hub.
_SAMPLE = 15
#: Members up to which a meeting is paired.
_SPLIT = 64
#: Elections one after another; then what is open is paired, whatever its size.
_LEVELS = 8


def index_layout(percent: int, width: int = 7, errors: int = 1) -> tuple[int, int, int]:
    """(chunks, width, errors) for a similarity of ``percent`` per cent."""
    s = percent / 100
    shared = sum(math.comb(width, k) * s ** (width - k) * (1 - s) ** k for k in range(errors + 1))
    return (max(1, math.ceil(math.log(MISS) / math.log(1 - shared))) if shared < 1 else 1), width, errors


def _shingle_sets(words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each): each document's distinct shingles, in ascending order."""
    doc = words.doc_of()
    counts = words.counts()
    if len(h) >= n:
        g = ngram_hashes(h, n)
        ok = words.left()[: len(g)] >= n
        value, owner = g[ok], doc[: len(g)][ok]
    else:
        value, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = []
        for i in short:
            total = U64(0)
            with np.errstate(over="ignore"):
                for x in h[words.first[i] : words.first[i + 1]]:
                    total = total * U64(0x9E3779B97F4A7C15) + x
                extra.append(total + U64(counts[i]))
        value, owner = np.concatenate([value, mix(np.array(extra, dtype=U64))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
    return value, owner


def _lower_word_hashes(batch: pa.RecordBatch):
    for row, end, words in words_of(batch.column("text"), SPACE_WORDS, lower=True):
        yield row, end, words, words.hashes(0)


def _signatures(n: int, layout: tuple[int, int, int]):
    size = layout[0] * layout[1]
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 1 << 63, size, dtype=U64) * U64(2) + U64(1)
    shift = rng.integers(0, 1 << 63, size, dtype=U64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            for row, end, words, h in _lower_word_hashes(batch):
                value, owner = _shingle_sets(words, h, n)
                count, *sets = _set_keys(value, owner, words.n_docs)
                full = np.flatnonzero(count)
                signature = np.zeros((len(full), size), dtype=np.uint16)
                if len(full):
                    at = np.r_[0, np.cumsum(count[full])[:-1]].astype(np.int64)
                    for k in range(size):
                        least = np.minimum.reduceat(value * factor[k] + shift[k], at)
                        signature[:, k] = (mix(least) & U64(0xFFFF)).astype(np.uint16)
                packed = np.full(words.n_docs, None, dtype=object)
                packed[full] = [x.tobytes() for x in signature]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(row, end - row) for c in kept], pa.array(count.astype(np.int64)), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)), pa.array(list(packed), pa.binary())],
                    names=[*kept, "n_shingles", "set_a", "set_b", "signature"],
                )

    return rows


def _index_keys(layout: tuple[int, int, int]):
    chunks, width, errors = layout
    masks = [[i for i in range(width) if i not in blank] for blank in combinations(range(width), errors)]
    weight = np.random.default_rng(11).integers(0, 1 << 63, (chunks, len(masks), width), dtype=U64) * U64(2) + U64(1)
    keys = chunks * len(masks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, chunks, width).astype(U64) + U64(1)
            out = np.empty((batch.num_rows, keys), dtype=np.int64)
            for c in range(chunks):
                for m, kept in enumerate(masks):
                    total = np.full(batch.num_rows, c * len(masks) + m, dtype=U64)
                    for i in kept:
                        total = mix(total * U64(0x9E3779B97F4A7C15) + s[:, c, i] * weight[c, m, i])
                    out[:, c * len(masks) + m] = total.view(np.int64)
            ids = np.repeat(np.asarray(batch.column("node")), keys)
            for a in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)[a : a + 100_000]), pa.array(ids[a : a + 100_000])], names=["key", "node"])

    return rows


def _set_keys(value: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of items, two sums of their hashes) of each document: equal sets have equal ones."""
    count = np.bincount(owner, minlength=n_docs)
    full = np.flatnonzero(count)
    sums = [np.zeros(n_docs, U64) for _ in range(2)]
    if len(full):
        at = np.r_[0, np.cumsum(count[full])[:-1]].astype(np.int64)
        sums[0][full] = np.add.reduceat(mix(value), at)
        sums[1][full] = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), at)
    return count, *sums


def _set_rows(n: int):
    """(node, items) of the rows whose text has the node's set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("set_a").to_numpy(zero_copy_only=False)
            for row, end, words, h in _lower_word_hashes(batch):
                value, owner = _shingle_sets(words, h, n)
                at = np.searchsorted(owner, np.arange(words.n_docs + 1)) * 8
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), words.n_docs, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(value.tobytes())])
                own = pa.array(_set_keys(value, owner, words.n_docs)[1].view(np.int64) == wanted[row:end])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, end - row), raw.cast(pa.binary())], names=["node", "items"]).filter(own)

    return rows


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection, and of both sets."""
    for batch in batches:
        out = np.zeros((3, batch.num_rows), dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column("items"), batch.column("hub_items"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            out[:, i] = np.count_nonzero(both[1:] == both[:-1]), len(a), len(b)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), *map(pa.array, out)], names=["node", "hub", "common", "size", "hub_size"])


def _centre_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hub, items) in the order of hub: the items of two members or more, how many hold each, and the number of members."""
    held: list[np.ndarray] = []
    hub = None
    schema = pa.schema([("hub", pa.int64()), ("members", pa.int64()), ("known", pa.binary()), ("counts", pa.binary())])

    def centre() -> tuple:
        items, count = np.unique(np.concatenate(held), return_counts=True)
        several = count >= min(2, len(held))
        return hub, len(held), items[several].tobytes(), count[several].astype(np.uint8).tobytes()

    for batch in batches:
        found = []
        for x, items in zip(batch.column("hub").to_pylist(), batch.column("items"), strict=True):
            if x != hub and held:
                found.append(centre())
                held = []
            hub = x
            held.append(np.frombuffer(items.as_buffer(), U64))
        held = [x.copy() for x in held]  # not a view of the batch
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(centre(), schema.types, strict=True)], schema=schema)


def _outside_items(percent: int):
    """Of each member a row without item, and its first items outside of the centre: as many as similar sets may lack, and one.

    inside: items in the centre. ahead: items outside from this one on, in the group's
    order. short: whether the item is among as many as the smaller of two similar sets
    may lack, and one.
    """
    same = ("hub", "node", "root", "hub_root")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, inside, ahead, short = [], [], [], [], []
            for x, known, counts, members in zip(batch.column("items"), batch.column("known"), batch.column("counts"), batch.column("members").to_pylist(), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(known.as_buffer(), U64)
                held = np.zeros(len(a), dtype=np.int64)
                if len(b):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    held = np.where(b[at] == a, np.frombuffer(counts.as_buffer(), np.uint8)[at], 0).astype(np.int64)
                out = 2 * held <= members
                outside = a[out][np.argsort(held[out], kind="stable")]  # a is in the order of the hashes
                n = len(a)
                first = outside[: n - -(-percent * n // 100) + 1]
                items.append(first)
                sizes.append(n)
                inside.append(n - len(outside))
                ahead.append(len(outside) - np.arange(len(first)))
                short.append(np.arange(len(first)) < n - -(-2 * percent * n // (100 + percent)) + 1)
            count = np.array([len(x) for x in items], dtype=np.int64)
            n = len(count)
            found = np.concatenate([np.zeros(0, U64), *items]).view(np.int64)
            repeat = np.r_[np.arange(n), np.repeat(np.arange(n), count)]
            none = np.r_[np.ones(n, bool), np.zeros(len(found), bool)]
            columns = {
                "item": pa.array(np.r_[np.zeros(n, np.int64), found], mask=none),
                **{c: pa.array(np.asarray(batch.column(c))[repeat]) for c in same},
                "size": pa.array(np.array(sizes, np.int64)[repeat]),
                "inside": pa.array(np.array(inside, np.int64)[repeat]),
                "ahead": pa.array(np.concatenate([np.zeros(n, np.int64), *ahead]).astype(np.int64)),
                "short": pa.array(np.concatenate([np.zeros(n, bool), *short])),
            }
            table = pa.RecordBatch.from_pydict(columns)
            for a in range(0, len(repeat), 100_000):
                yield table.slice(a, 100_000)

    return rows


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Alternates two steps until nothing changes: each node passes the least neighbour
    to its larger neighbours, then to its smaller ones. A node's neighbours are never
    gathered; only minima are aggregated. Every round is written to the shared folder.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"), "a", "m")
        links = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (node, hub) with the sizes of both sets and of their intersection."""
    hubs = sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items"))
    joined = pairs.select("node", "hub").join(sets, "node").join(hubs, "hub")
    return joined.mapInArrow(_overlap, "node long, hub long, common long, size long, hub_size long")


def _first_pairs(single: DataFrame, layout: tuple[int, int, int]) -> DataFrame:
    """(node, hub): every member of a key's bucket with the bucket's hub."""
    keys = single.mapInArrow(_index_keys(layout), "key long, node long")
    # Tables that are joined with what they were counted from are written first: Spark then can split a hot key's join partition.
    several = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    grouped = written(keys.join(several, "key"), "candidates")
    shares = grouped.groupBy("node").agg(F.sum("n").alias("shares"))
    ranked = written(grouped.join(shares, "node").select("key", "node", "shares"), "ranked")
    hubs = written(ranked.groupBy("key").agg((-F.max(F.struct("shares", (-F.col("node")).alias("minus")))["minus"]).alias("hub")), "hubs")
    return written(ranked.join(hubs, "key").where("node <> hub").select("node", "hub").distinct(), "pairs")


def _open_members(compared: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the groups with members outside of their hub's component: what _outside_items gives of each member."""
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    placed = compared.select("node", "hub").join(roots, "node", "left").join(hub_roots, "hub", "left")
    placed = written(placed.select("node", "hub", F.coalesce("root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root")), "placed")
    left_open = written(placed.where("root <> hub_root").select("hub").distinct(), "open")
    rest = placed.join(left_open, "hub", "left_semi")
    # A few members of each group, dealt by hash: one of each remainder.
    some = rest.groupBy("hub", F.pmod(F.xxhash64("node"), F.lit(_SAMPLE)).alias("part")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("x"))
    some = some.select("hub", F.col("x.node").alias("node")).unionByName(left_open.select("hub", F.col("hub").alias("node")))
    centres = some.join(sets, "node").select("hub", "items").repartition("hub").sortWithinPartitions("hub").mapInArrow(_centre_rows, "hub long, members long, known binary, counts binary")
    with_sets = rest.join(sets, "node").join(written(centres, "centres"), "hub")
    schema = "item long, hub long, node long, root long, hub_root long, size long, inside long, ahead long, short boolean"
    return written(with_sets.mapInArrow(_outside_items(percent), schema), "items")


def _meeting_pairs(members: DataFrame, percent: int, split: int | None) -> tuple[DataFrame, DataFrame | None]:
    """((node, hub) of the pairs that meet in an item outside, (node, hub) of what larger meetings elected)."""
    items = members.where("item IS NOT NULL")
    met = items.groupBy("hub", "item").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("z"), F.max(F.struct("inside", (-F.col("node")).alias("minus"))).alias("best")).where("a < z")
    met = written(met.select("hub", "item", "n", (-F.col("best.minus")).alias("next")), "met")
    elected = None
    if split is not None:
        large = met.where(F.col("n") > split)
        if not large.isEmpty():
            elected = items.join(large.select("hub", "item", "next"), ["hub", "item"]).where("node <> next").select("node", F.col("next").alias("hub")).distinct()
            met = met.where(F.col("n") <= split)
    meeting = written(items.join(met.select("hub", "item"), ["hub", "item"]), "meeting")
    small = meeting.where("short").select("hub", "item", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "inside", "ahead")])
    pairs = meeting.join(small, ["hub", "item"]).where(
        f"(x_size < size OR x_size = size AND x_node < node) AND root <> x_root AND 100 * x_size >= {percent} * size "
        f"AND (least(inside, x_inside) + least(ahead, x_ahead)) * {100 + percent} >= {percent} * (size + x_size)"
    )
    return pairs.select("node", F.col("x_node").alias("hub")), elected


def _inside_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(node, hub) of the pairs that have nothing outside in common, but perhaps enough inside.

    Inside of w items, a set of size n can be similar to sets of up to ``reach`` = w *
    (100 + percent) / percent - n items. Sizes are put in classes of about half of one per
    cent, and a set looks only into those that its reach and theirs allow.
    """
    grade = F.when(F.col("size") < 200, F.col("size")).otherwise(F.floor(F.log(F.col("size") / 200) * 200) + 200)
    able = members.where(f"item IS NULL AND 100 * inside >= {percent} * size")
    able = able.select("hub", "node", "root", "hub_root", "size", grade.cast("long").alias("grade"), F.expr(f"inside * {100 + percent} div {percent} - size").alias("reach"))
    able = written(able, "able")
    grades = able.groupBy("hub", "grade").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("most"), F.min("root").alias("a"), F.max("root").alias("z"))
    x = able.where("root <> hub_root").select("hub", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "reach")])
    fit = x.join(grades, "hub").where(f"low <= x_reach AND most >= x_size AND 100 * high >= {percent} * x_size AND 100 * x_size >= {percent} * low AND (a <> x_root OR z <> x_root)")
    pairs = fit.select("hub", "grade", "x_node", "x_root", "x_size", "x_reach").join(able, ["hub", "grade"]).where("node <> x_node AND root <> x_root AND size <= x_reach AND x_size <= reach")
    return pairs.select(F.greatest("node", "x_node").alias("node"), F.least("node", "x_node").alias("hub"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, width: int = 7, errors: int = 1, keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept; with ``keyed`` also text_key, the xxhash64 of the text.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets
    of ``shingle``-word shingles (A-Z lower-cased; a shorter text is one shingle).
    component_id is the least doc_id that a document reaches over links, kept tells
    whether that is its own.

    A null or wordless text has an empty set, is linked with nothing and kept. An
    empty table gives an empty one. A null doc_id is left out of all comparisons: its
    component_id is null and it is kept. Rows of equal doc_id with different texts are
    documents of their own that share a name: each is compared, and each row has the
    component of its own text. Other columns of docs play no part.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    layout = index_layout(percent, width, errors)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["text_key"] if keyed else []
    rows = texts.withColumn("text_key", F.xxhash64("text")) if keyed else texts
    known = written(rows.mapInArrow(_signatures(shingle, layout), f"doc_id long, {'text_key long, ' if keyed else ''}n_shingles long, set_a long, set_b long, signature binary"), "signatures")
    full = known.where("doc_id IS NOT NULL AND n_shingles > 0")

    # A node is a distinct set, and goes by the least doc_id that has it, or by a hash where that id has several sets.
    one = ["set_a", "set_b", "n_shingles"]
    nodes = written(full.groupBy(*one).agg(F.min("doc_id").alias("one"), F.first("signature").alias("signature")), "nodes")
    namesakes = written(nodes.groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one", F.lit(True).alias("several")), "namesakes")
    distinct_names = namesakes.isEmpty()
    if distinct_names:
        nodes = nodes.withColumn("node", F.col("one"))
    else:
        nodes = nodes.join(namesakes, "one", "left").withColumn("node", F.when(F.col("several"), F.xxhash64(*one)).otherwise(F.col("one")))
    release(docs)

    pairs = _first_pairs(nodes.select("node", "signature"), layout)
    wanted = written(pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct(), "wanted")
    few = wanted.count() <= MOST_BROADCAST
    named = nodes.select("node", F.col("one").alias("doc_id"), "set_a").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    named = F.broadcast(written(named, "named")) if few else named  # else the texts are shuffled
    sets = written(texts.join(named, "doc_id").mapInArrow(_set_rows(shingle), "node long, items binary").dropDuplicates(["node"]), "sets")
    release(docs)

    similar = F.expr(f"100 * common >= {percent} * (size + hub_size - common)")
    edges, second = [], []
    roots = None
    for level in range(_LEVELS):
        compared = written(_compared(pairs, sets), "compared")
        edges.append(compared.where(similar).select(F.col("node").alias("a"), F.col("hub").alias("b")))
        roots = components(reduce(DataFrame.unionByName, edges))
        release(docs)
        members = _open_members(compared, roots, sets, percent)
        met, elected = _meeting_pairs(members, percent, _SPLIT if level < _LEVELS - 1 else None)
        second += [met, _inside_pairs(members, percent)]
        if elected is None:
            break
        pairs = written(elected, "elected")
    second = written(reduce(DataFrame.unionByName, second).distinct(), "pairs")
    late = written(_compared(second, sets).where(similar).select(F.col("node").alias("a"), F.col("hub").alias("b")), "linked")
    release(docs)
    found = roots if late.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    classes = nodes.select(*one, "one", "node").join(found, "node", "left").select(*one, "one", F.coalesce("root", "node").alias("root"))
    if distinct_names:
        classes = classes.drop("one")
    else:
        classes = written(classes, "classes")
        classes = classes.drop("one").join(classes.groupBy("root").agg(F.min("one").alias("least")), "root").drop("root").withColumnRenamed("least", "root")
    out = known.drop("signature").join(classes, one, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"), *key)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
