"""The trie of conversations against one built in plain Python, and its edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelwright.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = prefixtrie.COLUMNS


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """Sorted rows of the trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children.get(p, []))
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items())


def found(df):
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def made_up(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "b c", "d  e\tf", "", "é ü"]
    rows = []
    for c in range(0, n):
        if c % 7 == 3:
            turns = [("user", "hot turn"), ("assistant", "a b"), ("user", "c")]  # one common conversation
        else:
            turns = [("user", "hot turn")] * (r.random() < 0.5) + [(r.choice(["user", "assistant", None]), r.choice(vocabulary + [None])) for _ in range(r.randint(0 if c % 20 else 1, 6))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "limit"), [(1, 150, 2), (2, 150, 16), (3, 80, 1), (4, 60, 10**6)])
def test_trie_against_plain_python(spark, seed, n, limit):
    rows = made_up(seed, n)
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), least_limit=limit, most_limit=limit)
    assert found(got) == plain(rows)


def test_trie_edges(spark):
    long_ = [(41, k, "user", f"t{k % 3}") for k in range(600)]
    odd = [(None, 0, "user", "lost"), (1, None, "user", "no number"), (1, 0, None, None), (1, 0, None, None), (23, 1, "u", "x"), (-7, 0, "u", "y"), (5, 0, "", ""), (40, 0, "u", "x " * 50_000), (70_000, 0, "u", "far"), (140_000, 0, "u", "far"), *long_]
    frame = spark.createDataFrame(odd, SCHEMA)
    for limit in (1, 16):
        got = prefixtrie.prefix_trie(frame.selectExpr("*", "1 AS depth", "2 AS node", "3 AS weight"), least_limit=limit, most_limit=limit)
        assert got.columns == COLUMNS and found(got) == plain([(c, t, r, x) for c, t, r, x in odd])
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ends_are_hashed_in_order_over_blocks(spark):
    ids = [5, 70_000, 3, 140_001, 70_001, 12]
    frame = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 9)], "node binary, conv_id long").repartition(3)
    got = {bytes(r.node): r.ends for r in prefixtrie.end_hashes(frame).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"b": hashlib.sha256(b"9").hexdigest()}


def test_louds_of_a_small_forest():
    # Roots A, B; A has children C, D; C has a child E.
    rows = [(1, 0, 0), (2, 0, 2), (3, 0, 4), (1, 1, 0), (2, 1, 3), (1, 2, 1)]
    level, sequence, label = (np.array(x) for x in zip(*rows, strict=True))
    tree = prefixtrie.Louds(level, sequence, label)
    assert tree.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert tree.parents().tolist() == [0, 0, 1, 1, 3] and tree.children().tolist() == [2, 2, 0, 1, 0, 0]
    assert tree.rolled_up((tree.children() == 0).astype(int)).tolist() == [3, 2, 1, 1, 1, 1]
    assert tree.row_node.tolist() == [1, 3, 5, 1, 4, 2]
