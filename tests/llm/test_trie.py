"""The prefix trie against a dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from estatum.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows, by whole prefixes."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, size = collections.defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        size[c] = len(seq)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if size[c] == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def made(seed, convs, most, words=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        n = rng.choice([1, 2, 3, most])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é" * 3][:words])) for t in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shard", [(4096, 3), (5, 7)])
def test_against_prefixes(spark, segment, shard):
    rows = made(1, [*range(0, 12), *range(95, 125), 200, 301, -7, -100, -103], 23)
    rows += [(5, None, "user", "first"), (5, 3, None, None), (5, 3, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", part string").repartition(5)
    assert got(trie.prefix_trie(df, segment, shard)) == brute(rows)


def test_common_conversations(spark):
    """Many copies, a common first turn, and a conversation of a third of all turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(4)] + [(1000 + c, t, "user", "hi" if t == 0 else f"{c} {t}") for c in range(300) for t in range(3)]
    rows += [(700, t, "user", f"long {t % 7}") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(trie.prefix_trie(df, 128, 64)) == got(trie.prefix_trie(df)) == brute(rows)


def test_awkward(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(none).count() == 0 and trie.prefix_trie(none).columns == COLUMNS
    # a conversation whose turns are all another's, which has none: the root alone
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(alone, 0, "user", "x" * 100_000)]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert got(trie.prefix_trie(spark.createDataFrame([*rows, (300, 1, "user", "x" * 100_000)], SCHEMA))) == brute([*rows, (300, 1, "user", "x" * 100_000)])
    with pytest.raises(ValueError):
        trie.prefix_trie(none, 4)


def test_double_array():
    rng = np.random.default_rng(0)
    parent = np.array([0] + [int(rng.integers(0, max(1, i // 3))) for i in range(1, 3000)])
    code = np.zeros(3000, np.int64)
    for p in range(3000):
        kids = np.flatnonzero(parent[1:] == p) + 1
        code[kids] = np.sort(rng.choice(np.arange(1, 5000), len(kids), replace=False))
    base, check, cell = trie.double_array(parent, code)
    assert len(set(cell.tolist())) == 3000 and cell[0] == 0
    assert (base[cell[parent[1:]]] + code[1:] == cell[1:]).all() and (check[cell[1:]] == cell[parent[1:]]).all()


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(trie.op13_trie(spark, folder)) == brute(rows)
