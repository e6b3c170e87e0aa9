import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import LONG, docs, empty_docs, odd_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from backleaf.llm import simhash
from backleaf.llm.graph import components


def plain_fingerprint(text, width=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows, radius=3):
    """rows: (key, id, fingerprint) -> smallest id reachable, by key."""
    root = {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _, f) in enumerate(rows):
        for b, _, g in rows[:i]:
            if (f ^ g).bit_count() <= radius:
                root[find(a)] = find(b)
    groups = {}
    for k, i, _ in rows:
        groups.setdefault(find(k), []).append(i)
    return {k: min((x for x in groups[find(k)] if x is not None), default=None) for k, _, _ in rows}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAZ \n\té ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_odd_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint(LONG) == plain_fingerprint(LONG)


@pytest.mark.parametrize("radius", [0, 1, 3, 8])
def test_tree_finds_all_and_only_near_codes(radius):
    rng = np.random.default_rng(radius)
    codes = np.unique(rng.integers(0, 2**12, 500, dtype=np.uint64) * np.uint64(0x1001001001))
    queries = np.r_[codes[:50], rng.integers(0, 2**63, 20, dtype=np.uint64)]
    q, v = simhash.BKTree(codes).within(queries, radius)
    want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(codes) if (int(a) ^ int(b)).bit_count() <= radius}
    assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)


def test_tree_of_few():
    for n in (0, 1, 2):
        q, v = simhash.BKTree(np.arange(n, dtype=np.uint64)).within(np.arange(2, dtype=np.uint64), 3)
        assert len(q) == 2 * n


@pytest.mark.parametrize("more", [{}, {"tree_size": 16, "most": 20}, {"tree_size": 1, "most": 10**9}, {"tree_size": 16, "most": 12, "levels": 1}])
def test_links_of_dense_groups(spark, more):
    rng = random.Random(1)
    codes = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            codes.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    codes |= {rng.getrandbits(64) for _ in range(200)}
    signed = [x - 2**64 if x >> 63 else x for x in sorted(codes)]
    links = simhash.near_links(spark.createDataFrame(pd.DataFrame({"fp": signed})), 3, **more)
    pairs = links.toPandas()
    assert len(pairs) <= 4 * 4 ** more.get("levels", 2) * len(codes)  # one for each code and shard, four shards a deal
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_classes([(x, x, x & (2**64 - 1)) for x in signed])
    assert {x: got.get(x, x) for x in signed} == want


def test_classes_of_odd_rows(spark):
    near = " ".join(f"word{i}" for i in range(400))
    df = docs(spark, [(100, near), (101, near + " more"), (102, near.upper()), (99, "other words " * 30), (None, near)]).unionByName(odd_docs(spark))
    rows = df.collect()
    want = plain_classes([(k, r.doc_id, plain_fingerprint(r.text)) for k, r in enumerate(rows)])
    expected = sorted((str(r.doc_id), plain_fingerprint(r.text), str(want[k])) for k, r in enumerate(rows))
    got = simhash.duplicate_classes(df).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == expected
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(set(map(str, want.values())))


def test_no_rows_and_clashing_names(spark):
    assert simhash.duplicate_classes(empty_docs(spark)).count() == 0
    df = odd_docs(spark).withColumnRenamed("lang", "keep_id").withColumnRenamed("source", "keep_hash")
    assert simhash.keep_one(df).columns == df.columns


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (8, 7), (3, 7)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
