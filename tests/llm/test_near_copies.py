import random
import tracemalloc

import numpy as np
import pytest
from helpers import docs, empty_docs, odd_docs, words
from test_simhash import plain_fingerprint

import corpus_pipeline
from backleaf.llm import common, near_copies, simhash


def plain_set(text, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_keepers(rows):
    """rows: (id, text), ids distinct -> the smallest id of each class, by all pairs."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids[: ids.index(a)]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sorted({find(i) for i in ids})


def edited(seed):
    """Originals with copies of zero to eight changed words, beside a passage many texts share."""
    rng, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for d in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 60, 120, 300]))] + (passage if d % 2 else [])
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randrange(9) if k else 0):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append((len(out), " ".join(copy)))
    return out


def test_stage_keeps_one_of_each_class_of_similar_texts(spark):
    rows = edited(5)
    want = plain_keepers(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect())
    assert got == want and len(want) < len(rows)


def test_copy_beyond_three_bits_goes(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copy = [*base[:50], "x", *base[51:100], "z", *base[101:120], "y", *base[121:]]
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    assert (plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).bit_count() > 3
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()] == [1]


@pytest.mark.parametrize("bounds", [{"most_sets": 7}, {"most_sets": 2}, {"most_shingles": 500}])
def test_blocks_find_the_same(spark, bounds):
    rows = edited(6)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(spark, rows), **bounds).collect()) == plain_keepers(rows)


def test_shard_search_equals_all_pairs():
    sets = [near_copies.shingles(t) for _, t in edited(7) if t]
    codes = np.array([simhash.majority(x.view(np.uint64)) for x in sets], np.uint64)
    order = np.argsort(codes, kind="stable")
    codes, sets = codes[order], [sets[i] for i in order]
    want = list(range(len(sets)))
    for u in range(len(sets)):
        for v in range(u):
            both = len(np.intersect1d(sets[u], sets[v]))
            if (int(codes[u]) ^ int(codes[v])).bit_count() <= 22 and 9 * both >= 4 * (len(sets[u]) + len(sets[v])):
                a, b = sorted((want[u], want[v]))
                want = [a if x == b else x for x in want]
    assert near_copies.linked(codes, sets, 22, at_once=16).tolist() == want


def test_shard_search_holds_a_few_copies_of_its_sets():
    """200 near copies of 4,000 shingles: at most 40 bytes a shingle beside the sets, and the links of all."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 4000, dtype=np.int64)
    sets = [np.unique(np.r_[base[rng.random(4000) > 0.02], rng.integers(-(2**63), 2**63, 80, dtype=np.int64)]) for _ in range(200)]
    codes = np.array([simhash.majority(x.view(np.uint64)) for x in sets], np.uint64)
    order = np.argsort(codes, kind="stable")
    codes, sets = codes[order], [sets[i] for i in order]
    tracemalloc.start()
    got = near_copies.linked(codes, sets, 22)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not got.any() and peak <= 40 * sum(map(len, sets)), peak / sum(map(len, sets))


def test_python_gets_small_batches_within(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([max(x.num_rows for x in common.parts([b]))])], names=["n", "part"])

    df = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 4000) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with common.small_batches(spark):
        within = df.mapInArrow(sizes, "n long, part long").collect()
    assert sum(r.n for r in within) == 3000 and max(r.n for r in within) <= 600 and max(r.part for r in within) <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_stages_bound_the_batches_of_results_that_run_later(spark):
    key, df = "spark.sql.execution.arrow.maxBytesPerBatch", docs(spark, [(1, "a b c")])
    before = spark.conf.get(key, None)
    try:
        for set_before, after in ((None, str(2 << 20)), ("3000000", "3000000")):
            spark.conf.unset(key) if set_before is None else spark.conf.set(key, set_before)
            corpus_pipeline.pack_sequences(spark, df, "")
            assert spark.conf.get(key) == after
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_similar_sets_share_keys_and_bits():
    """Of 2,000 pairs at a similarity of just 0.8, all share a key and lie within the radius."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = 9 * int(rng.integers(6, 60))
        x = rng.integers(-(2**63), 2**63, n + n // 9, dtype=np.int64)
        a, b = np.sort(x[:n]), np.sort(x[n // 9 :])
        assert 9 * len(np.intersect1d(a, b)) == 4 * (len(a) + len(b))
        assert (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
        assert (simhash.majority(a.view(np.uint64)) ^ simhash.majority(b.view(np.uint64))).bit_count() <= 22


def test_rows_alike_in_id_and_text(spark):
    rows = [(1, "same text", x, "s", 9) for x in "abc"] + [(2, "same text", "d", "s", 9)]
    once, again = (near_copies.keep_one(docs(spark, r)).collect() for r in (rows, rows[::-1]))
    assert len(once) == 1 and once == again and once[0].doc_id == 1


def test_stage_on_the_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == plain_keepers([(r.doc_id, r.text) for r in df.collect()])


def test_odd_and_no_rows(spark):
    got = [r.doc_id for r in near_copies.keep_one(odd_docs(spark)).collect()]
    assert len(got) == len(set(got)) and 0 in got and 1 not in got and None in got
    assert near_copies.keep_one(empty_docs(spark)).count() == 0
