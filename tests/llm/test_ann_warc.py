import hashlib
import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from backleaf.llm import ann, queries, warc

# --- nearest neighbours


def vectors_df(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def by_force(rows, every=20, k=20):
    x = {i: np.array(v, "f4").astype(float) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            order = sorted((-float(x[q] @ x[i]), i) for i in x if i != q)
            out[q] = [i for _, i in order[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', sf)}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = answers(ann.search(df, shard_rows=700)), by_force(rows)
    assert got.keys() == want.keys() and all([r for r, _, _ in g] == list(range(1, 21)) for g in got.values())
    assert np.mean([len({i for _, i, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    x = dict(rows)
    for q, found in got.items():
        assert all(s == pytest.approx(float(np.dot(np.float64(x[q]), np.float64(x[i]))), abs=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))


def test_within_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 400, dtype=np.uint64) & np.uint64(0x0F0F0F0F0F0F0F0F)
    shard = ann.Shard(codes)
    for radius in (0, 3, 7, 8, 20, 64):
        want = [i for i, c in enumerate(codes) if (int(c) ^ int(codes[7])).bit_count() <= radius]
        assert shard.within(codes[7], radius).tolist() == want


@pytest.mark.parametrize("n", [1, 2, 15, 21, 22])
def test_few_rows_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=5) * (1 + i)).tolist()) for i in range(n)]
    got = {q: [i for _, i, _ in f] for q, f in answers(ann.search(vectors_df(spark, rows))).items()}
    assert got == {q: f for q, f in by_force(rows).items() if f}


def test_equal_vectors_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    good = [(i, a) for i in range(100, 200)] + [(i, b) for i in range(30)] + [(i, rng.normal(size=8).tolist()) for i in range(300, 330)]
    bad = [(500, None), (520, []), (540, [0.0] * 8), (560, [1.0] * 7 + [float("nan")]), (580, [1.0] * 7 + [float("inf")]), (600, [1.0] * 7 + [None]), (620, [1.0] * 9), (None, a)]
    df = vectors_df(spark, good + bad + good[:3]).withColumn("score", F.lit(1))
    got = {q: [i for _, i, _ in f] for q, f in answers(ann.search(df)).items()}
    want = by_force(good)
    assert got.keys() == want.keys()
    # 100 copies of a query's own vector: the smallest 20 other ids.
    assert got[100] == list(range(101, 121)) and got[140] == list(range(100, 120)) == want[140]
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20))


def test_overflowing_products_and_widths(spark):
    """Products of components near 1e200 overflow: infinite scores first, no numbers last, no error; width chooses the vectors."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [1e200, -1e200]), (3, [1.0, 0.0]), (4, [-1e200, -1e200]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.search(df))[0]
    assert [i for _, i, _ in got] == [1, 3, 2, 4] and got[0][2] == float("inf") and got[1][2] == 1e200
    assert ann.search(df, width=3).count() == 0 and ann.search(df.withColumn("vec_id", F.col("vec_id") * 20), width=3).count() == 0


def test_queries_with_too_few_within_their_radius_are_searched_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(100)]
    monkeypatch.setattr(ann.Reach, "radius", lambda self, q: np.zeros(len(q), int))
    got = {q: [i for _, i, _ in f] for q, f in answers(ann.search(vectors_df(spark, rows), shard_rows=30)).items()}
    assert got == by_force(rows)


def test_work_falls_as_rows_grow():
    """Vectors around 200 centres: the share of rows that the tables touch, and that floats rank, at a recall of 0.95 or more."""
    rng = np.random.default_rng(1)
    centres, shares = rng.normal(size=(200, 32)), []
    for n in (2000, 20_000):
        x = centres[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 32))
        codes = ann.Codes(x[:1000], float(np.linalg.norm(x, axis=1).max()))
        reach, shard = ann.Reach(codes, x[:1000], n, 20, 0.95), ann.Shard(codes.of_rows(x))
        touched, ranked, found = 0, 0, 0
        asked = np.arange(0, n, n // 100)
        for i, code, radius in zip(asked, codes.of_queries(x[asked]), reach.radius(x[asked])):
            touched += len(shard.touched(code, int(radius)))
            near = shard.within(code, int(radius))
            ranked += len(near)
            products = x @ x[i]
            products[i] = -np.inf
            found += len(set(np.argsort(-products)[:20]) & set(near.tolist()))
        shares.append((touched / n / len(asked), ranked / n / len(asked)))
        assert found >= 0.95 * 20 * len(asked)
    assert shares[1][0] < 0.6 * shares[0][0] and shares[1][1] < 0.3 * shares[0][1]


def test_registered_query_recall(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = answers(queries.QUERIES["op6_nearest_neighbours"](spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = by_force(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.95


def test_no_vectors(spark):
    assert ann.search(vectors_df(spark, [])).count() == 0
    assert ann.search(vectors_df(spark, [(0, None), (20, [0.0])])).count() == 0


# --- archives


BIG = "<html>" + "row of a page, " * 100 + "</html>"


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def plain_pages(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        keeper = max(ids, default=None)
        revisit = len(raw) >= 1000 and keeper is not None and i != keeper
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(map(str, out))


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(i, f"http://h/{i}", BIG if i % 3 else BIG + str(i)) for i in range(40)]
    rows += [(50, None, None), (51, "a\r\nX-Page-ID: 7\r\n\r\n☃", ""), (52, "u", "small"), (53, "u", "small"), (None, "u", BIG), (None, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (39, "u", BIG + "39"), (60, "ü", "é" * 500), (61, "ü", "é" * 500), (62, "u", "é" * 499), (63, "u", "é" * 499), (64, "u", BIG * 3000)]
    df = pages_df(spark, rows).withColumn("digest", F.lit(1)).repartition(3)
    archives = warc.write(df, f"file://{tmp_path}/warc", archive_bytes=2000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and archives.count() >= 3
    assert sorted(map(str, map(tuple, warc.read(archives).collect()))) == plain_pages(rows)


def test_no_pages(spark, tmp_path):
    assert warc.read(warc.write(pages_df(spark, []), f"file://{tmp_path}/warc")).count() == 0


def test_an_archive_reads_with_zstandard_alone(spark, sf_dir, tmp_path):
    archives = warc.write(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet"), f"file://{tmp_path}/warc")
    for a in archives.collect():
        data = open(a.path.removeprefix("file://"), "rb").read()
        assert data[:4] == b"\x5d\x2a\x4d\x18"  # the skippable frame's magic
        n = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + n])
        assert dictionary.dict_id() != 0
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        first = one.decompress(data[8 + n :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and first.endswith(b"\r\n\r\n") and one.eof
        assert sum(1 for _ in warc.frames(io.BytesIO(data), 100)) == a.records + 1  # and the archive's own
        assert b"WARC-Type: warcinfo" in first
        for raw in warc.frames(io.BytesIO(data)):
            fields, block = raw.split(b"\r\n\r\n", 1)
            own = dict(x.split(b": ", 1) for x in fields.split(b"\r\n")[1:])
            assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= own.keys() and (b"WARC-Target-URI" in own or own[b"WARC-Type"] == b"warcinfo")
            assert own[b"WARC-Block-Digest"].decode() == warc.sha1_field(hashlib.sha1(block[: int(own[b"Content-Length"])]).digest())


def test_broken_archives_are_errors():
    frame = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, False, "d", ""))
    assert [warc.parsed(x) for x in warc.frames(io.BytesIO(frame * 2))] == [(1, 4, hashlib.sha1(b"body").hexdigest(), "response", None)] * 2
    with pytest.raises(ValueError, match="ends within"):
        list(warc.frames(io.BytesIO(frame[:-3])))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.frames(io.BytesIO(b"\x5d\x2a\x4d\x18\xff\x00\x00\x00abc")))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(warc.record(1, "u", b"body", hashlib.sha1(b"other").hexdigest(), None, False, "d", ""))
