"""The stored index: updates, restarts, refusals, publication, streaming and HTTP."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from backleaf import api
from backleaf.functions import codec, keys, notes
from backleaf.operators import merkle
from backleaf.plans.store import IndexStore, RootMismatch
from backleaf.sources import stream
from backleaf.sources.log import LogTable
from backleaf.streaming import ingest

FIXTURE = ["foo: 2", "bar: 5", "bar: 10", "foo: 8"]


def key(name):
    return hashlib.sha256(name.encode()).digest()


def log_of(spark, leaves, start=0):
    rows = [(i + start, x.encode()) for i, x in enumerate(leaves)]
    return LogTable(spark.createDataFrame(rows, "idx long, leaf binary"))


def checkpoint(leaves):
    return codec.format_checkpoint("test", len(leaves), merkle.tree_root([merkle.hash_leaf(x.encode()) for x in leaves]))


def store_of(spark, tmp_path, mapping=keys.before, **more):
    return IndexStore(spark, str(tmp_path / "index"), mapping, **more)


def test_lookups(spark, tmp_path):
    store = store_of(spark, tmp_path)
    with pytest.raises(LookupError, match="not populated"):
        store.lookup(key("foo"))
    assert store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE)) == 4
    assert store.lookup(key("foo")) == ([0, 3], 4)
    assert store.lookup(key("bar")) == ([1, 2], 4)
    assert store.lookup(key("banana")) == (None, 4)
    assert store.lookup(key("foo"), 3) == ([0], 3)
    assert store.lookup(key("bar"), 1) == ([], 1)
    asked = spark.createDataFrame([(key("bar"),), (key("banana"),)], "key binary")
    got = {bytes(r.key): r.idxs for r in store.lookup_many(asked).collect()}
    assert got == {key("bar"): [1, 2], key("banana"): None}


def test_empty_log_stores_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert store.update(log_of(spark, ["x:"]), codec.format_checkpoint("test", 0, merkle.EMPTY_ROOT)) == 0
    assert store.checkpoint() is None and store.manifest()["revisions"] == 0


@pytest.mark.parametrize("steps", [(600,), (1, 600), (255, 256, 257, 600), (300, 599, 600)])
def test_steps_give_the_same_index(spark, tmp_path, steps):
    leaves = [f"{'abcdefg'[i * i % 7]}: {i}" for i in range(600)]
    store = store_of(spark, tmp_path)
    for n in steps:
        store.update(log_of(spark, leaves[:n]), checkpoint(leaves[:n]))
        store = store_of(spark, tmp_path)  # as after a restart
    assert store.index_root().hex() == ROOTS.setdefault("600", store.index_root().hex())
    for c in "abcdefg":
        want = [i for i in range(600) if "abcdefg"[i * i % 7] == c]
        assert store.lookup(key(c)) == (want or None, 600)
    assert store.manifest()["revisions"] == len(steps)


ROOTS: dict[str, str] = {}


def test_refusals_leave_the_manifest_alone(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.update(log_of(spark, FIXTURE[:3]), checkpoint(FIXTURE[:3]))
    before = store.manifest()
    tampered = [*FIXTURE[:3], "foo: 9"]
    with pytest.raises(RootMismatch):
        store.update(log_of(spark, tampered), checkpoint(FIXTURE))
    with pytest.raises(RootMismatch):
        store.update(log_of(spark, FIXTURE[:2]), checkpoint(FIXTURE[:2]))
    with pytest.raises(RootMismatch):
        store.update(log_of(spark, FIXTURE), checkpoint(["foo: 1", *FIXTURE[1:3]]))
    with pytest.raises(ValueError, match="log"):
        store.update(log_of(spark, FIXTURE[:3]), checkpoint(FIXTURE))  # short read
    with pytest.raises(ValueError):
        store.update(log_of(spark, FIXTURE), b"no checkpoint")
    assert store.manifest() == before
    # Leaves beyond the checkpoint are not read.
    assert store.update(log_of(spark, [*FIXTURE, "zap: 1"]), checkpoint(FIXTURE)) == 4
    assert store.lookup(key("zap")) == (None, 4)


def test_failing_mapping_names_the_leaf_and_can_be_repaired(spark, tmp_path):
    leaves = [*FIXTURE, "no mark", "foo: 1"]
    store = store_of(spark, tmp_path)
    with pytest.raises(Exception, match="mapping index 4"):
        store.update(log_of(spark, leaves), checkpoint(leaves))
    assert store.size() == 0
    mended = store_of(spark, tmp_path, lambda leaf, idx: keys.hashed(F.substring_index(leaf.cast("string"), ":", 1)))
    mended.update(log_of(spark, leaves), checkpoint(leaves))
    assert mended.lookup(key("no mark")) == ([4], 6)
    assert mended.lookup(key("foo")) == ([0, 3, 5], 6)


def test_cut_off_update_leaves_no_second_posting(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path)
    monkeypatch.setattr(store, "_commit", lambda m: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError, match="cut off"):
        store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    again = store_of(spark, tmp_path)
    assert again.size() == 0
    again.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    assert again.lookup(key("foo")) == ([0, 3], 4)


def test_revisions(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.update(log_of(spark, FIXTURE[:2]), checkpoint(FIXTURE[:2]))
    store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))  # unchanged, published all the same
    leaves = [store.revision(i) for i in range(3)]
    assert leaves[1] == leaves[2] == codec.revision_leaf(store.index_root(), checkpoint(FIXTURE))
    out = codec.parse_checkpoint(store.output_checkpoint())
    assert (out.size, out.root) == (3, merkle.tree_root([merkle.hash_leaf(x) for x in leaves]))
    with pytest.raises(IndexError):
        store.revision(3)
    quiet = store_of(spark, tmp_path, publish_unchanged=False)
    quiet.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    assert quiet.manifest()["revisions"] == 3


def test_repeated_keys_of_a_leaf_count(spark, tmp_path):
    store = store_of(spark, tmp_path, lambda leaf, idx: keys.words(leaf.cast("string")))
    leaves = ["a b a", "", "b"]
    store.update(log_of(spark, leaves), checkpoint(leaves))
    assert store.lookup(key("a")) == ([0, 0], 3)
    assert store.lookup(key("b")) == ([0, 2], 3)


def test_stream_follows_checkpoints(spark, tmp_path):
    leaves = [f"{'ab'[i % 2]}: {i}" for i in range(1000)]
    folder, store = f"file://{tmp_path}/log", store_of(spark, tmp_path)
    rows = log_of(spark, leaves).rows
    rows.orderBy(F.desc("idx")).repartition(3).write.parquet(f"{folder}/leaves")  # files in no order of positions
    for n in (300, 301, 1000):
        stream.write_checkpoint(folder, n, checkpoint(leaves[:n]))
        ingest.follow(store, folder, f"{tmp_path}/progress").awaitTermination()
        assert store.size() == n
    ingest.follow(store, folder, f"{tmp_path}/other-progress").awaitTermination()  # all of it is known
    assert store.lookup(key("b")) == (list(range(1, 1000, 2)), 1000)
    assert store.manifest()["revisions"] == 3
    assert spark.read.format("backleaf_log").load(folder).count() == 1000


def test_spans():
    cuts = [(s.start, s.end) for s in stream.spans(5, 3 * stream.PART)]
    assert cuts[0] == (5, stream.PART) and cuts[-1][1] == 3 * stream.PART and len(cuts) == 3
    assert stream.spans(7, 7) == []
    files = {"a": (0, 4), "b": (5, 5), "c": (stream.PART, 3 * stream.PART), "d": (0, -1)}
    assert [s.files for s in stream.spans(5, 3 * stream.PART, files)] == [("b",), ("c",), ("c",)]


def test_http(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert api.answer(store, api.PATH + "00" * 32) == (500, "index not populated")
    store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    assert [api.answer(store, api.PATH + x)[0] for x in ("", "zz", "00")] == [400] * 3 and api.answer(store, "/x")[0] == 404
    server = api.serve(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        got = api.fetch(url, "foo")
        assert got == {"output_log_cp": None, "output_log_leaf": None, "output_log_proof": None, "index_key": [0] * 32, "index_value": [0, 3], "index_proof": None}
        assert api.fetch(url, "banana")["index_value"] is None
        with pytest.raises(RuntimeError, match="404"):
            api.fetch(url, "foo", "/elsewhere/")
    finally:
        server.shutdown()


def test_many_updates_keep_few_folders(spark, tmp_path):
    """A lookup that has begun ends after the next update; folders and postings are merged and removed."""
    leaves = [f"{'abcdefg'[i * i % 7]}: {i}" for i in range(120)]
    store, folders = store_of(spark, tmp_path, bucket_bits=2), []
    log = log_of(spark, leaves)
    for n in range(10, 121, 10):
        reading = store.chunks()[0] if n > 10 else None
        store.update(log, checkpoint(leaves[:n]))
        assert reading is None or reading.agg(F.sum(F.size("idxs"))).first()[0] == n - 10
        folders.append({k: len(list((tmp_path / "index" / k).iterdir())) for k in ("postings", "digests", "subtrees")})
    assert max(f["postings"] for f in folders) <= 10 and max(f["digests"] for f in folders) <= 6 and max(f["subtrees"] for f in folders) <= 2
    assert len(store.manifest()["postings"]) <= 5
    for name in "abcdefg":
        want = [i for i, x in enumerate(leaves) if x[0] == name] or None
        assert store.lookup(key(name)) == store.probe(key(name)) == (want, 120)
    once = IndexStore(spark, str(tmp_path / "once"), keys.before)
    once.update(log, checkpoint(leaves))
    assert once.index_root() == store.index_root()


def test_newer_checkpoint_of_the_same_size_is_kept(spark, tmp_path):
    for publish in (True, False):
        store = IndexStore(spark, str(tmp_path / str(publish)), keys.before, publish_unchanged=publish)
        first, second = checkpoint(FIXTURE) + b"\none\n", checkpoint(FIXTURE) + b"\ntwo\n"
        store.update(log_of(spark, FIXTURE), first)
        store.update(log_of(spark, FIXTURE), second)
        assert store.checkpoint() == second
        assert store.manifest()["revisions"] == (2 if publish else 1)


def test_signed_logs(spark, tmp_path):
    own = notes.Signer("test", bytes(range(32)))
    out = notes.Signer("out.example", bytes(32))
    store = store_of(spark, tmp_path, verify=notes.verifying(own.verifier()), signer=out)
    with pytest.raises(notes.BadSignature):
        store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    store.update(log_of(spark, FIXTURE), own.signed(checkpoint(FIXTURE)))
    n, covering = store.appended()
    cp = notes.verifying(out.verifier())(covering)
    assert n == 0 and cp.size == 1 and cp.root == merkle.tree_root([merkle.hash_leaf(store.revision(0))])
    with pytest.raises(RootMismatch, match="other"):
        IndexStore(spark, store.folder, keys.before).update(log_of(spark, FIXTURE), checkpoint(FIXTURE).replace(b"test", b"other", 1))


def test_keys_and_signatures(tmp_path, monkeypatch):
    # The second test of RFC 8032, section 7.1.
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key_text, signature = "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    assert notes.public_key(seed).hex() == key_text and notes.sign(seed, b"\x72").hex() == signature
    assert not notes.is_signed(bytes.fromhex(key_text), b"\x73", bytes.fromhex(signature))
    signer = notes.Signer("a", seed)
    (tmp_path / "key").write_text(f"{signer}\n")
    monkeypatch.setenv("BACKLEAF_TEST_KEY", str(signer))
    assert notes.Signer.parse(notes.load_key(str(tmp_path / "key"))) == notes.Signer.parse(notes.load_key(None, "BACKLEAF_TEST_KEY")) == signer
    for bad in ("", "x", str(signer)[:-4], str(signer.verifier())):
        with pytest.raises(ValueError):
            notes.Signer.parse(bad)
    with pytest.raises(ValueError):
        notes.load_key(None, "BACKLEAF_NO_SUCH_KEY")


def test_failed_updates_are_tried_again(spark, tmp_path, monkeypatch):
    folder, store = f"file://{tmp_path}/log", store_of(spark, tmp_path)
    log_of(spark, FIXTURE).rows.write.parquet(f"{folder}/leaves")
    stream.write_checkpoint(folder, 4, checkpoint(FIXTURE))
    update, left = store.update, [2]

    def flaky(log, raw):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("not now")
        return update(log, raw)

    monkeypatch.setattr(store, "update", flaky)
    ingest.follow(store, folder, f"{tmp_path}/progress", wait_seconds=0).awaitTermination()
    assert store.size() == 4 and left == [-1]


def test_batch_client(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.update(log_of(spark, FIXTURE), checkpoint(FIXTURE))
    server = api.serve(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        names = spark.createDataFrame([("foo",), ("banana",), (None,)], "n string")
        got = {r.name: json.loads(r.body)["index_value"] for r in api.fetch_many(names, f"http://127.0.0.1:{server.server_address[1]}").collect()}
    finally:
        server.shutdown()
    assert got == {"foo": [0, 3], "banana": None}


def test_scan_reads_each_row_group_once_in_small_batches(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, folder = 200_000, f"file://{tmp_path}"
    (tmp_path / "leaves").mkdir()
    order = [i * 7919 % n for i in range(n)]  # in no order of positions
    leaves = [b"%d:" % i * 20 for i in order]
    pq.write_table(pa.table({"idx": pa.array(order, pa.int64()), "leaf": leaves}), tmp_path / "leaves/a.parquet", row_group_size=n // 2)
    parts = stream.LogReader({"path": folder}).partitions()
    assert len(parts) == 1 and not list(stream.scan(folder, parts[0]))  # without a checkpoint, nothing is published
    stream.write_checkpoint(folder, n - 1, b"")
    parts = stream.LogReader({"path": folder}).partitions()
    assert len(parts) == 2
    batches = [b for p in parts for b in stream.scan(folder, p)]
    assert max(b.nbytes for b in batches) < 8 << 20
    got = sorted(zip([i for b in batches for i in b.column("idx").to_pylist()], [x for b in batches for x in b.column("leaf").to_pylist()]))
    assert got == sorted(x for x in zip(order, leaves) if x[0] < n - 1)


def test_digests_bound_their_arrow_batches(spark):
    from backleaf.operators import index

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        index.digests(spark.createDataFrame([(b"k", 0, [1])], "key binary, chunk long, idxs array<long>"))
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
