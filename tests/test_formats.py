import hashlib

import pytest
from pyspark.sql import functions as F

from backleaf.functions import codec, hashing, keys
from backleaf.sources import log as logs

H = hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        ("", 0, ""),
        ("0\n", 0, ""),
        ("0\n1\n2\n", 3, "0\n1\n2\n"),
        (f"1 {H} {H}\n", 2, f"1 {H} {H}\n"),
        ("1\n2 fdfxx", 2, "1\n"),
        ("1\n2\n3", 9, "1\n2\n"),
        ("0\n2\n5 xxabcdeadbeef", 3, "0\n2\n"),
    ],
)
def test_wal_recovery(text, size, want):
    assert logs.recovered_wal(text, size) == want


@pytest.mark.parametrize("text", ["1\n2\n3\n\n", "1 zz\n2\n", "1 \n"])
def test_wal_recovery_refuses_broken_rows(text):
    with pytest.raises(ValueError, match="no row"):
        logs.recovered_wal(text, 9)


def test_wal_text_round_trip(spark, tmp_path):
    rows = spark.range(2056).select("id", F.array(F.unhex(F.sha2(F.unhex(F.lpad(F.hex(F.col("id") % 256), 2, "0")), 256))).alias("keys"))
    rows.select(codec.wal_row(F.col("id"), F.col("keys"))).write.text(str(tmp_path / "wal"))
    back = logs.read_wal(spark, str(tmp_path / "wal"))
    assert back.count() == 2056 and back.where("not is_valid").count() == 0
    got = {r.idx: bytes(r["keys"][0]) for r in back.collect()}
    assert got == {i: hashlib.sha256(bytes([i % 256])).digest() for i in range(2056)}


def test_wal_rows(spark):
    lines = ["1", f"1 {H} {H.upper()}", "1 deadbeef feed01xxx", "", "1 ", " 1", "-1", "9223372036854775807", "9223372036854775808", f"1  {H}"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [(r.i, None if r.k is None else len(r.k)) for r in df.select(codec.wal_position(F.col("line")).alias("i"), codec.wal_keys(F.col("line")).alias("k")).collect()]
    assert got == [(1, 0), (1, 2), (None, None), (None, None), (None, None), (None, None), (None, None), (2**63 - 1, 0), (None, None), (None, None)]


def test_checkpoints(spark):
    good = codec.format_checkpoint("log", 4, bytes(32), "\nsigned\n")
    cp = codec.parse_checkpoint(good)
    assert (cp.origin, cp.size, cp.root, cp.raw) == ("log", 4, bytes(32), good)
    for bad in (b"log\n4\nAAAA", b"log\nx\nAAAA\n", b"log\n4\n%%\n", b"log\n-1\nAAAA\n", b"log\n9223372036854775808\nAAAA\n"):
        with pytest.raises(ValueError):
            codec.parse_checkpoint(bad)
        df = spark.createDataFrame([(bad.decode(),)], "t string")
        assert df.select(codec.checkpoint_fields(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("text", [None, "", "abc", "zz", "ab" * 31, "ab" * 33])
def test_bad_keys_are_refused(text):
    with pytest.raises(ValueError):
        codec.parse_key(text)


def test_value_digest(spark):
    got = spark.range(1).select(hashing.value_digest(F.array(F.lit(0).cast("long"), F.lit(3).cast("long")))).first()[0]
    assert bytes(got) == hashlib.sha256((0).to_bytes(8) + (3).to_bytes(8)).digest()
    assert bytes(got).hex().startswith("8b1ae42f") and bytes(got).hex().endswith("4c9c")


def test_lookup_json(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<bigint>")
    got = [r[0] for r in df.select(codec.lookup_json_column(F.col("a"))).collect()]
    assert got == [codec.lookup_json(x).replace(" ", "") for x in ([1, 2], [], None)]


def test_failing_mapping_names_the_leaf(spark):
    df = spark.createDataFrame([(0, "foo: 2"), (1, "bar")], "idx long, leaf string")
    with pytest.raises(Exception, match="mapping index 1"):
        df.select(keys.before(F.col("leaf"), F.col("idx"))).collect()
    with pytest.raises(Exception, match="mapping index 1"):
        df.select(keys.json_field(F.when(F.col("idx") == 0, "{}").otherwise("[1"), F.col("idx"), "m")).collect()


def test_missing_json_field_is_the_empty_string(spark):
    got = spark.range(1).select(keys.json_field(F.lit('{"Module": "a"}'), F.col("id"), "module")).first()[0]
    assert [bytes(x) for x in got] == [hashlib.sha256(b"").digest()]


def test_python_mapping(spark):
    df = spark.createDataFrame([(b"ab",)], "leaf binary")
    got = df.select(keys.from_python(lambda x: [hashlib.sha256(x[i : i + 1]).digest() for i in range(len(x))], F.col("leaf"))).first()[0]
    assert [bytes(x) for x in got] == [hashlib.sha256(c).digest() for c in (b"a", b"b")]


def test_failing_python_mapping_names_the_leaf(spark):
    df = spark.createDataFrame([(7, b"ab"), (8, b"")], "idx long, leaf binary")
    with pytest.raises(Exception, match="mapping index 8"):
        df.select(keys.from_python(lambda x: [x[:1] * 32] if x else 1 / 0, F.col("leaf"), F.col("idx"))).collect()


@pytest.mark.parametrize("text", [None, "", "abc", "zz", "ab" * 31, "ab" * 33, "ab" * 32])
def test_faults_of_keys_as_a_column(spark, text):
    try:
        want = codec.parse_key(text) and None
    except ValueError as fault:
        want = str(fault)
    assert spark.createDataFrame([(text,)], "t string").select(codec.key_fault(F.col("t"))).first()[0] == want


def test_demo_stream(spark):
    query = logs.demo_stream(spark, per_second=50).writeStream.format("memory").queryName("demo").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.idx: bytes(r.leaf) for r in spark.table("demo").collect()}
    assert got.items() <= {r.idx: bytes(r.leaf) for r in logs.demo(spark, len(got) + 1).rows.collect()}.items()


def test_demo_log(spark):
    log = logs.demo(spark, 50)
    got = log.rows.select("idx", F.from_json(F.col("leaf").cast("string"), logs.ENTRY).alias("e")).select("idx", "e.*").collect()
    assert [r.idx for r in got] == list(range(50)) and {r.module for r in got} == set(logs.MODULES)
    assert all(bytes(r.hash) == hashlib.sha256((r.module + r.version).encode()).digest() for r in got)
    assert [r.idx for r in log.range(10, 12).rows.collect()] == [10, 11]
