"""Registered queries of the stored index, its sources, streaming and HTTP, and their SQL oracles."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backleaf import api
from backleaf.functions import codec, keys, notes
from backleaf.functions.hashing import hex_lower
from backleaf.operators import index, merkle
from backleaf.plans.queries import EVENT_LEAVES, event_leaf, registered, root_sql, shown_lists, table
from backleaf.plans.store import IndexStore, RootMismatch
from backleaf.sources import log as logs
from backleaf.sources import scratch, stream
from backleaf.sources.log import LogTable
from backleaf.streaming import ingest

LEAF_SQL = "concat(event_id, ':', event_type)"
#: Where the three updates end, as SQL.
ENDS = ("n // 3", "n // 3 * 2 + 1", "n")


def events_log(spark: SparkSession, sf_dir: str) -> tuple[LogTable, int]:
    rows = table(spark, sf_dir, "events")
    return LogTable(rows.select(F.col("event_id").alias("idx"), event_leaf().cast("binary").alias("leaf"))), rows.count()


def event_keys(leaf, idx):
    """The leaf's event type, and its position's last digit."""
    return keys.hashed(F.substring_index(leaf.cast("string"), ":", -1), idx % 10)


POSTINGS_SQL = "SELECT event_type AS name, event_id AS idx FROM events UNION ALL SELECT (event_id % 10)::VARCHAR, event_id FROM events"


def checkpoints(log: LogTable, ends: list[int]) -> list[bytes]:
    """What the log publishes at each size."""
    leaves, frontier, out = merkle.leaf_hashes(log.rows, F.col("leaf")), merkle.Frontier(), []
    for end in ends:
        frontier = merkle.extend(frontier, leaves.where(F.col("i") < end), end)
        out.append(codec.format_checkpoint("events", end, frontier.root()))
    return out


def updated_store(spark: SparkSession, sf_dir: str) -> tuple[IndexStore, int]:
    """A store that has followed the events in three updates."""
    log, n = events_log(spark, sf_dir)
    store = IndexStore(spark, scratch.new_folder(spark, "store"), event_keys)
    for raw in checkpoints(log, [n // 3, n // 3 * 2 + 1, n]):
        store.update(log, raw)
    return store, n


def all_names(log: LogTable) -> DataFrame:
    return log.rows.select(F.explode(event_keys(F.col("leaf"), F.col("idx"))).alias("key")).distinct()


@registered(f"SELECT sha256(name) AS key_hex, string_agg(idx, ',' ORDER BY idx) AS positions, (SELECT count(*) FROM events) AS size FROM ({POSTINGS_SQL}) GROUP BY name UNION ALL SELECT sha256('banana'), NULL, (SELECT count(*) FROM events)")
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of a store after three updates, and one it lacks."""
    store, _ = updated_store(spark, sf_dir)
    absent = spark.range(1).select(F.explode(keys.hashed(F.lit("banana"))).alias("key"))
    return shown_lists(store.lookup_many(all_names(events_log(spark, sf_dir)[0]).union(absent)))


@registered(f"SELECT sha256(name) AS key_hex, string_agg(idx, ',' ORDER BY idx) FILTER (idx < s) AS positions, s AS size FROM ({POSTINGS_SQL}), (SELECT count(*) // 2 AS s FROM events) GROUP BY name, s")
def store_lookups_at_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a size that no update ended at."""
    store, n = updated_store(spark, sf_dir)
    return shown_lists(store.lookup_many(all_names(events_log(spark, sf_dir)[0]), n // 2))


@registered(f"SELECT sha256(name) AS key_hex, count(*) AS n, sha256(unhex(string_agg(format('{{:016x}}', idx), '' ORDER BY idx))) AS value_digest FROM ({POSTINGS_SQL}) GROUP BY name")
def store_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests that three updates leave, bucket by bucket."""
    store, _ = updated_store(spark, sf_dir)
    found = spark.read.parquet(*[f"{store.folder}/{x}" for x in store.manifest()["digests"].values()])
    return found.select(hex_lower(F.col("key")).alias("key_hex"), "n", hex_lower(F.col("digest")).alias("value_digest"))


@registered(" UNION ALL ".join(f"SELECT {k}::BIGINT AS revision, 'events' AS origin, {end} AS size, root FROM (SELECT count(*) AS n FROM events), ({root_sql(EVENT_LEAVES + f' WHERE event_id < (SELECT {end} FROM (SELECT count(*) AS n FROM events))')})" for k, end in enumerate(ENDS)))
def store_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each update has published: the checkpoint in it."""
    store, _ = updated_store(spark, sf_dir)
    rows = [(k, store.revision(k).decode()) for k in range(store.manifest()["revisions"])]
    parsed = spark.createDataFrame(rows, "revision long, leaf string").select("revision", codec.checkpoint_fields(F.expr("substring(leaf, 67)")).alias("c"))
    return parsed.select("revision", "c.origin", "c.size", hex_lower(F.col("c.root")).alias("root"))


@registered("SELECT sha256('') AS root, 0::BIGINT AS size, 0::BIGINT AS revisions")
def empty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without leaves: its root, and a store that has seen it."""
    log, _ = events_log(spark, sf_dir)
    store = IndexStore(spark, scratch.new_folder(spark, "store"), event_keys)
    size = store.update(log.range(0, 0), codec.format_checkpoint("events", 0, merkle.EMPTY_ROOT))
    return spark.createDataFrame([(merkle.Frontier().root().hex(), size, store.manifest()["revisions"])], "root string, size long, revisions long")


@registered("SELECT * FROM (VALUES ('same size, other root', true), ('smaller', true), ('tampered leaf', true), ('missing leaf', true), ('other origin', true), ('no checkpoint', true), ('next checkpoint', false)) v(what, is_refused)")
def update_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that must fail, and after them one that must not."""
    log, n = events_log(spark, sf_dir)
    half, whole = checkpoints(log, [n // 2, n])
    store = IndexStore(spark, scratch.new_folder(spark, "store"), event_keys)
    store.update(log, half)
    tampered = LogTable(log.rows.withColumn("leaf", F.when(F.col("idx") == n - 1, F.lit(b"x:y")).otherwise(F.col("leaf"))))
    cases = {
        "same size, other root": (log, codec.format_checkpoint("events", n // 2, bytes(32))),
        "smaller": (log, codec.format_checkpoint("events", n // 3, bytes(32))),
        "tampered leaf": (tampered, whole),
        "missing leaf": (LogTable(log.rows.where(F.col("idx") != n - 2)), whole),
        "other origin": (log, whole.replace(b"events", b"others", 1)),
        "no checkpoint": (log, b"x"),
        "next checkpoint": (log, whole),
    }
    out = []
    for what, (of, raw) in cases.items():
        try:
            out.append((what, store.update(of, raw) != n))
        except (RootMismatch, ValueError):
            out.append((what, True))
    return spark.createDataFrame(out, "what string, is_refused boolean")


@registered("SELECT * FROM (VALUES ('signed', true), ('signed by another key', false), ('text changed', false), ('not signed', false), ('other origin', false)) v(what, is_accepted)")
def checkpoint_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of the events' log under a key, and what verification says of them."""
    _, n = events_log(spark, sf_dir)
    own, other = notes.Signer("events", bytes(range(32))), notes.Signer("events", bytes(32))
    text = codec.format_checkpoint("events", n, bytes(32))
    verify = notes.verifying(notes.Verifier.parse(str(own.verifier())))
    cases = {
        "signed": own.signed(text),
        "signed by another key": other.signed(text),
        "text changed": own.signed(text).replace(b"events\n", b"events\n1", 1),
        "not signed": text,
        "other origin": own.signed(text.replace(b"events", b"others", 1)),
    }
    out = []
    for what, raw in cases.items():
        try:
            out.append((what, verify(raw).size == n))
        except ValueError:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, is_accepted boolean")


@registered(f"SELECT event_id AS idx, {LEAF_SQL} AS leaf FROM events WHERE event_id < (SELECT count(*) - count(*) // 7 FROM events)")
def log_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log folder read up to its latest checkpoint, which lies before its last leaves."""
    log, n = events_log(spark, sf_dir)
    folder = scratch.new_folder(spark, "log")
    log.rows.repartition(3, "idx").write.parquet(f"{folder}/leaves")  # files in no order of positions
    for size in (1, n - n // 7):
        stream.write_checkpoint(folder, size, codec.format_checkpoint("events", size, bytes(32)))
    spark.dataSource.register(stream.LogSource)
    return spark.read.format("backleaf_log").load(folder).select("idx", F.col("leaf").cast("string").alias("leaf"))


@registered(f"SELECT sha256(name) AS key_hex, string_agg(idx, ',' ORDER BY idx) AS positions, (SELECT count(*) FROM events) AS size FROM ({POSTINGS_SQL}) GROUP BY name")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that has followed a log folder by Structured Streaming over two checkpoints, with a restart between."""
    log, n = events_log(spark, sf_dir)
    folder, progress = scratch.new_folder(spark, "log"), scratch.new_folder(spark, "progress")
    log.rows.repartition(3, "idx").write.parquet(f"{folder}/leaves")
    store = IndexStore(spark, scratch.new_folder(spark, "store"), event_keys)
    for end, raw in zip((n // 2, n), checkpoints(log, [n // 2, n])):
        stream.write_checkpoint(folder, end, raw)
        ingest.follow(store, folder, progress).awaitTermination()
    return shown_lists(store.lookup_many(all_names(log)))


@registered("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'the key is missing' WHEN 2 THEN 'the key is not hex' WHEN 3 THEN 'the key is not hex' WHEN 4 THEN 'the key is not of 32 bytes' WHEN 5 THEN 'the key is missing' END AS fault FROM events""")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested keys, five in six of them broken: empty, no hex, half a byte, too long, null."""
    kind, good = F.col("event_id") % 6, F.sha2("event_type", 256)
    text = F.when(kind == 0, good).when(kind == 1, F.lit("")).when(kind == 2, F.concat(F.lit("zz"), good)).when(kind == 3, F.substring(good, 1, 63)).when(kind == 4, F.concat(good, good))
    return table(spark, sf_dir, "events").select("event_id", codec.key_fault(text).alias("fault"))


@registered("SELECT event_id AS idx, event_id || ' ' || sha256(event_type) || ' ' || sha256(user_id::VARCHAR) AS line, sha256(user_id::VARCHAR) AS last_key, true AS is_valid FROM events")
def wal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead log written as text files and read back."""
    path = scratch.new_folder(spark, "wal")
    logs.write_wal(table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), keys.hashed(F.col("event_type"), F.col("user_id")).alias("keys")), path)
    back = logs.read_wal(spark, path)
    return back.select("idx", "line", hex_lower(F.element_at("keys", -1)).alias("last_key"), "is_valid")


@registered("""SELECT * FROM (VALUES ('empty', ''), ('whole', '0' || chr(10) || '1' || chr(10)), ('torn row', '1' || chr(10)), ('no newline at the end', '1' || chr(10) || '2' || chr(10)),
    ('beyond the size', '0' || chr(10) || '2' || chr(10)), ('empty line', 'refused')) v(what, kept)""")
def wal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log file's text is cut to after a crash."""
    cases = {"empty": ("", 0), "whole": ("0\n1\n", 2), "torn row": ("1\n2 fdfxx", 2), "no newline at the end": ("1\n2\n3", 9), "beyond the size": ("0\n2\n5 xxabcdeadbeef", 3), "empty line": ("1\n2\n\n3\n", 9)}
    out = []
    for what, (text, size) in cases.items():
        try:
            out.append((what, logs.recovered_wal(text, size)))
        except ValueError:
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, kept string")


@registered(f"""SELECT name, string_agg(idx, ',' ORDER BY idx) AS positions FROM ({POSTINGS_SQL}) WHERE name IN ('click', '7') GROUP BY name UNION ALL SELECT 'banana', NULL""")
def http_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the HTTP endpoint to its client: two keys and one that the index lacks."""
    store, _ = updated_store(spark, sf_dir)
    server = api.serve(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        got = [(name, api.fetch(url, name)["index_value"]) for name in ("click", "7", "banana")]
    finally:
        server.shutdown()
    rows = spark.createDataFrame(got, "name string, at array<long>")
    return rows.select("name", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("positions"))


@registered("SELECT count(*) // 2 AS failing_leaf FROM events")
def mapping_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position that a build names whose mapping fails at one leaf."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    n = rows.count()
    leaf = F.when(F.col("event_id") == n // 2, F.lit("no mark")).otherwise(F.concat("event_type", F.lit(":")))
    try:
        index.postings(rows, keys.before(leaf, F.col("event_id")), "event_id").count()
        at = -1
    except Exception as why:
        at = int(str(why).split("mapping index ")[1].split(":")[0])
    return spark.createDataFrame([(at,)], "failing_leaf long")
