"""Registered queries of the index engine and their SQL oracles.

Results hold scalars only (hex text, joined lists), so that two engines can be compared value by
value. Names ending in _sql are pieces of DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backleaf.functions import codec, keys
from backleaf.functions.hashing import hex_lower, leaf_hash
from backleaf.operators import index, merkle, trie
from backleaf.sources import log as logs

QUERIES = {}
ORACLE_SQL = {}


def registered(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(digests: DataFrame) -> DataFrame:
    return digests.select(hex_lower(F.col("key")).alias("key_hex"), "n", hex_lower(F.col("digest")).alias("value_digest"))


def shown_lists(lists: DataFrame) -> DataFrame:
    return lists.select(hex_lower(F.col("key")).alias("key_hex"), F.array_join(F.transform("idxs", lambda x: x.cast("string")), ",").alias("positions"), "size")


def built(rows: DataFrame, mapping: Column, idx_col: str) -> DataFrame:
    return shown(index.digests(index.chunks(index.postings(rows, mapping, idx_col))))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(table(spark, sf_dir, "events"), keys.hashed(F.col("event_type")), "event_id")


def event_leaf() -> Column:
    return F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))


def index_sql(postings: str) -> str:
    """The index over a SELECT of name and idx."""
    return f"""SELECT sha256(name) AS key_hex, count(*) AS n,
        sha256(unhex(string_agg(format('{{:016x}}', idx), '' ORDER BY idx))) AS value_digest
    FROM ({postings}) p GROUP BY name"""


def root_sql(leaves: str) -> str:
    """The Merkle root over a SELECT of i and leaf (text)."""
    return f"""WITH RECURSIVE t(lvl, i, h) AS (
        SELECT 0, i, unhex(sha256(unhex('00') || leaf::BLOB)) FROM ({leaves}) l
        UNION ALL
        SELECT max(lvl) + 1, i // 2, CASE WHEN count(*) = 1 THEN any_value(h) ELSE unhex(sha256(unhex('01') || min_by(h, i) || max_by(h, i))) END
        FROM t WHERE (SELECT count(*) FROM t) > 1 GROUP BY i // 2)
    SELECT lower(hex(h)) AS root FROM t ORDER BY lvl DESC LIMIT 1"""


EVENT_LEAVES = "SELECT event_id AS i, concat(event_id, ':', event_type) AS leaf FROM events"


# --- Building an index


@registered(index_sql("SELECT event_type AS name, event_id AS idx FROM events"))
def index_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "events"), keys.hashed(F.col("event_type")), "event_id")


@registered(index_sql("SELECT user_id::VARCHAR AS name, event_id AS idx FROM events"))
def index_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "events"), keys.hashed(F.col("user_id")), "event_id")


@registered(index_sql("SELECT json_extract_string(props, '$.k') AS name, event_id AS idx FROM events"))
def index_json_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "events"), keys.json_field(F.col("props"), F.col("event_id"), "k"), "event_id")


@registered(index_sql("SELECT event_type AS name, event_id AS idx FROM events"))
def index_cut_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    return built(table(spark, sf_dir, "events"), keys.before(leaf, F.col("event_id")), "event_id")


@registered(index_sql("SELECT 'type=' || event_type AS name, event_id AS idx FROM events UNION ALL SELECT 'user=' || user_id, event_id FROM events"))
def index_multi_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "events"), keys.prefixed(type=F.col("event_type"), user=F.col("user_id")), "event_id")


@registered(index_sql("SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name, doc_id AS idx FROM documents"))
def index_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(index.digests(index.named_chunks(table(spark, sf_dir, "documents"), keys.word_names(F.col("text")), "doc_id")))


@registered(index_sql("SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS name, doc_id AS idx FROM documents"))
def index_doc_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(index.digests(index.named_chunks(table(spark, sf_dir, "documents"), F.array_distinct(keys.word_names(F.col("text"))), "doc_id")))


@registered(index_sql("""SELECT array_to_string(labels[i:], '.') AS name, page_id AS idx
    FROM (SELECT page_id, labels, unnest(range(1, greatest(len(labels), 2))) AS i
          FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.') AS labels FROM pages))"""))
def index_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "pages"), keys.host_and_parents(F.col("url")), "page_id")


@registered(index_sql("SELECT user_id::VARCHAR AS name, event_id AS idx FROM events WHERE event_type = 'error'"))
def index_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = keys.hashed(F.when(F.col("event_type") == "error", F.col("user_id")))
    return built(table(spark, sf_dir, "events"), mapping, "event_id")


@registered(index_sql("SELECT unnest([lang, source, lang]) AS name, doc_id AS idx FROM documents"))
def index_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(table(spark, sf_dir, "documents"), keys.hashed(F.col("lang"), F.col("source"), F.col("lang")), "doc_id")


@registered(index_sql("SELECT conv_id::VARCHAR AS name, i AS idx FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)"))
def index_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in the order of two columns: dense positions from the rows before each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    part = F.floor(F.col("conv_id") / 4096)
    parts = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("m"))
    ahead = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("ahead"))
    starts = sizes.withColumn("part", part).join(ahead, "part")
    starts = starts.select("conv_id", (F.col("ahead") + F.sum("n").over(Window.partitionBy("part").orderBy("conv_id")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    dense = rows.withColumn("place", place).join(starts, "conv_id").withColumn("idx", F.col("start") + F.col("place"))
    return built(dense, keys.hashed(F.col("conv_id")), "idx")


# --- The write-ahead log's text


@registered("SELECT event_id AS idx, event_id || ' ' || sha256(event_type) || ' ' || sha256(user_id::VARCHAR) AS line FROM events")
def wal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("idx"), codec.wal_row(F.col("event_id"), keys.hashed(F.col("event_type"), F.col("user_id"))).alias("line"))


@registered("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN event_id ELSE -1 END AS idx, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE -1 END AS n_keys,
    event_id % 5 IN (0, 1, 2) AS is_valid FROM events""")
def wal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back from text: with one key, none, two (upper case), and two that are broken."""
    n, h = F.col("event_id").cast("string"), F.sha2("event_type", 256)
    kind = F.col("event_id") % 5
    line = F.when(kind == 0, F.concat_ws(" ", n, h)).when(kind == 1, n).when(kind == 2, F.concat_ws(" ", n, h, F.upper(h))).when(kind == 3, F.concat_ws(" ", n, F.lit("deadbeef"))).otherwise(F.concat(n, F.lit(" ")))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    line = F.col("line")
    return rows.select("event_id", F.coalesce(codec.wal_position(line), F.lit(-1).cast("long")).alias("idx"), F.coalesce(F.size(codec.wal_keys(line)), F.lit(-1)).alias("n_keys"), codec.wal_valid(line).alias("is_valid"))


# --- The log's Merkle tree


@registered("SELECT event_id AS i, sha256(unhex('00') || concat(event_id, ':', event_type)::BLOB) AS leaf_hash FROM events")
def leaf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.leaf_hashes(table(spark, sf_dir, "events"), event_leaf(), "event_id").select("i", hex_lower(F.col("h")).alias("leaf_hash"))


@registered(f"""WITH RECURSIVE t(lvl, i, h) AS (
        SELECT 0, i, unhex(sha256(unhex('00') || leaf::BLOB)) FROM ({EVENT_LEAVES}) l
        UNION ALL
        SELECT max(lvl) + 1, i // 2, CASE WHEN count(*) = 1 THEN any_value(h) ELSE unhex(sha256(unhex('01') || min_by(h, i) || max_by(h, i))) END
        FROM t WHERE lvl < 8 GROUP BY i // 2)
    SELECT i AS tile, lower(hex(h)) AS tile_root FROM t WHERE lvl = 8""")
def log_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return merkle.tiles(merkle.leaf_hashes(rows, event_leaf(), "event_id"), rows.count()).select(F.col("i").alias("tile"), hex_lower(F.col("h")).alias("tile_root"))


@registered(root_sql(EVENT_LEAVES))
def log_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return merkle.root(merkle.leaf_hashes(rows, event_leaf(), "event_id"), rows.count()).select(hex_lower(F.col("h")).alias("root"))


#: Sizes at the edges of a tile, and shares of the whole log: each as a function of its size and as SQL.
SIZES = (
    (lambda n: 1, "1"),
    (lambda n: 255, "255"),
    (lambda n: 256, "256"),
    (lambda n: 257, "257"),
    (lambda n: n // 2, "(SELECT count(*) // 2 FROM events)"),
    (lambda n: n - 1, "(SELECT count(*) - 1 FROM events)"),
    (lambda n: n, "(SELECT count(*) FROM events)"),
)


@registered(" UNION ALL ".join(f"SELECT {n}::BIGINT AS size, root FROM ({root_sql(EVENT_LEAVES + f' WHERE event_id < {n}')})" for _, n in SIZES))
def log_root_at_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    leaves, n, out = merkle.leaf_hashes(rows, event_leaf(), "event_id"), rows.count(), None
    for of, _ in SIZES:
        row = merkle.root(leaves, of(n)).select(F.lit(of(n)).cast("long").alias("size"), hex_lower(F.col("h")).alias("root"))
        out = row if out is None else out.unionByName(row)
    return out


@registered(f"""SELECT n AS size, root, true AS matches FROM (SELECT count(*) AS n FROM events), ({root_sql(EVENT_LEAVES)})""")
def log_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root by a frontier that grows in three steps, held against the root over all leaves."""
    rows = table(spark, sf_dir, "events")
    n, leaves, frontier = rows.count(), merkle.leaf_hashes(rows, event_leaf(), "event_id"), merkle.Frontier()
    for end in (n // 3, n // 3 * 2 + 1, n):
        frontier = merkle.extend(frontier, leaves.where(F.col("i") < end), end)
    whole = merkle.root(leaves, n)
    return whole.select(F.lit(frontier.size).cast("long").alias("size"), hex_lower(F.col("h")).alias("root"), (F.col("h") == F.lit(frontier.root())).alias("matches"))


# --- Lookups

LISTS = """SELECT k.key_hex, p.positions, (SELECT count(*) FROM events) AS size FROM (VALUES {keys}) v(name), LATERAL (SELECT sha256(v.name) AS key_hex) k
    LEFT JOIN (SELECT event_type AS t, string_agg(event_id, ',' ORDER BY event_id) AS positions FROM events GROUP BY 1) p ON p.t = v.name"""


def asked(spark: SparkSession, *names: str) -> DataFrame:
    return spark.range(1).select(F.explode(keys.hashed(*map(F.lit, names))).alias("key"))


@registered("SELECT sha256('click') AS key_hex, string_agg(event_id, ',' ORDER BY event_id) AS positions, (SELECT count(*) FROM events) AS size FROM events WHERE event_type = 'click'")
def lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    return shown_lists(index.lookup_many(index.chunks(event_posts(spark, sf_dir)), asked(spark, "click"), n))


@registered("SELECT sha256('banana') AS key_hex, NULL::VARCHAR AS positions, (SELECT count(*) FROM events) AS size")
def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    return shown_lists(index.lookup_many(index.chunks(event_posts(spark, sf_dir)), asked(spark, "banana"), n))


@registered("""SELECT sha256(event_type) AS key_hex, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (event_id < (SELECT count(*) // 2 FROM events)), '') AS positions,
    (SELECT count(*) // 2 FROM events) AS size FROM events GROUP BY event_type""")
def lookup_at_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, n = event_posts(spark, sf_dir), table(spark, sf_dir, "events").count()
    return shown_lists(index.lookup_many(index.chunks(posts), posts.select("key").distinct(), n // 2))


@registered("""SELECT sha256(u::VARCHAR) AS key_hex, positions, (SELECT count(*) FROM events) AS size
    FROM (SELECT DISTINCT user_id AS u FROM events UNION SELECT DISTINCT -1 - user_id FROM events)
    LEFT JOIN (SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS positions FROM events GROUP BY 1) ON user_id = u""")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users, and as many names that the index lacks."""
    rows = table(spark, sf_dir, "events")
    of = index.chunks(index.postings(rows, keys.hashed(F.col("user_id")), "event_id"))
    users = rows.select("user_id").union(rows.select(-1 - F.col("user_id"))).distinct()
    return shown_lists(index.lookup_many(of, users.select(F.explode(keys.hashed(F.col("user_id"))).alias("key")), rows.count()))


@registered("SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (3, 5, 8)")
def dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    of = index.chunks(index.postings(rows, keys.hashed(F.col("user_id")), "event_id"))
    wanted = index.lookup_many(of, asked(spark, "3", "5", "8"), rows.count())
    return index.dereference(wanted, rows, "event_id").drop("key", "idxs", "size")


@registered("""SELECT sha256('click') AS key_hex,
    '{"output_log_cp":null,"output_log_leaf":null,"output_log_proof":null,"index_key":[' || array_to_string(list_transform(range(32), lambda x: 0), ',') || '],"index_value":['
    || string_agg(event_id, ',' ORDER BY event_id) || '],"index_proof":null}' AS body FROM events WHERE event_type = 'click'""")
def lookup_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.lookup_many(index.chunks(event_posts(spark, sf_dir)), asked(spark, "click"), table(spark, sf_dir, "events").count())
    return found.select(hex_lower(F.col("key")).alias("key_hex"), codec.lookup_json_column(F.col("idxs")).alias("body"))


# --- Following the log


@registered("SELECT DISTINCT sha256(user_id::VARCHAR) AS key_hex FROM events WHERE event_id >= (SELECT count(*) - count(*) // 10 FROM events)")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    posts = index.postings(rows, keys.hashed(F.col("user_id")), "event_id")
    n = rows.count()
    return index.changed_keys(posts, n - n // 10, n).select(hex_lower(F.col("key")).alias("key_hex"))


@registered(index_sql("SELECT o_orderpriority AS name, o_orderkey AS idx FROM orders UNION ALL SELECT o_custkey::VARCHAR, o_orderkey FROM orders"))
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index at the last size, from the one 1 % before and the keys changed since."""
    rows = table(spark, sf_dir, "orders")
    n = rows.count()
    old = n - n // 100
    posts = index.postings(rows, keys.hashed(F.col("o_orderpriority"), F.col("o_custkey")), "o_orderkey")
    before = index.digests(index.chunks(posts, old))
    return shown(index.updated_digests(before, posts, index.changed_keys(posts, old, n), n))


@registered("SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(lower(text), '[a-z]{14}')")
def unmapped_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    long_words = keys.hashed_all(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{14,}"), F.lit(0)))
    return index.unmapped(rows, index.postings(rows, long_words, "doc_id"), "doc_id").select("doc_id", "lang")


DENSE = (("events", "event_id"), ("orders", "o_orderkey"), ("pages", "page_id"), ("labels", "doc_id"))


@registered(" UNION ALL ".join(f"SELECT '{t}' AS log, count(*) AS n, min({c}) AS lowest, max({c}) AS highest, count(DISTINCT {c}) AS n_distinct, min({c}) = 0 AND max({c}) = count(*) - 1 AND count(DISTINCT {c}) = count(*) AS is_dense FROM {t}" for t, c in DENSE))
def density_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in DENSE:
        row = logs.density(table(spark, sf_dir, t), c).select(F.lit(t).alias("log"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@registered("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'log' END AS origin, CASE WHEN event_id % 4 = 0 THEN event_id END AS size,
    CASE WHEN event_id % 4 = 0 THEN sha256(event_type) END AS root FROM events""")
def checkpoint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints as text, of which three in four are broken: too short, no number, no base64."""
    kind, good = F.col("event_id") % 4, F.base64(F.unhex(F.sha2("event_type", 256)))
    size = F.when(kind == 2, F.lit("x")).otherwise(F.col("event_id").cast("string"))
    text = F.concat(F.lit("log\n"), size, F.lit("\n"), F.when(kind == 3, F.lit("%%%")).otherwise(good), F.when(kind == 1, F.lit("")).otherwise(F.lit("\n\nsigned\n")))
    rows = table(spark, sf_dir, "events").select("event_id", codec.checkpoint_fields(text).alias("c"))
    return rows.select("event_id", "c.origin", "c.size", hex_lower(F.col("c.root")).alias("root"))


@registered("""SELECT i AS idx, sha256(unhex('00') || leaf::BLOB) AS leaf_hash FROM (SELECT (b * 256 + p - 1)::BIGINT AS i, es[p] AS leaf
    FROM (SELECT event_id // 256 AS b, list(concat(event_id, ':', event_type) ORDER BY event_id) AS es FROM events GROUP BY 1), LATERAL (SELECT unnest(range(1, len(es) + 1)) AS p))""")
def bundle_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves taken apart again from bundles of 256 entries."""
    rows = table(spark, sf_dir, "events").select("event_id", event_leaf().cast("binary").alias("leaf"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "leaf"))), lambda x: x["leaf"])
    bundles = rows.groupBy(F.floor(F.col("event_id") / 256).alias("bundle")).agg(entries.alias("entries"))
    flat = merkle.leaf_hashes(logs.from_bundles(bundles).rows, F.col("leaf"))
    return flat.select(F.col("i").alias("idx"), hex_lower(F.col("h")).alias("leaf_hash"))


@registered("""SELECT idx, module, version, sha256(module || version) AS hash, sha256(unhex('00') || ('{"module":"' || module || '","version":"' || version || '","hash":"' || to_base64(unhex(sha256(module || version))) || '"}')::BLOB) AS leaf_hash
    FROM (SELECT idx, ['foo', 'bar', 'baz', 'splat'][('0x' || d[1:8])::BIGINT % 4 + 1] AS module,
                 strftime(make_timestamp(idx * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN nanos = '' THEN '' ELSE '.' || nanos END || 'Z' AS version
          FROM (SELECT idx, d, rtrim(lpad((('0x' || d[9:16])::BIGINT % 1000000000)::VARCHAR, 9, '0'), '0') AS nanos
                FROM (SELECT idx, sha256('1:' || idx) AS d FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS idx))))""")
def generated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the demonstration log, as many as events, decoded again."""
    rows = logs.demo(spark, table(spark, sf_dir, "events").count()).rows
    rows = rows.select("idx", F.from_json(F.col("leaf").cast("string"), logs.ENTRY).alias("e"), hex_lower(leaf_hash(F.col("leaf"))).alias("leaf_hash"))
    return rows.select("idx", "e.module", "e.version", hex_lower(F.col("e.hash")).alias("hash"), "leaf_hash")


# --- The index's own root, in this engine's encoding


def trie_sql(index: str) -> str:
    """The trie's root over a SELECT of key_hex and value_digest, few of them: the neighbours with the longest common prefix are joined, again and again."""
    common = "bit_position('1'::BIT, xor(unhex(s[i].k)::BIT, unhex(s[i + 1].k)::BIT)) - 1"
    return f"""WITH RECURSIVE t(s) AS (
        SELECT list({{'k': key_hex, 'h': sha256(unhex('00' || key_hex || value_digest))}} ORDER BY key_hex) FROM ({index})
        UNION ALL
        SELECT s[:j - 1] || [{{'k': s[j].k, 'h': sha256(unhex('01' || format('{{:04x}}', gap) || lower(hex((left((unhex(s[j].k)::BIT)::VARCHAR, gap) || repeat('0', 256 - gap))::BIT::BLOB)) || s[j].h || s[j + 1].h))}}] || s[j + 2:]
        FROM (SELECT s, list_max(gaps)::BIGINT AS gap, list_position(gaps, list_max(gaps)) AS j
              FROM (SELECT s, list_transform(range(1, len(s)), lambda i: {common}) AS gaps FROM t WHERE len(s) > 1)))
    SELECT s[1].h AS index_root FROM t WHERE len(s) = 1"""


EVENT_INDEX = index_sql("SELECT event_type AS name, event_id AS idx FROM events")


def event_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.digests(index.chunks(event_posts(spark, sf_dir)))


@registered(trie_sql(EVENT_INDEX))
def index_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = trie.root(trie.subtrees(event_digests(spark, sf_dir)))
    return spark.range(1).select(F.lit(root.hex()).alias("index_root"))


@registered()
def index_root_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = index.named_chunks(table(spark, sf_dir, "documents"), keys.word_names(F.col("text")), "doc_id")
    root = trie.root(trie.subtrees(index.digests(of)))
    return spark.range(1).select(F.lit(root.hex()).alias("index_root"))


@registered(f"""SELECT index_root || chr(10) || chr(10) || 'events' || chr(10) || n || chr(10) || to_base64(unhex(root)) || chr(10) AS leaf
    FROM ({trie_sql(EVENT_INDEX)}), (SELECT count(*) AS n FROM events), ({root_sql(EVENT_LEAVES)})""")
def publish_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    n = rows.count()
    frontier = merkle.extend(merkle.Frontier(), merkle.leaf_hashes(rows, event_leaf(), "event_id"), n)
    leaf = codec.revision_leaf(trie.root(trie.subtrees(event_digests(spark, sf_dir))), codec.format_checkpoint("events", n, frontier.root()))
    return spark.range(1).select(F.lit(leaf.decode()).alias("leaf"))


@registered(f"""SELECT key_hex, sha256(unhex('00' || key_hex || value_digest)) AS leaf_hash FROM (SELECT *, count(*) OVER (PARTITION BY key_hex[1:4]) AS k
    FROM ({index_sql("SELECT user_id::VARCHAR AS name, event_id AS idx FROM events")})) WHERE k = 1""")
def trie_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees of users that are alone in theirs: their roots are their leaves' hashes."""
    found = index.digests(index.chunks(index.postings(table(spark, sf_dir, "events"), keys.hashed(F.col("user_id")), "event_id")))
    alone = found.groupBy(F.substring("key", 1, 2).alias("at")).count().where("count = 1")
    parts = trie.subtrees(found)
    return parts.join(alone, F.substring("first_key", 1, 2) == F.col("at"), "left_semi").select(hex_lower(F.col("first_key")).alias("key_hex"), hex_lower(F.col("root")).alias("leaf_hash"))
