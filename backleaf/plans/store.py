"""A stored index that follows its log from checkpoint to checkpoint.

A folder in any Hadoop file system:

    postings/<start>-<end>-<n>/bucket=<b>/   key, chunk, idxs of a range of positions
    digests/<end>-<n>/bucket=<b>/            key, n, digest at a size
    subtrees/<end>-<n>/                      the trie's subtrees at a size, at most 65,536 rows
    revisions/<n>                            what was published, one text each
    manifest.json                            size, frontier, checkpoint, root, the folders that count

An update checks the log against its checkpoint first, then writes folders, then replaces the
manifest in one rename. Readers see what the manifest names and positions below its size, so an update that
fails or is cut off shows nothing and is simply done again.

Keys fall in buckets by their first bits. An update reads and writes digests of the buckets it changes only, and
of these the manifest names the folder. Postings are merged as they pile up: the last two folders
become one while the older is not over twice as large in positions, so there are about as many as the size has
bits, and each posting is rewritten about as often. Folders that neither the manifest nor the one before it names
are deleted after an update; readers have the time of an update to finish.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backleaf.functions import codec, notes
from backleaf.operators import index, merkle, trie
from backleaf.sources.log import LogTable


class RootMismatch(ValueError):
    """The leaves do not give the root that the checkpoint states, or the log shrank."""


_POSTINGS = "key binary, chunk long, idxs array<bigint>, bucket int"


class Files:
    """The few file operations a store needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def read(self, path: str) -> bytes | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def replace(self, path: str, data: bytes) -> None:
        """Writes beside path, then renames over it."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".next")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(beside), fs.makeQualified(p), how)


class IndexStore:
    """An index in a folder. keys: from (leaf, idx) columns to the mapping's array of keys; fixed for the store's life.

    verify: reads a checkpoint, and checks its signature (notes.verifying); without it, checkpoints are read as they are.
    The log's origin is that of the first checkpoint; another one is refused. signer: signs output checkpoints.
    bucket_bits: keys fall in 2 ** bucket_bits buckets (8 at most), for a new store.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        keys: Callable[[Column, Column], Column],
        verify: Callable[[bytes], codec.Checkpoint] = codec.parse_checkpoint,
        publish_unchanged: bool = True,
        signer: notes.Signer | None = None,
        bucket_bits: int = 4,
    ):
        self.spark, self.folder, self.keys, self.verify, self.publish_unchanged, self.signer = spark, folder.rstrip("/"), keys, verify, publish_unchanged, signer
        self.files, self.bucket_bits = Files(spark), bucket_bits

    def manifest(self) -> dict:
        found = self.files.read(f"{self.folder}/manifest.json")
        if found is None:
            return {
                "size": 0, "frontier": [], "origin": None, "checkpoint": None, "bucket_bits": self.bucket_bits, "writes": 0, "postings": [],
                "digests": {}, "subtrees": None, "index_root": trie.EMPTY.hex(), "revisions": 0, "output_frontier": [], "before": [],
            }
        return json.loads(found)

    def size(self) -> int:
        return self.manifest()["size"]

    def checkpoint(self) -> bytes | None:
        """The log's checkpoint that the index stands at."""
        raw = self.manifest()["checkpoint"]
        return None if raw is None else base64.b64decode(raw)

    def index_root(self) -> bytes:
        return bytes.fromhex(self.manifest()["index_root"])

    def update(self, log: LogTable, raw_checkpoint: bytes) -> int:
        """Takes in the log up to its checkpoint and publishes; returns the size. All or nothing."""
        m, cp = self.manifest(), self.verify(raw_checkpoint)
        if m["origin"] not in (None, cp.origin):
            raise RootMismatch(f"the checkpoint is of {cp.origin!r}, the log of {m['origin']!r}")
        if cp.size < m["size"]:
            raise RootMismatch(f"the log shrank from {m['size']} to {cp.size}")
        stale = set(m["before"])
        before = merkle.Frontier(m["size"], [bytes.fromhex(h) for h in m["frontier"]])
        latest = {"checkpoint": base64.b64encode(raw_checkpoint).decode(), "origin": cp.origin}
        if cp.size == m["size"]:
            if cp.size and before.root() != cp.root:
                raise RootMismatch(f"at {cp.size} the index has {before.root().hex()}, the checkpoint {cp.root.hex()}")
            if cp.size and (self.publish_unchanged or m["checkpoint"] != latest["checkpoint"]):
                m |= latest
                self._commit(self._published(m, raw_checkpoint) if self.publish_unchanged else m)
            return cp.size
        start, end = m["size"], cp.size
        batch = log.range(start, end)
        after = merkle.extend(before, merkle.leaf_hashes(batch.rows, F.col("leaf")), end)
        if after.root() != cp.root:
            raise RootMismatch(f"at {end} the leaves give {after.root().hex()}, the checkpoint {cp.root.hex()}")

        m |= latest | {"size": end, "frontier": [h.hex() for h in after.hashes]}
        posts = index.postings(batch.rows, self.keys(F.col("leaf"), F.col("idx")))
        m["postings"] = [*m["postings"], self._write_postings(m, index.chunks(posts), start, end)]
        stale.add(m["postings"][-1]["folder"])  # unless it stays as it is
        new = self._postings([m["postings"][-1]])
        changed = new.select("key").distinct()
        buckets = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # 2 ** bucket_bits at most
        if buckets:
            name = f"digests/{end:020d}-{m['writes']}"
            again = index.digests(self._postings(m["postings"]).where(F.col("bucket").isin(buckets)).join(changed, "key", "left_semi").drop("bucket"))
            if old := [m["digests"][str(b)] for b in buckets if str(b) in m["digests"]]:
                again = again.unionByName(self.spark.read.parquet(*[f"{self.folder}/{x}" for x in old]).join(changed, "key", "left_anti"))
            self._written(self._with_bucket(m, again).repartitionByRange("key"), name, "bucket")
            m["digests"] = m["digests"] | {str(b): f"{name}/bucket={b}" for b in buckets}
            digests = self.spark.read.parquet(*[f"{self.folder}/{name}/bucket={b}" for b in buckets])

            of_trie = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int").alias("bucket")
            parts = changed.select(of_trie).distinct()
            fresh = trie.subtrees(digests.withColumn("bucket", of_trie).join(parts, "bucket", "left_semi").drop("bucket"))
            stay = self.spark.read.parquet(f"{self.folder}/{m['subtrees']}").join(parts, "bucket", "left_anti") if m["subtrees"] else None
            m["subtrees"] = f"subtrees/{end:020d}-{m['writes']}"
            m["index_root"] = trie.root(self._written(fresh if stay is None else stay.unionByName(fresh), m["subtrees"])).hex()
        m = self._merged(m)
        m["writes"] += 1
        self._commit(self._published(m, raw_checkpoint))
        now = self.manifest()
        for path in stale - self._named(now) - set(now["before"]):
            self.files.delete(f"{self.folder}/{path}")
        return end

    def _named(self, m: dict) -> set[str]:
        """Folders that a manifest counts."""
        return {x["folder"] for x in m["postings"]} | {x.rsplit("/", 1)[0] for x in m["digests"].values()} | ({m["subtrees"]} if m["subtrees"] else set())

    def _with_bucket(self, m: dict, df: DataFrame) -> DataFrame:
        first = F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int")
        return df.withColumn("bucket", F.shiftright(first, 8 - m["bucket_bits"]))

    def _write_postings(self, m: dict, chunks: DataFrame, start: int, end: int) -> dict:
        folder = f"postings/{start:020d}-{end:020d}-{m['writes']}"
        rows = self._with_bucket(m, chunks).repartitionByRange("key", "chunk").sortWithinPartitions("key", "chunk")
        self._written(rows, folder, "bucket")
        return {"folder": folder, "start": start, "end": end}

    def _postings(self, parts: list[dict]) -> DataFrame:
        """(key, chunk, idxs, bucket); a range of positions that starts within a chunk gives a row of its own for it."""
        return reduce(DataFrame.unionByName, [self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/{x['folder']}") for x in parts])

    def _merged(self, m: dict) -> dict:
        """The last folders of postings as one, as long as the older is not over twice as large."""
        parts = list(m["postings"])
        k = len(parts) - 1
        while k and parts[k - 1]["end"] - parts[k - 1]["start"] <= 2 * (parts[-1]["end"] - parts[k]["start"]):
            k -= 1
        if k < len(parts) - 1:
            whole = self._postings(parts[k:]).groupBy("key", "chunk").agg(F.array_sort(F.flatten(F.collect_list("idxs"))).alias("idxs"))
            parts[k:] = [self._write_postings(m | {"writes": f"{m['writes']}m"}, whole, parts[k]["start"], parts[-1]["end"])]
        return m | {"postings": parts}

    def _written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _published(self, m: dict, raw_checkpoint: bytes) -> dict:
        leaf = codec.revision_leaf(bytes.fromhex(m["index_root"]), raw_checkpoint)
        out = merkle.Frontier(m["revisions"], [bytes.fromhex(h) for h in m["output_frontier"]])
        self.files.replace(f"{self.folder}/revisions/{m['revisions']:012d}", leaf)
        out.append(merkle.hash_leaf(leaf))
        return m | {"revisions": out.size, "output_frontier": [h.hex() for h in out.hashes]}

    def _commit(self, m: dict) -> None:
        """Replaces the manifest; it also names the folders that the one before it did."""
        before = self._named(self.manifest())
        self.files.replace(f"{self.folder}/manifest.json", json.dumps(m | {"before": sorted(before)}, indent=1).encode())

    def revision(self, n: int) -> bytes:
        """What revision n (from 0) published."""
        if not 0 <= n < self.manifest()["revisions"]:
            raise IndexError(f"there is no revision {n}")
        return self.files.read(f"{self.folder}/revisions/{n:012d}")

    def output_checkpoint(self, origin: str | None = None) -> bytes:
        """The state of the log of revisions; signed, and by default named, by the signer if there is one."""
        m = self.manifest()
        out = merkle.Frontier(m["revisions"], [bytes.fromhex(h) for h in m["output_frontier"]])
        text = codec.format_checkpoint(origin or (self.signer.name if self.signer else "revisions"), out.size, out.root())
        return self.signer.signed(text) if self.signer else text

    def appended(self) -> tuple[int, bytes]:
        """The last revision's index, and the output checkpoint that covers it."""
        n = self.manifest()["revisions"]
        if not n:
            raise LookupError("nothing is published")
        return n - 1, self.output_checkpoint()

    def chunks(self) -> tuple[DataFrame, int]:
        """The index and the size it is served at."""
        m = self.manifest()
        if not m["size"]:
            raise LookupError("index not populated")
        return self._postings(m["postings"]), m["size"]

    def lookup(self, key: bytes, size: int | None = None) -> tuple[list[int] | None, int]:
        """A key's positions, and the size they are valid for; an earlier size may be asked for."""
        of, now = self.chunks()
        of = of.where(F.col("bucket") == key[0] >> 8 - self.manifest()["bucket_bits"])
        return index.lookup(of, key, now if size is None else min(size, now))

    def probe(self, key: bytes) -> tuple[list[int] | None, int]:
        """lookup() without a Spark job: the key's bucket is read here, its row groups skipped by their statistics."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector, FileSystem

        m = self.manifest()
        if not m["size"]:
            raise LookupError("index not populated")
        bucket, found = key[0] >> 8 - m["bucket_bits"], []
        for part in m["postings"]:
            store, top = FileSystem.from_uri(f"{self.folder}/{part['folder']}/bucket={bucket}")
            files = [f.path for f in store.get_file_info(FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".parquet")]
            if files:
                rows = ds.dataset(files, filesystem=store, format="parquet").to_table(columns=["chunk", "idxs"], filter=ds.field("key") == key)
                found += [i for idxs in rows.column("idxs").to_pylist() for i in idxs]
        return sorted(found) if found else None, m["size"]

    def lookup_many(self, keys: DataFrame, size: int | None = None) -> DataFrame:
        of, now = self.chunks()
        return index.lookup_many(of, keys, now if size is None else min(size, now))
