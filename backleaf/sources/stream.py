"""A log folder as a streaming source whose offsets are log positions.

The folder holds leaves/ (Parquet with idx and leaf) and checkpoints/<size>, one text for each
published state. A micro-batch runs from one checkpoint's size to the latest one's, whatever files
the leaves lie in. File sources cannot do this: files arrive in no order of positions.

A partition is a row group that may hold positions of the batch, by the statistics in its file's footer; it is
read once, as a stream of small Arrow batches, so that time grows with the row groups and memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Leaves in a partition, a multiple of 256.
PART = 1 << 16


class Span(InputPartition):
    """Positions from start to end - 1, and the files that may hold some of them."""

    def __init__(self, start: int, end: int, files: tuple[str, ...] = ()):
        super().__init__(start)
        self.start, self.end, self.files = start, end, files


class Group(InputPartition):
    """Those positions from start to end - 1 that lie in one row group of a file."""

    def __init__(self, start: int, end: int, file: str = "", group: int = 0):
        super().__init__(start)
        self.start, self.end, self.file, self.group = start, end, file, group


def checkpoint_sizes(folder: str) -> list[int]:
    from pyarrow.fs import FileSelector, FileSystem

    store, top = FileSystem.from_uri(folder)
    found = store.get_file_info(FileSelector(f"{top}/checkpoints", allow_not_found=True))
    return sorted(int(x.base_name) for x in found if x.base_name.isdigit())


def checkpoint_text(folder: str, size: int) -> bytes:
    from pyarrow.fs import FileSystem

    store, top = FileSystem.from_uri(folder)
    with store.open_input_stream(f"{top}/checkpoints/{size}") as f:
        return f.read()


def write_checkpoint(folder: str, size: int, raw: bytes) -> None:
    from pyarrow.fs import FileSystem

    store, top = FileSystem.from_uri(folder)
    store.create_dir(f"{top}/checkpoints", recursive=True)
    with store.open_output_stream(f"{top}/checkpoints/.{size}") as f:
        f.write(raw)
    store.move(f"{top}/checkpoints/.{size}", f"{top}/checkpoints/{size}")


def spans(start: int, end: int, files: dict[str, tuple[int, int]] | None = None) -> list[Span]:
    edges = [start, *range(start - start % PART + PART, end, PART), end]
    return [Span(a, b, tuple(f for f, (low, high) in (files or {}).items() if low < b and high >= a)) for a, b in zip(edges, edges[1:]) if b > a]


def groups(folder: str, start: int, end: int, known: dict[str, list[tuple[int, int]]] | None = None) -> list[Group]:
    """The row groups that may hold a position from start to end - 1; files in known are not opened again."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector, FileSystem

    if end <= start:
        return []
    store, top = FileSystem.from_uri(folder)
    known = {} if known is None else known
    names = [f.path for f in store.get_file_info(FileSelector(f"{top}/leaves", allow_not_found=True)) if f.base_name.endswith(".parquet")]
    new = [n for n in names if n not in known]
    for part in ds.dataset(new, filesystem=store, format="parquet").get_fragments() if new else ():
        of = [(g.num_rows, g.statistics.get("idx")) for g in part.row_groups]
        known[part.path] = [(x["min"], x["max"]) if x else (0, 2**63 - 1 if n else -1) for n, x in of]
    return [Group(start, end, n, i) for n in names for i, (low, high) in enumerate(known[n]) if low < end and high >= start]


def scan(folder: str, part: Group, most_rows: int = 1 << 14, most_bytes: int = 2 << 20) -> Iterator:
    """Arrow batches of idx and leaf, about most_bytes long at most (a longer leaf: by itself), of the row group's positions."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    if not part.file:
        return
    store, _ = FileSystem.from_uri(folder)
    # Pages are read as they are needed, not the column's chunk at once.
    with pq.ParquetFile(part.file, filesystem=store, buffer_size=1 << 20, pre_buffer=False) as f:
        of = f.metadata.row_group(part.group)
        rows = max(1, min(most_rows, most_bytes * of.num_rows // max(1, of.total_byte_size)))
        for batch in f.iter_batches(rows, row_groups=[part.group], columns=["idx", "leaf"], use_threads=False):
            at = batch.column("idx").cast(pa.int64())
            inside = pc.and_(pc.greater_equal(at, part.start), pc.less(at, part.end))
            own = pa.RecordBatch.from_arrays([at, batch.column("leaf").cast(pa.binary())], names=["idx", "leaf"]).filter(inside)
            if own.num_rows:
                yield own


class LogSource(DataSource):
    """spark.read or spark.readStream.format("backleaf_log").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "backleaf_log"

    def schema(self) -> str:
        return "idx bigint, leaf binary"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        return groups(self.folder, 0, max(checkpoint_sizes(self.folder), default=0)) or [Group(0, 0)]

    def read(self, partition):
        return scan(self.folder, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.known = options["path"], {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"size": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"size": max(checkpoint_sizes(self.folder), default=0)}

    def partitions(self, start: dict, end: dict):
        return groups(self.folder, start["size"], end["size"], self.known) or [Group(0, 0)]

    def read(self, partition):
        return scan(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Nothing to give back: the log keeps its leaves."""
