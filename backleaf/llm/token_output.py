"""Token ids in binary matrices, ready for training.

Windows come from best-fit-decreasing packing with a segment tree (see packing); overlong documents
are split at window ends, without loss. A record of the written table is a matrix of up to
rows_per_matrix windows:

    matrix_id     long
    n_rows, width int    shape of the matrix
    id_bytes      int    2 or 4
    ids           binary n_rows x width unsigned little-endian ids, rows padded with pad_id
    sequence_ids  array<long>
    cu_seqlens    array<array<int>>  of each row: 0, then the cumulative lengths of its segments
    position_resets array<array<int>> of each row: where position ids start again from 0
    doc_ids, doc_starts, doc_tokens array<array<long>>  of each segment: its document, the ids before it, the document's ids

Spark's own writer writes it, so that a task that runs twice leaves one copy, in any store.

Defined results: as in packing; an id that id_bytes cannot hold raises an error.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from backleaf.llm import tokens
from backleaf.llm.packing import PIECE_SCHEMA, Packer, documents_of, windows_of

MATRIX_SCHEMA = (
    "matrix_id long, n_rows int, width int, id_bytes int, ids binary, sequence_ids array<long>, cu_seqlens array<array<int>>, "
    "position_resets array<array<int>>, doc_ids array<array<long>>, doc_starts array<array<long>>, doc_tokens array<array<long>>"
)


def matrices(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    id_bytes: int = 2,
    rows_per_matrix: int = 64,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """The documents' ids as records of MATRIX_SCHEMA."""
    import pyarrow as pa

    path = tokenizer_path or tokens.public_path()

    def record(rows: list) -> pa.RecordBatch:
        ids = np.full((len(rows), window), pad_id, f"<u{id_bytes}")
        lengths = [[len(p) for p in pieces] for _, pieces in rows]
        for row, (_, pieces) in zip(ids, rows):
            own = np.frombuffer(b"".join(p.ids for p in pieces), "<u4")
            if len(own) and int(own.max()) >> 8 * id_bytes:
                raise ValueError(f"an id does not fit {id_bytes} bytes: {own.max()}")
            row[: len(own)] = own
        sums = [np.r_[0, np.cumsum(n)].tolist() for n in lengths]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        of = lambda name: pa.array([[[getattr(p, name) for p in pieces] for _, pieces in rows]], pa.list_(longs))
        arrays = [pa.array([rows[0][0]], pa.int64()), *(pa.array([x], pa.int32()) for x in (len(rows), window, id_bytes)), pa.array([ids.tobytes()])]
        arrays += [pa.array([[s for s, _ in rows]], longs), pa.array([sums], pa.list_(ints)), pa.array([[s[:-1] for s in sums]], pa.list_(ints))]
        arrays += [of("doc_id"), of("start"), of("doc_tokens")]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in MATRIX_SCHEMA.split(", ")])

    def made(batches):
        rows: list = []
        for row in windows_of(batches, Packer(window, group_tokens, power_tail=False), path, end_id):
            rows.append(row)
            if len(rows) == rows_per_matrix:
                yield record(rows)
                rows = []
        if rows:
            yield record(rows)

    return documents_of(df, id_col, text_col).mapInArrow(made, MATRIX_SCHEMA)


def write(df: DataFrame, path: str, **options) -> None:
    """Writes the matrices of df's documents to path, a folder in any store that Spark writes."""
    matrices(df, **options).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written table read back: one row for each segment, as PIECE_SCHEMA, with its position reset checked."""
    import pyarrow as pa

    def read(batches):
        for b in batches:
            out = []
            for x in b.to_pylist():
                grid = np.frombuffer(x["ids"], f"<u{x['id_bytes']}").reshape(x["n_rows"], x["width"]).astype("<u4")
                for row, sequence, cu, resets, docs, starts, of in zip(grid, x["sequence_ids"], x["cu_seqlens"], x["position_resets"], x["doc_ids"], x["doc_starts"], x["doc_tokens"]):
                    if cu[:-1] != resets:
                        raise ValueError(f"sequence {sequence}: position resets and lengths do not agree")
                    out += [(d, s, e - a, zlib.crc32(row[a:e].tobytes()), n, sequence, a) for d, s, n, a, e in zip(docs, starts, of, cu, cu[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=PIECE_SCHEMA.names)

    return spark.read.parquet(path).mapInArrow(read, PIECE_SCHEMA)


def position_ids(cu_seqlens: list[int], width: int) -> np.ndarray:
    """A row's position ids: counting from 0 in each segment, and in the padding."""
    at = np.arange(width)
    starts = np.array(cu_seqlens)
    return at - starts[np.searchsorted(starts, at, "right") - 1]
