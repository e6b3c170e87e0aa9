"""Text formats: rows of the write-ahead log, checkpoints, published revisions, lookup requests and answers."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row: the position in digits, then a space and 64 hex digits for each key.
WAL_ROW = "^[0-9]+( [0-9a-fA-F]{64})*$"


def wal_row(idx: Column, keys: Column) -> Column:
    return F.array_join(F.concat(F.array(idx.cast("string")), F.transform(keys, lambda k: F.lower(F.hex(k)))), " ")


def wal_valid(line: Column) -> Column:
    """Whether a line is a row whose position fits a long."""
    return line.rlike(WAL_ROW) & F.split(line, " ", 2)[0].try_cast("bigint").isNotNull()


def wal_position(line: Column) -> Column:
    return F.when(wal_valid(line), F.split(line, " ", 2)[0].try_cast("bigint"))


def wal_keys(line: Column) -> Column:
    """The row's keys as array<binary>, null if the line is no row."""
    parts = F.split(line, " ")
    return F.when(wal_valid(line), F.transform(F.slice(parts, F.lit(2), F.size(parts)), F.unhex))


@dataclass(frozen=True)
class Checkpoint:
    """A log's state as published: who, how many leaves, their root. `raw` is the text it came from.

    Reading does not check signatures: pass `verify` where a log signs its checkpoints.
    """

    origin: str
    size: int
    root: bytes
    raw: bytes


def format_checkpoint(origin: str, size: int, root: bytes, rest: str = "") -> bytes:
    return f"{origin}\n{size}\n{base64.b64encode(root).decode()}\n{rest}".encode()


def parse_checkpoint(raw: bytes) -> Checkpoint:
    parts = raw.decode().split("\n", 3)
    if len(parts) < 4:
        raise ValueError("a checkpoint has at least four parts")
    if not re.fullmatch("[0-9]+", parts[1]) or int(parts[1]) >= 2**63:
        raise ValueError(f"no size of a log: {parts[1]!r}")
    return Checkpoint(parts[0], int(parts[1]), base64.b64decode(parts[2], validate=True), raw)


def checkpoint_fields(text: Column) -> Column:
    """A checkpoint text as struct(origin, size, root), null where it is none."""
    parts = F.split(text, "\n", 4)
    size = F.when(F.get(parts, F.lit(1)).rlike("^[0-9]+$"), F.get(parts, F.lit(1)).try_cast("bigint"))
    root = F.try_to_binary(F.get(parts, F.lit(2)), F.lit("base64"))
    return F.when((F.size(parts) == 4) & size.isNotNull() & root.isNotNull(), F.struct(parts[0].alias("origin"), size.alias("size"), root.alias("root")))


def revision_leaf(index_root: bytes, checkpoint: bytes) -> bytes:
    """What is published for one state of the index: its root in hex, an empty line, the log's checkpoint."""
    return index_root.hex().encode() + b"\n\n" + checkpoint


def parse_revision(leaf: bytes) -> tuple[bytes, Checkpoint]:
    head, _, rest = leaf.partition(b"\n\n")
    return bytes.fromhex(head.decode()), parse_checkpoint(rest)


def parse_key(text: str | None) -> bytes:
    """A requested key, 64 hex digits; ValueError tells what is wrong."""
    if not text:
        raise ValueError("the key is missing")
    if not re.fullmatch("([0-9a-fA-F]{2})*", text):
        raise ValueError("the key is not hex")
    if len(text) != 64:
        raise ValueError("the key is not of 32 bytes")
    return bytes.fromhex(text)


def key_fault(text: Column) -> Column:
    """What parse_key() says of a requested key, null for a good one."""
    even_hex = text.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("the key is missing")).when(~even_hex, F.lit("the key is not hex")).when(F.char_length(text) != 64, F.lit("the key is not of 32 bytes"))


def lookup_json(positions: list[int] | None) -> str:
    """A lookup's answer; proofs and checkpoints of it are null, and so are the positions of an unknown key."""
    fields = {"output_log_cp": None, "output_log_leaf": None, "output_log_proof": None, "index_key": [0] * 32, "index_value": positions, "index_proof": None}
    return json.dumps(fields)


def lookup_json_column(positions: Column) -> Column:
    """The same as a column over array<bigint>."""
    null = F.lit(None).cast("string")
    answer = F.struct(
        null.alias("output_log_cp"), null.alias("output_log_leaf"), null.alias("output_log_proof"),
        F.array_repeat(F.lit(0), 32).alias("index_key"), positions.alias("index_value"), null.alias("index_proof"),
    )
    return F.to_json(answer, {"ignoreNullFields": "false"})
