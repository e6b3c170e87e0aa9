"""Mappings from a log leaf to its keys.

A mapping is a column of type array<binary>: 32-byte hashes, none to many for a leaf, in order, with
repeats if the mapping gives a key more than once. It must depend on the leaf alone (no random
numbers, no clock), or indexes built twice differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.functions.hashing import sha256


def hashed(*names: Column) -> Column:
    """One key for each given string; a null gives none."""
    return F.transform(F.filter(F.array(*[n.cast("string") for n in names]), F.isnotnull), sha256)


def hashed_all(names: Column) -> Column:
    """One key for each string of an array, repeats included."""
    return F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), F.isnotnull), sha256)


def prefixed(**names: Column) -> Column:
    """Keys of several key spaces in one index: the hash of "space=value" for each."""
    return hashed(*[F.concat(F.lit(f"{space}="), n.cast("string")) for space, n in names.items()])


def failing(idx: Column, why: str) -> Column:
    """Stops the build, naming the position of the leaf that cannot be mapped."""
    return F.raise_error(F.concat(F.lit("mapping index "), idx.cast("string"), F.lit(f": {why}")))


def json_field(leaf: Column, idx: Column, field: str) -> Column:
    """The hash of a JSON leaf's string field ("" if it is missing); a leaf that is no JSON object stops the build."""
    read = F.from_json(leaf.cast("string"), T.MapType(T.StringType(), T.StringType()))
    return F.when(read.isNull(), failing(idx, "no JSON object")).otherwise(F.array(sha256(F.coalesce(F.try_element_at(read, F.lit(field)), F.lit("")))))


def before(leaf: Column, idx: Column, mark: str = ":") -> Column:
    """The hash of what stands before the first mark; a leaf without it stops the build."""
    text = leaf.cast("string")
    return F.when(F.instr(text, mark) == 0, failing(idx, f"no {mark}")).otherwise(F.array(sha256(F.substring_index(text, mark, 1))))


def word_names(text: Column) -> Column:
    """Each run of a-z in the lower-cased text, repeats included: names, for index.named_chunks."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def words(text: Column) -> Column:
    """A key for each of word_names()."""
    return hashed_all(word_names(text))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)


def host_and_parents(url: Column) -> Column:
    """A key for a URL's host name and each parent domain of two labels or more."""
    labels = F.split(url_host(url), "\\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return hashed_all(F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def from_python(f: Callable[[bytes], list[bytes]], leaf: Column, idx: Column | None = None) -> Column:
    """A mapping in Python, in Arrow batches, for what columns cannot express; with idx, an error names the leaf's position."""

    @F.udf(T.ArrayType(T.BinaryType()), useArrow=True)
    def mapped(data, at):
        try:
            return [bytes(k) for k in f(bytes(data))]
        except Exception as why:
            raise ValueError(f"mapping index {'?' if at is None else at}: {why}") from why

    return mapped(leaf.cast("binary"), F.lit(None).cast("long") if idx is None else idx)
