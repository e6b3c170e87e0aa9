"""Registered queries with SQL against DuckDB; all of them for their columns and that they cover every row."""

import zlib

import numpy as np
import pytest
from oracle import same

from backleaf.llm import queries, tokens

ROWS = {"op1": "documents", "op3": "documents", "op4": "documents", "op7": "documents", "op8": "pages", "op9": "documents"}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] in ROWS])
def test_query_has_a_row_for_each_row(spark, sf_dir, name):
    at = ROWS[name.split("_")[0]]
    got = queries.QUERIES[name](spark, sf_dir)
    key = "page_id" if at == "pages" else "doc_id"
    want = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{at}.parquet").select(key).collect())
    assert sorted(r[0] for r in got.select(key).collect()) == want


@pytest.mark.parametrize("name", ["op5_packing", "op10_token_matrices"])
def test_registered_packing_against_the_library(spark, sf_dir, name):
    """Each document's ids, once each, as the library itself gives them; sequences gapless and not over 2048."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.public_path())
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    ends, at = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        ends[r.doc_id] += r.length
    assert ends == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in at.values())
    assert max(at.values()) <= 2048 and sum(at.values()) >= (0.98 if name.startswith("op5") else 0.9) * padded


def test_registered_mix_meets_its_targets(spark, sf_dir):
    rows = queries.QUERIES["op3_mixing_sources"](spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target, per_shard = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.taken > 0) == bool(r.shards)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        for s in filter(None, r.shards.split(",")):
            per_shard[s] = per_shard.get(s, 0) + 1
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and 2 <= len(per_shard) <= 64


def test_ten_operators_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 11))}
