import zlib
from array import array
from functools import lru_cache

import numpy as np
import pytest
from helpers import LONG, docs, empty_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from backleaf.llm import packing, token_output, tokens


@pytest.fixture(scope="module")
def plain():
    return lambda text: array("I", library().encode(text or "", add_special_tokens=False).ids).tobytes()


LETTERS = "abcXYZ 's't're 12!?#$%&|<>\n\téà̀ßΣσςİıſǰ日本。한العहिไ 　 ­​\x00\x01\x0b\x1c\x85Ᲊ😀𝔘"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=40), st.sampled_from(["", "<|endoftext|>", "<|startoftext|> x"]))
def test_ids_equal_the_library(text, tail):
    own = tokens.word_tokenizer(tokens.public_path())
    assert next(own.ids([text + tail])) == array("I", library().encode(text + tail, add_special_tokens=False).ids).tobytes()


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


def test_ids_of_every_table_text_equal_the_library(spark, sf_dir, plain):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert list(tokens.WordTokenizer(tokens.public_path(), cached_chars=2000).ids(texts, at_once=5000)) == [plain(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_decreasing(given_):
    capacity, lengths = given_
    got = packing.best_fit(lengths, capacity)
    assert sorted(i for w in got for i in w) == list(range(len(lengths)))
    rooms: list[int] = []  # the plain method, looking at every window
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    assert sorted(capacity - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(20, 300), st.booleans())
def test_packer_loses_nothing(lengths, group, power):
    packer = packing.Packer(16, group, power)
    ids = [np.arange(n, dtype="<u4") + 1000 * k for k, n in enumerate(lengths)]
    windows = [w for k, x in enumerate(ids) for w in packer.add(k, x.tobytes())] + list(packer.finish())
    back = {}
    for w in windows:
        assert sum(map(len, w)) <= 16 and all(len(p) for p in w)
        for p in w:
            back.setdefault(p.doc_id, []).append(p)
    for k, x in enumerate(ids):
        assert b"".join(p.ids for p in sorted(back[k], key=lambda p: p.start)) == x.tobytes()
    if power:  # all but well filled windows are full or powers of two
        assert all((n := sum(map(len, w))) * 16 >= 16 * 15 or n & (n - 1) == 0 for w in windows)


def checked(rows, df, plain, window=2048):
    """Every document's ids in its pieces, once; no gaps in sequences."""
    texts = [(r.doc_id, plain(r.text) + (1).to_bytes(4, "little")) for r in df.collect()]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    for doc, ids in texts:
        pieces = [r for r in by_doc[doc] if r.doc_tokens == len(ids) // 4]
        same = sum(d == doc and len(x) == len(ids) for d, x in texts)
        assert sum(r.length for r in pieces) == same * len(ids) // 4
        alike = [x for d, x in texts if d == doc and len(x) == len(ids)]  # repeated rows, or texts of one length
        assert all(any(r.ids_crc32 == zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) for x in alike) for r in pieces)
        covered = np.zeros(len(ids) // 4, int)
        for r in pieces:
            covered[r.start : r.start + r.length] += 1
        assert (covered == same).all()


@pytest.mark.parametrize("group", [3000, 4_000_000])
def test_pieces_of_odd_rows(spark, plain, group):
    df = odd_docs(spark).withColumnRenamed("lang", "sequence_id")
    checked(packing.pack(df, group_tokens=group).collect(), df, plain)


def test_matrices_of_odd_rows(spark, plain, tmp_path):
    df = odd_docs(spark).withColumnRenamed("lang", "sequence_id").withColumn("ids", F.lit(1)).withColumn("Matrix_ID", F.lit("x"))
    token_output.write(df, str(tmp_path / "m"), window=512, rows_per_matrix=3)
    checked(token_output.segments(spark, str(tmp_path / "m")).collect(), df, plain, 512)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        grid = np.frombuffer(bytes(r.ids), "<u2").reshape(r.n_rows, r.width)
        for row, cu, resets in zip(grid, r.cu_seqlens, r.position_resets):
            assert not row[cu[-1] :].any()
            places = token_output.position_ids(cu, r.width)
            assert [i for i in range(cu[-1]) if places[i] == 0] == resets
            assert all(places[a:b].tolist() == list(range(b - a)) for a, b in zip(cu, cu[1:]))


def test_no_rows(spark, tmp_path):
    assert packing.pack(empty_docs(spark)).count() == 0
    token_output.write(empty_docs(spark), str(tmp_path / "m"))
    assert token_output.segments(spark, str(tmp_path / "m")).count() == 0


def test_ids_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        token_output.matrices(docs(spark, [(1, "some words")]), id_bytes=1).count()


def test_padding_is_little(spark, sf_dir):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    fills = [r[1] for r in rows]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fills)
    assert padded < 0.01 * sum(fills)


def test_a_very_long_word(plain):
    text = "x" * 5000 + " " + "é" * 3000 + " " + LONG[:500]
    assert next(tokens.word_tokenizer(tokens.public_path()).ids([text])) == plain(text)
