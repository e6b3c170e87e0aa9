"""Each stage of the pipeline against a plain version on its own input, then run() as a whole."""

import zlib
from array import array

import pytest
import regex
from helpers import empty_docs, odd_docs, words
from pyspark.sql import functions as F
from test_mixing_classifier import plain_targets
from test_near_copies import plain_keepers
from test_rules_licenses_chat import plain_measures

import corpus_pipeline as pipeline
from backleaf.llm import tokens


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's input and output, as the pipeline passes them on."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, step) in enumerate(pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(k))
        step(spark, docs, sf_dir).write.parquet(at)
        out.append((name, docs, spark.read.parquet(at)))
        docs = out[-1][2]
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_drop_what_they_reject(spark, sf_dir, stages):
    _, before, after = stages[0]

    def stays(text):
        n, chars, symbols, dup, repeat = plain_measures(text)
        lines = sum(bool(words(x)) for x in text.split("\n"))
        capitals = len(regex.findall(r"\p{Lu}", text))
        return not (n < 1 or n >= 50 and 2 * repeat > n or 10 * symbols > 3 * n or 2 * dup > lines or 10 * capitals > 4 * chars or chars < 2 * n or chars > 15 * n)

    has = {r.doc_id for r in after.collect()}
    assert sorted(has) == sorted(r.doc_id for r in before.collect() if stays(r.text))
    assert all(r.doc_id in has for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect())


def test_classifier_filters_the_raw_table(spark, sf_dir):
    """By itself, without the rules before it: bad documents go, clean ones stay."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    has = {r.doc_id for r in pipeline.quality_classifier(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in has for d in good) >= 0.99 * len(good) and sum(d not in has for d in bad) >= 0.85 * len(bad) > 0


def test_classifier_keeps_clean_documents(spark, sf_dir, stages):
    _, before, after = stages[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    had, has = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, after))
    assert has <= had and all(d in has for d in had if labels.get(d) == 1)


def test_one_of_each_class_stays(stages):
    _, before, after = stages[2]
    rows = before.collect()
    assert sorted(r.doc_id for r in after.collect()) == plain_keepers([(r.doc_id, r.text) for r in rows])


def test_mix_meets_targets(stages):
    """With whole documents: within half of a document of the target."""
    _, before, after = stages[3]
    sizes, taken, rows = {}, {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        rows[r.doc_id] = r
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        assert rows[r.doc_id] == r
    longest = {s: max(len(words(r.text)) for r in rows.values() if r.source == s) for s in sizes}
    want = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= longest[s] / 2 + 0.5 for s, t in want.items())


def test_pieces_hold_all_ids(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    t = Tokenizer.from_file(tokens.public_path())
    want = {}
    for r in before.collect():
        ids = array("I", [*t.encode(r.text, add_special_tokens=False).ids, 1])
        want.setdefault((r.doc_id, len(ids)), [0, ids])[0] += 1
    total = {}
    for r in after.collect():
        total[r.doc_id, r.doc_tokens] = total.get((r.doc_id, r.doc_tokens), 0) + r.length
        _, ids = want[r.doc_id, r.doc_tokens]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert total == {k: n * k[1] for k, (n, _) in want.items()}
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert all(r.n <= 2048 and r.k == r.m for r in fill)


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = pipeline.run(spark, sf_dir)
    assert got.agg(F.sum("length")).first()[0] == stages[-1][2].agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("make", [odd_docs, empty_docs])
def test_odd_and_no_rows_pass_every_stage(spark, sf_dir, make):
    docs = make(spark).withColumn("kept", F.lit(1)).withColumn("draws", F.lit(2))
    for _, step in pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.count()
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count() - 1
