import re

import numpy as np
import oracle
import pytest
from helpers import LONG, docs, empty_docs, odd_docs, words
from pyspark.sql import functions as F

from backleaf.llm import classifier, mixing

# --- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By the words of the contract: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    total = sum(sizes.values())
    while open_:
        rest = total - sum(out.values())
        share = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 50, None: 7}, {"Z": 3, "a": 5, "é": 9, "😀": 4, None: 100}, {f"s{i}": i * i for i in range(40)}, {"only": 12}, {"a": 0}],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


TARGETS_SQL = r"""WITH s AS (SELECT source, sum(n)::BIGINT AS z FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents) GROUP BY 1)
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, z AS source_size FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""


def test_sizes_equal_sql(spark, sf_dir):
    got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size")
    oracle.same(got, TARGETS_SQL, sf_dir)


@pytest.mark.parametrize("blocks", [3, 65536])
def test_mix_meets_targets_to_the_word(spark, sf_dir, blocks):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    mixed = mixing.mix(raw, max_blocks=blocks, shards=8).cache()
    rows = mixed.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want, taken = plain_targets(sizes), {}
    for r in rows:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert sum(d.words for d in r.draws) <= 3 * r.size and all(0 < d.words <= r.size and 0 <= d.shard < 8 for d in r.draws)
        assert len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[r.source] = taken.get(r.source, 0) + sum(d.words for d in r.draws)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    drawn = mixing.drawn_rows(mixed, length_col=None).collect()
    out = {}
    for r in drawn:
        out[r.source] = out.get(r.source, 0) + len(words(r.text))
    assert out == taken
    assert sum(1 for r in drawn if not any(r.text == x.text for x in rows if x.doc_id == r.doc_id)) <= len(want)
    again = mixing.mix(raw, max_blocks=blocks, shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("fan_bits", [1, 2, 10])
def test_splitting_tree_keeps_quotas(spark, fan_bits):
    want = [0, 1, 7, 1000, 40_000]
    quotas = spark.createDataFrame(list(enumerate(want)), "rank long, n long")
    leaves = np.zeros((16, 5), int)
    for r in mixing.split(quotas, 4, 5, 3, fan_bits).collect():
        assert leaves[r.node, r.rank] == 0 and r.n > 0
        leaves[r.node, r.rank] = r.n
    assert leaves.sum(0).tolist() == want
    assert leaves.sum(1).max() - leaves.sum(1).min() <= 1
    assert abs(leaves[:, 3] - 62.5).max() < 6 * 62.5**0.5


def test_shards_take_their_quotas_of_each_source(spark, sf_dir):
    """The draws of blocks, as the plan deals them: each once, shards of equal number, sources mixed in each."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = raw.select("source", F.xxhash64("doc_id").alias("h"), mixing.word_count(F.col("text")).alias("size")).cache()
    by_source, by_block = mixing.plan(sized, mixing.WEIGHTS, 3, 4, 65536, 64, 1000, 4, 20)
    draws = by_block.select("rank", "block", F.explode("block_draws").alias("d")).select("rank", "block", "d.*").collect()
    assert len({(r.rank, r.block, r["pass"]) for r in draws}) == len(draws)
    per_shard = np.bincount([r.shard for r in draws], minlength=4)
    assert per_shard.max() - per_shard.min() <= 1
    for rank in {r.rank for r in draws}:
        n = np.bincount([r.shard for r in draws if r.rank == rank], minlength=4)
        assert abs(n - n.sum() / 4).max() <= 5 * max(1, n.sum() / 4) ** 0.5
    words = {r.source: r.w for r in mixing.drawn_rows(mixing.mix(raw, shards=4, least_words=64)).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    assert all(abs(words[r.source] - r.target) <= 0.5 for r in by_source.collect())


def test_many_sources(spark):
    """100,000 sources: by their number in the tree's arrays, and joined by shuffle, not broadcast."""
    n = 100_000
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), F.when(F.col("id") % 3 == 0, "d e")).alias("text"), F.lpad((F.col("id") % n).cast("string"), 6, "0").alias("source"))
    out = mixing.mix(df, shards=4, most_broadcast=1000)
    got = out.select("source", "source_size", "target", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)").alias("taken")).groupBy("source").agg(F.first("source_size").alias("z"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.count("*").alias("k"))
    row = got.agg(F.count("*").alias("n"), F.max(F.abs(F.col("taken") - F.col("t"))).alias("off"), F.max(F.col("t") / F.col("z")).alias("most"), F.sum("t").alias("t"), F.sum("z").alias("z"), F.min("k").alias("k")).first()
    assert row.n == n and row.k == 2 and row.off <= 0.5 and row.most <= 3 and row.t == pytest.approx(row.z)


@pytest.mark.parametrize("whole", [False, True])
def test_the_cut_falls_on_copies(spark, whole):
    """Rows alike in all columns: of 40 copies as many are taken as the cut leaves, the same in every run; whole documents stay whole."""
    text = "one two three four five six seven"
    df = docs(spark, [(1, text, "en", "a", 1)] * 40 + [(2, text, "en", "b", 1)] * 25 + [(3, text, "en", "c", 1)] * 25)
    got = [mixing.mix(df.repartition(k, "doc_id"), shards=2, whole=whole).collect() for k in (1, 3)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 90
    for s in "abc":
        rows = [r for r in got[0] if r.source == s]
        taken = sum(d.words for r in rows for d in r.draws)
        assert abs(taken - rows[0].target) <= (3.5 if whole else 0.5)
        assert not whole or all(d.words == 7 for r in rows for d in r.draws)


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 5, 5), (3, 40, 21), (1000, 9000, 5000), (0, 9, 4), (9, 0, 4), (30_000, 70_000, 50_000)])
def test_hypergeometric(spark, good, bad, draws):
    u = "((cast(xxhash64(id) & 4503599627370495L as double) + 0.5) / 4503599627370496D)"
    n = 3000 if good < 10_000 else 400
    x = np.array([r[0] for r in spark.range(n).select(F.expr(mixing.hypergeometric(f"{good}L", f"{bad}L", f"{draws}L", u))).collect()])
    total = good + bad
    mean, var = draws * good / total, draws * good * bad * (total - draws) / total**2 / (total - 1)
    assert x.min() >= max(0, draws - bad) and x.max() <= min(good, draws)
    assert abs(x.mean() - mean) <= 5 * (var / n) ** 0.5 + 1e-9 and abs(x.var() - var) <= 5 * var * (3 / n) ** 0.5 + 1e-9


def test_mix_of_odd_rows(spark):
    df = odd_docs(spark).withColumnRenamed("lang", "size").withColumn("draws", F.lit(1))
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "size_", "source", "n_chars", "draws_", "size", "source_size", "target", "draws"]
    assert got.count() == df.count() and mixing.mix(empty_docs(spark)).count() == 0
    drawn = mixing.drawn_rows(mixing.mix(odd_docs(spark)), length_col="n_chars")
    assert drawn.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "place"]
    texts = {r.text for r in odd_docs(spark).collect()}
    for r in drawn.collect():
        assert r.text in texts or r.n_chars == len(r.text) and any(t and t.startswith(r.text) for t in texts)


def test_a_cut_keeps_white_space(spark):
    df = docs(spark, [(i, " a  b\tc\n\nd " * 30, "en", f"s{i}", 1) for i in range(3)])
    for r in mixing.drawn_rows(mixing.mix(df)).collect():
        assert (" a  b\tc\n\nd " * 30).startswith(r.text) and not re.search(r"\s$", r.text) or r.text == " a  b\tc\n\nd " * 30


def test_shards_on_disk(spark, sf_dir, tmp_path):
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=4)
    mixing.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == mixing.drawn_rows(mixed).count() and back.select("shard").distinct().count() == 4


# --- classifier


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    raw, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = classifier.classify(raw, labels.where(~held_out)).join(labels.where(held_out), "doc_id").select("quality", "kept", "score", "text_score", "meta_score").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(good) > 100 and len(bad) > 15
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)
    assert all(0 <= s <= 1 for r in got for s in (r.score, r.text_score, r.meta_score))


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    good = int(y.sum())
    return (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def test_views_teach_each_other():
    """Two strong views: what they hand over is kept in most trials, and no trial loses by it."""
    kept = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 2000)
        text, meta = rng.normal(size=(2000, 6)) + 1.6 * y[:, None] * (np.arange(6) < 2), rng.normal(size=(2000, 3)) + 1.2 * y[:, None]
        labelled, rest = np.arange(2000) < 150, np.arange(2000) >= 150
        score = {r: auc(classifier.co_train(text[labelled], meta[labelled], y[labelled], text[rest], meta[rest], r, sure=0.9).scores(text[rest], meta[rest])[2], y[rest]) for r in (0, 3)}
        state = classifier.exchange_of(text[labelled], meta[labelled], y[labelled], sure=0.9)
        kept.append(sum(state.learn(list(range(rest.sum())), text[rest], meta[rest], state.picks(text[rest], meta[rest], state.thresholds()), 1000)))
        assert score[3] > 0.96 and score[3] >= score[0] - 0.005
    assert sum(k > 100 for k in kept) >= 2


@pytest.mark.parametrize("labels", [150, 500, 1900])
def test_exchange_does_no_harm_on_the_documents(sf_dir, labels):
    """Five splits of the labelled rows: the combined ranking of the other half after three rounds and after none, and how right the handed rows are."""
    import pyarrow.parquet as pq

    sf = sf_dir.replace("sf0.001", "sf0.1")
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    y = np.array([quality.get(r["doc_id"], -1) for r in rows])
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)[:4000]
    text = classifier.text_features([r["text"] for r in rows])
    meta = classifier.meta_features([(c, [r[c] for r in rows]) for c in ("lang", "source")], [r["n_chars"] for r in rows])
    score, meta_score, handed, right = {0: [], 3: []}, {0: [], 3: []}, 0, 0
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(known)
        fit, rest = order[:labels], order[len(order) // 2 :]
        for rounds in (0, 3):
            m = classifier.co_train(text[fit], meta[fit], y[fit], text[pool], meta[pool], rounds)
            _, by_meta, both = m.scores(text[rest], meta[rest])
            score[rounds].append(auc(both, y[rest]))
            meta_score[rounds].append(auc(by_meta, y[rest]))
            assert (m.both.weights >= 0).all()
        state = classifier.exchange_of(text[fit], meta[fit], y[fit])
        picks = state.picks(text[rest], meta[rest], state.thresholds())
        if all((picks[:, 0] == c).any() for c in (0, 1)):  # else nothing is handed over
            handed += int((picks[:, 0] >= 0).sum())
            right += int((picks[:, 0] == y[rest]).sum())
    assert np.mean(score[3]) >= np.mean(score[0]) and np.mean(meta_score[3]) >= np.mean(meta_score[0])
    assert handed > 1000 and right >= 0.95 * handed


def test_fit_hands_over_rows_of_the_whole_table(spark, sf_dir, monkeypatch):
    """The distributed passes hand over what an exchange in memory does, if nothing is cut by the bounds."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    raw, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = []
    learn = classifier.Exchange.learn
    monkeypatch.setattr(classifier.Exchange, "learn", lambda self, keys, *rest: seen.append(len(keys)) or learn(self, keys, *rest))
    monkeypatch.setattr(classifier.Exchange, "thresholds", lambda self: [(0.6, 0.6), (0.6, 0.6)])
    args = ("doc_id", "text", "quality", ("lang", "source"), "n_chars")
    model = classifier.fit(raw, labels, *args, labelled_rows=6000, handed_rows=1000, rounds=2, seed=11)
    known = {r.doc_id for r in labels.collect()}
    n = sum(r.doc_id not in known for r in raw.collect())
    assert model is not None and seen and 0.9 * n <= seen[0] <= 2 * n
    again = classifier.fit(raw.repartition(2, "doc_id"), labels, *args, labelled_rows=6000, handed_rows=1000, rounds=2, seed=11)
    assert np.array_equal(model.text.weights, again.text.weights) and np.array_equal(model.meta.weights, again.meta.weights)


def test_a_repeated_labelled_id_is_fitted_once(spark, sf_dir):
    raw, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    args = (labels, "doc_id", "text", "quality", ("lang", "source"), "n_chars")
    once, twice = (classifier.fit(x, *args, labelled_rows=6000, handed_rows=10, rounds=0, seed=11) for x in (raw, raw.unionByName(raw)))
    assert np.array_equal(once.text.weights, twice.text.weights)


def test_classifier_on_odd_rows(spark, sf_dir):
    raw, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    df = odd_docs(spark).withColumn("kept", F.lit(7))
    got = classifier.classify(df, labels, training=raw)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept_", "text_score", "meta_score", "score", "kept"]
    rows = got.collect()
    assert len(rows) == df.count() and all(r.score is not None and r.kept == (r.score >= 0.5) for r in rows)
    twice = [r.score for r in rows if r.doc_id == 5]
    assert len(twice) == 3 and len(set(twice)) == 1
    assert classifier.classify(empty_docs(spark), labels, training=raw).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 1), (1, 0)], [(None, 1), (2, None), (3, 9)]])
def test_without_both_classes_all_stay(spark, labels):
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    got = classifier.classify(odd_docs(spark), df).collect()
    assert len(got) == odd_docs(spark).count() and all(r.kept and r.score == 1 for r in got)


def test_features_of_very_long_text():
    assert np.isfinite(classifier.text_features([LONG * 3, None, ""])).all()
