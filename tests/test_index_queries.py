"""Every registered query of the index engine against its SQL."""

import oracle
import pytest

from backleaf.plans import queries, store_queries  # noqa: F401


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_published_leaf_reads_back(spark, sf_dir):
    from backleaf.functions import codec

    root, cp = codec.parse_revision(queries.QUERIES["publish_leaf"](spark, sf_dir).first().leaf.encode())
    assert root.hex() == queries.QUERIES["index_root"](spark, sf_dir).first().index_root
    assert cp.size == 1000 and cp.root.hex() == queries.QUERIES["log_root"](spark, sf_dir).first().root


def test_digests_deal_out_rows_that_a_join_has_dealt_by_key(spark):
    """Spark takes a join's shuffle by key for a repartition by it, and may read it where its parts lie once the join is one by broadcast."""
    from backleaf.operators import index

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([(b"k", 0, [1, 2]), (b"k", 1, [70000])], "key binary, chunk long, idxs array<long>")
        digests = index.digests(chunks.join(chunks.select("key").distinct(), "key", "left_semi"))
        above = digests._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].split("SortMergeJoin")[0]
        assert "Exchange" in above
        assert [r.n for r in digests.collect()] == [3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
