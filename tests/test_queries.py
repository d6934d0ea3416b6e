import duckdb
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from chronoloom.plans.graph_queries import ORACLES, QUERIES, graph


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, con, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["temporal_attention", "link_logits"])
def test_attention_of_large_scores_matches_sql(spark, data, tmp_path, name):
    # scores grow with the logarithm of degrees: their exponentials overflow unless the largest is taken off
    spark.read.parquet(f"{data}/events.parquet").withColumn("value", F.col("value") * 8).write.parquet(f"{tmp_path}/events.parquet")
    sql = duckdb.connect()
    sql.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sql.sql(ORACLES[name]).df()
    assert len(want) and want.notna().all(axis=None)
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(want)


def test_entry_without_or_with_text_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_two_hop_takes_both_ends_of_every_event(spark, data, tmp_path):
    given = spark.read.parquet(f"{data}/events.parquet")
    given.orderBy("ts").limit(120).write.parquet(f"{tmp_path}/events.parquet")
    events = graph(spark, str(tmp_path)).select("eid", "src", "dst", "ts").collect()
    both = [y for e, a, b, t in events for y in ((2 * e, a, b, t), (2 * e + 1, b, a, t))]

    def latest(roots, k):
        out = set()
        for root, at in roots:
            before = sorted(((t, e, d) for e, s, d, t in both if s == root and t < at), reverse=True)[:k]
            out |= {(root, at, e, d, at - t, i) for i, (t, e, d) in enumerate(before, 1)}
        return out

    first = latest({(s, t) for _, s, _, t in both}, 3)
    second = latest({(x[3], x[1]) for x in first}, 2)
    columns = ["hop", "root", "root_ts", "nbr_eid", "nbr", "dt", "rank"]
    got = {tuple(x) for x in QUERIES["two_hop_events"](spark, str(tmp_path)).select(columns).collect()}
    assert first and got == {(1, *x) for x in first} | {(2, *x) for x in second}
    assert {x[1] for x in got} & {b for _, _, b, _ in events} and {x[0] for x in QUERIES["sample_unique_nodes_events"](spark, str(tmp_path)).collect()} == {x[4] for x in got}


def test_whole_vectors_are_passed(spark, data):
    size = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    got = QUERIES["message_pass_whole_vectors"](spark, data)
    assert sorted(x["i"] for x in got.select("i").distinct().collect()) == list(range(size))


def test_vectors_are_passed_to_their_end(spark, data, tmp_path):
    size = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    assert {x["i"] for x in QUERIES["message_pass_vectors"](spark, data).select("i").distinct().collect()} == set(range(size))
    # and vectors of other lengths
    vectors = [(0, [0.5 + i for i in range(70)]), (1, [1.0, None, 3.0]), (2, []), (3, None), (4, [2.0] * 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = [(s, d, float(3 * s + d)) for s in range(6) for d in range(4) if s != d] + [(1, 9, 2.0), (2, 8, 1.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        sql.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = rows(QUERIES["message_pass_vectors"](spark, str(tmp_path)).toPandas())
    assert got == rows(sql.sql(ORACLES["message_pass_vectors"]).df()) and len(got[1]) == 3 * 70 + 5 + 3
