"""Steps whose cost must not grow with tables that they do not need."""

from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import drift, federation, history, intelligence, store
from lodestone.plans.graph import NODE_COLUMNS, Graph
from lodestone.plans.star import star_graph, stored_star_graph

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_by_rank_at_any_size(spark):
    n = 60_000  # so many that ranges are cut by a sample of the files
    nodes = store.conform(spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("file_path")), NODE_COLUMNS)
    got = federation.partition_files(Graph(nodes, spark.createDataFrame([], "src bigint, dst bigint, type string")), 7).orderBy("file_path").collect()
    each = -(-n // 7)
    assert [r.part for r in got] == [i // each for i in range(n)]


def test_a_graph_stored_apart_is_the_same_and_is_not_shuffled(spark, tmp_path, monkeypatch):
    g, key = star_graph(spark, SF), "spark.sql.maxConcurrentOutputFileWriters"
    before, hints = spark.conf.get(key), []
    kind = type(g.nodes)
    hint = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, name, *a: (hints.append(name), hint(self, name, *a))[1])
    store.save(g, str(tmp_path / "g"), apart=True)
    assert not hints and spark.conf.get(key) == before
    back = store.load(spark, str(tmp_path / "g"))
    for a, b in ((g.nodes, back.nodes), (g.edges, back.edges)):
        assert a.exceptAll(b.select(*a.columns)).isEmpty() and a.count() == b.count()


def test_few_rules_and_marks_do_not_shuffle_nodes(spark):
    g, key = stored_star_graph(spark, SF), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")  # nodes are too large for a broadcast, rules and marks are not
    try:
        layers = plan(drift.layer_breaches(g, queries._rules(g, '{"type":"REQUIRED_LAYER","order":["Class","Method","Domain","Function"]}')))
        calls = plan(drift.call_excess(g, queries._rules(g, '{"type":"MAX_OUTGOING_CALLS","label":"Method","max":1}')))
        marked = plan(queries._decorated(g))
    finally:
        spark.conf.set(key, before)
    assert "hashpartitioning(label" not in layers + calls and "hashpartitioning(layer" not in layers
    assert "hashpartitioning" not in marked


def test_pairs_of_files_are_added_up_by_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(history, "TASK_PAIRS", 10)
    commits = spark.range(300).select((F.col("id") % 100).alias("commit"), (F.col("id") % 3 + F.col("id") % 2 * 3).alias("file"))
    assert "REPARTITION_BY_NUM" in plan(history.coupling_pairs(commits, 1, 0.0))


def test_communities_are_counted_from_labels_worked_out_once(spark):
    met = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            met.add(len(x))
            yield x

    labels = spark.range(40).select("id", (F.col("id") % 4).alias("community")).mapInPandas(count, "id long, community long")
    edges = spark.range(36).select(F.col("id").alias("src"), (F.col("id") + 4).alias("dst"))
    rows = intelligence.community_stats(labels, edges).collect()
    assert [(r.community, r["size"], r.density) for r in rows] == [(k, 10, 0.2) for k in range(4)]
    assert met.value == 40


def test_communities_of_customers_store_and_read_no_other_tables(spark, monkeypatch):
    seen, spread = [], intelligence.propagate_labels
    monkeypatch.setattr(queries, "stored_star_graph", lambda *_: 1 / 0)
    monkeypatch.setattr(intelligence, "propagate_labels", lambda nodes, edges, rounds: (seen.extend((nodes, edges)), spread(nodes, edges, rounds))[1])
    assert queries.queries()["community_stats"](spark, SF).count() > 0
    read = {f.rsplit("/", 1)[1] for df in seen for f in df.inputFiles()}
    assert read == {"customer.parquet", "nation.parquet", "region.parquet"}


def test_labels_are_not_broadcast(spark):
    edges = spark.range(36).select(F.col("id").alias("src"), (F.col("id") + 4).alias("dst"))
    labels = intelligence.propagate_labels(spark.range(40), edges, 1)
    assert "Broadcast" not in plan(labels)
    inside = [x for x in plan(intelligence.community_stats(labels, edges)).splitlines() if "Join [" in x and ("src#" in x or "dst#" in x)]
    assert len(inside) == 2 and all("SortMergeJoin" in x for x in inside)
