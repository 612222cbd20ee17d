import math

import brute_clusters
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quillon import queries
from quillon.operators import classify as cl
from quillon.operators import cluster as cs
from quillon.operators import refine as rf
from quillon.operators import weights as wt
from quillon.plans import clustering, iteration, topics
from quillon.plans.iteration import number_rows, stage
from quillon.sources import tsv
from quillon.streaming.classify import classify_stream

GENRES = """Alex\tPop\t10\tR&B\t6\tRock\t4
Bob\tJazz\t8\tReggae\t9
Dave\tClassic\t4\tWorld\t4
Ted\tJazz\t9\tMetal\t2\tReggae\t6
Fred\tPop\t4\tRock\t3\tHip-hop\t3
Sam\tClassic\t8\tRock\t1"""
ON = ["abc", "ac", "ab", "def", "df", "de"]


@pytest.fixture
def genres(spark, tmp_path):
    (tmp_path / "in.tsv").write_text(GENRES + "\n")
    return tsv.read_vectors(spark, str(tmp_path / "in.tsv"))


@pytest.fixture
def letters(spark):
    rows = [(i, c, 2.0 if c in on else -1.0) for i, on in enumerate(ON) for c in "abcdef"]
    docs = spark.createDataFrame([(i, str(i + 1)) for i in range(6)], "ord long, doc_id string")
    return docs, spark.createDataFrame(rows, "ord long, feature string, value double")


def test_parser(spark, tmp_path):
    lines = ["d1\ta\t2\tb\t3abc", "d2", "d3\tx\t1\tx\t0\tx\t5\ty", "d4\t\t7\tz\tfoo\tw\t-1.5", "", "d5\tx\t5\tx\t0", "d6\tq\tnan\tr\t1e400\ts\t 2"]
    (tmp_path / "f.tsv").write_text("\n".join(lines))
    docs, features = tsv.read_vectors(spark, str(tmp_path / "f.tsv"))
    assert [(r["ord"], r["doc_id"]) for r in docs.orderBy("ord").collect()] == [(0, "d1"), (1, "d2"), (2, "d3"), (3, "d4"), (4, "d5"), (5, "d6")]
    assert {(r["ord"], r["feature"]): r["value"] for r in features.collect()} == {(0, "a"): 2, (0, "b"): 3, (2, "x"): 5, (3, "w"): -1.5, (4, "x"): 5, (5, "s"): 2}
    every = tsv.read_lines(spark, str(tmp_path / "f.tsv"), skip_empty=False)
    assert every.count() == 7


def test_numbering(spark):
    got = number_rows(spark.range(1000).repartition(7), "n", "id", start=5).collect()
    assert {(r["id"], r["n"]) for r in got} == {(i, i + 5) for i in range(1000)}
    assert number_rows(spark.range(0), "n", "id").count() == 0


def test_weights(spark, genres):
    _, features = genres
    found = {(r["ord"], r["feature"]): r["value"] for r in wt.idf(features, 6).collect()}
    assert found[0, "Pop"] == pytest.approx(10.986123, abs=1e-6) and found[5, "Rock"] == pytest.approx(0.693147, abs=1e-6) and found[3, "Metal"] == pytest.approx(3.583519, abs=1e-6)
    score = {(r["ord"], r["feature"]): r["value"] for r in wt.standard_score(features).collect()}
    assert score[0, "Pop"] == pytest.approx(66.864418, abs=1e-6)
    codes = {r["feature"]: r["code"] for r in wt.vocabulary(features).collect()}
    assert codes == {"Pop": 0, "R&B": 1, "Rock": 2, "Jazz": 3, "Reggae": 4, "Classic": 5, "World": 6, "Hip-hop": 8, "Metal": 7}
    constant = spark.createDataFrame([(0, "a", 2.0), (1, "a", 2.0)], "ord long, feature string, value double")
    assert {r["value"] for r in wt.standard_score(constant).collect()} == {50.0}


def test_heaviest_idf_is_the_heaviest_of_idf(spark, monkeypatch):
    features = queries.tables.token_features(spark, SMALL).filter("ord < 60").persist()
    rows = lambda df: sorted((r["ord"], r["feature"], r["value"]) for r in df.select("ord", "feature", "value").collect())
    found = wt.heaviest_idf(features, 60, 7)
    assert rows(found) == rows(wt.heaviest(wt.idf(features, 60), 7)) and "BroadcastExchange" in found._jdf.queryExecution().toString()
    assert all("hashpartitioning(feature" not in line for line in found._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_many_counted_features_do_not_move_all_features(spark, monkeypatch):
    """With more counted features than may be broadcast all features were shuffled to them."""
    features = stage(queries.tables.token_features(spark, SMALL).filter("ord < 60"), "features")
    rows = lambda df: sorted((r["ord"], r["feature"], r["value"]) for r in df.select("ord", "feature", "value").collect())
    monkeypatch.setattr(iteration, "BROADCAST_ROWS", 300)
    found = wt.heaviest_idf(features, 60, 7)
    assert rows(found) == rows(wt.heaviest(wt.idf(features, 60), 7))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(iteration, "BROADCAST_ROWS", 0)  # not even one df
    assert rows(wt.heaviest_idf(features, 60, 7)) == rows(found)


def test_clusters(spark, letters):
    docs, features = letters
    u = cs.unit(features)
    for method in ("rb", "kmeans"):
        for seed in (1, 12345):
            found = {r["ord"]: r["cluster_id"] for r in clustering.cluster(u, docs, method, n=2, seed=seed).collect()}
            assert len(found) == 6 and len({found[i] for i in (0, 1, 2)}) == 1 and len({found[i] for i in (3, 4, 5)}) == 1 and found[0] != found[3]
    assign = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(6)], "ord long, cluster_id long")
    points = {r["ord"]: r["point"] for r in cs.points(u, assign, docs).collect()}
    assert points[0] == pytest.approx(0.941696, abs=1e-6) and points[1] == pytest.approx(0.772462, abs=1e-6)
    norms = [r["norm"] for r in cs.composite_norms(cs.composite(u, assign)).collect()]
    assert sum(norms) == pytest.approx(4.973241, abs=1e-6)
    parent = assign.select("ord", F.lit(1).cast("long").alias("cluster_id"))
    child = parent.join(assign.withColumnRenamed("cluster_id", "child"), "ord")
    assert cs.sectioned_gain(u, parent, child).first()["gain"] == pytest.approx(3.790025, abs=1e-6)
    lines = {r["cluster_id"]: r["line"] for r in tsv.cluster_lines(cs.points(u, assign, docs), True).collect()}
    assert lines[1] == "1\t1\t0.941696\t2\t0.772462\t3\t0.772462"
    top = cs.centroid_top(cs.centroid(cs.composite(u, assign)), features, 3)
    assert {r["cluster_id"]: r["line"] for r in tsv.centroid_lines(top).collect()}[1].startswith("1\ta\t0.672036\tf\t-0.336018")


def test_cluster_edges(spark, letters):
    docs, features = letters
    u = cs.unit(features)
    more = docs.union(spark.createDataFrame([(6, "empty")], "ord long, doc_id string"))
    assert clustering.kmeans(u, docs, 7).count() == 0
    assert clustering.kmeans(u, more, 2).count() == 7
    assert clustering.repeated_bisection(u, more, n=3).count() == 7
    assert clustering.repeated_bisection(u, docs, n=1).select("cluster_id").distinct().count() == 1
    assert clustering.repeated_bisection(u, docs, limit=100.0).select("cluster_id").distinct().count() == 1
    assert clustering.repeated_bisection(u, docs, limit=3.0).select("cluster_id").distinct().count() == 2
    for bad in (dict(method="kmeans", limit=1.0), dict(method="other", n=2), dict(method="rb")):
        with pytest.raises(ValueError):
            clustering.cluster(u, docs, **bad)


def test_limit_without_a_bound_on_clusters(spark, monkeypatch):
    docs = spark.range(10_100).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("doc_id"))
    u = docs.select("ord", F.col("doc_id").alias("feature"), F.lit(1.0).alias("w"))
    bit = lambda u, members, seed, passes: members.select("ord", "grp", F.expr("cast(shiftright(ord, cast(floor(log2(grp)) AS int)) & 1 AS int)").alias("child"))
    monkeypatch.setattr(clustering, "split_groups", bit)  # a single split by the document's number, for time
    assert clustering.repeated_bisection(u, docs, limit=0.5).select("cluster_id").distinct().count() == 10_100  # two unlike documents gain 0.586


def test_deep_clusters(spark, letters, monkeypatch):
    docs, features = letters
    u = cs.unit(features)
    peel = lambda u, members, seed, passes: members.join(members.groupBy("grp").agg(F.min("ord").alias("m")), "grp").select("ord", "grp", F.when(F.col("ord") == F.col("m"), 0).otherwise(1).alias("child"))
    monkeypatch.setattr(clustering, "split_groups", peel)
    monkeypatch.setattr(clustering, "DEEPEST", 2)  # as if numbers ran out after two splits
    assert clustering.repeated_bisection(u, docs, limit=1e-9).select("cluster_id").distinct().count() == 6


def test_classify(spark, genres):
    docs, features = genres
    u = cs.unit(features)
    assign = spark.createDataFrame([(0, 1), (4, 1), (1, 2), (3, 2), (2, 3), (5, 3)], "ord long, cluster_id long")
    comp = cs.composite(u, assign)
    cents = cl.make_centroids(cs.centroid(comp).select(F.col("cluster_id").alias("cent_ord"), F.col("cluster_id").cast("string").alias("cluster"), "feature", F.col("w").alias("value")))
    brute = {(r["ord"], r["rank"]): (r["cluster"], r["point"]) for r in cl.classify(u, cents, inv_keys=0).collect()}
    assert brute[0, 1][0] == "1" and brute[0, 1][1] == pytest.approx(0.928262, abs=1e-6) and brute[0, 2][1] == pytest.approx(0.021814, abs=1e-6)
    assert brute[5, 2] == ("1", pytest.approx(0.056050, abs=1e-6)) and len(brute) == 9
    one = {(r["ord"], r["rank"]): r["cluster"] for r in cl.classify(u, cents, inv_keys=1).collect()}
    assert one == {(0, 1): "1", (1, 1): "2", (2, 1): "3", (3, 1): "2", (4, 1): "1", (5, 1): "3"}
    assert cl.classify(u, cents, inv_size=0).count() == 0
    rock = [(r["cent_ord"], r["w_raw"]) for r in cl.inverted_index(cents, 1).filter("feature = 'Rock'").collect()]
    assert rock == [(1, pytest.approx(0.451887, abs=1e-6))]
    assert cl.count_vectors(cents) == 3


def test_stream(spark, genres, tmp_path):
    _, features = genres
    vectors = features.select(F.col("ord").alias("cent_ord"), F.col("ord").cast("string").alias("cluster"), "feature", "value")
    (tmp_path / "live").mkdir()
    (tmp_path / "live" / "a.tsv").write_text("x\tPop\t1\ny\tnothing\t1\n")
    got = []
    classify_stream(spark, str(tmp_path / "live"), cl.make_centroids(vectors), lambda df, i: got.extend(r["line"] for r in df.collect()), str(tmp_path / "state"), k=1).awaitTermination()
    assert len(got) == 2 and "y" in got and any(x.startswith("x\t0\t0.8") for x in got)


def test_topics(spark, genres):
    docs, features = genres
    pdz, pwz, pz = topics.plsi(features, 3, 4)
    assert sum(pz) == pytest.approx(1)
    for z in range(3):
        assert pdz.agg(F.sum(f"d{z}")).first()[0] == pytest.approx(1) and pwz.agg(F.sum(f"w{z}")).first()[0] == pytest.approx(1)
    for r in topics.plsi_membership(pdz, pz, True).groupBy("ord").agg(F.sum("p").alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    tokens = topics.lda_tokens(features, 2)
    total = features.agg(F.sum(F.ceil("value"))).first()[0]
    assert tokens.count() == total
    after = topics.gibbs(tokens, 2, 3)
    assert after.count() == total
    for r in topics.theta(after, 2).groupBy("ord").agg(F.sum("p").alias("s"), F.min("p").alias("m")).collect():
        assert r["s"] == pytest.approx(1) and r["m"] > 0
    for r in topics.phi(after, 2).groupBy("topic").agg(F.sum("p").alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    with pytest.raises(ValueError):
        topics.gibbs(tokens, 2, 1, alpha=-1.0)
    lines = tsv.membership_lines(docs, topics.plsi_membership(pdz, pz, True)).collect()
    assert len(lines) == 6 and all(len(r["line"].split("\t")) == 4 for r in lines)


def test_topics_of_documents_without_features(spark, genres):
    docs, features = genres
    more = docs.union(spark.createDataFrame([(6, "empty")], "ord long, doc_id string"))
    pdz, _, pz = topics.plsi(features, 3, 2, docs=more)
    same, _, same_pz = topics.plsi(features, 3, 2)
    assert pz == pytest.approx(same_pz)
    lines = {r["ord"]: r["line"] for r in tsv.membership_lines(more, topics.plsi_membership(pdz, pz, True)).collect()}
    assert lines.pop(6) == "empty\t0.000000\t0.000000\t0.000000"
    assert lines == {r["ord"]: r["line"] for r in tsv.membership_lines(docs, topics.plsi_membership(same, same_pz, True)).collect()}
    shares = topics.theta(topics.lda_tokens(features, 2), 2, docs=more).filter("ord = 6").collect()
    assert [r["p"] for r in shares] == [0.5, 0.5]


def test_registered_searches_are_whole(spark, monkeypatch):
    ran = {}
    monkeypatch.setattr(clustering, "cluster", lambda u, docs, method, n=None, limit=None, seed=0, passes=clustering.PASSES: ran.setdefault((method, n, limit), passes))
    monkeypatch.setattr(topics, "gibbs", lambda tokens, k, iterations=topics.GIBBS_ITERATIONS: ran.setdefault("gibbs", iterations) and tokens)
    for name in ("kmeans_clusters", "rb_clusters", "rb_limit_clusters", "lda_theta", "lda_phi"):
        queries.QUERIES[name](spark, SMALL)
    assert ran == {("kmeans", 20, None): 30, ("rb", 20, None): 30, ("rb", None, 5.0): 30, "gibbs": 100}


def test_objective_never_falls(spark, genres):
    _, features = genres
    u = cs.unit(features)
    state = spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "ord long, grp long, child int")
    total = lambda s: sum(math.sqrt(r["q"]) for r in u.join(s, "ord").groupBy("child", "feature").agg(F.sum("w").alias("s")).groupBy("child").agg(F.sum(F.col("s") * F.col("s")).alias("q")).collect())
    before = total(state)
    for cells in (0, None):  # distributed, and inside one task
        assert before <= total(clustering.refine(u, state, 2, local_cells=cells)) <= 4.632181


def test_passes_end_without_gaining_moves(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = spark.createDataFrame([(i, str(f), float(x[i, f])) for i in range(300) for f in range(3)], "ord long, feature string, w double")
    start = spark.createDataFrame([(i, 0, i % 2) for i in range(300)], "ord long, grp long, child int")
    state = clustering.refine(u, start, 2, local_cells=0)
    comp = rf.wide_composite(u, state, 2)
    assert rf.best_moves(u, state, comp, rf.wide_norms(comp, 2), 2).filter(F.col("gain") > rf.EPSILON).count() == 0


def test_refinement_is_alike_at_every_size(spark, monkeypatch):
    """A group's result depends neither on the groups beside it nor on how composites reach the documents."""
    rng = np.random.default_rng(7)
    x = rng.random((240, 6)) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, str(f), float(x[i, f])) for i in range(240) for f in range(6)]
    u = spark.createDataFrame(rows, "ord long, feature string, w double")
    start = spark.createDataFrame([(i, i // 80, i % 3) for i in range(240)], "ord long, grp long, child int")
    start = start.filter("ord < 200")  # the last group is half as large
    u = u.filter("ord < 200")
    found = {r["ord"]: r["child"] for r in clustering.refine(u, start, 3).collect()}
    x = x[:200]
    for g in range(3):
        mine = range(80 * g, min(80 * g + 80, 200))
        want = brute_clusters.refine(x[mine.start : mine.stop], np.arange(mine.start, mine.stop) % 3, 3)
        assert [found[i] for i in mine] == want.tolist()
    for cells in (0, 1_000):  # all distributed; only the last group in a task
        assert {r["ord"]: r["child"] for r in clustering.refine(u, start, 3, local_cells=cells).collect()} == found
    monkeypatch.setattr(rf, "BROADCAST_CELLS", -3)
    assert {r["ord"]: r["child"] for r in clustering.refine(u, start, 3, local_cells=0).collect()} == found


def vectors_of(u, docs):
    ords = sorted(r["ord"] for r in docs.select("ord").collect())
    return brute_clusters.dense([(r["ord"], r["feature"], r["w"]) for r in u.collect()], ords), ords


def test_kmeans_query_matches_brute_force(spark):
    u, ords = vectors_of(queries._pruned(spark, SMALL), queries.tables.document_rows(spark, SMALL))
    found = {r["ord"]: r["cluster_id"] for r in queries.kmeans_clusters(spark, SMALL).collect()}
    assert found == brute_clusters.kmeans(u, ords, 20)


def test_bisection_matches_brute_force(spark):
    pruned, docs = queries._pruned(spark, SMALL), queries.tables.document_rows(spark, SMALL)
    u, ords = vectors_of(pruned, docs)
    found = {r["ord"]: r["cluster_id"] for r in clustering.cluster(pruned, docs, "rb", n=5).collect()}
    assert found == brute_clusters.bisect(u, ords, n=5)


def test_limited_bisection_query_matches_brute_force(spark):
    emb = cs.unit(queries.tables.embedding_features(spark, SMALL))
    u, ords = vectors_of(emb, emb.select("ord").distinct())
    found = {r["ord"]: r["cluster_id"] for r in queries.rb_limit_clusters(spark, SMALL).collect()}
    assert found == brute_clusters.bisect(u, ords, limit=5.0)


def test_sampler_matches_brute_force(spark):
    tokens = topics.lda_tokens(queries.tables.user_event_features(spark, SMALL), 3)
    before = {(r["ord"], r["feature"], r["i"]): r["topic"] for r in tokens.collect()}
    after = {(r["ord"], r["feature"], r["i"]): r["topic"] for r in topics.gibbs(tokens, 3, 5).collect()}
    assert after == brute_clusters.gibbs(before, 3, 5, 50.0 / 3, 0.01) != before
    dealt = topics.gibbs(tokens, 3, 2, tokens_per_task=200)  # several buckets, each with its own state
    assert dealt.count() == len(before) and dealt.columns == ["ord", "feature", "i", "topic"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r["ord"], r["feature"], r["i"]): r["topic"] for r in topics.gibbs(tokens, 3, 5).collect()} == after
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def some_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.random((60, 6)) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    docs = spark.createDataFrame([(i, str(i)) for i in range(61)], "ord long, doc_id string")  # the last one has no features
    return x, docs, spark.createDataFrame([(i, str(f), float(x[i, f])) for i in range(60) for f in range(6)], "ord long, feature string, w double")


@pytest.mark.parametrize("method, n, limit, most", [("kmeans", 6, None, 40), ("rb", 6, None, 40), ("rb", None, 0.8, 180)])
def test_searches_that_fit_a_task_take_few_jobs(spark, monkeypatch, method, n, limit, most):
    """Seeds, splits and passes of a job or more each took minutes on small tables; the clusters are the same."""
    x, docs, u = some_vectors(spark)
    search = lambda: {r["ord"]: r["cluster_id"] for r in clustering.cluster(u, docs, method, n, limit).collect()}
    found, jobs = jobs_of(spark, f"{method}-{n}", search)
    all_x = np.vstack([x, np.zeros(6)])
    assert found == (brute_clusters.kmeans(all_x, list(range(61)), n) if method == "kmeans" else brute_clusters.bisect(all_x, list(range(61)), n, limit))
    assert 3 <= len(set(found.values())) and jobs < most
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 40_000 if n is None or method == "rb" else 0)  # only parts fit a task, or nothing
    assert search() == found


@pytest.mark.parametrize("n, limit", [(6, None), (None, 0.8)])
def test_bisection_of_packed_vectors_is_alike_at_every_size(spark, monkeypatch, n, limit):
    """Inside one task, and with a job a pass over packed vectors; a cluster too large for a task took many jobs a pass."""
    x, docs, u = some_vectors(spark)
    want = brute_clusters.bisect(np.vstack([x, np.zeros(6)]), list(range(61)), n, limit)
    search = lambda: {r["ord"]: r["cluster_id"] for r in clustering.cluster(u, docs, "rb", n, limit).collect()}
    monkeypatch.setattr(clustering, "PACKED_CELLS", 100)
    found, jobs = jobs_of(spark, f"limit-{n}", search)
    assert found == want and jobs < 40
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 0)
    assert search() == want
    monkeypatch.setattr(rf, "BROADCAST_CELLS", 0)
    assert clustering.pack(u, docs) is None


def test_kmeans_of_packed_vectors_takes_a_job_a_pass(spark, monkeypatch):
    """A corpus too large for a task took several jobs a seed and a pass; the clusters are the same, with features of one document too."""
    x, docs, u = some_vectors(spark)
    alone = spark.createDataFrame([(i, f"own{i}", 0.5) for i in range(0, 60, 3)] + [(60, "own60", 0.8), (60, "more60", 0.6)], u.schema)
    x = np.hstack([x, np.zeros((60, 22))])
    for at, i in enumerate(range(0, 60, 3)):
        x[i, 6 + at] = 0.5
    x = np.vstack([x, np.append(np.zeros(26), [0.8, 0.6])])
    u = u.union(alone)
    want = brute_clusters.kmeans(x, list(range(61)), 6)
    search = lambda method="kmeans": {r["ord"]: r["cluster_id"] for r in clustering.cluster(u, docs, method, 6).collect()}
    assert search() == want
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 0)
    monkeypatch.setattr(clustering, "PACKED_CELLS", 100)
    monkeypatch.setattr(clustering, "kmeans", never)
    packed = clustering.pack(u, docs, 6)
    assert packed.width == 6 and packed.rows.agg(F.sum("rest")).first()[0] == pytest.approx(20 * 0.25 + 1)
    found, jobs = jobs_of(spark, "packed-kmeans", search)
    assert found == want and jobs < 80
    assert search("rb") == brute_clusters.bisect(x, list(range(61)), 6)


def test_bisection_counts_shared_features_alone(spark, monkeypatch):
    """Features of one document each counted against the bound on packed features, beyond which splits are joins."""
    x, docs, u = some_vectors(spark)
    alone = spark.createDataFrame([(i, f"own{i}", 0.5) for i in range(60)], u.schema)
    monkeypatch.setattr(rf, "BROADCAST_CELLS", 70)  # 35 features before
    monkeypatch.setattr(clustering, "COMPOSITE_CELLS", 12)
    assert clustering.pack(u.union(alone), docs).width == 6


def never(*args, **named):
    raise AssertionError("not to be called")


def test_limited_search_of_full_vectors_stays_in_tasks(spark, monkeypatch):
    """0.1 GB of embeddings were packed from a row a cell, and took a job a pass where a matrix fits a task."""
    x, docs, u = some_vectors(spark)
    want = brute_clusters.bisect(np.vstack([x, np.zeros(6)]), list(range(61)), limit=0.8)
    monkeypatch.setattr(clustering, "split_packed", never)
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 20_000)  # 366 cells, and 400 as a matrix or 120 otherwise
    search = lambda given: {r["ord"]: r["cluster_id"] for r in clustering.cluster(given, docs, "rb", limit=0.8).collect()}
    assert search(u) == want
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)] + [(60, None)], "ord long, x array<double>")
    shared_out, dealt = clustering.shared_out, []
    monkeypatch.setattr(clustering, "shared_out", lambda spark, loads, most: dealt.append(len(loads)) or shared_out(spark, loads, most))
    monkeypatch.setattr(clustering, "SHARED_CELLS", 100)
    with monkeypatch.context() as m:
        m.setattr(clustering, "pack", never)
        assert search(clustering.pack_arrays(rows, u)) == want and dealt[:2] == [1, 2]
        m.setattr(queries.clustering, "cluster", lambda given, *args, **named: given)
        assert isinstance(queries.rb_limit_clusters(spark, SMALL), clustering.Packed)
    monkeypatch.setattr(clustering, "DEEPEST", 2)  # below the first split from the long form
    assert search(clustering.pack_arrays(rows, u)) == search(u) and len(set(search(u).values())) > 2


def test_clusters_are_dealt_evenly(spark):
    slots, parts = clustering.shared_out(spark, {g: 10 - g for g in range(1, 9)}, 4)
    rows = slots.repartition(parts, "slot").select("grp", F.spark_partition_id().alias("part")).collect()
    loads = {p: sum(10 - r["grp"] for r in rows if r["part"] == p) for p in {r["part"] for r in rows}}
    assert parts == 4 and sorted(loads.values()) == [11, 11, 11, 11]


def test_arrays_are_packed_as_their_long_form(spark):
    arrays = [[3.0, 0.0, 4.0], [0.0, 0.0], None, [], [None, 2.0], [1e-200, 0.0, 1.0], [1e-200], [1.0, 2.0, 2.0, 4.0]]
    rows = spark.createDataFrame(list(enumerate(arrays)), "ord long, x array<float>")
    long = rows.select("ord", F.posexplode("x").alias("pos", "v")).select("ord", F.col("pos").cast("string").alias("feature"), F.col("v").cast("double").alias("value"))
    u = cs.unit(long.filter("value <> 0"))
    packed = clustering.pack_arrays(rows, u)
    found = {(r["ord"], str(f)): w for r in packed.rows.collect() for f, w in zip(np.frombuffer(r["codes"], np.int32), np.frombuffer(r["w"]), strict=True)}
    bare = {(i, "0"): 0.0 for i in {*range(8)} - {r["ord"] for r in u.collect()}}
    assert packed.width == 4 and packed.rows.count() == 8 and {(1, "0"), (2, "0"), (3, "0")} <= set(bare)
    assert found == pytest.approx({(r["ord"], r["feature"]): r["w"] for r in u.collect()} | bare)
    for other in (rows.union(rows), rows.union(spark.createDataFrame([(None, [1.0])], rows.schema)), rows.limit(0)):
        assert clustering.pack_arrays(other, u) is None  # these take the long form


def test_pruning_gets_whole_documents(spark):
    """Features dealt by document and feature let every partition keep 50 of a document, so nearly all were shuffled."""
    counts = queries.tables.token_features(spark, SMALL, together=True)
    rows = counts.withColumn("part", F.spark_partition_id())
    assert rows.groupBy("ord").agg(F.countDistinct("part").alias("n")).filter("n > 1").isEmpty()
    assert "hashpartitioning(ord" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(counts.collect()) == sorted(queries.tables.token_features(spark, SMALL).collect())
    pruned = queries._pruned(spark, SMALL)
    assert pruned.groupBy("ord").count().agg(F.max("count")).first()[0] == 50


def test_sweeps_of_one_bucket_are_one_job(spark):
    """Lasting a job or more each, 100 sweeps of a small corpus took minutes."""
    tokens = topics.lda_tokens(queries.tables.user_event_features(spark, SMALL), 3)
    spark.sparkContext.setJobGroup("sweeps", "sweeps")
    try:
        topics.gibbs(tokens, 3, 40)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("sweeps")) < 20


def test_sampler_of_several_buckets_matches_brute_force(spark, monkeypatch):
    tokens = topics.lda_tokens(queries.tables.user_event_features(spark, SMALL), 3)
    buckets = {r["ord"]: r["b"] for r in tokens.select("ord", F.expr("pmod(xxhash64(ord), 5) AS b")).distinct().collect()}
    before = {(r["ord"], r["feature"], r["i"]): r["topic"] for r in tokens.collect()}
    want = brute_clusters.gibbs_buckets(before, buckets.get, 3, 3, 50.0 / 3, 0.01)
    assert len(set(buckets.values())) > 2
    for few in (topics.FEW, 0):  # as plain numbers and as arrays
        monkeypatch.setattr(topics, "FEW", few)
        assert {(r["ord"], r["feature"], r["i"]): r["topic"] for r in topics.gibbs(tokens, 3, 3, tokens_per_task=200).collect()} == want


def test_cursor_removal_and_order(spark, letters, caplog):
    docs, features = letters
    u = cs.unit(features)
    with caplog.at_level("DEBUG", logger="quillon"):
        found = clustering.cluster(u, docs, "rb", n=2)
    assert "gain 3.790025" in caplog.text
    cursor = clustering.results(found)
    assert sorted([next(cursor)["ords"], next(cursor)["ords"]]) == [[0, 1, 2], [3, 4, 5]] and next(cursor, None) is None
    left = cs.remove_members(found, docs, spark.createDataFrame([("1",), ("9",)], "doc_id string"))
    assert sorted(r["ord"] for r in left.collect()) == [1, 2, 3, 4, 5]
    assert [(r["size"], r["place"]) for r in cs.by_size(left).orderBy("place").collect()] == [(3, 1), (2, 2)]


def test_many_centroids_are_compared_alike(spark, monkeypatch):
    """Centroids as columns and as rows give the same similarities, with and without candidates."""
    u = cs.unit(queries.tables.token_features(spark, SMALL)).filter("ord < 60").persist()
    cents = cl.make_centroids(u.filter("ord % 7 = 0").select(F.col("ord").alias("cent_ord"), F.col("ord").cast("string").alias("cluster"), "feature", F.col("w").alias("value")))
    rows = lambda df: sorted((r["ord"], r["rank"], r["cluster"], round(r["point"], 9)) for r in df.collect())
    wide = [rows(cl.classify(u, cents, keys, 3, 4)) for keys in (0, 2)]
    monkeypatch.setattr(cl, "WIDE", 0)
    assert [rows(cl.classify(u, cents, keys, 3, 4)) for keys in (0, 2)] == wide and wide[0] != wide[1]
