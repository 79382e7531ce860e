import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import highlight as hl, vectors
from marginalia.functions.vectors import distance, mean_vectors, nearest, unit
from marginalia.operators import duplicates, fts, ivf, navigate, search
from marginalia.plans.queries import QUERIES

VECTOR = "id long, g long, v array<float>"


def test_pool_sizes():
    assert [search.candidate_count(k) for k in (1, 10, 25, 100, 400)] == [50, 50, 50, 200, 500]
    assert [search.rerank_pool(50, k) for k in (1, 4, 5, 10, 30)] == [2, 8, 10, 10, 30] and search.rerank_pool(3, 10) == 3


def test_fusion_interleaves(spark):
    a = spark.createDataFrame([(0, i, i) for i in range(1, 21)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(0, 100 + i, i) for i in range(1, 21)], "query_id long, id long, rank int")
    got = [r.id for r in search.fuse([a, b], 10).orderBy("rank").collect()]
    assert got == [x for i in range(1, 6) for x in (i, 100 + i)]


def test_rerank_orders_and_cuts(spark):
    rows = [(0, i, i, "red apple", t) for i, t in enumerate(["none", "red apple pie", "a red one"], 1)]
    got = search.rerank(spark.createDataFrame(rows, "query_id long, id long, rank int, query string, text string"), 2)
    assert [(r.id, r.rerank_score) for r in got.orderBy("position").collect()] == [(2, 1.0), (3, 0.5)]


@pytest.mark.parametrize("block", [4096, 6])
def test_nearest_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "ROW_BYTES", 1 << (26 if block > 6 else 13))
    x = np.random.default_rng(0).standard_normal((200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None)], VECTOR).repartition(5)
    asked = df.where("id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = nearest(df, asked, "id", "v", 7, skip="id").collect()
    for q in range(20):
        d = 1 - u @ u[q]
        want = [i for i in np.argsort(d, kind="stable") if i != q][:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    with pytest.raises(ValueError):
        nearest(df, asked, "id", "v", metric="other")
    assert nearest(df, asked.where("false"), "id", "v").count() == 0


def test_column_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    rows = df.select(*(distance(F.col("a"), F.col("b"), m).alias(m) for m in ("cosine", "l2", "dot")), unit(F.col("b")).alias("u")).collect()
    assert [(round(r.cosine, 9), r.l2, r.dot) for r in rows] == [(1.0, 5.0, 1.0), (0.0, 0.0, -24.0)] and rows[1].u == [0.6, 0.8]
    means = mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "g int, v array<float>"), "g", "v").collect()
    assert means[0].mean == [2.0, 3.0]


@pytest.mark.parametrize("block", [4096, 6])
def test_ivf_recall(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "ROW_BYTES", 1 << (26 if block > 6 else 16))
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], VECTOR)
    asked = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    c = ivf.fit_centres(df, "v", 12)
    index = ivf.assign(df, "id", "v", c)
    assert index.count() == 1500
    near = {(r.query_id, r.id) for r in ivf.search_index(index, asked, c, 4).collect()}
    exact = {(r.query_id, r.id) for r in nearest(df, asked, "id", "v", 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and len(near) == 150
    assert ivf.search_index(index, asked.where("false"), c, 4).count() == 0
    assert [ivf.list_count(n) for n in (10, 8192 * 3, 10**9)] == [1, 3, 256]


def test_similar_pairs_recall_and_greedy_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape), base[:5]]).astype(np.float32)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(500, 0, None), (501, 0, [0.0] * 32)], VECTOR)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    exact = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.9}
    got = {(r.a, r.b) for r in duplicates.similar_pairs(df, "id", "v", 0.9).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.8), (1, 5, 0.7), (4, 5, 0.9)], "a long, b long, similarity double")
    groups = sorted(tuple(r) for r in duplicates.greedy_groups(pairs).collect())
    assert groups == [(1, 2, 0.9), (1, 5, 0.7), (3, 4, 0.8)]
    classes = duplicates.vector_classes(df, "id", "v")
    assert {(r.id, r.class_id) for r in classes.where("id <> class_id").collect()} == {(120 + i, i) for i in range(5)} and classes.count() == 125
    some = spark.createDataFrame([(0, 1, 0.95)], "seed long, member long, similarity double")
    assert sorted(tuple(r) for r in duplicates.with_copies(some, classes).collect()) == [(0, 1, 0.95), (0, 120, 1.0), (0, 121, 0.95), (2, 122, 1.0), (3, 123, 1.0), (4, 124, 1.0)]


@pytest.mark.parametrize("block", [4096, 30])
def test_similar_pairs_loses_none(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.standard_normal((150, 16)), 1 + 0.5 * rng.standard_normal((150, 16))]).astype(np.float32)
    df = spark.createDataFrame([(7 * i % 300, 0, v.tolist()) for i, v in enumerate(x)] + [(900, 0, x[0].tolist()), (901, 0, None), (902, 0, [0.0] * 16)], VECTOR)
    u = np.empty((300, 16))
    u[7 * np.arange(300) % 300] = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for threshold in (0.4, -0.2):
        found = duplicates.similar_pairs(df, "id", "v", threshold).collect()
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= threshold}
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
        assert all(abs(r.similarity - u[r.a] @ u[r.b]) < 1e-9 for r in found)
    assert duplicates.similar_pairs(df.where("id < 0"), "id", "v").count() == 0
    some = {(r.a, r.b) for r in duplicates.likely_pairs(df, "id", "v", 0.4).collect()}
    assert some <= {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.4 - 1e-9} and some


@pytest.mark.parametrize(("hot", "block"), [(0, 4096), (60, 4096), (60, 3)])
def test_similar_groups_whatever_their_size(spark, monkeypatch, hot, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "ROW_BYTES", 1 << (26 if block > 3 else 11))
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((40, 8)), np.ones((hot, 8)) + 0.01 * rng.standard_normal((hot, 8)), [[1.0] * 8]])
    labels = [i % 8 for i in range(40)] + [8] * hot + [9]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(zip(labels, x, strict=True))] + [(900, None, [1.0] * 8), (901, 3, None)], "id long, g long, v array<double>").repartition(3)
    got = search.similar_groups(df, df.select("g").distinct(), "g", "id", "v", 5).orderBy("query_id", "rank").collect()
    u, g = x / np.linalg.norm(x, axis=1, keepdims=True), np.array(labels)
    for q in set(labels):
        m = x[g == q].mean(axis=0)
        d = {o: round(min(1 - u[g == o] @ m / np.linalg.norm(m)), 9) for o in set(labels) - {q}}
        assert [r.other for r in got if r.query_id == q] == sorted(d, key=lambda o: (d[o], o))[:5]


def test_greedy_groups_against_a_sequential_pass(spark):
    rng = np.random.default_rng(8)
    graphs = [[(1, 2), (2, 3), (3, 6), (4, 6)]] + [[(a, b) for a in range(25) for b in range(a + 1, 25) if rng.random() < p] for p in (0.05, 0.12, 0.3)]
    for edges in graphs:
        near, decided, want = set(edges), set(), set()
        for a in sorted({x for e in edges for x in e}):
            if a not in decided:
                own = {b for b in range(a + 1, 25) if (a, b) in near and b not in decided}
                decided |= own
                want |= {(a, b, a + b / 100) for b in own}
        got = duplicates.greedy_groups(spark.createDataFrame([(a, b, a + b / 100) for a, b in edges], "a long, b long, similarity double")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_copies_have_the_links_of_their_class(spark, tmp_path):
    near, far = [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(0, near), (1, [1.0, 0.0, 0.0]), (2, near), (3, near), (4, far), (5, far), (6, None), (7, [0.0] * 3)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.class_id, r.n_links) for r in QUERIES["duplicate_note_links"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (0, 1), 3: (0, 1), 4: (4, 0), 5: (4, 0), 6: (None, 0), 7: (None, 0)}


def test_highlight(spark):
    df = spark.createDataFrame([("The Sensor (panel) sensors",), (None,)], "t string")
    assert df.select(hl.highlight(F.col("t"), "panel", "<script>", "</b>").alias("h")).first().h == "The Sensor (**panel</b>) sensors"
    got = [r.h for r in df.select(hl.highlight(F.col("t"), "the sensor (panel)", "==").alias("h")).collect()]
    assert got == ["The ==Sensor== ==(panel)== ==sensor==s", None]
    assert hl.query_terms("The of Sensor ab este") == ["Sensor"] and hl.query_terms(None) == []


def test_facets_come_before_and_exclusions_after(spark, sf):
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    plan = chunks.where(navigate.facets(folder="projects")).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(folder,projects),StringStartsWith(folder,projects/))]" in plan and "text" not in plan
    df = spark.createDataFrame([(1, "A Ledger"), (2, "b"), (3, None)], "i int, text string")
    assert [r.i for r in df.where(navigate.without_terms(["ledger"])).collect()] == [2, 3]


def test_folders_and_tags(spark):
    df = spark.createDataFrame([("exam", "A, b"), ("exam/x", "ab"), ("examples", "c"), (None, None)], "folder string, tags string")
    assert df.where(navigate.in_folder("folder", "exam")).count() == 2
    assert [df.where(navigate.has_tags(t, m)).count() for t, m in ((["a"], False), (["a", "b"], True), (["c", "b"], False), (["z"], True))] == [1, 1, 2, 0]
    assert df.where(navigate.any_tag_contains(["b"])).count() == 2


def test_bm25_prefers_rare_terms_and_drops_stop_words(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the the dog"), (3, "Thé CÃT cat"), (4, None), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(0, "the cat"), (1, "zebra"), (2, None)], "query_id long, query string")
    got = [(r.query_id, r.id) for r in fts.bm25(docs, asked, "id").orderBy("query_id", "rank").collect()]
    assert got == [(0, 3), (0, 1), (0, 2)]
    assert [r.id for r in fts.bm25(docs, asked, "id", without=fts.stop_words("english")).orderBy("rank").collect()] == [3, 1]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_stored_postings_rank_as_texts_do(spark, sf, monkeypatch, tmp_path, hot):
    from marginalia.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("term", F.lit("clash"))
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    for without in ((), ("the", "de")):
        want = [tuple(r) for r in fts.bm25(docs, asked, "doc_id", without=without).orderBy("query_id", "rank").collect()]
        at = str(tmp_path / f"index{len(without)}")
        fts.postings(docs, "doc_id", without=without).sort("term").write.parquet(at)
        sizes = docs.select(fts.lengths(F.col("text"), without).alias("length"))
        for most in (fts.MOST_PUSHED, 0):
            monkeypatch.setattr(fts, "MOST_PUSHED", most)
            got = fts.bm25_indexed(spark.read.parquet(at), sizes, asked, without=without)
            rows = [tuple(r) for r in got.orderBy("query_id", "rank").collect()]
            assert [(r[0], r[1], r[3]) for r in rows] == [(r[0], r[1], r[3]) for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want])
        monkeypatch.undo()
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
    assert want and fts.bm25_indexed(spark.read.parquet(at), sizes, asked.where("false")).count() == 0


def test_join_of_hot_keys_in_parts(spark, monkeypatch):
    from marginalia.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "i long, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "k string, j long")
    got = sorted(tuple(r) for r in skew.join_any(big, small, "k").select("i", "j").collect())
    assert got == sorted((r.i, r.j) for r in big.join(small, "k").select("i", "j").collect())
