import numpy as np
import pytest

from vectrail.functions.metadata import tagged_map
from vectrail.operators import graph, ivfpq, kmeans, pq, search, sq8
from vectrail.operators.kernels import exact
from vectrail.types import METADATA, EmptyIndex, InvalidFormat, InvalidInput, Metric

SCHEMA = f"vector_id long, vector array<float>, metadata {METADATA.simpleString()}"


def frame(spark, x, meta=None):
    rows = [(i + 1, [float(c) for c in v], tagged_map(meta(i)) if meta else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ask(spark, q):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "q_id long, q array<double>")


def brute(x, q, k, metric, allowed=None):
    x = np.asarray(x, np.float32).astype(float)
    d = exact(np.asarray(q, float), x, metric)
    ids = np.arange(1, len(x) + 1)
    if allowed is not None:
        d, ids = d[allowed], ids[allowed]
    order = np.lexsort((ids, d))[:k]
    return list(zip(ids[order].tolist(), d[order].tolist()))


def hits(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append((r["vector_id"], r["distance"]))
    return out


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_and_batch_equal_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x, q = rng.uniform(-1, 1, (60, 9)), rng.uniform(-1, 1, (7, 9))
    x[10] = x[20] = x[30]
    x[3] = 0
    df = frame(spark, x)
    found = hits(search.knn_batch(df, ask(spark, q), 8, metric))
    for i in range(len(q)):
        assert found[i] == brute(x, q[i], 8, metric)
    q32 = np.asarray(q[0], np.float32).astype(float)
    assert [tuple(r) for r in search.knn(df, q32, 8, metric).collect()] == brute(x, q32, 8, metric)
    assert len(search.knn(df, q32, 100, metric).collect()) == 60
    assert search.knn(df, q32, 0, metric).collect() == []


def test_batch_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_FLOATS", 8)
    x = np.random.default_rng(1).normal(size=(30, 4))
    found = hits(search.knn_batch(frame(spark, x), ask(spark, x[:5]), 3))
    assert [found[i] for i in range(5)] == [brute(x, np.asarray(x[i]), 3, Metric.L2) for i in range(5)]


def test_filters_by_distance_order(spark):
    df = frame(spark, [(0, -3 * i) for i in range(14)], lambda i: {"tint": "rgbw"[i * 3 % 4], "size": i // 3})
    ids = lambda f: [r["vector_id"] for r in search.knn(df, [0, 0], 14, "l2", f).collect()]
    tint = lambda x: {"Eq": {"key": "tint", "value": x}}
    want = lambda test: [i + 1 for i in range(14) if test("rgbw"[i * 3 % 4], i // 3)]
    assert ids({"Or": [tint("g"), tint("w")]}) == want(lambda t, s: t in "gw")
    assert ids({"In": {"key": "size", "values": [4, 0, "r"]}}) == want(lambda t, s: s in (0, 4))
    assert ids({"And": [{"Range": {"key": "size", "min": 1, "max": 3}}, tint("b")]}) == want(lambda t, s: 1 <= s <= 3 and t == "b")


def test_selective_scan(spark, monkeypatch):
    df = frame(spark, [(2 * i, 1) for i in range(18)], lambda i: {"deck": i % 4, "paid": i % 3 == 0})
    found = {"And": [{"Eq": {"key": "deck", "value": 2}}, {"Eq": {"key": "paid", "value": True}}]}
    want = [i + 1 for i in range(18) if i % 4 == 2 and i % 3 == 0]
    assert [r["vector_id"] for r in search.selective_scan(df, [0, 0], 5, found).collect()] == want
    assert search.selective_scan(df, [0, 0], 5, {"Or": []}) is None
    monkeypatch.setattr(search, "SELECTIVE", 0)
    assert search.selective_scan(df, [0, 0], 5, found) is None
    assert [r["vector_id"] for r in search.search_filtered(df, [0, 0], 5, found).collect()] == want


def test_empty_collection_is_an_error(spark):
    with pytest.raises(EmptyIndex):
        search.search(frame(spark, []), [1.0], 1)


def test_sq8(spark, tmp_path):
    df = frame(spark, [[-7, 0.5, 31], [9, 64, 31]])
    index = sq8.Sq8Index.build(df, "l2")
    assert {r["vector_id"]: r["codes"] for r in index.codes.collect()} == {1: [0, 0, 0], 2: [255, 255, 0]}
    assert len(index) == 2 and index.dimension == 3
    index.save(str(tmp_path / "sq8"))
    back = sq8.Sq8Index.load(spark, str(tmp_path / "sq8"))
    assert [r["vector_id"] for r in back.search([9, 64, 31], 1).collect()] == [2]
    spark.createDataFrame([(9, [1, 2, 999])], "vector_id long, codes array<smallint>").write.mode("append").parquet(str(tmp_path / "sq8/codes"))
    with pytest.raises(InvalidFormat):
        sq8.Sq8Index.load(spark, str(tmp_path / "sq8"))


def test_sq8_recall(spark):
    x = np.random.default_rng(2).uniform(-1, 1, (400, 16))
    df, q = frame(spark, x), ask(spark, x[:20])
    got = search.recall(sq8.Sq8Index.build(df, "cosine").search_batch(q, 10), search.knn_batch(df, q, 10, "cosine"), 10).first()["recall"]
    assert got > 0.95


def test_kmeans_separates_clusters():
    rng = np.random.default_rng(0)
    heart = np.array([[-6, 1, 2], [3, 9, -4], [8, -7, 0], [0, -1, 11]])
    sizes = [25, 31, 18, 40]
    x = np.concatenate([rng.normal(c, 0.2, (n, 3)) for c, n in zip(heart, sizes)])
    centroids, label = kmeans.fit(x, 4)
    cuts = np.cumsum([0, *sizes])
    assert sorted(len(set(label[a:b].tolist())) for a, b in zip(cuts, cuts[1:])) == [1] * 4 and len(set(label.tolist())) == 4
    assert (label == kmeans.assign(x, centroids.astype(float))[0]).all()
    assert np.allclose(kmeans.fit(x, 1)[0][0], x.mean(axis=0), atol=1e-5)
    assert len(kmeans.fit(x[:3], 5)[0]) == 3
    with pytest.raises(InvalidInput):
        kmeans.fit(np.array([[np.inf]]), 1)


def test_pq_and_ivfpq(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 16)) * 0.3 + rng.normal(size=16) * 3 for _ in range(6)])
    df, q = frame(spark, x), ask(spark, x[::40])
    index = ivfpq.IvfPqIndex.build(df, ivfpq.IvfPqConfig(nlist=6, m=4, ksub=32, iterations=6))
    truth = search.knn_batch(df, q, 10)
    recalls = [search.recall(index.search_batch(q, 10, n, 4), truth, 10).first()["recall"] for n in (1, 6)]
    assert recalls[0] <= recalls[1] and recalls[1] >= 0.95
    table = index.books.table(x[0])
    manual = ((x[0].reshape(4, 1, 4) - index.books.centroids.astype(float)) ** 2).sum(axis=2)
    assert np.allclose(table, manual)
    codes = index.books.encode(x)
    assert np.allclose(index.books.reconstruct(codes)[:, :4], index.books.centroids[0][codes[:, 0]])
    index.save(str(tmp_path / "ivf"))
    back = ivfpq.IvfPqIndex.load(spark, str(tmp_path / "ivf"))
    assert hits(back.search_batch(q, 5, 3, 2)) == hits(index.search_batch(q, 5, 3, 2))
    assert len(back) == 360 and back.payload_bytes() == (360 * 4, 360 * 64)
    with pytest.raises(InvalidInput):
        pq.check_shape(10, 4, 16)
    with pytest.raises(InvalidInput):
        index.books.reconstruct(np.array([[99, 0, 0, 0]]))


def test_graph_recall_filter_and_snapshot(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 16))
    df, q = frame(spark, x, lambda i: {"parity": i % 2}), ask(spark, rng.uniform(-1, 1, (15, 16)))
    config = graph.GraphConfig(ef_construction=60, shard_rows=100)
    index = graph.GraphIndex.build(df, "l2", config)
    assert search.recall(index.search_batch(q, 10, 60), search.knn_batch(df, q, 10), 10).first()["recall"] > 0.95
    even = {"Eq": {"key": "parity", "value": 0}}
    found = index.search_batch(q, 10, 60, even, df)
    truth = search.knn_batch(df.filter("vector_id % 2 = 1"), q, 10)
    assert search.recall(found, truth, 10).first()["recall"] > 0.9
    index.save(str(tmp_path / "g"))
    back = graph.GraphIndex.load(spark, str(tmp_path / "g"), "l2", config)
    assert hits(back.search_batch(q, 3)) == hits(index.search_batch(q, 3))
    assert back.max_level() >= 1 and back.adjacency().count() >= 300
    with pytest.raises(InvalidFormat):
        graph.GraphIndex.load(spark, str(tmp_path / "g"), "cosine", config)


def test_graph_crosses_rows_that_do_not_match():
    """The rows that match lie at the far end of a spiral of others."""
    turn = np.linspace(0, 9, 160)
    x = np.concatenate([np.stack([turn * np.cos(turn), turn * np.sin(turn), turn * 0], axis=1), [[-30, 4, 1], [-31, 4, 2], [-32, 5, 1], [-33, 5, 2]]])
    g = graph.Graph(x, np.arange(500, 664), graph.GraphConfig(m=5, ef_construction=40), Metric.L2).build()
    ids, d = g.search(np.array([-31.2, 4.1, 1.5]), 4, 12, np.arange(164) >= 160)
    assert sorted(ids.tolist()) == [660, 661, 662, 663] and (np.diff(d) >= 0).all()


def test_graph_selects_diverse_neighbours():
    """Of three beside each other one is taken, then the one on the other side."""
    x = np.array([[5.0, 0.0], [5.2, 0.3], [5.1, -0.4], [-7.0, 0.0]])
    g = graph.Graph(x, np.arange(4), graph.GraphConfig(), Metric.L2)
    ranked = sorted((float((v * v).sum()), i) for i, v in enumerate(x))
    assert [n for _, n in g._diverse(ranked, 2)] == [0, 3]


def test_newer_and_deleted_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (80, 6))
    df, q = frame(spark, x, lambda i: {"parity": i % 2}), ask(spark, x[60:66])
    live = df.filter("vector_id % 7 <> 0")
    index = graph.GraphIndex.build(df.filter("vector_id <= 50"), "l2", graph.GraphConfig(ef_construction=40))
    truth = search.knn_batch(live, q, 5)
    assert hits(index.search_fresh(q, 5, live, 50, 60)) == hits(truth)
    even = {"Eq": {"key": "parity", "value": 0}}
    assert hits(index.search_fresh(q, 5, live, 50, 60, even)) == hits(search.knn_batch(live.filter("vector_id % 2 = 1"), q, 5))
    books = pq.Codebooks(np.asarray(x[:16], np.float32).reshape(16, 2, 3).transpose(1, 0, 2))
    ivf = ivfpq.IvfPqIndex.from_trained(df, x[:4], books).only(live)
    assert all(i % 7 for rows in hits(ivf.search_batch(q, 10, 4, 4)).values() for i, _ in rows)
