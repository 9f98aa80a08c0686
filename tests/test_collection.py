import pytest
from pyspark.sql import functions as F

from vectrail.functions.metadata import tagged_map
from vectrail.sources import oplog
from vectrail.sources.collection import Collection
from vectrail.sources.vecfiles import read_vecs, to_vectors, write_vecs
from vectrail.streaming import ingest
from vectrail.types import METADATA, DimensionMismatch, EmptyIndex, InvalidFormat, InvalidInput, NotFound


TREES = [([4, 1], {"kind": "oak", "age": 80}), ([1, 4], {"kind": "elm", "age": 12}), ([-3, 2], None), ([5, 5], {"kind": "oak", "age": 9}), ([2, -6], {"kind": "fir"}), ([4, 2], {"kind": "oak", "age": 80, "tagged": True})]


def test_searches_of_a_collection(spark, tmp_path):
    with Collection.create(spark, str(tmp_path / "c"), 2, "l2") as c:
        with pytest.raises(EmptyIndex):
            c.search([0, 0], 2)
        assert c.insert_batch([v for v, _ in TREES], [m for _, m in TREES]) == [1, 2, 3, 4, 5, 6]
        near = lambda f, k=9: [r["vector_id"] for r in c.search([4, 1.25], k, f).collect()]
        oak = {"Eq": {"key": "kind", "value": "oak"}}
        assert near(None) == [1, 6, 4, 2, 3, 5] and near(None, 2) == [1, 6]
        assert near(oak) == [1, 6, 4]
        assert near({"And": [oak, {"Range": {"key": "age", "max": 20}}]}) == [4]
        assert near({"Or": [{"Eq": {"key": "kind", "value": "fir"}}, {"Eq": {"key": "tagged", "value": True}}]}) == [6, 5]
        assert near({"In": {"key": "age", "values": [12, 9, "80"]}}) == [4, 2]
        assert near({"Range": {"key": "age"}}) == [1, 6, 4, 2]
        assert near({"Eq": {"key": "kind", "value": "yew"}}) == []
        rows = c.search_batch([{"vector": [2, -5], "k": 1}, {"vector": [5, 4], "k": 2, "filter": oak}]).orderBy("q_id", "rank").collect()
        assert [(r["q_id"], r["vector_id"]) for r in rows] == [(0, 5), (1, 4), (1, 6)]
        for bad in ([], [{"vector": [1, 0, 2], "k": 1}], [{"vector": [1, 0], "k": 0}]):
            with pytest.raises(InvalidInput):
                c.search_batch(bad)


def test_a_write_does_not_shuffle_the_snapshot(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 2, "l2")
    c.insert_batch([[i, 0] for i in range(50)])
    c.flush()
    c.insert([7.5, 0])
    c.delete(3)
    c.update_metadata(9, {"a": 1})
    found = c.search([7.4, 0], 3)
    assert [r["vector_id"] for r in found.collect()] == [51, 8, 9]
    assert len(c) == 50 == c.vectors().count()
    plan = c.vectors()._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, x in enumerate(plan.split("\n")) if "LeftAnti" in x)
    first = plan.split("\n")[scan : scan + 4]
    assert "BroadcastHashJoin" in first[0] and not any("Exchange hashpartitioning" in x for x in first)
    assert [r["vector"] for r in c.get(8).collect()] == [[7.0, 0.0]] and not c.get(3).count()


def test_graph_of_a_collection(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 2, "l2", tombstone_ratio=0.2)
    c.insert_batch([[i, i % 5] for i in range(60)], [{"odd": i % 2 == 1, "row": i} for i in range(60)])
    ids = lambda f=None, k=4: [r["vector_id"] for r in c.search_graph([20.25, 1], k, f).collect()]
    true = lambda f=None, k=4: [r["vector_id"] for r in c.search([20.25, 1], k, f).collect()]
    assert c.metrics().first()["max_level"] is None
    c.build_graph()
    few, many = {"Eq": {"key": "row", "value": 3}}, {"Range": {"key": "row", "min": 15}}
    assert c.plan(few) == "scan" and c.plan(many) == c.plan(None) == "graph"
    assert ids() == true() and ids(few) == true(few) == [4] and ids(many) == true(many)
    c.insert([20.25, 1], {"row": 99})  # newer than the graph
    c.delete(21)
    assert ids() == true() and ids()[0] == 61 and 21 not in ids(k=30)
    path = next((tmp_path / "c").glob("graph-[0-9]*/meta"))
    for x in path.iterdir():
        x.unlink()
    assert ids() == true() and c.metrics().first()["max_level"] >= 0  # built anew
    for i in range(1, 20):
        c.delete(i)
    assert c.deleted < 19 and ids() == true()  # compacted on the way, and the graph with it


def test_life_of_a_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.create(spark, path, 2, "l2", tombstone_ratio=0.4)
    with pytest.raises(InvalidInput):
        Collection.create(spark, path, 2)
    c.insert_batch([[0, 0], [1, 0], [2, 0], [3, 0]])
    with pytest.raises(InvalidInput):
        c.insert_batch([[5, 5], [float("nan"), 0]])
    with pytest.raises(DimensionMismatch):
        c.insert([1])
    assert len(c) == 4
    c.update_metadata(2, {"a": 1})
    assert c.search([0, 0], 9, {"Eq": {"key": "a", "value": 1}}).count() == 1
    c.update_metadata(2, {"b": True})
    assert c.search([0, 0], 9, {"Eq": {"key": "a", "value": 1}}).count() == 0
    c.clear_metadata(2)
    assert c.search([0, 0], 9, {"And": []}).count() == 0
    c.delete(1)
    assert c.version == 0 and c.deleted == 1
    for bad in (0, 1, 99):
        with pytest.raises(NotFound):
            c.delete(bad)
    assert [r["vector_id"] for r in c.search([0, 0], 9).collect()] == [2, 3, 4]
    again = Collection.open(spark, path, 2, tombstone_ratio=0.4)
    assert [r["vector_id"] for r in again.search([0, 0], 9).collect()] == [2, 3, 4]
    again.delete(2)  # 2 of 4: compacted
    assert again.deleted == 0 and again.segments == 0 and again.version == 1
    assert again.insert([9, 9]) == 5
    again.flush()
    assert sorted(r["vector_id"] for r in Collection.open(spark, path).vectors().collect()) == [3, 4, 5]
    assert again.metrics().first().asDict() == {"live": 3, "deleted": 0, "max_vector_id": 5, "dimension": 2, "metric": "l2", "max_level": None, "payload_bytes": 24}
    assert again.health() == "ok"
    with pytest.raises(InvalidFormat):
        Collection.open(spark, path, 3)


def test_interrupted_write_is_not_seen(spark, tmp_path):
    path = tmp_path / "c"
    c = Collection.create(spark, str(path), 1, "l2")
    c.insert([1])
    (path / "snapshot-1").mkdir()
    (path / f"current-{c.mark + 1}").mkdir()
    (path / f"current-{c.mark + 1}" / "part-0").write_bytes(b"half")
    assert [r["vector_id"] for r in Collection.open(spark, str(path)).vectors().collect()] == [1]


def log(spark, rows):
    made = [(seq, op, i, [float(seq)] if op.startswith("insert") else None, tagged_map(m)) for seq, op, i, m in rows]
    return oplog.with_checksum(spark.createDataFrame(made, f"seq long, op string, vector_id long, vector array<float>, metadata {METADATA.simpleString()}"))


ROWS = [(0, "insert", 1, None), (1, "insert_meta", 2, {"a": 1}), (2, "update_meta", 1, {"b": 2}), (3, "clear_meta", 2, None), (4, "insert", 3, None), (5, "delete", 3, None), (6, "update_meta", 3, {"c": 1}), (7, "update_meta", 9, {"d": 1}), (8, "insert", 1, None)]


def state(df):
    return {r["vector_id"]: (r["vector"][0], {k: v["i"] for k, v in r["metadata"].items()} if r["metadata"] is not None else None, r["deleted"]) for r in df.collect()}


def test_fold(spark):
    folded = state(oplog.fold(log(spark, ROWS)))
    assert folded == {1: (0.0, {"b": 2}, False), 2: (1.0, None, False), 3: (4.0, None, True)}
    twice = log(spark, ROWS).unionByName(log(spark, ROWS))
    assert state(oplog.fold(twice)) == folded
    assert sorted(r["vector_id"] for r in oplog.live(oplog.fold(log(spark, ROWS))).collect()) == [1, 2]
    assert oplog.max_vector_id(log(spark, ROWS)).first()[0] == 3
    assert [(r["seq"], r["op"]) for r in oplog.checkpoint_log(log(spark, ROWS)).orderBy("seq").collect()][:2] == [(1, "update_meta"), (2, "update_meta")]


def test_prefix_stops_at_the_first_bad_row(spark):
    torn = log(spark, ROWS).withColumn("crc", F.when(F.col("seq") == 3, F.lit(1)).otherwise(F.col("crc")))
    assert [r["seq"] for r in oplog.valid_prefix(torn).orderBy("seq").collect()] == [0, 1, 2]
    assert oplog.valid_prefix(log(spark, ROWS)).count() == 9


def test_streamed_fold_equals_the_batch(spark, tmp_path):
    ingest.stage_log(log(spark, ROWS), str(tmp_path / "log"))
    q = ingest.fold_stream(ingest.read_log_stream(spark, str(tmp_path / "log")), str(tmp_path / "state"), str(tmp_path / "check"))
    q.awaitTermination()
    assert state(ingest.folded_state(spark, str(tmp_path / "state"))) == state(oplog.fold(log(spark, ROWS)))


def test_vec_files(spark, tmp_path):
    path = str(tmp_path / "x.fvecs")
    write_vecs(path, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    rows = to_vectors(read_vecs(spark, path, limit=2)).orderBy("vector_id").collect()
    assert [(r["vector_id"], r["vector"]) for r in rows] == [(1, [1, 2, 3]), (2, [4, 5, 6])]
    write_vecs(str(tmp_path / "t.ivecs"), [[1, 2], [3, 4]], "ivecs")
    assert [r["vector"] for r in read_vecs(spark, str(tmp_path / "t.ivecs"), "ivecs").orderBy("pos").collect()] == [[1, 2], [3, 4]]
    with open(path, "ab") as f:
        f.write(b"xx")
    with pytest.raises(InvalidFormat):
        read_vecs(spark, path)
