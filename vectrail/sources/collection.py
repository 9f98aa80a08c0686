"""A durable collection of vectors: versions of a snapshot and log segments under one folder, and the calls on it.

Layout: `meta` (dimension, metric), `snapshot-N` (vector_id, vector, metadata of live rows), `log-N/segment-M` (log rows
since snapshot N), `current-N` markers and `graph-N` indexes, each a complete Parquet write whose _SUCCESS makes it
count. The newest complete `current` names the state, the number of live rows too; what an interrupted write left behind
is not named and is ignored. Every call that writes is one Spark job, the commit of one batch; one writer at a time.

Reads pass the snapshot on and fold only the log and the rows that it changes, so a search after a write does not shuffle
the snapshot's vectors. A graph index (`build_graph`) covers the rows up to the id that it was built through; newer rows
are scanned beside it, deleted ones never returned, and one that is damaged or gone is built anew when asked.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.filters import search_filter
from vectrail.functions.metadata import literal_map, tagged_map
from vectrail.functions.validate import check_search, check_vector, is_valid
from vectrail.operators import search as operators
from vectrail.operators.graph import GraphConfig, GraphIndex
from vectrail.sources import oplog
from vectrail.types import METADATA, OP_LOG, VECTORS, EmptyIndex, InvalidFormat, InvalidInput, Metric, NotFound

CURRENT = "version int, segments int, max_vector_id long, max_seq long, deleted long, bytes long, live long"


class Collection:
    """`create` or `open` one; use it as a context manager to flush at the end."""

    def __init__(self, spark: SparkSession, path: str, tombstone_ratio: float = 0.2, log_limit: int = 64 << 20):
        self.spark, self.path, self.tombstone_ratio, self.log_limit = spark, path.rstrip("/"), tombstone_ratio, log_limit
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.dimension, self.metric = meta["dimension"], Metric(meta["metric"])
        self._load()

    # -- files -------------------------------------------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        """Complete Parquet folders by name."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not fs.exists(root):
            return []
        found = [x.getPath() for x in fs.listStatus(root) if x.isDirectory()]
        return [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _load(self) -> None:
        marks = sorted(int(n[8:]) for n in self._names() if n.startswith("current-"))
        if not marks:
            raise InvalidFormat("the collection has no complete state")
        self.mark = marks[-1]
        state = self.spark.read.parquet(f"{self.path}/current-{self.mark}").first()
        self.version, self.segments, self.max_vector_id, self.max_seq, self.deleted, self.log_bytes, self.live = (state[c] for c in ("version", "segments", "max_vector_id", "max_seq", "deleted", "bytes", "live"))
        if self.segments and oplog.first_bad(self._all_log()).first()["bad"] is not None:
            self.live = self.vectors().count()  # a damaged log holds less than was committed

    def _commit(self) -> None:
        row = (self.version, self.segments, self.max_vector_id, self.max_seq, self.deleted, self.log_bytes, self.live)
        self.spark.createDataFrame([row], CURRENT).coalesce(1).write.parquet(f"{self.path}/current-{self.mark + 1}")
        self.mark += 1

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, metric: Metric | str = Metric.COSINE, overwrite: bool = False, **options) -> Collection:
        if dimension < 1:
            raise InvalidInput("the dimension is at least 1")
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(root):
            if not overwrite:
                raise InvalidInput(f"{path} exists")
            fs.delete(root, True)
        spark.createDataFrame([(dimension, int(Metric.parse(metric)))], "dimension int, metric int").write.parquet(f"{path}/meta")
        spark.createDataFrame([], VECTORS).write.parquet(f"{path}/snapshot-0")
        spark.createDataFrame([(0, 0, 0, -1, 0, 0, 0)], CURRENT).write.parquet(f"{path}/current-0")
        return cls(spark, path, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimension: int | None = None, **options) -> Collection:
        found = cls(spark, path, **options)
        if dimension is not None and dimension != found.dimension:
            raise InvalidFormat(f"the collection has {found.dimension} dimensions, not {dimension}")
        return found

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        self.flush()

    # -- state -------------------------------------------------------------------------------------------------------
    def _all_log(self) -> DataFrame:
        return self.spark.read.schema(OP_LOG).parquet(*(f"{self.path}/log-{self.version}/segment-{i}" for i in range(self.segments)))

    def log(self) -> DataFrame:
        """Rows since the snapshot, up to the first damaged one."""
        return oplog.valid_prefix(self._all_log()) if self.segments else self.spark.createDataFrame([], OP_LOG)

    def snapshot(self) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.path}/snapshot-{self.version}")

    def vectors(self) -> DataFrame:
        """Live rows: (vector_id, vector, metadata)."""
        return oplog.state(self.log(), self.snapshot()) if self.segments else self.snapshot()

    def get(self, vector_id: int) -> DataFrame:
        """The live row of an id; only rows of that id are read on from the snapshot and folded from the log."""
        own = F.col("vector_id") == vector_id
        here = self.snapshot().filter(own)
        return oplog.live(oplog.fold(self.log().filter(own), here)) if self.segments else here

    def __len__(self) -> int:
        return self.live

    def health(self) -> str:
        return "ok"

    def metrics(self) -> DataFrame:
        """(live, deleted, max_vector_id, dimension, metric, max_level, payload_bytes); max_level is null without a graph,
        payload_bytes are those of the live vectors as floats."""
        graph = self._graph_state()
        level = self.graph().max_level() if graph else None
        one = self.spark.range(1).select(F.lit(self.live).cast("long").alias("live"), F.lit(level).cast("int").alias("max_level"), F.lit(4 * self.live * self.dimension).cast("long").alias("payload_bytes"))
        return one.select("live", F.lit(self.deleted).cast("long").alias("deleted"), F.lit(self.max_vector_id).cast("long").alias("max_vector_id"), F.lit(self.dimension).alias("dimension"), F.lit(self.metric.name.lower()).alias("metric"), "max_level", "payload_bytes")

    # -- graph index -------------------------------------------------------------------------------------------------
    def _graph_state(self):
        """(name, through, config) of the newest complete graph, if there is one."""
        names = sorted((n for n in self._names() if n.startswith("graph-at-")), key=lambda n: int(n[9:]))
        if not names:
            return None
        r = self.spark.read.parquet(f"{self.path}/{names[-1]}").first()
        return f"{self.path}/graph-{names[-1][9:]}", r["through"], GraphConfig(m=r["m"], ef_construction=r["ef"], seed=r["seed"], shard_rows=r["shard_rows"])

    def build_graph(self, config: GraphConfig | None = None) -> GraphIndex:
        """Build a graph over the live rows and keep it with the collection; older ones go."""
        config, number = config or GraphConfig(), 1 + max([-1, *(int(n[9:]) for n in self._names() if n.startswith("graph-at-"))])
        GraphIndex.build(self.vectors(), self.metric, config).save(f"{self.path}/graph-{number}")
        row = (self.max_vector_id, config.m, config.ef_construction, config.seed, config.shard_rows)
        self.spark.createDataFrame([row], "through long, m int, ef int, seed long, shard_rows int").coalesce(1).write.parquet(f"{self.path}/graph-at-{number}")
        jvm, fs = self._fs()
        for name in (f"graph-at-{number - 1}", f"graph-{number - 1}"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        return self.graph()

    def graph(self) -> GraphIndex:
        """The kept graph; built anew where there is none, or where its snapshot is damaged."""
        state = self._graph_state()
        if not state:
            return self.build_graph()
        try:
            return GraphIndex.load(self.spark, state[0], self.metric, state[2])
        except (InvalidFormat, AnalysisException):
            return self.build_graph(state[2])

    def plan(self, found: dict | str | None) -> str:
        """How `search_graph` answers: "scan" for an Eq or And of Eq that names few rows, else "graph"."""
        return "scan" if found is not None and operators.selective_ids(self.vectors(), found) is not None else "graph"

    def search_graph(self, query, k: int, found: dict | str | None = None, ef: int = 100) -> DataFrame:
        """(vector_id, distance) as `search`, through the graph, or exactly where the filter names few rows."""
        query = check_vector(query, self.dimension)
        check_search(k, ef)
        rows = self._rows()
        if found is not None:
            near = operators.selective_scan(rows, query, k, found, self.metric)
            if near is not None:
                return near
        index = self.graph()  # may build it
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "q_id long, q array<double>")
        hits = index.search_fresh(asked, k, rows, self._graph_state()[1], ef, found)
        return hits.orderBy("rank").select("vector_id", "distance")

    # -- writes ------------------------------------------------------------------------------------------------------
    def _append(self, rows: DataFrame, count: int) -> None:
        rows = oplog.with_checksum(rows)
        where = f"{self.path}/log-{self.version}/segment-{self.segments}"
        rows.write.mode("overwrite").parquet(where)
        jvm, fs = self._fs()
        self.segments += 1
        self.max_seq += count
        self.log_bytes += fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(where)).getLength()

    def insert_df(self, batch: DataFrame, order: str = "pos") -> DataFrame:
        """Append all rows (pos, vector[, metadata]) as one commit, ids in order of `order`; (pos, vector_id) of them.

        The batch is checked as a whole first; one bad row rejects it."""
        if "metadata" not in batch.columns:
            batch = batch.withColumn("metadata", F.lit(None).cast(METADATA))
        found = batch.agg(F.count("*").alias("n"), F.count_if(~is_valid(F.col("vector"), self.dimension)).alias("bad")).first()
        if found["bad"]:
            raise InvalidInput(f"{found['bad']} vectors are not of {self.dimension} finite components")
        if found["n"]:
            numbered = oplog.assign_ids(batch.select(order, F.col("vector").cast("array<float>").alias("vector"), "metadata"), order, self.max_vector_id)
            seq = F.col("vector_id") - self.max_vector_id + self.max_seq
            op = F.when(F.col("metadata").isNull(), oplog.INSERT).otherwise(oplog.INSERT_META)
            first = self.max_vector_id
            self._append(numbered.select(seq.alias("seq"), op.alias("op"), "vector_id", "vector", "metadata"), found["n"])
            self.max_vector_id += found["n"]
            self.live += found["n"]
            self._commit()
            self._maintain()
            return oplog.assign_ids(batch.select(order, F.col("vector").cast("array<float>").alias("vector"), "metadata"), order, first).select(order, "vector_id")
        return batch.select(order, F.lit(None).cast("long").alias("vector_id"))

    def insert_batch(self, vectors: list, metadata: list | None = None) -> list[int]:
        if metadata is not None and len(metadata) != len(vectors):
            raise InvalidInput("one metadata entry for each vector")
        rows = [(i, check_vector(v, self.dimension), tagged_map(metadata[i]) if metadata else None) for i, v in enumerate(vectors)]
        if not rows:
            return []
        first = self.max_vector_id
        self.insert_df(self.spark.createDataFrame(rows, f"pos long, vector array<float>, metadata {METADATA.simpleString()}"))
        return list(range(first + 1, first + len(rows) + 1))

    def insert(self, vector, metadata: dict | None = None) -> int:
        return self.insert_batch([vector], [metadata])[0]

    def _must_live(self, vector_id: int) -> None:
        if not self.get(vector_id).limit(1).count():
            raise NotFound(f"no live vector {vector_id}")

    def _change(self, op: str, vector_id: int, metadata: dict | None = None) -> None:
        self._must_live(vector_id)
        row = self.spark.range(1).select(
            F.lit(self.max_seq + 1).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(vector_id).cast("long").alias("vector_id"), F.lit(None).cast("array<float>").alias("vector"), literal_map(metadata).alias("metadata")
        )
        self._append(row, 1)
        self.deleted += op == oplog.DELETE
        self.live -= op == oplog.DELETE
        self._commit()

    def delete(self, vector_id: int) -> None:
        self._change(oplog.DELETE, vector_id)
        self._maintain()

    def update_metadata(self, vector_id: int, metadata: dict) -> None:
        """Replace all metadata of a vector."""
        tagged_map(metadata)
        self._change(oplog.UPDATE_META, vector_id, metadata)

    def clear_metadata(self, vector_id: int) -> None:
        self._change(oplog.CLEAR_META, vector_id)

    def _maintain(self) -> None:
        if self.deleted and self.deleted / (self.live + self.deleted) > self.tombstone_ratio:
            self.compact()
        elif self.log_bytes > self.log_limit:
            self.flush()

    def flush(self) -> None:
        """Write the live rows as the next snapshot and start an empty log. Tombstones stay counted."""
        if self.segments:
            self._rewrite(self.deleted)

    def compact(self) -> None:
        """As flush, and the tombstones are gone; ids and the high-water mark stay. A graph is built anew, without them."""
        self._rewrite(0)
        if state := self._graph_state():
            self.build_graph(state[2])

    def _rewrite(self, deleted: int) -> None:
        target = self.version + 1
        self.vectors().write.mode("overwrite").parquet(f"{self.path}/snapshot-{target}")
        old, self.version, self.segments, self.deleted, self.log_bytes = self.version, target, 0, deleted, 0
        self._commit()
        jvm, fs = self._fs()
        for name in (f"snapshot-{old}", f"log-{old}", f"current-{self.mark - 2}"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    # -- searches ----------------------------------------------------------------------------------------------------
    def _rows(self) -> DataFrame:
        if not self.deleted and not self.live:
            raise EmptyIndex("the collection has no vectors")
        return self.vectors()

    def search(self, query, k: int, found: dict | str | None = None, ef: int = 100) -> DataFrame:
        """(vector_id, distance) of the k nearest live vectors that pass the filter; exact, so `ef` only gets checked."""
        query = check_vector(query, self.dimension)
        check_search(k, ef)
        return operators.knn(self._rows(), query, k, self.metric, found)

    def search_batch(self, queries: list[dict] | DataFrame, k: int | None = None) -> DataFrame:
        """(q_id, rank, vector_id, distance). Queries are a DataFrame (q_id, q[, k][, filter_json]) or a list of
        {"vector", "k", "filter"}, numbered in their order; one invalid query rejects the batch."""
        if not isinstance(queries, DataFrame):
            import json

            from vectrail.functions.filters import parse

            if not queries:
                raise InvalidInput("an empty batch")
            rows = []
            for i, q in enumerate(queries):
                check_search(q.get("k", k), q.get("ef"), edge=True)
                rows.append((i, check_vector(q["vector"], self.dimension), q.get("k", k), json.dumps(parse(q["filter"])) if q.get("filter") else None))
            queries = self.spark.createDataFrame(rows, "q_id long, q array<double>, k int, filter_json string")
        return operators.knn_batch(self._rows(), queries, k, self.metric, self.dimension)

    def matching(self, found: dict | str) -> DataFrame:
        return self.vectors().filter(search_filter(found, F.col("metadata"))).select("vector_id")
