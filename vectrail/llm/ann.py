"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (`sample_rows`, default 8,192 rows of least id hashes): the sample's nearest-neighbour graph is
cut into balanced parts by label propagation under a capacity, then a small network learns, from the parts of a vector's
neighbours, which parts its neighbours are likely to be in. Every row is indexed under its most probable part; a query
goes to its most probable parts and their rows are reranked by the exact cosine. How many parts a query visits is
measured on the sample: the least number that finds `recall` (0.97) of the true neighbours there.

There are as many parts as `PART_ROWS` rows fill, as far as the sample can tell parts apart (a part for each 32 of its
rows, at most 256). A part is a number of blocks of about `BLOCK_ROWS` rows, by a hash of the id, so a part that holds a
third of all rows (one vector that many rows share, say) is spread over as many tasks as its size asks for; a block's
task sees its rows once and streams the queries past them, and a query is sent once for each block of the parts it visits. Each block returns a query's best few, and the best of those are kept.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have not the most common number of
components, take no part, nor do rows with a null id; of rows with one id the least vector counts; fewer candidates than
k give fewer rows; ties go to the smaller id; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import as_long, checkpoint, read_table, shuffle_parts

PART_ROWS = 4096
BLOCK_ROWS = 65_536
SCORES = 1 << 22  # of queries with a block's rows that are held at once
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of every row, by blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Parts of at most slack * n / parts rows with few graph edges between them.

    Rows start with the nearest of `parts` seeds that has room; then, round by round, a row moves to the part that most
    of its neighbours (in either direction) are in if there is room, the largest gains first.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    seeds = x[rng.choice(n, parts, replace=False)]
    near = x @ seeds.T
    label, size = np.full(n, -1), np.zeros(parts, np.int64)
    for row in np.argsort(-near.max(axis=1)):
        for p in np.argsort(-near[row]):
            if size[p] < room:
                label[row], size[p] = p, size[p] + 1
                break
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (src, label[dst]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for row in np.argsort(-gain):
            if gain[row] <= 0:
                break
            if size[best[row]] < room:
                size[label[row]] -= 1
                size[best[row]] += 1
                label[row] = best[row]
                moved += 1
        if moved < n // 200:
            break
    return label


@dataclass
class Router:
    """A two-layer network from unit vectors to parts, and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 2) -> Router:
    """Cross-entropy against each row's share of neighbours by part (Adam, minibatches)."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], targets.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            err = (z / z.sum(axis=1, keepdims=True) - targets[at]) / len(at)
            back = (err @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, parts: int, *, k: int = 10, recall: float = 0.97) -> Router:
    """A router from a sample of unit vectors."""
    if len(x) < 4 or parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
    held = np.arange(len(x)) % 8 == 0
    router = train_router(x[~held], share[~held])
    # the rows are indexed by the router's first choice, so that is where their neighbours are looked for
    home = router.logits(x).argmax(axis=1)
    place = np.argsort(np.argsort(-router.logits(x[held]), axis=1), axis=1)
    need = np.sort(np.take_along_axis(place, home[graph[held][:, :5]], axis=1).ravel())
    router.probes = int(min(parts, need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1))
    return router


def valid_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): ids with the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(as_long(vectors, vec_id).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common:
        rows = rows.filter(F.size("v") == common["n"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _routed(shared, probes: int):
    def run(batches):
        router = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = router.logits(unit(_matrix(batch.column(1))))
            top = np.argsort(-z, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    return run


def _rerank(k: int):
    """Best k of a block's rows for each query that comes by; the rows of a block come first."""

    def run(batches):
        now, ids, rows, held = None, [], [], None
        for batch in batches:
            block = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(block)) if block[i] != block[i - 1]), len(block)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if block[lo] != now:
                    now, ids, rows, held = block[lo], [], [], None
                ask = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                n = int((~ask).sum())
                if n:
                    ids.append(part.column(2).slice(0, n).to_numpy())
                    rows.append(_matrix(part.column(3).slice(0, n)))
                if n == len(part) or not ids:
                    continue
                if held is None:
                    own, x = np.concatenate(ids), np.concatenate(rows)
                    held = own, x, unit(x), np.sqrt((x * x).sum(axis=1))
                own, x, u, norm = held
                q_ids, q = part.column(2).slice(n).to_numpy(), _matrix(part.column(3).slice(n))
                out: list[tuple] = []
                step = max(1, SCORES // len(own))
                for i in range(0, len(q), step):
                    s = unit(q[i : i + step]) @ u.T
                    s[q_ids[i : i + step, None] == own[None, :]] = -np.inf
                    top = min(k, s.shape[1])
                    cut = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top] - SLACK
                    for j in range(len(s)):
                        c = np.flatnonzero((s[j] >= cut[j]) & (s[j] > -np.inf))
                        a = q[i + j]
                        score = (x[c] * a).sum(axis=1) / (norm[c] * np.sqrt((a * a).sum()))
                        for o in np.lexsort((own[c], -score))[:k]:
                            out.append((int(q_ids[i + j]), int(own[c[o]]), float(score[o])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, *, where: str | None = None, k: int = 5, sample_rows: int = 8192, parts: int | None = None, probes: int | None = None, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each query, a row's own id left out.

    `vectors` and `queries` are (vec_id, v) as from `valid_vectors`; instead of queries a condition on vec_id may name
    them. `parts` and `probes` follow from the number of rows and the sample where they aren't given.
    """
    spark = vectors.sparkSession
    vectors = checkpoint(vectors)  # read by five jobs
    total = vectors.count()
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    x = unit(np.array(picked.v.tolist(), float)) if len(picked) else np.zeros((0, 1))
    router = fit(x, parts or max(2, min(256, sample_rows // 32, total // PART_ROWS + 2)), recall=recall)
    shared = spark.sparkContext.broadcast(router)
    schema = "vec_id long, v array<double>, parts array<int>"
    rows = vectors.mapInArrow(_routed(shared, 1), schema).select("vec_id", "v", F.col("parts")[0].alias("part"))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # one row a part
    salts = F.create_map(*(F.lit(x) for p in range(router.parts) for x in (p, max(1, -(-sizes.get(p, 0) // BLOCK_ROWS)))))
    block = lambda part, salt: (part.cast("long") * 1_000_003 + salt).alias("block")
    index = rows.select(block(F.col("part"), F.pmod(F.xxhash64("vec_id"), salts[F.col("part")])), F.lit(False).alias("ask"), "vec_id", "v")
    asked = (vectors.filter(where) if where else queries if queries is not None else vectors).mapInArrow(_routed(shared, probes or router.probes), schema)
    asked = asked.select("vec_id", "v", F.explode("parts").alias("part"))
    asked = asked.select("vec_id", "v", "part", F.explode(F.sequence(F.lit(0), salts[F.col("part")] - 1)).alias("salt"))
    asked = asked.select(block(F.col("part"), F.col("salt")), F.lit(True).alias("ask"), "vec_id", "v")
    both = index.unionByName(asked).repartition(shuffle_parts(spark), "block").sortWithinPartitions("block", "ask")
    best = both.mapInArrow(_rerank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of every 50th vector."""
    return search(valid_vectors(read_table(spark, sf_dir, "embeddings")), where="vec_id % 50 = 0")
