"""Toxicity by class-conditional Kneser-Ney language models.

Two models over the characters (UTF-8 bytes) of words, one of toxic and one of ordinary training rows. The highest
order (`order` bytes, with a space at either end of a word) has the class's own counts with absolute discounting; all
lower orders are continuation counts of both classes together, so what is rare is smoothed alike in both and speaks
for neither. An n-gram seen in no class then has the ratio of the two backoff weights of its context, and one of an
unseen context has none: the log-likelihood ratio of any text needs two tables only, of seen n-grams and of contexts.

Counts are taken over all labelled training rows, summed in the task that reads them and then grouped by n-gram; they
grow with the input, and so do the two tables. Scoring reads both whole, in as many broadcast blocks as they need (about
`block_rows` n-grams each, default 2**20, 16 bytes a row, and their contexts): the driver holds one block at a time, a
task KEPT_BLOCKS, or one where there are more.

A text is scored by the ratio of its length-normalised log-likelihoods (per word), by the same over the root of the
length, the log length and its most toxic word's ratio; a logistic curve makes that a probability. It is fitted on a
sample of the labelled rows of remainder 1 (at most `calibration_rows`, default 50,000, least hashes of their ids first,
an id with all its rows or none) with models that have counted all other rows; then the sample is counted too, and the
models of all labelled training rows score. Only the text is read for a score.

Rows whose crc32(doc_id as text) leaves 2 modulo 4 are never learned from: remainders 0, 1 and 3 are counted.

Defined cases: a null or empty text, or one without words, scores the share of toxic calibration rows; without
training rows of both classes every score is that share (0 without any); a null doc_id has no label; of repeated
labels the largest holds; repeated documents count and are scored as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import SLICE_BYTES, as_long, binary_parts, checkpoint, fresh, read_table, slices, with_schema
from vectrail.llm.decontaminate import words_of

BROADCAST_ROWS = 1_000_000
CACHE_WORDS = 500_000
KEPT_BLOCKS = 4
DISCOUNT = 0.75


def _grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all words as numbers, and each one's word; a word shorter than an n-gram is padded at its end."""
    padded = [(b" " + w + b" ").ljust(order) for w in words]
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.int64)
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    word = np.repeat(np.arange(len(words)), lens)
    g = np.zeros(max(0, len(raw) - order + 1), np.int64)
    for j in range(order):
        g = (g << 8) | raw[j : len(raw) - order + 1 + j]
    inside = word[: len(g)] == word[order - 1 :]
    return g[inside], word[: len(g)][inside]


def _counts(order: int):
    def run(batches):
        held: list[Counter] = [Counter(), Counter()]

        def flush():
            kinds = list(set(held[0]) | set(held[1]))
            if not kinds:
                return
            g, word = _grams(kinds, order)
            keys, at = np.unique(g, return_inverse=True)
            sums = [np.bincount(at, weights=np.array([h[w] for w in kinds], float)[word], minlength=len(keys)).astype(np.int64) for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[0]), pa.array(sums[1])], names=["g", "c0", "c1"])
            held[0].clear(), held[1].clear()

        for batch in batches:
            raw, off = binary_parts(batch.column(0))
            labels = batch.column(1).to_pylist()
            for i, j in slices(off):
                for k in range(i, j):
                    held[labels[k]].update(words_of(raw[off[k] : off[k + 1]].tobytes()))
                if len(held[0]) + len(held[1]) > CACHE_WORDS:
                    yield from flush()
        yield from flush()

    return run


def _tables(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(g, ratio) of the n-grams and (h, ratio) of the contexts, from n-grams with both classes' counts."""
    d = F.lit(DISCOUNT)
    mask = lambda m: F.lit((1 << (8 * m)) - 1).cast("long")
    levels = {order: grams.select("g")}
    for m in range(order - 1, 0, -1):
        levels[m] = levels[m + 1].select(F.col("g").bitwiseAND(mask(m)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    lower = levels[1].crossJoin(F.broadcast(levels[1].agg(F.sum("n").alias("s"), F.count("*").alias("t"))))
    lower = lower.select("g", ((F.col("n") - d) / F.col("s") + d * F.col("t") / F.col("s") / 256).alias("p"))
    for m in range(2, order):
        here = levels[m].withColumn("h", F.shiftright("g", 8))
        context = here.groupBy("h").agg(F.sum("n").alias("s"), F.count("*").alias("t"))
        back = lower.select(F.col("g").alias("low"), F.col("p").alias("q"))
        lower = here.join(context, "h").withColumn("low", F.col("g").bitwiseAND(mask(m - 1))).join(back, "low")
        lower = lower.select("g", ((F.col("n") - d) / F.col("s") + d * F.col("t") / F.col("s") * F.col("q")).alias("p"))
    here = grams.withColumn("h", F.shiftright("g", 8))
    sums = [x for k in "01" for x in (F.sum(f"c{k}").alias(f"s{k}"), F.count_if(F.col(f"c{k}") > 0).alias(f"t{k}"))]
    context = here.groupBy("h").agg(*sums)
    lam = lambda k: F.when(F.col(f"s{k}") > 0, d * F.col(f"t{k}") / F.col(f"s{k}")).otherwise(F.lit(1.0))
    back = lower.select(F.col("g").alias("low"), F.col("p").alias("q"))
    full = here.join(context, "h").withColumn("low", F.col("g").bitwiseAND(mask(order - 1))).join(back, "low")
    p = lambda k: F.greatest(F.col(f"c{k}") - d, F.lit(0.0)) / F.greatest(F.col(f"s{k}"), F.lit(1)) + lam(k) * F.col("q")
    seen = full.select("g", F.log(p(1) / p(0)).alias("ratio"))
    return seen, context.select(F.col("h").alias("g"), F.log(lam(1) / lam(0)).alias("ratio"))


PACKED = "block int, grams binary, ratios binary, contexts binary, weights binary"


def _pack(batches):
    """The rows (block, kind, g, ratio) of one block as one row of sorted arrays."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if held:
        block, kind, g, ratio = (np.concatenate(x) for x in zip(*held))
        row = [pa.array(block[:1])]
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(g[at])]
            row += [pa.array([x[at].tobytes()], pa.binary()) for x in (g, ratio)]
        yield pa.RecordBatch.from_arrays(row, names=["block", "grams", "ratios", "contexts", "weights"])


def _blocks(seen: DataFrame, contexts: DataFrame, n: int) -> list:
    """Broadcasts of (number, n-grams, ratios, contexts, weights): all rows, dealt by the remainder modulo n."""
    rows = [t.select(F.pmod("g", F.lit(n)).cast("int").alias("block"), F.lit(k).alias("kind"), "g", "ratio") for k, t in enumerate((seen, contexts))]
    packed = rows[0].unionByName(rows[1]).repartitionById(n, "block").mapInArrow(_pack, PACKED)
    kinds = (np.int64, float, np.int64, float)
    share = seen.sparkSession.sparkContext.broadcast
    return [share((r[0], *(np.frombuffer(x, t) for x, t in zip(r[1:], kinds)))) for r in packed.toLocalIterator()]


@dataclass
class Model:
    """What scoring needs: the tables as broadcast blocks, and a curve."""

    order: int
    n_blocks: int
    blocks: list  # of broadcasts; a block that got no row is left out
    curve: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    share: float = 0.0

    def word_ratios(self, words: list[bytes]) -> np.ndarray:
        g, word = _grams(words, self.order)
        out, seen = np.zeros(len(g)), np.zeros(len(g), bool)
        for shared in self.blocks:
            number, grams, ratios, contexts, weights = shared.value
            if len(self.blocks) > KEPT_BLOCKS and getattr(shared, "_path", None):
                del shared._value  # read again from its file next time
            for keys, values, ask, final in ((contexts, weights, g >> 8, False), (grams, ratios, g, True)):
                if len(keys):
                    at = np.flatnonzero((ask % self.n_blocks == number) & ~seen)
                    k = np.minimum(np.searchsorted(keys, ask[at]), len(keys) - 1)
                    hit = keys[k] == ask[at]
                    out[at[hit]] = values[k[hit]]
                    seen[at[hit]] |= final
        return np.bincount(word, weights=out, minlength=len(words))

    def probability(self, features: np.ndarray) -> np.ndarray:
        empty = features[:, 2] == 0
        if self.curve is None:
            return np.full(len(features), self.share)
        z = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale]) @ self.curve
        return np.where(empty, self.share, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _features(model, cache: dict[bytes, float], raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: ratio per word, ratio over the root of the length, log(1 + words), the most toxic word's ratio."""
    out = np.zeros((len(off) - 1, 4))
    for i, j in slices(off, SLICE_BYTES * min(8, max(1, len(model.blocks)))):
        flat, sizes = [], []
        for k in range(i, j):
            words = words_of(raw[off[k] : off[k + 1]].tobytes())
            sizes.append(len(words))
            flat += words
        got = np.array(list(map(cache.get, flat, repeat(np.nan))), float)
        if len(miss := np.flatnonzero(np.isnan(got))):
            new = list({flat[m] for m in miss.tolist()})
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
            values = dict(zip(new, model.word_ratios(new).tolist()))
            cache.update(values)
            got[miss] = [values[flat[m]] for m in miss.tolist()]
        n = np.array(sizes)
        has = np.flatnonzero(n)
        if len(has):
            first = (np.cumsum(n) - n)[has]
            total, top = np.add.reduceat(got, first), np.maximum.reduceat(got, first)
            out[i + has] = np.column_stack([total / n[has], total / np.sqrt(n[has]), np.log1p(n[has]), top])
    return out


def _featured(text_at: int, model: Model):
    def run(batches):
        cache = {}
        for batch in batches:
            f = _features(model, cache, *binary_parts(batch.column(text_at)))
            value = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), 4).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, "features"])

    return run


def _scored(text_at: int, model: Model, name: str):
    def run(batches):
        cache = {}
        for batch in batches:
            p = model.probability(_features(model, cache, *binary_parts(batch.column(text_at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return run


def remainder(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by damped Newton steps with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w, mean, scale


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """(id) of remainder 1, least hashes first, while all their rows are at most `most`; what does not fit is skipped."""
    ids = rows.filter(remainder(F.col("id")) == 1).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    found, total = [], 0
    for i, n in ids.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "n").collect():
        if total + n <= most:
            found.append((i,))
            total += n
    return rows.sparkSession.createDataFrame(found, "id long")


def _model(grams: DataFrame, order: int, block_rows: int) -> Model:
    n_blocks = -(-grams.count() // block_rows) | 1  # odd: a remainder then depends on all bytes
    return Model(order, n_blocks, _blocks(*_tables(grams, order), n_blocks))


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = 4, block_rows: int = 1 << 20, calibration_rows: int = 50_000) -> Model:
    """Both language models from all labelled rows of remainders 0, 1 and 3, and the curve from a sample of remainder 1."""
    known = labels.select(as_long(labels, doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = documents.select(as_long(documents, doc_id).alias("id"), F.col(text).alias("text")).filter(remainder(F.col("id")) != 2)
    rows = rows.join(F.broadcast(known) if small else known, "id")
    held = _sampled(rows, calibration_rows)
    count = lambda t: t.select("text", "y").mapInArrow(_counts(order), "g long, c0 long, c1 long")
    whole = lambda t: checkpoint(t.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    grams = whole(count(rows.join(F.broadcast(held), "id", "left_anti")))
    classes = grams.agg(F.sum("c0"), F.sum("c1")).first()
    model = _model(grams, order, block_rows)
    asked = rows.join(F.broadcast(held), "id", "left_semi").select("text", "y")
    sample = asked.mapInArrow(_featured(0, model), with_schema(asked, features=T.ArrayType(T.DoubleType()))).select("features", "y").toPandas()
    for block in model.blocks:
        block.destroy()
    grams = whole(grams.unionByName(count(asked)))
    model = _model(grams, order, block_rows)
    y = sample.y.to_numpy(float)
    model.share = float(y.mean()) if len(y) else 0.0
    if 0 < model.share < 1 and all(classes):
        x = np.array(sample.features.tolist(), float)
        model.curve, model.mean, model.scale = fit_curve(x, y)
    return model


def score(documents: DataFrame, model: Model, *, text: str = "text") -> tuple[DataFrame, str]:
    """Every row and column of `documents` with its score, and the score column's name."""
    name = fresh(documents, "score")
    return documents.mapInArrow(_scored(documents.columns.index(text), model, name), with_schema(documents, **{name: T.DoubleType()})), name


def drop_toxic(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text: str = "text", **options) -> DataFrame:
    """`documents` without those that score `threshold` or more; columns stay the same."""
    scored, name = score(documents, train(documents, labels, text=text, **options), text=text)
    return scored.filter(F.col(name) < threshold).drop(name)


def op9_toxicity_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """One row per document with its toxicity score."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored, name = score(docs.select(as_long(docs, "doc_id").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), F.col(name).alias("score"), F.when(F.col(name) >= 0.3, 1).otherwise(0).alias("predicted"))
