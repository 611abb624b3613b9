"""Cosine search, closest pairs, analogies and projections. vectors: idx, token, vec array<double>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.vectors import cosine
from vecloom.operators import tsne
from vecloom.operators.storage import ship


#: Bytes of queries' vectors that one pass takes.
SENT_BYTES = 32 << 20
#: Similarities held at a time, and the queries that they are of.
CELLS, QUERIES = 1 << 20, 1024


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query, rank, idx, sim: the k most similar vectors of each query, ties by idx; null similarities (of zero
    vectors) last.

    The queries go out in blocks of bounded size, each against all vectors by matrix products; a
    task sends its best k of a query, so the matrix of all similarities is never stored."""
    spark = ship(vectors.sparkSession)
    kind = queries.schema["idx"].dataType.simpleString()
    q = queries.select(F.col("idx").cast("long").alias("query"), "vec")
    dims = vectors.select(F.max(F.size("vec"))).first()[0] or 1
    n, per = q.count(), max(1, SENT_BYTES // (8 * dims))
    blocks = -(-n // per)
    out = spark.createDataFrame([], "query long, idx long, sim double")
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.query for r in rows], np.int64), _units(np.array([r.vec for r in rows], np.float64))))

        def best(batches, sent=sent):
            ids, unit = sent.value
            each = min(len(ids), QUERIES)
            held = None
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, CELLS // each)):
                    part = batch.slice(at, max(1, CELLS // each))
                    idx, m = part.column(0).to_numpy(), _units(_matrix(part.column(1), unit.shape[1])).T
                    found = []
                    for q in range(0, len(ids), each):
                        sim = unit[q : q + each] @ m
                        all_idx = np.broadcast_to(idx, sim.shape)
                        if held is not None:
                            all_idx, sim = np.hstack([held[0][q : q + each], all_idx]), np.hstack([held[1][q : q + each], sim])
                        found.append(_top(all_idx, sim, k))
                    held = tuple(np.concatenate(x) for x in zip(*found))
            if held is not None:
                flat = held[1].reshape(-1)
                yield pa.record_batch([pa.array(np.repeat(ids, held[0].shape[1])), pa.array(held[0].reshape(-1).astype(np.int64)), pa.array(flat, mask=np.isnan(flat))], ["query", "idx", "sim"])

        out = out.unionByName(vectors.select(F.col("idx").cast("long").alias("idx"), "vec").mapInArrow(best, "query long, idx long, sim double"))
    order = W.partitionBy("query").orderBy(F.col("sim").desc_nulls_last(), "idx")
    back = vectors.schema["idx"].dataType.simpleString()
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").cast(kind).alias("query"), "rank", F.col("idx").cast(back).alias("idx"), "sim")


def _matrix(vectors, dims: int):
    """Rows of a column of lists; null ones are nan."""
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    if not pc.all(pc.equal(pc.list_value_length(vectors), dims), min_count=0).as_py():
        raise ValueError(f"a vector hasn't {dims} dimensions")
    out = np.full((len(vectors), dims), np.nan)
    out[there] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return out


def _top(idx, sim, k: int):
    """idx and sim of the k largest of each row, ties by idx, nan last."""
    value = np.where(np.isnan(sim), -np.inf, sim)
    if sim.shape[1] <= k:
        col = np.lexsort((idx, -value), axis=1)
    else:
        row, col = np.nonzero(value >= np.partition(value, -k, axis=1)[:, [-k]])
        order = np.lexsort((idx[row, col], -value[row, col], row))
        row, col = row[order], col[order]
        col = col[np.arange(len(row)) - np.searchsorted(row, np.arange(len(sim)))[row] < k].reshape(len(sim), k)
    return np.take_along_axis(idx, col, 1), np.take_along_axis(sim, col, 1)


def _units(m):
    """Rows over their norms; rows of norm 0 become nan."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def closest_pairs(vocab: DataFrame, inputs: DataFrame, outputs: DataFrame, max_words: int = 100, k: int = 5) -> DataFrame:
    """word, rank, match, sim: input vectors of the most frequent words, or of all where there are no more
    than max_words, against output vectors of all."""
    from vecloom.operators.vocabulary import top_words

    few = vocab.limit(max_words + 1).count() <= max_words
    top = (vocab if few else top_words(vocab, max_words)).select("idx").join(inputs, "idx")
    found = top_similar(top, outputs, k)
    names = vocab.select("idx", "token")
    return found.join(names.select(F.col("idx").alias("query"), F.col("token").alias("word")), "query").join(names.withColumnRenamed("token", "match"), "idx").select("word", "rank", "match", "sim")


#: First line of the text of closest pairs: fixed value.
HEADER = 'Closest pairs in format "{word}:{closest_word_pairs}"'


def closest_pairs_text(pairs: DataFrame) -> DataFrame:
    """A header and lines `word: a, b, c`, in the order of at."""
    lists = pairs.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "match"))).alias("m"))
    lines = lists.select(F.lit(1).alias("at"), F.concat("word", F.lit(": "), F.array_join(F.transform("m", lambda x: x["match"]), ", ")).alias("value"))
    head = pairs.sparkSession.createDataFrame([(0, HEADER)], "at int, value string")
    return head.unionByName(lines)


def save_closest_pairs(pairs: DataFrame, path: str) -> None:
    """The text as one file folder, header first."""
    closest_pairs_text(pairs).repartition(1).sortWithinPartitions("at", "value").select("value").write.mode("overwrite").text(path)


def analogy(combos: DataFrame, inputs: DataFrame, outputs: DataFrame, k: int = 5) -> DataFrame:
    """combos: start, minus, plus, end. Adds cosine (of start - minus + plus to end, input vectors) and
    nearest (the k best output tokens). Rows with a word outside the vocabulary go."""
    rows = combos.withColumn("id", F.xxhash64("start", "minus", "plus", "end"))
    for role in ("start", "minus", "plus", "end"):
        rows = rows.join(inputs.select(F.col("token").alias(role), F.col("vec").alias(f"v_{role}")), role)
    made = F.zip_with(F.zip_with("v_start", "v_minus", lambda a, b: a - b), "v_plus", lambda a, b: a + b)
    rows = rows.withColumn("vec", made).withColumn("cosine", cosine("vec", "v_end"))
    near = top_similar(rows.select(F.col("id").alias("idx"), "vec"), outputs, k).join(outputs.select("idx", "token"), "idx")
    lists = near.groupBy(F.col("query").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ", ").alias("nearest"))
    return rows.join(lists, "id", "left").select("start", "minus", "plus", "end", "cosine", "nearest")


def project(vectors: DataFrame, max_words: int | None = None, skip_unk: bool = True, labels: DataFrame | None = None, method: str = "pca", rounds: int = 500) -> DataFrame:
    """idx, token, x, y (and label): two dimensions of the vectors. method 'pca' or 'tsne'; the latter is exact on the driver up to
    DRIVER_WORDS words and goes through neighbours and a grid beyond."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.where("idx <> 0") if skip_unk else vectors
    if max_words is not None:
        df = df.orderBy("idx").limit(max_words)
    dims = df.select(F.size("vec")).first()[0]
    if dims < 2:
        raise ValueError("projection needs two dimensions")
    if dims == 2:
        out = df.select("idx", "token", "vec")
    elif method == "pca":
        v = df.withColumn("v", array_to_vector("vec"))
        out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("idx", "token", vector_to_array("p").alias("vec"))
    elif method == "tsne":
        if df.limit(DRIVER_WORDS + 1).count() <= DRIVER_WORDS:
            out = _tsne(df, rounds=rounds)
        else:
            points = tsne.embed(df.select("idx", "vec"), rounds=rounds)
            out = df.select("idx", "token").join(points, "idx").select("idx", "token", F.array("x", "y").alias("vec"))
    else:
        raise ValueError(f"method {method!r}")
    out = out.select("idx", "token", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    return out if labels is None else out.join(labels.withColumnRenamed("node", "token"), "token", "left")


#: Words of an exact t-SNE on the driver at most.
DRIVER_WORDS = 2000


def _tsne(df: DataFrame, perplexity: float = 30.0, rounds: int = 500, seed: int = 42) -> DataFrame:
    """Exact t-SNE on the driver, for at most DRIVER_WORDS rows."""
    import numpy as np

    rows = df.select("idx", "token", "vec").collect()
    x = np.array([r.vec for r in rows])
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    target, p = np.log(min(perplexity, max(2.0, (n - 1) / 3))), np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(d[i] - np.delete(d[i], i).min()) * beta)
            w[i] = 0
            w /= w.sum()
            h = -(w[w > 0] * np.log(w[w > 0])).sum()
            lo, hi = (beta, hi) if h > target else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = w
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, move = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap**2).sum(-1))
        np.fill_diagonal(w, 0)
        g = (((p * (4 if t < 100 else 1) - np.maximum(w / w.sum(), 1e-12)) * w)[:, :, None] * gap).sum(1) * 4
        move = (0.5 if t < 100 else 0.8) * move - max(n / 12, 50) * g
        y = y + move - move.mean(0)
    return df.sparkSession.createDataFrame([(r.idx, r.token, v) for r, v in zip(rows, y.tolist())], "idx int, token string, vec array<double>")


def decision_line(spark, theta: list[float], low: float, high: float, points: int = 100) -> DataFrame:
    """x, y of the boundary theta0 + theta1 x + theta2 y = 0 over [low - 1, high + 1]."""
    a, b, c = theta
    step = (high - low + 2) / (points - 1)
    x = F.lit(low - 1.0) + F.col("id") * step
    return spark.range(points).select(x.alias("x"), ((-a - b * x) / c).alias("y"))


def decision_lines(lines: DataFrame, points: int = 100) -> DataFrame:
    """lines (theta array<double> of three, low, high, ...) with point, x, y in place of these: decision_line() of each row."""
    rest = [c for c in lines.columns if c not in ("theta", "low", "high")]
    at = lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("low") - 1 + F.col("point") * ((F.col("high") - F.col("low") + 2) / (points - 1)))
    a, b, c = (F.get("theta", F.lit(k)) for k in range(3))
    return at.select(*rest, "point", "x", ((-a - b * F.col("x")) / c).alias("y"))
