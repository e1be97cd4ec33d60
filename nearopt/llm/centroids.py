"""Clustering around centroids in whole numbers, with partial-distance search for the nearest centroid.

Components are integers, so distances, sums and means are exact, and neither the number of tasks nor their order changes
a result.  The kept vectors are written once as integers.  A round is one pass over them: a task finds each vector's
nearest centroid and sums the vectors of each, and only these sums (a number for each centroid and component) are
shuffled.  The driver holds the centroids alone.

Search: dimensions are gone through in blocks, those of largest variance first.  The first block of all centroids shows
which one to measure first; with its distance as the bound, each further centroid's squared differences add up block
after block, and vectors whose sum is strictly above their bound leave it.  Who stays through all dimensions is compared,
ties going to the smaller number; nothing with the least distance can leave, so the result is that of the full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm.util import dropped, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers beyond this size are held at it, so that a distance (64 squares of twice as much) fits in a long.
LARGEST = 1 << 27
#: Dimensions of a block, and vectors searched at once.
BLOCK, ROWS = 8, 4096


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors with as many components, none of them null or non-finite: q is floor(scale * component),
    held within LARGEST."""
    v = F.col(f"`{vector_col}`")
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    within = lambda x: F.least(F.greatest(x, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    whole = F.transform(v, lambda x: F.floor(within(x.cast("double") * scale)).cast("int"))
    return vectors.where(v.isNotNull() & fine).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("q"))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The column q as rows of a matrix of 64-bit integers."""
    return batch.column(batch.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK, spent: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; order has the dimensions, the most telling first.
    spent, if given, gets the number of squared differences taken."""
    n, k = len(x), len(centroids)
    x, c = np.ascontiguousarray(x[:, order]), centroids[:, order]
    d, used = x.shape[1], 0
    head = min(block, d)
    near = ((x[:, None, :head] - c[None, :, :head]) ** 2).sum(2)  # n x k, from the first block
    used += n * k * head
    which = near.argmin(1)
    best = near[np.arange(n), which] + ((x[:, head:] - c[which, head:]) ** 2).sum(1)
    used += n * (d - head)
    first = which.copy()
    for j in range(k):
        rows = np.flatnonzero((first != j) & (near[:, j] <= best))
        part = near[rows, j]
        for a in range(head, d, block):
            if not len(rows):
                break
            part = part + ((x[rows, a : a + block] - c[j, a : a + block]) ** 2).sum(1)
            used += len(rows) * (min(a + block, d) - a)
            stays = part <= best[rows]
            rows, part = rows[stays], part[stays]
        better = (part < best[rows]) | (j < which[rows])  # at a tie the smaller number
        best[rows[better]], which[rows[better]] = part[better], j
    if spent is not None:
        spent.append(used)
    return which, best


def _moments(q: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(rows, variance of each dimension), for the order of the search only."""

    def task(batches):
        n, s, s2 = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _rows(batch, width).astype(float)
            n, s, s2 = n + len(x), s + x.sum(0), s2 + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(s), pa.array(s2)], ["j", "n", "s", "s2"])

    rows = q.mapInArrow(task, "j long, n long, s double, s2 double").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).orderBy("j").collect()
    if not rows or not rows[0].n:
        return 0, np.zeros(width)
    n = rows[0].n
    return n, np.array([r.s2 / n - (r.s / n) ** 2 for r in rows])


def _start(q: DataFrame, k: int, seed: int | str) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids, in that order; equal ids are ordered by their vectors."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = q.select(hexed.alias("hex"), "q").orderBy("hex", "q").limit(k).collect()  # k rows, a top-k in each task first
    return np.array([r.q for r in rows], np.int64)


def _moved(q: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; those of no vector stay."""
    k, width = centroids.shape

    def task(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = _rows(batch, width)
            for a in range(0, len(x), ROWS):
                part = x[a : a + ROWS]
                which, _ = nearest(part, centroids, order)
                n += np.bincount(which, minlength=k)
                by = np.argsort(which, kind="stable")
                own, starts = np.unique(which[by], return_index=True)
                total[own] += np.add.reduceat(part[by], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    rows = q.mapInArrow(task, "cluster long, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("j", "v"))
    rows = rows.groupBy("cluster", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = centroids.copy()
    for r in rows.collect():  # k * width rows
        if r.n:
            out[r.cluster, r.j] = int(r.v) // int(r.n)
    return out


def _assigned(q: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    width = centroids.shape[1]

    def task(batches):
        for batch in batches:
            x = _rows(batch, width)
            found = [nearest(x[a : a + ROWS], centroids, order) for a in range(0, len(x), ROWS)]
            which, best = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(which.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return q.mapInArrow(task, f"vec_id {dict(q.dtypes)['vec_id']}, cluster int, distance long")


def sha_of(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int | str = 1) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null, or with a null or non-finite component are left out; zero vectors stay.  A null id
    is hashed as "null"; equal ids are ordered by their vectors; repeated rows count each for itself.  With fewer than k
    kept vectors there are as many centroids as vectors, and with none no rows.  Components beyond LARGEST / scale in
    size count as that; sums of distances beyond a long count as the largest long.  Other columns aren't read.
    """
    q = written(integers(vectors, id_col, vector_col, dimensions, scale), "centroid-integers")
    n, spread = _moments(q, dimensions)
    order = np.argsort(-spread, kind="stable")
    centroids = _start(q, k, seed) if n else np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        centroids = _moved(q, centroids, order)
    rows = written(_assigned(q, centroids, order), "centroid-rows")
    dropped(q)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    spark = vectors.sparkSession
    total = min(sum(int(r.s) for r in sums), (1 << 63) - 1)
    facts = spark.createDataFrame([(r.cluster, min(int(r.s), (1 << 63) - 1), total, sha_of(centroids[r.cluster])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(name: str, before: str) -> str:
    """Assignment to the centroids of `before` and their means, as the centroids `name`."""
    return f"""{name}_at AS MATERIALIZED ({_sql_assign(before)}),
{name}_mean AS MATERIALIZED (SELECT cluster, list(CAST(floor_of AS BIGINT) ORDER BY j) AS c FROM (SELECT cluster, j, CASE WHEN s >= 0 THEN s // m ELSE -((-s + m - 1) // m) END AS floor_of FROM (SELECT cluster, j, sum(v) AS s, count(*) AS m FROM (SELECT cluster, unnest(q) AS v, unnest(range(0, {DIMENSIONS})) AS j FROM {name}_at) GROUP BY cluster, j)) GROUP BY cluster),
{name} AS MATERIALIZED (SELECT b.cluster, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN {name}_mean m USING (cluster))"""


def _sql_assign(before: str) -> str:
    square = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT vec_id, any_value(q) AS q, min_by(cluster, (CAST(d AS BIGINT), cluster)) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (SELECT row, vec_id, q, cluster, {square} AS d FROM kept, {before}) GROUP BY row, vec_id"


SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY hex, q) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS hex, q FROM kept ORDER BY hex, q LIMIT {CENTROIDS})),
{_sql_round("c1", "c0")},
{_sql_round("c2", "c1")},
{_sql_round("c3", "c2")},
final AS MATERIALIZED ({_sql_assign("c3")})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM final JOIN c3 USING (cluster)
"""
