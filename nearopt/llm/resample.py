"""Quality by importance resampling.

Two bags of hashed word n-grams (one and two words) are counted: one over all documents, the raw text, and one over
the documents labelled good, the target.  A document's log weight is the sum, over its n-grams, of the log ratio of
the two models.  Adding a Gumbel draw to each log weight and keeping the k largest keys is sampling k documents
without replacement in proportion to their weights.

Counts are summed in each task and then by bucket, so what is shuffled is a vector per task.  The k-th largest key is
found by narrowing a histogram over keys, not by a global sort, so no task and no driver holds all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv
from nearopt.llm.util import scratch, written

#: Buckets that n-grams are hashed into; each has this many counts added before the ratio is taken.
BUCKETS, SMOOTHING = 10_000, 1.0
#: Share of the documents that the sample keeps.
SHARE = 0.8
#: Bound of the labelled sample: target documents whose ids have the smallest hashes.
MOST_TARGETS = 200_000
#: Rows that are numbered at a time.
STEP = 65_536
#: Bins of a narrowing step, and the keys that are few enough to be sorted.
BINS, FEW = 1024, 4096


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each): the hashed n-grams of the texts of a slice."""
    words, bounds = tv.words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = text[1:] == text[:-1]
    two = tv.splitmix((words[:-1] * tv._MIX[0] + words[1:] * tv._MIX[1])[pair])
    return np.concatenate([words, two]) % np.uint64(BUCKETS), np.concatenate([text, text[1:][pair]])


def model(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the target's to the raw model's probability, by bucket.

    targets has the ids of the target documents in its first column.  All documents count in the raw model.
    """
    ids = targets.select(F.col(targets.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    n = ids.count()
    if n > MOST_TARGETS:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * MOST_TARGETS / n)))
    ids = F.broadcast(ids.withColumn("target", F.lit(True)))

    def counted(batches):
        both = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = tv.as_strings(batch.column(1))
            target = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b in tv.slices(texts):
                bucket, text = _grams(texts.slice(a, b - a))
                both[0] += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
                both[1] += np.bincount(bucket[target[a:b][text]].astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0, some]), pa.array(both[1, some])], ["bucket", "raw", "good"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left").select("target", "text")
    sums = rows.mapInArrow(counted, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():  # BUCKETS rows at most
        raw[row.bucket], good[row.bucket] = row.raw, row.good
    share = lambda x: np.log(x + SMOOTHING) - math.log(x.sum() + SMOOTHING * BUCKETS)
    return share(good) - share(raw) if good.sum() else np.zeros(BUCKETS)


def weighed(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_grams and log_weight of each row of docs."""

    def of(batches):
        for batch in batches:
            texts = tv.as_strings(batch.column(1))
            for a, b in tv.slices(texts):
                bucket, text = _grams(texts.slice(a, b - a))
                weight = np.bincount(text, weights=ratio[bucket.astype(np.int64)], minlength=b - a).astype(float)  # of no n-grams it has integers
                n = np.bincount(text, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array(weight)], ["doc_id", "text_hash", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(of, "doc_id long, text_hash long, n_grams long, log_weight double")


def gumbel(seed: int, *of: Column) -> Column:
    """A Gumbel draw that depends on the seed and the columns alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n, from 0: rows equal in (doc_id, text_hash) are numbered, so that each has a draw of its own.

    Equal rows are counted and given back by their count, in steps, as no task should sort or hold a group of them.
    """
    same = ["doc_id", "text_hash"]
    groups = written(rows.groupBy(*same).agg(F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("log_weight").alias("log_weight")), "groups")
    once = groups.where("copies = 1").withColumn("n", F.lit(0).cast("long"))
    more = groups.where("copies > 1").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {STEP}"))))
    more = more.repartition("doc_id", "text_hash", "step").withColumn("n", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("copies"), (F.col("step") + 1) * STEP) - 1)))
    return once.unionByName(more.drop("step")).drop("copies")


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of finite doubles, exactly; None if k < 1 or there are no k values."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    if k == n:
        return low
    x, above = F.col(column), 0
    while True:
        inside = keys.where((x >= low) & (x <= high))
        if n <= FEW or low == high:
            return low if low == high else inside.orderBy(x.desc()).limit(FEW).select(column).collect()[k - above - 1][0]
        width = (high - low) / BINS
        if not (width > 0 and low + width > low):
            values = inside.groupBy(x).count().orderBy(x.desc()).limit(FEW).collect()
        else:
            at = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
            bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy(F.desc("bin")).collect()
            for row in bins:
                if above + row.n >= k:
                    low, high, n = row.low, row.high, row.n
                    break
                above += row.n
            continue
        for value, count in values:
            above += count
            if above >= k:
                return value


def resample(docs: DataFrame, targets: DataFrame, share: float = SHARE, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_grams, log_weight, key (log_weight and its Gumbel draw), kept.

    kept marks the ceil(share * rows) largest keys; rows that tie with the last of them are kept as well.  Each row has a
    draw of its own, from its id, its text and its number among rows equal in both; so rows that share an id, or have
    none, are sampled one by one.  Null and empty texts have no n-grams and log weight 0.  Without target documents all
    weights are 0 and the sample is uniform.  An empty table gives no rows; columns of docs but these two are not read.
    """
    with scratch() as keep:
        rows = _numbered(weighed(docs, model(docs, targets, id_col, text_col), id_col, text_col))
        draw = gumbel(seed, F.col("doc_id"), F.col("text_hash"), F.col("n"))
        keyed = keep(written(rows.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + draw).alias("key")), "keys"))
    least = kth_largest(keyed, "key", math.ceil(share * keyed.count()))
    return keyed.withColumn("kept", F.col("key") >= F.lit(math.inf if least is None else least))
