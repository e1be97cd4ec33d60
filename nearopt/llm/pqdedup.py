"""Near-duplicate embeddings by product quantisation, without lost links.

Vectors are scaled to length 1, where cosine >= c means a distance of at most r = sqrt(2 - 2 c).

1. Equal vectors of a label are one class, which weighs as many vectors as it stands for.
2. Coarse centres and the codebooks of the residuals' subspaces are fitted on a bounded sample; each class gets the
   list of its nearest centre, its code, and the length e of what the code leaves out.
3. Each class probes the lists that can hold a vector within r.  A vector of list b is no nearer to the prober's own
   centre a than to b, so it lies beyond the plane half way between them; the list is probed if that plane is within
   r.  These probes are sufficient, whatever the data.
4. In a list, distances come from a table for each prober, by asymmetric lookup of the codes.  A distance above r + e
   rules a pair out, by the triangle inequality; the rest are ranked by the exact cosine of the original vectors.

Lists are dealt into blocks of bounded size, by label; a block gives counts and, for components, one edge for each
vector at most, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv
from nearopt.llm.components import components
from nearopt.llm.util import scratch, written
from nearopt.llm.vectors import keys, padded, usable
from nearopt.llm.vectors import rows as rows_of

#: Least cosine of a link.
COSINE = 0.98
#: Vectors the index is fitted on (those of the smallest hashes) at least, and for each list; vectors of a list on
#: average, of which a quarter to 16 times as many lists are tried, and most lists.
SAMPLE, EACH, PER_LIST, MOST_LISTS = 16_384, 4, 4096, 65_536
#: Comparisons by lookup that cost as much as sending a vector to a list.
PROBE = 500
#: Distances to centres that are held at once.
HELD = 1 << 24
#: Subspaces, codewords of each, and steps of the fitting.
PARTS, WORDS, STEPS = 8, 64, 8
#: Members and probers of a block at most, on average of the deal.
CHUNK = 2048
#: Slack for rounding in the bounds; it only adds pairs to the exact step.
SLACK = 1e-6


def _steps(n: int, centres: int):
    """Slices of n vectors, so that their distances to all centres stay within HELD."""
    size = max(16, HELD // centres)
    return [slice(a, a + size) for a in range(0, n, size)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm = (centres * centres).sum(1)
    return np.concatenate([(norm - 2 * x[s] @ centres.T).argmin(1) for s in _steps(len(x), len(centres))]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def probes(centres: np.ndarray, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
    """The lists of centres that can hold a vector within radius of each vector, whose own list is given."""
    norm, out = (centres * centres).sum(1), []
    for s in _steps(len(x), len(centres)):
        d = norm - 2 * x[s] @ centres.T
        home, at = np.unique(own[s], return_inverse=True)
        gap = np.sqrt(np.maximum(norm[home, None] + norm - 2 * centres[home] @ centres.T, 0))
        near = d - d[np.arange(len(d)), own[s]][:, None] <= 2 * radius * gap[at] + SLACK
        out += [np.flatnonzero(row).astype(np.int32) for row in near]
    return out


def number_of_lists(sample: np.ndarray, n: int, alike: float, radius: float) -> int:
    """How many lists make the least work for n vectors like the sample, of which a share `alike` has a vector's label.

    More lists are shorter, but of data without clusters a vector probes more of them.  So a few numbers are tried on
    the sample: a probe, for which a vector travels, costs as much as PROBE comparisons by lookup.
    """
    best = (math.inf, 1)
    held_out = np.arange(len(sample)) % max(2, len(sample) // 1000) == 0  # those a centre is fitted on are nearer to it
    asked, sample = sample[held_out], sample[~held_out] if len(sample) > 1 else sample
    for times in (0.25, 1, 4, 16):
        lists = int(max(1, min(MOST_LISTS, n * times / PER_LIST, len(sample) / EACH)))
        centres = k_means(sample, lists, np.random.default_rng(3), 3)
        share = np.bincount(_nearest(sample, centres), minlength=lists) / len(sample)
        found = probes(centres, asked, _nearest(asked, centres), radius)
        work = PROBE * np.mean([len(p) for p in found]) + n * alike * np.mean([share[p].sum() for p in found])
        best = min(best, (work, lists))
    return best[1]


class Index:
    """Coarse centres and, for each subspace, codewords of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres = k_means(sample, lists, rng)
        residuals = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.words = [k_means(residuals[:, a:b], WORDS, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, error) of unit vectors."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, a:b], w) for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words)], 1).astype(np.uint8)
        said = np.concatenate([w[codes[:, p]] for p, w in enumerate(self.words)], 1)
        return own, codes, np.linalg.norm(rest - said, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Which lists each vector probes."""
        return probes(self.centres, x, own, radius)

    def distances(self, x: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from vectors to the members of a list, by lookup in a table for each vector."""
        rest = x - self.centres[of_list]
        out = np.zeros((len(x), len(codes)), np.float32)
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, w = rest[:, a:b], self.words[p]
            table = ((part * part).sum(1)[:, None] + (w * w).sum(1) - 2 * part @ w.T).astype(np.float32)
            out += table[:, codes[:, p]]
        return np.sqrt(np.maximum(out, 0))


def kept_as(vectors: DataFrame, vector_col: str) -> type:
    """The type that holds the components without loss: float32 for an array<float>, else float64."""
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, the vector's key (k1, k2) and its components as bytes; null bytes where it can't be compared.

    Vectors of different lengths are never equal in label here: the length is part of the label.
    """
    kind = kept_as(vectors, vector_col)

    def of(batches):
        for batch in batches:
            ok, size, values = usable(batch.column(2), kind)
            at = pa.array(np.cumsum(ok) - 1, mask=~ok)
            labels = pa.array([f"{n}:{x}" for n, x in zip(size.tolist(), batch.column(1).filter(pa.array(ok)).to_pylist())], pa.string())
            halves = keys(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), labels.take(at), pa.array(halves[:, 0], pa.int64()).take(at), pa.array(halves[:, 1], pa.int64()).take(at), values.take(at)], ["vec_id", "label", "k1", "k2", "vector"])

    # Without a label a vector is compared with none, as if it were none.
    own = F.when(F.col(label_col).isNotNull(), F.col(vector_col)).alias("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), own)
    return rows.mapInArrow(of, "vec_id long, label string, k1 long, k2 long, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _block(index: Index, of_list: int, members: dict, probers: dict, cosine: float, radius: float):
    """(links of each prober by weight, edges) of a block."""
    counts = np.zeros(len(probers["rep"]), np.int64)
    all_i, all_j = [], []
    for a in range(0, len(counts), 256):
        some = slice(a, a + 256)
        near = index.distances(probers["unit"][some], of_list, members["code"]) <= radius + members["error"] + SLACK
        near &= probers["rep"][some][:, None] != members["rep"]
        i, j = np.nonzero(near)
        ok = np.concatenate([cosines(probers["x"][some][i[b : b + 8192]], members["x"][j[b : b + 8192]]) >= cosine for b in range(0, len(i), 8192)]) if len(i) else np.empty(0, bool)
        i, j = i[ok] + a, j[ok]
        np.add.at(counts, i, members["weight"][j])
        all_i.append(i)
        all_j.append(j)
    i, j = np.concatenate(all_i), np.concatenate(all_j)
    nodes, at = np.unique(np.concatenate([probers["rep"][i], members["rep"][j]]), return_inverse=True)
    left, right = at[: len(i)], at[len(i) :]
    least = np.arange(len(nodes))
    while True:  # smallest node that links within the block reach
        new = least.copy()
        np.minimum.at(new, left, least[right])
        np.minimum.at(new, right, least[left])
        new = new[new]
        if (new == least).all():
            break
        least = new
    other = least != np.arange(len(nodes))
    return counts, nodes[other], nodes[least[other]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row per row of vectors: vec_id, n_links, component_id, kept.

    Rows are compared if their labels are equal and not null and their vectors have the same length.  n_links counts
    the other rows linked directly, component_id is the smallest vec_id that links reach, its own included, and kept
    says that it is its own.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; so do rows with a null id, for which component_id is null and kept true.  Repeated rows are linked.  An
    empty table gives no rows; other columns are not read.
    """
    with scratch() as keep:
        return _near_duplicates(keep(written(clean(vectors, id_col, vector_col, label_col), "vectors")), kept_as(vectors, vector_col), cosine, keep)


def _near_duplicates(rows: DataFrame, kind: type, cosine: float, keep) -> DataFrame:
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    usable = rows.where("vector is not null and vec_id is not null")
    classes = written(usable.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.length("vector"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width //= np.dtype(kind).itemsize
    alike = classes.groupBy("label").count().agg(F.sum(F.pow(F.col("count") / F.lit(float(n)), 2))).first()[0]
    most = min(MOST_LISTS, n // PER_LIST)
    sample = classes.select("vector", "rep").orderBy(F.xxhash64("rep"), "rep").limit(max(SAMPLE, EACH * most)).select("vector").toArrow().column(0)
    sample = _unit(padded(sample, width, kind))
    index = Index(sample, number_of_lists(sample, n, alike, radius))

    def assigned(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _unit(padded(part.column(3), width, kind))
                own, codes, errors = index.encode(x)
                lists = index.probes(x, own, radius)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(lists, pa.list_(pa.int32()))], ["rep", "label", "weight", "vector", "list", "code", "error", "probes"])

    coded = written(classes.select("rep", "label", "weight", "vector").mapInArrow(assigned, "rep long, label string, weight long, vector binary, list int, code binary, error double, probes array<int>"), "coded")
    probing = coded.select("rep", "label", F.explode("probes").alias("list"))
    size = lambda df, name: df.groupBy("label", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    deals = written(size(coded, "m").join(size(probing, "p"), ["label", "list"]), "deals")
    share = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    members = coded.select("rep", "label", "list", "weight", "vector", "code", "error", F.lit(False).alias("probing")).join(deals, ["label", "list"]).withColumn("i", share("m")).withColumn("j", spread("p"))
    probers = coded.select("rep", "label", F.explode("probes").alias("list"), "weight", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), F.lit(True).alias("probing")).join(deals, ["label", "list"]).withColumn("i", spread("m")).withColumn("j", share("p"))
    dealt = members.unionByName(probers).withColumn("block", F.xxhash64("label", "list", "i", "j"))
    dealt = dealt.select("block", "label", "list", "probing", "rep", "weight", "vector", "code", "error").repartition("block").sortWithinPartitions("block", "probing")

    def compared(batches):
        def done(table: pa.Table):
            blocks = table.column("block").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            out = []
            for a, b in zip(first, first[1:]):
                part = table.slice(a, b - a)
                probing = part.column("probing").to_numpy()
                m = int(np.searchsorted(probing, True))
                if not 0 < m < b - a:
                    continue
                x = padded(part.column("vector"), width, kind)
                unit, rep = _unit(x), part.column("rep").to_numpy()
                code = rows_of(part.column("code").slice(0, m), np.uint8)
                held = {"rep": rep[:m], "x": x[:m], "code": code, "error": part.column("error").slice(0, m).to_numpy().astype(np.float32), "weight": part.column("weight").to_numpy()[:m]}
                counts, hi, lo = _block(index, part.column("list")[0].as_py(), held, {"rep": rep[m:], "x": x[m:], "unit": unit[m:]}, cosine, radius)
                some = counts > 0
                out.append((np.concatenate([rep[m:][some], hi]), np.concatenate([counts[some], np.full(len(hi), -1)]), np.concatenate([rep[m:][some], lo])))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "n", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            blocks = held.column("block").to_numpy()
            cut = int(np.searchsorted(blocks, blocks[-1], "left")) if len(blocks) else 0
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    found = written(dealt.mapInArrow(compared, "a long, n long, b long"), "found")  # n >= 0: links counted; -1: an edge
    links = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comps = components(found.where("n < 0").select("a", "b")).withColumnsRenamed({"id": "rep", "component": "comp"})
    per_class = keep(written(classes.select("label", "k1", "k2", "rep", "weight").join(links, "rep", "left").join(comps, "rep", "left").select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("comp", "rep").alias("comp")), "per-class"))
    usable_key = F.when(F.col("vec_id").isNotNull(), F.col("label"))
    out = rows.select("vec_id", usable_key.alias("label"), "k1", "k2").join(per_class, ["label", "k1", "k2"], "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least_of ON id = vec_id LEFT JOIN counted ON a = vec_id
"""
