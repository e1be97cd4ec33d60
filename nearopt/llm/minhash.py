"""Near-duplicates on word shingles: MinHash bands, sequential Bayesian pruning, exact verification.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit key of their set, and a
   signature of 196 minima (at 85 percent; see scheme), of which hashes of the bands and one byte of each minimum are
   kept.  Documents with equal sets are one class from here on, so groups of exact copies cost one row.  A class has a
   number of its own, never an id of a document: ids may repeat, sets don't.
2. The band hashes give buckets; buckets of one class are dropped.
3. In a bucket, pairs are compared batch after batch of minima.  After each batch, a pair goes when the posterior
   probability that its similarity reaches the threshold, given its matches so far, is below MISS.
4. Survivors are verified on their full sets, and links give components.  A large bucket is dealt into chunks, twice and
   differently, where each row proposes its most similar survivors only; that connects most of a group of near copies.
   Large buckets that still hold several components are compared once more, full sets at hand: the rows beside the
   bucket's largest component probe all its rows, and each surviving pair of different components is verified in the
   first bucket that it shares, unless links found there connect it already.  So no pair of different components
   remains untested, and pairs of a group are never rows of a table.

All comparisons are made in blocks of bounded size, so one large bucket is the work of many tasks; what the last pass
costs grows with the rows that the first left beside the largest component, not with the square of the bucket.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv
from nearopt.llm.components import components
from nearopt.llm.util import free, having, scratch, written

#: Words in a shingle.
WIDTH = 5
#: Link: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: The bands miss a pair at the threshold with this probability at most; minima of a signature, unless a band of one
#: takes more.
BANDS_MISS, MOST = 2e-5, 256
#: Minima compared at a time, and the posterior probability of a link below which a pair is pruned.
BATCH, MISS = 28, 1e-6
#: Rows up to which all survivors of a bucket are proposed at once; of larger buckets, the rows of a chunk, how many
#: times rows are dealt into chunks, and the first proposals of each row there; rows of either side of a last block.
SMALL, CHUNK, DEALS, FIRST, CROSS = 16, 128, 2, 2, 128
#: Roles in the last pass: members of the bucket's largest component, members beside it, and the latter as probers.
MEMBER, BESIDE, PROBER = 0, 1, 2


@functools.cache
def scheme(percent: float) -> tuple[int, int]:
    """Bands and minima in a band for a threshold: the most minima, up to 7, that MOST allows at BANDS_MISS."""
    for rows in range(7, 0, -1):
        missed = 1 - (percent / 100) ** rows
        bands = max(-(-BATCH // rows), math.ceil(math.log(BANDS_MISS) / math.log(missed)) if missed > 0 else 1)
        if bands * rows <= MOST:
            break
    return bands, rows


@functools.cache
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(85))
    a = rng.integers(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, hashes, dtype=np.uint32)


def signature(shingles: np.ndarray, percent: float = PERCENT) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit shingles."""
    a_, b_ = _functions(math.prod(scheme(percent)))
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a_), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(high), 256):
        np.minimum(out, (high[a : a + 256, None] * a_ + b_).min(0), out=out)
    return out


def band_hashes(least: np.ndarray, percent: float = PERCENT) -> np.ndarray:
    """A hash of each band of a signature and its number."""
    bands, rows = scheme(percent)
    mixed = (least.reshape(bands, rows).astype(np.uint64) * tv._MIX[:rows]).sum(1) + np.arange(bands, dtype=np.uint64) * tv._MIX[7]
    return tv.splitmix(tv.splitmix(mixed)).view(np.int64)


@functools.cache
def least_matches(threshold: float, miss: float = MISS, hashes: int = math.prod(scheme(PERCENT))) -> dict[int, int]:
    """By number of minima compared, the matches below which a pair is pruned.

    The prior of the similarity s is uniform.  A byte of a minimum matches with probability s + (1 - s) / 256, so the
    posterior after m matches of n is in proportion to the binomial likelihood at that probability.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(BATCH, hashes + 1, BATCH):
        for m in range(n + 1):
            match = grid + (1 - grid) / 256
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                out[n] = m
                break
    return out


def _sets(texts: pa.Array, width: int):
    """(row, shingles) of the texts of a batch, shingles sorted and distinct."""
    for a, b in tv.slices(texts):
        flat, bounds = tv.distinct(*tv.shingles(*tv.words(texts.slice(a, b - a)), width))
        for i in range(b - a):
            yield a + i, flat[bounds[i] : bounds[i + 1]]


def described(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: float = PERCENT, mark: Column | None = None) -> DataFrame:
    """doc_id, mark (a long of the row, if given), n_shingles, the set's key (k1, k2), a hash of each band of its signature
    and a byte of each minimum, null for an empty set."""
    names = ["doc_id", "mark", "n_shingles", "k1", "k2", "bands", "signature"]

    def of(batches):
        for batch in batches:
            texts = tv.as_strings(batch.column(1))
            n, keys, bands, signatures = [], [], [], []
            known: dict[bytes, tuple] = {}
            for _, own in _sets(texts, width):
                raw = own.tobytes()
                key = xxhash.xxh3_128_digest(raw)
                n.append(len(own))
                keys.append(key)
                if len(own) and key not in known:
                    least = signature(own, percent)
                    known[key] = (band_hashes(least, percent), least.astype(np.uint8).tobytes())
                bands.append(known[key][0] if len(own) else None)
                signatures.append(known[key][1] if len(own) else None)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names)

    mark = F.lit(None).cast("long") if mark is None else mark
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), mark.alias("mark"))
    return rows.mapInArrow(tv.trimmed(of), "doc_id long, mark long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary")


def _sets_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, width: int) -> DataFrame:
    """(k1, k2, shingles) of the documents of these ids, written; each set once, however often its row repeats."""

    def of(batches):
        for batch in batches:
            sets: dict[bytes, bytes] = {}
            for _, own in _sets(tv.as_strings(batch.column(1)), width):
                raw = own.tobytes()
                sets[xxhash.xxh3_128_digest(raw)] = raw
            keys = np.frombuffer(b"".join(sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sets.values(), pa.binary())], ["k1", "k2", "shingles"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    sets = written(having(rows, "doc", ids).mapInArrow(tv.trimmed(of), "k1 long, k2 long, shingles binary"), "sets")
    keys = sets.select("k1", "k2")
    return sets if keys.count() == keys.distinct().count() else written(sets.dropDuplicates(["k1", "k2"]), "sets")


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    raw, bounds = tv.buffers(column.cast(pa.large_binary()))
    return raw[: bounds[-1]].view(dtype).reshape(-1, width)


def _pruned(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that survive all batches, and their matches."""
    seen, matches = 0, np.zeros(len(i), np.int64)
    for n, m in least.items():
        step = np.concatenate([(signatures[i[a : a + 65536], seen:n] == signatures[j[a : a + 65536], seen:n]).sum(1) for a in range(0, len(i), 65536)]) if len(i) else matches
        matches = matches + step
        keep = matches >= m
        i, j, matches, seen = i[keep], j[keep], matches[keep], n
    return i, j, matches


def _proposed(i: np.ndarray, j: np.ndarray, matches: np.ndarray) -> np.ndarray:
    """Which pairs are among the FIRST best of either end."""
    if not len(i):
        return np.ones(len(i), bool)
    ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, -matches[pair], ends))
    ends, pair = ends[order], pair[order]
    first = np.concatenate([[0], np.flatnonzero(ends[1:] != ends[:-1]) + 1])
    rank = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
    out = np.zeros(len(i), bool)
    out[pair[rank < FIRST]] = True
    return out


def _is_link(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _connecting(i: np.ndarray, j: np.ndarray, matches: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs are links that connect components not connected by those before them, most similar pairs first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = np.zeros(len(i), bool)
    for k in np.argsort(-matches, kind="stable").tolist():
        a, b = root(int(comps[i[k]])), root(int(comps[j[k]]))
        if a != b and _is_link(sets[i[k]], sets[j[k]], percent):
            parent[max(a, b)] = min(a, b)
            out[k] = True
    return out


def _small_pairs(first: np.ndarray, size: np.ndarray, rows: dict, least: dict[int, int]):
    for n in np.unique(size):
        if 2 <= n <= SMALL:
            x, y = np.triu_indices(n, 1)
            starts = first[size == n]
            i, j = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
            differ = (rows["comp"][i] != rows["comp"][j]) & (rows["rep"][i] != rows["rep"][j])
            yield _pruned(rows["signature"], i[differ], j[differ], least)


def _large_pairs(start: int, n: int, rows: dict, least: dict[int, int]):
    """Surviving pairs of different components in one block, as positions in it, and their matches.  In blocks of the
    last pass pairs are of a prober and a member; a member that probes too, here or elsewhere, only meets smaller ones."""
    sig, comp, role, rep = (rows[c][start : start + n] for c in ("signature", "comp", "role", "rep"))
    crossed = "sets" in rows
    left, right = (np.flatnonzero(role == PROBER), np.flatnonzero(role != PROBER)) if crossed else (np.arange(n), np.arange(n))
    parts, head = [], np.ascontiguousarray(sig[:, :BATCH].T)
    for a in range(0, len(left), 256):
        some = left[a : a + 256]
        matches = np.zeros((len(some), len(right)), np.uint8)
        for h in range(BATCH):
            matches += head[h, some, None] == head[h][right][None, :]
        ok = (matches >= least[BATCH]) & (comp[some, None] != comp[right][None, :]) & (rep[some, None] != rep[right][None, :])
        ok &= ((role[right] == MEMBER)[None, :] | (rep[some, None] < rep[right][None, :])) if crossed else some[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        parts.append(_pruned(sig, some[x], right[y], least))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3


def _pairs_in(rows: dict, least: dict[int, int], percent: int):
    """(a, b) ids of the pairs proposed; rows of a block stand together.  With sets and bands among the rows, the
    pairs are links that connect components."""
    blocks = rows["block"]
    first = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1])
    size = np.diff(np.append(first, len(blocks)))
    found = [] if "sets" in rows else [(i, j) for i, j, _ in _small_pairs(first, size, rows, least)]
    some = size > (1 if "sets" in rows else SMALL)
    for start, n in zip(first[some].tolist(), size[some].tolist()):
        own = slice(start, start + n)
        if (rows["comp"][own] == rows["comp"][start]).all():
            continue
        i, j, matches = _large_pairs(start, n, rows, least)
        if "sets" in rows:
            bands = rows["bands"][own]
            at = int(np.flatnonzero(bands[0] == rows["bucket"][start])[0])
            here = np.concatenate([(bands[i[a : a + 65536]] == bands[j[a : a + 65536]]).argmax(1) == at for a in range(0, len(i), 65536)]) if len(i) else np.empty(0, bool)
            i, j, matches = i[here], j[here], matches[here]
            keep = _connecting(i, j, matches, rows["comp"][own], rows["sets"][own], percent)
        else:
            keep = _proposed(i, j, matches)
        found.append((i[keep] + start, j[keep] + start))
    if not found:
        return np.empty((0, 2), np.int64)
    a, b = (rows["rep"][np.concatenate(x)] for x in zip(*found))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with block: small buckets are one; larger ones are dealt, DEALS times anew, into chunks of about CHUNK."""
    parts = F.when(F.col("n") > SMALL, F.ceil(F.col("n") / CHUNK)).otherwise(F.lit(1)).cast("int")
    deals = F.when(parts > 1, F.lit(DEALS)).otherwise(F.lit(1))
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    return rows.withColumn("block", F.xxhash64("bucket", "deal", F.pmod(F.xxhash64("deal", "rep"), parts))).withColumn("role", F.lit(MEMBER))


def _crossed(rows: DataFrame) -> DataFrame:
    """rows (bucket, rep, comp, ..) of buckets that hold several components, with block and role: the rows beside a
    bucket's largest component probe all of its rows, by blocks of about CROSS of either."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    of_bucket = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    parts = lambda n: F.greatest(F.ceil(n / CROSS), F.lit(1)).cast("int")
    of_bucket = written(of_bucket.select("bucket", F.col("top.comp").alias("main"), parts(F.col("all")).alias("m"), parts(F.col("all") - F.col("top.n")).alias("p")), "deals")
    rows = rows.join(of_bucket, "bucket")
    share = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumn("i", share("m")).withColumn("j", spread("p")).withColumn("role", F.when(F.col("comp") == F.col("main"), MEMBER).otherwise(BESIDE))
    probers = rows.where("comp <> main").withColumn("i", spread("m")).withColumn("j", share("p")).withColumn("role", F.lit(PROBER))
    return members.unionByName(probers).withColumn("block", F.xxhash64("bucket", "i", "j"))


def _candidates(rows: DataFrame, least: dict[int, int], percent: int, with_sets: bool = False) -> DataFrame:
    """Distinct pairs (a, b) proposed from rows (block, bucket, rep, comp, signature, role); with_sets, with bands and
    shingles among the columns, links that connect components."""
    bands, hashes = scheme(percent)[0], math.prod(scheme(percent))
    names = ["block", "bucket", "rep", "comp", "role", "signature"] + ["bands", "shingles"] * with_sets
    rows = rows.select(*names).repartition("block").sortWithinPartitions("block")

    def of(batches):
        def done(table: pa.Table):
            table = table.combine_chunks()
            own = {c: table.column(c).to_numpy() for c in ("block", "bucket", "rep", "comp", "role")}
            own["signature"] = _fixed(table.column("signature").combine_chunks(), np.uint8, hashes)
            if with_sets:
                own["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)
                own["sets"] = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            pairs = _pairs_in(own, least, percent)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: pa.Table | None = None
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

    return rows.mapInArrow(tv.trimmed(of), "a long, b long").distinct()


def _verified(pairs: DataFrame, keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold; keys has (rep, k1, k2), sets (k1, k2, shingles)."""

    def of(batches):
        for batch in batches:
            sets = (zip(*(batch.column(c).to_pylist() for c in (2, 3))))
            ok = [_is_link(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in sets]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    for end in "ab":  # the narrow pairs get the keys, so that sets are dealt by what they are written with
        pairs = pairs.join(keys.select(F.col("rep").alias(end), F.col("k1").alias(f"{end}1"), F.col("k2").alias(f"{end}2")), end)
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("k1").alias(f"{end}1"), F.col("k2").alias(f"{end}2"), F.col("shingles").alias(name)), [f"{end}1", f"{end}2"])
    return pairs.select("a", "b", "x", "y").mapInArrow(tv.trimmed(of), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z as a-z; a text of fewer words than width is one shingle; null, empty
    and wordless texts have none and link with nothing.  component_id is the smallest doc_id that links reach,
    and kept says that it is the row's own.  Repeated rows each have their row.  Links are of texts: rows that share an
    id but not a text are in the groups of their own texts.  Rows with a null id take no part: component_id is null, kept
    is true.  An empty table gives no rows; columns of docs but these two are not read.
    """
    with scratch() as keep:
        return _grouped(docs, id_col, text_col, width, percent, keep).drop("mark", "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, keep, mark: Column | None = None) -> DataFrame:
    """doc_id, mark, n_shingles, component (a number of the group of texts, null where a row takes no part),
    component_id, kept."""
    least = least_matches(percent / 100, hashes=math.prod(scheme(percent)))
    all_rows = keep(written(described(docs, id_col, text_col, width, percent, mark), "described"))
    usable = all_rows.where("signature is not null and doc_id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers hold, as the table is written
    banded = classes.select("rep", "doc", F.explode("bands").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = written(banded.join(shared, "bucket"), "buckets")
    signatures = having(classes.select("rep", "signature"), "rep", buckets.select("rep").distinct())
    sets = _sets_of(docs, id_col, text_col, buckets.select("doc").distinct(), width)
    rows = buckets.drop("doc").join(signatures, "rep").withColumn("comp", F.col("rep"))
    pairs = written(_candidates(_dealt(rows), least, percent), "pairs")
    links = written(_verified(pairs, classes.select("rep", "k1", "k2"), sets, percent), "links")
    comps = components(links)
    named = lambda df, to: df.withColumnsRenamed({"id": "rep", "component": to})
    large = buckets.drop("doc").where(F.col("n") > SMALL).join(named(comps, "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    large = written(large, "large")
    open_ = large.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    last = written(large.join(open_, "bucket"), "open")
    if last.take(1):
        last = last.join(classes.select("rep", "k1", "k2", "bands", "signature"), "rep").join(sets, ["k1", "k2"])
        more = written(_candidates(_crossed(last), least, percent, True), "links")
        # What is known of the components stands for the links before.
        comps = components(more.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    comps = named(comps, "comp")
    members = comps.unionByName(comps.select(F.col("comp").alias("rep"), "comp").distinct())
    firsts = members.join(classes.select("rep", "doc"), "rep").groupBy("comp").agg(F.min("doc").alias("component_id"))
    keyed = classes.select("k1", "k2", "rep", "doc").join(members.join(firsts, "comp"), "rep", "left")
    keyed = keep(written(keyed.select("k1", "k2", F.coalesce("comp", "rep").alias("component"), F.coalesce("component_id", "doc").alias("component_id")), "keyed"))
    apart = F.col("signature").isNull() | F.col("doc_id").isNull()
    out = all_rows.select("doc_id", "mark", "n_shingles", "k1", "k2", apart.alias("apart")).join(keyed, ["k1", "k2"], "left")
    own = lambda c, other: F.when(F.col("apart"), other).otherwise(F.col(c)).alias(c)
    out = out.select("doc_id", "mark", "n_shingles", own("component", F.lit(None)), own("component_id", F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near copies; all columns stay, whatever their names.

    Of a group stays the row of the smallest id, of several of that id the one with the smallest hash of all its columns,
    so reruns agree; of rows equal in all columns one stays.  Rows that share an id but not a text are rows of their own
    groups: unlike texts all stay, whatever their ids.  Rows with a null id and rows without words all stay; an empty
    table stays empty.
    """
    flat = [F.to_json(c) if "map<" in t else c for c, t in ((F.col(f"`{n}`"), t) for n, t in docs.dtypes)]
    mark = F.xxhash64(*flat, *[c.isNull() for c in flat])
    with scratch() as keep:
        found = written(_grouped(docs, id_col, text_col, WIDTH, percent, keep, mark).select("doc_id", "mark", "component").where("doc_id is not null"), "found")
        first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
        stays = first.select("first.*").unionByName(found.where("component is null").select("doc_id", "mark"))
        stays = written(stays.withColumn("staying", F.lit(1)), "stays")
        by_id = found.groupBy("doc_id").agg(F.count("*").alias("n")).join(stays.groupBy("doc_id").agg(F.sum("staying").alias("m")), "doc_id", "left")
        gone = keep(written(by_id.where("m is null").select("doc_id"), "gone"))
        # Ids of which some rows go and others stay: these rows are told apart by their marks.
        parted = keep(written(by_id.where("m < n").select("doc_id"), "parted"))
        some = keep(written(having(stays.select("doc_id", "mark"), "doc_id", parted).distinct(), "some"))
        wordless = keep(written(having(found.where("component is null").select("doc_id", "mark"), "doc_id", parted).distinct(), "wordless"))
    rest = having(docs, id_col, gone, "left_anti")
    if not parted.take(1):
        return rest
    name, own, of = (free(n, docs) for n in ("mark", "own_id", "own_mark"))
    some, wordless = (t.toDF(own, of) for t in (some, wordless))
    here = (F.col(f"`{id_col}`").cast("long") == F.col(own)) & (F.col(name) == F.col(of))
    marked = having(rest, id_col, parted).withColumn(name, mark)
    winners = marked.join(some, here, "left_semi").join(wordless, here, "left_anti").dropDuplicates([id_col, name])
    empty = marked.join(wordless, here, "left_semi")
    return having(rest, id_col, parted, "left_anti").unionByName(winners.unionByName(empty).drop(name))


SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM worded),
flat AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
coded AS (SELECT doc_id, hash(shingle) AS code FROM flat),
counted AS (SELECT doc_id, count(*) AS n FROM flat GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM coded a JOIN coded b ON a.code = b.code AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN counted x ON x.doc_id = a JOIN counted y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of ON id = doc_id
"""
