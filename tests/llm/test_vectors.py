"""Product quantisation, NN-descent and importance resampling against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearopt.llm import nndescent, pqdedup, resample

VEC = "vec_id long, embedding array<float>, label int"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7]


def cloud(rng, n, width=8):
    """Vectors with families of near copies, exact copies, ties in distance, and different lengths."""
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rows[rng.integers(len(rows))]
            x = base[1] if rng.random() < 0.3 else (np.array(base[1]) + rng.normal(scale=rng.choice([0.02, 0.07, 0.12]), size=width)).astype(np.float32).tolist()
            rows.append((i * 7, x, base[2] if rng.random() < 0.8 else 1))
        else:
            rows.append((i * 7, rng.normal(size=width).astype(np.float32).tolist(), None if rng.random() < 0.05 else int(rng.integers(3))))
    return rows


def links_by_hand(rows, cosine):
    out = {}
    usable = [i for i, (d, x, label) in enumerate(rows) if d is not None and label is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    for i in usable:
        for j in usable:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                out.setdefault(i, []).append(j)
    return out


@pytest.mark.parametrize("lists", [1, 9])
def test_no_link_is_lost(spark, lists, monkeypatch):
    monkeypatch.setattr(pqdedup, "PER_LIST", 10_000 if lists == 1 else 30)
    monkeypatch.setattr(pqdedup, "CHUNK", 20)
    rng = np.random.default_rng(lists)
    rows = cloud(rng, 260)
    rows += [(5000 + i, x, 1) for i, x in enumerate(ODD)] + [(6000, rows[0][1][:5], rows[0][2]), (None, rows[0][1], rows[0][2]), rows[3], (6001, (np.array(rows[1][1]) * 1e18).tolist(), rows[1][2])]
    frame = spark.createDataFrame(rows, VEC).withColumn("n_links", F.lit("clash"))
    links = links_by_hand(rows, 0.98)
    least = {i: rows[i][0] for i in range(len(rows))}
    for _ in range(len(rows)):
        new = {i: min([least[i], *(least[j] for j in links.get(i, []))]) if least[i] is not None else None for i in least}
        if new == least:
            break
        least = new
    want = sorted([(rows[i][0], len(links.get(i, [])), least[i], rows[i][0] is None or rows[i][0] == least[i]) for i in range(len(rows))], key=repr)
    assert sorted(map(tuple, pqdedup.near_duplicates(frame).collect()), key=repr) == want
    assert pqdedup.near_duplicates(frame.limit(0)).count() == 0


def test_asymmetric_distances_are_within_the_error(monkeypatch):
    rng = np.random.default_rng(2)
    x = pqdedup._unit(rng.normal(size=(500, 16)))
    index = pqdedup.Index(x, 12)
    own, codes, errors = index.encode(x)
    for c in range(3):
        m = own == c
        d = index.distances(x, c, codes[m])
        true = np.linalg.norm(x[:, None] - x[m][None], axis=2)
        assert (np.abs(d - true) <= errors[m] + 1e-4).all()
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.7
    for held in (1 << 24, 12 * 16):  # all at once, and a few vectors at a time
        monkeypatch.setattr(pqdedup, "HELD", held)
        probes = index.probes(x, own, 0.7)
        assert all(own[j] in probes[i] for i, j in np.argwhere(near)) and sum(map(len, probes)) < 12 * 500


def test_lists_follow_the_data(monkeypatch):
    """Many short lists where vectors are clustered, few where they aren't and every one would be probed."""
    monkeypatch.setattr(pqdedup, "PER_LIST", 500)
    rng = np.random.default_rng(8)
    flat = pqdedup._unit(rng.normal(size=(4000, 128)))
    centres = rng.normal(size=(400, 128))
    apart = pqdedup._unit(centres[rng.integers(0, 400, 4000)] + 0.1 * rng.normal(size=(4000, 128)))
    few, many = (pqdedup.number_of_lists(x, 40_000, 1.0, 0.2) for x in (flat, apart))
    assert few <= 80 < many <= 1000


def neighbours_by_hand(rows, every, k):
    usable = [(d, np.array(x, float)) for d, x, _ in rows if d is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    out = {}
    for d, x in usable:
        if d % every == 0:
            far = {}
            for e, y in usable:
                if e != d and len(x) == len(y):
                    far[e] = min(far.get(e, math.inf), math.sqrt(((x - y) ** 2).sum()))
            out[d] = sorted((s, e) for e, s in far.items())[:k]
    return out


def test_neighbours_found(spark):
    rng = np.random.default_rng(3)
    rows = cloud(rng, 1500)
    rows += [(70_000 + i, x, 1) for i, x in enumerate(ODD)] + [(80_000, rows[0][1][:5], 1), (None, rows[0][1], 1), rows[0]]
    rows += [(90_000 + i, rows[5][1], 1) for i in range(40)]  # many copies
    rows += [(95_000 + 50 * i, rng.normal(size=5).tolist(), 1) for i in range(30)]  # another length
    frame = spark.createDataFrame(rows, VEC).withColumn("score", F.lit("clash"))
    want = neighbours_by_hand(rows, 100, 10)
    got = {}
    for r in nndescent.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(want[q]) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for _, v in want[q]})
    assert hits >= 0.95 * sum(map(len, want.values()))
    copies = [v for _, v, _ in got[90_000]]
    assert copies == [v for _, v in want[90_000]]  # equal distances go by id


def test_the_pool_grows_until_recall_is_reached(spark, monkeypatch):
    for name, value in (("POOL", 40), ("WIDTH", 8), ("ENTRIES", 4), ("EXACT", 40), ("LIST", 8), ("MEET", 4), ("ROUNDS", 3)):
        monkeypatch.setattr(nndescent, name, value)
    x = np.random.default_rng(6).normal(size=(6000, 32))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    sizes, search = [], nndescent.search
    monkeypatch.setattr(nndescent, "search", lambda *a: sizes.append(a[3]) or search(*a))
    got = nndescent.nearest(spark.createDataFrame(rows, VEC)).collect()
    x = np.array([r[1] for r in rows])
    hits = 0
    for q in range(0, 6000, 100):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(sizes) > 1 and sizes == [40 * 2**i for i in range(len(sizes))]
    assert hits >= 0.9 * 600


def test_neighbours_too_close_for_bytes_are_found_by_search(spark, monkeypatch):
    """Families whose members differ less than a byte of a component can tell."""
    for name, value in (("POOL", 64), ("WIDTH", 32)):
        monkeypatch.setattr(nndescent, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 16))
    x = np.concatenate([c + 1e-4 * rng.normal(size=(400, 16)) for c in centres])
    precise, recoded = [], nndescent._recoded
    monkeypatch.setattr(nndescent, "_recoded", lambda rows: precise.append(1) or recoded(rows))
    got = nndescent.nearest(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VEC), every=30).collect()
    hits = 0
    for q in range(0, len(x), 30):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert precise and hits >= 0.9 * 400


def test_components_of_any_size_end(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (v * s).tolist(), 1) for i, (v, s) in enumerate(zip(rng.normal(size=(120, 4)), 10.0 ** rng.integers(-320, 150, 120).astype(float)))]
    got = nndescent.nearest(spark.createDataFrame(rows, VEC.replace("float", "double")), every=10).collect()
    assert {r.query_id for r in got} == {i for i, v, _ in rows if i % 10 == 0 and any(v)} and all(r.score >= 0 for r in got)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [3.0, 4.0], None)]
    got = [tuple(r) for r in nndescent.nearest(spark.createDataFrame(rows, VEC)).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == pytest.approx(math.sqrt(2))
    assert nndescent.nearest(spark.createDataFrame([(0, None, 1)], VEC)).count() == 0
    assert nndescent.nearest(spark.createDataFrame(rows[:1], VEC)).count() == 0


def test_resampling(spark):
    rng = random.Random(5)
    good, bad = [f"good{k}" for k in range(40)], [f"bad{k}" for k in range(40)]
    texts = [" ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randint(1, 60))) for i in range(800)] + [None, ""]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "good1", "en", "s", 1)], "doc_id long, text string, lang string, source string, key int")
    targets = spark.createDataFrame([(i,) for i in range(0, 300) if i % 4] + [(None,), (99_999,)], "doc_id long")
    ratio = resample.model(frame, targets)
    raw, counts = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    import pyarrow as pa

    for i, t in enumerate(texts + ["good1"]):  # the counts, document by document
        bucket, _ = resample._grams(resample.tv.as_strings(pa.array([t], pa.string())))
        for b in bucket.tolist():
            raw[b] += 1
            counts[b] += i < 300 and i % 4 > 0
    want = np.log((counts + 1) / (counts.sum() + resample.BUCKETS)) - np.log((raw + 1) / (raw.sum() + resample.BUCKETS))
    assert np.allclose(ratio, want)
    rows = resample.resample(frame, targets, share=0.6).collect()
    assert len(rows) == len(texts) + 1
    keys = sorted((r.key for r in rows), reverse=True)
    assert all(r.kept == (r.key >= keys[math.ceil(0.6 * len(rows)) - 1]) for r in rows)
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):  # each document's weight and draw
        bucket, _ = resample._grams(resample.tv.as_strings(pa.array([t], pa.string())))
        assert by[i].n_grams == len(bucket) and by[i].log_weight == pytest.approx(sum(want[b] for b in bucket.tolist()), abs=1e-9)
        draw = spark.range(1).select(F.xxhash64(F.lit(23), F.lit(i).cast("long"), F.xxhash64(F.lit(t).cast("string")), F.lit(0).cast("long"))).first()[0] if i < 12 else None
        if draw is not None:
            u = (draw % 2**52 + 0.5) / 2**52
            assert by[i].key == pytest.approx(by[i].log_weight - math.log(-math.log(u)), abs=1e-9)
    assert by[800].log_weight == by[801].log_weight == 0 and by[800].n_grams == 0
    kept = [[by[i].kept for i in range(800) if bool(i % 4) == g] for g in (True, False)]
    assert np.mean(kept[0]) > np.mean(kept[1]) + 0.5
    assert resample.resample(frame.limit(0), targets).count() == 0
    uniform = resample.resample(frame, targets.limit(0), share=0.5).collect()
    assert {r.log_weight for r in uniform} == {0.0} and 0.4 < np.mean([r.kept for r in uniform]) < 0.6


def test_each_row_has_a_draw_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 64)
    rows = [(7, "same text")] * 600 + [(None, "no id")] * 400 + [(None, None)] * 200 + [(8, f"other {i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    targets = spark.createDataFrame([(7,)], "doc_id long")
    got = resample.resample(frame, targets, share=0.5).collect()
    assert len(got) == len(rows) and len({r.key for r in got}) == len(rows) and sum(r.kept for r in got) == 750
    assert {r.kept for r in got if r.doc_id == 7} == {r.kept for r in got if r.doc_id is None} == {True, False}
    again = resample.resample(frame.repartition(5), targets, share=0.5).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    long = spark.createDataFrame([(1, "word " * 600_000), (2, "x" * 3_000_000), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_grams for r in resample.resample(long, targets).collect()} == {1: 1_199_999, 2: 1, 3: 0}


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 8)
    monkeypatch.setattr(resample, "BINS", 4)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), np.full(60, 0.25), np.repeat(rng.normal(size=20) * 1e-300, 3), [1e300, -1e300]])
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 17, 100, 180, 250, len(values)):
        assert resample.kth_largest(frame, "x", k) == np.sort(values)[::-1][k - 1]
    assert resample.kth_largest(frame, "x", 0) is None and resample.kth_largest(frame, "x", 10_000) is None
