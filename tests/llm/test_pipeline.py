"""The corpus pipeline against the same stages in plain Python, each on its own input."""

import os
import random
import threading
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearopt.llm import langid, packing, secrets
from nearopt.llm.util import dropped, scratch, written
from nearopt.storage import shared_dir

from test_rowwise import base_by_hand, copies_by_hand, entropy_by_hand  # noqa: E402
from test_text import DOC, LANGS, by_hand

P = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(21)
    rows = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        text = " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120)))
        rows.append([i * 3, text, lang, rng.choice(["a", "a", "a", "b", "c", None]), len(text)])
        if rng.random() < 0.3:
            source = rng.choice(rows)
            words = source[1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(["x", "password=abcdef012345678", "0123456789abcdef01"])
            rows.append([i * 3 + 1, " ".join(words), source[2], "b", 1])  # a near copy, in the language of its source
    rows += [[2000, None, "en", "a", 0], [2001, "", "en", "b", 0], [2002, "12 34", "en", None, 5], rows[3], rows[3]]
    return [tuple(r) for r in rows]


def cleaned(text):
    base = base_by_hand(text)
    spans, merged = sorted(base + entropy_by_hand(text, base)), []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + "[SECRET]" + text[e:]
    return text


def test_each_stage_on_its_own_input(spark):
    frame = spark.createDataFrame(corpus(), DOC)
    docs = frame
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"), name)
        seen.append([tuple(r) for r in docs.collect()])
        if name != "pack":
            assert docs.columns == frame.columns
    kept, unique, clean, mixed, pieces = seen
    decide = langid._compressors(langid.learn(frame))
    assert Counter(kept) == Counter(r for r in corpus() if not langid.decide(r[1], decide)[2])
    assert len(kept) >= 0.97 * (len(corpus()) - 3)
    want = {c for _, _, c in by_hand([(r[0], r[1]) for r in kept], 80)}
    assert sorted(r[0] for r in unique) == sorted(want) and set(unique) <= set(kept)
    assert Counter(clean) == Counter((r[0], cleaned(r[1]), *r[2:]) for r in unique)
    assert any("[SECRET]" in r[1] for r in clean)
    assert Counter(mixed) == copies_by_hand(clean)
    tokenizer = packing.tokenizer(P.path(packing.TOKENIZER))
    want = Counter()
    for d, text, *_ in mixed:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], 0
        for n in packing.lengths(len(ids)):
            want[d, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])), len(ids), tuple(ids[at : at + n])] += 1
            at += n
    assert Counter((*p[:5], tuple(p[5])) for p in pieces) == want


def test_run_chains_the_stages_and_leaves_one_table(spark, tmp_path):
    spark.createDataFrame(corpus(), DOC).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{shared_dir(spark)}/nearopt"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("stage-mix")
    assert out.count() > 300


def test_long_texts_and_clashing_columns_pass_the_stages(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice(LANGS["en"]) for _ in range(3)) for _ in range(200_000))
    rows = [*corpus()[:120], (5000, long, "en", "a", 1), (5001, long + " and a few words more", "en", "b", 1), (5002, "token=abcdefghijklmnop " + long[::-1], "en", None, 2)]
    extra = ["kept", "component", "mark", "spans", "stretches", "size", "copies", "lang_pred", "key", "id", "TEXT_"]
    frame = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(k) for k, c in enumerate(extra)})
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "unused"), name)
        assert docs.columns == frame.columns
        assert docs.where(" or ".join(f"`{c}` <> {k}" for k, c in enumerate(extra))).count() == 0
        if name == "language":
            assert docs.where("doc_id >= 5000").count() >= 2
        if name == "near_duplicates":
            assert docs.where("doc_id in (5000, 5001)").count() == 1


def test_equal_lengths_lie_together(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOC).repartition(3)
    pieces = packing.pack(docs, with_ids=True)
    for part in packing.bucketed(pieces).withColumn("part", F.spark_partition_id()).select("part", "length", "sequence_id").toPandas().groupby("part"):
        rows = part[1][["length", "sequence_id"]].values.tolist()
        assert rows == sorted(rows)
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    folders = {d for d in os.listdir(f"{tmp_path}/buckets") if d.startswith("length=")}
    assert folders == {f"length={r.length}" for r in pieces.select("length").distinct().collect()}
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert back.where(F.size("ids") != F.col("length")).count() == 0
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(back) == key(pieces)


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch() as keep:
        kept, gone = keep(written(spark.range(3), "a")), written(spark.range(3), "b")
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
    dropped(kept)


def test_scopes_are_of_a_thread(spark):
    """A query in another thread neither deletes nor keeps the tables of this one."""
    opened, done, other = threading.Event(), threading.Event(), []

    def run():
        with scratch():
            other.append(written(spark.range(4), "other"))
            opened.set()
            done.wait(60)
            other.append(other[0].count())

    thread = threading.Thread(target=run)
    thread.start()
    opened.wait(60)
    with scratch():
        written(spark.range(2), "own")
    done.set()
    thread.join()
    assert other[1] == 4


def test_secret_kinds_are_those_of_the_scan():
    assert secrets.KINDS[:3] == ("assign", "access", "hex")
