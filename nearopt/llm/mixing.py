"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, q = target / size of its source.  Its documents
are put in one fixed order; the running sum of q along that order, shifted by one offset u per source, crosses
an integer as often as the document is taken: copies = floor(u + q r) - floor(u + q (r - 1)) for the document
of rank r.  The order goes by size, so that each size is hit in proportion and the words taken stay within about the
largest document of the target.

A rank within a source would need all its rows in one task.  So a source is dealt into cells of (size, first hex digits
of the key's hash): counts of cells are pre-aggregated, their prefix sums are taken over that small table, and only the
rank within a cell looks at single rows.  A hot source or a hot size is spread over all its cells.  The order is by size
and hash, the same whatever the size of the table.  The key is the id and a digest of the text, so rows that share an
id, or have none, are spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearopt.llm.util import md5_hex, scratch, unit, written

#: One word, as the size counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
CAP = 3
#: Hex digits of a cell: 256 cells of each source and size.
DIGITS = 2
#: Parts into which the table of sources is dealt.
PARTS = 64


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source_size, target): the total shared by weight, no target above cap times its source's size.

    per_source has (src, source_size), one row per source, and src in the order in which weights repeat.  The shares
    are t * weight for one level t, cut at the cap.  t starts where nothing is cut and rises while what is cut by it
    leaves more to the rest; each step is one sum over the sources.  Sources are ranked within ranges of their names, so
    there may be as many as there are documents.
    """
    t = per_source.repartitionByRange(PARTS, "src").withColumn("part", F.spark_partition_id())
    t = written(t, "mix-sources")
    at, starts = 0, []
    for part, n in sorted(t.groupBy("part").count().collect()):  # PARTS rows at most
        starts.append((part, at))
        at += n
    skip = F.lit(0)
    for part, n in starts:
        skip = F.when(F.col("part") == part, F.lit(n)).otherwise(skip)
    rank = skip + F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = t.withColumn("w", w).withColumn("top", cap * F.col("source_size"))
    r, level, before = F.col("top").cast("double") / F.col("w"), None, None
    while True:
        cut = F.lit(False) if level is None else r < level
        total, over, free_weight, n = t.agg(F.sum("source_size"), F.sum(F.when(cut, F.col("top"))), F.sum(F.when(~cut, F.col("w"))), F.sum(cut.cast("long"))).first()
        if n == before or total is None:
            break
        before, level = n, float(total - (over or 0)) / free_weight
    target = F.least(F.col("w") * F.lit(level or 0.0), F.col("top").cast("double"))
    return t.select("src", "source_size", target.alias("target"))


def copies(rows: DataFrame, sizes: DataFrame | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows with src, source_size, target and copies, the times the mix takes each.

    rows has key, source, size and any other columns but these names; sizes, if given, is a cheaper table with the same
    (key, source, size) for the counts.  Null sources are one source, the last.  Equal keys and sizes are ordered by
    `tie`, if rows has that column.  Reruns give the same copies however the rows are partitioned.
    """
    sizes = rows if sizes is None else sizes
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # null last: "~" comes after "="
    cell = ["src", "size", "cell"]
    dealt = lambda df: df.withColumn("src", src).withColumn("hex", md5_hex(seed, F.col("key"))).withColumn("cell", F.substring("hex", 1, DIGITS))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = dealt(sizes.select("key", "source", "size")).groupBy(*cell).agg(F.count("*").alias("n"))
    by_size = written(cells.groupBy("src", "size").agg(F.sum("n").alias("n")), "mix-by-size")
    goal = targets(by_size.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    by_size = by_size.withColumn("below", before(["src"], "size")).select("src", "size", "below").join(goal, "src")
    cells = cells.withColumn("skip", before(["src", "size"], "cell")).join(by_size, ["src", "size"]).withColumn("skip", F.col("skip") + F.col("below")).drop("n", "below")
    own = Window.partitionBy(*cell).orderBy("hex", *(["tie"] if "tie" in rows.columns else []))
    ranked = dealt(rows).withColumn("rank", F.row_number().over(own)).join(cells, cell)
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = unit(md5_hex(f"{seed}-offset", F.col("src")))
    rank = F.col("skip") + F.col("rank")
    # An offset within rounding of 1 could cross one integer too many.
    taken = F.least((F.floor(u + q * rank) - F.floor(u + q * (rank - 1))).cast("long"), F.ceil(q).cast("long"))
    return ranked.withColumn("copies", taken).drop("hex", "cell", "rank", "skip")


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id, or "null", and a digest of the text, null as empty."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; all columns stay, whatever their names.

    Null and empty texts have size 0 and are taken by the same rule; null sources are one source, the last.  Null and
    repeated ids are told apart by their texts, then by the other columns; repeated rows are taken each for itself.  An
    empty table stays empty.
    """
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    rows = docs.select(_key(docs, id_col, text_col).alias("key"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(*rest).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = copies(rows, written(rows.select("key", "source", "size"), "mix-sizes"), seed)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, and taken, the words that the mix takes of it.

    Null text has size 0; a source of no words has target 0; an empty table gives no rows.  Null and repeated ids are
    told apart by their texts; repeated rows are taken each for itself.  Other columns of docs are not read.
    """
    with scratch() as keep:
        rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), _key(docs, id_col, text_col).alias("key"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size")), "mix-rows")
        out = copies(rows, seed=seed).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))
        return keep(written(out, "mixed"))


SQL = r"""
WITH sized AS (SELECT doc_id, '=' || source AS named, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
keyed AS (SELECT doc_id, size, coalesce(named, '~') AS src, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest) AS hex FROM sized),
sources AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY src),
weighed AS (SELECT src, source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM sources),
ordered AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS r, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, src) AS place FROM weighed),
levels AS (SELECT *, CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ordered),
goal AS (SELECT src, source_size, least(w * (SELECT min_by(level, place) FROM levels WHERE level <= r), CAST(3 * source_size AS DOUBLE)) AS target, CAST(CAST('0x' || substr(md5('17-offset:' || src), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0e0 AS u FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY size, hex) AS rank FROM keyed)
SELECT doc_id, size, source_size, target, size * least(CAST(floor(u + (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0e0 END) * rank) - floor(u + (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0e0 END) * (rank - 1)) AS BIGINT), CAST(ceil(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0e0 END) AS BIGINT)) AS taken
FROM ranked JOIN goal USING (src)
"""
