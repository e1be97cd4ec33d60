"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with stretches of labelled texts.  A text is
encoded once with each dictionary, in blocks so that every part of a long text meets the dictionary, and the
language of the smallest total wins.  If the runner-up is hardly larger, the decision is rejected.  A fast level
is used: it finds what it can in the dictionary and little else, which is what tells languages apart.
"""

from __future__ import annotations

import regex
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv

#: Bound of the training sample: this many stretches of this many characters for each language.
SAMPLES, STRETCH = 200, 1000
#: Languages that can be learned; more is an error.
MOST_LANGUAGES = 200
#: Bytes of a dictionary, level, and bytes of a block.
DICTIONARY, LEVEL, BLOCK = 65536, -3, 4096
#: A decision is rejected if the second size is less than (1 + MARGIN) times the smallest.
MARGIN = 0.004
UNKNOWN = "und"

#: A-Z to a-z, and ASCII signs and digits to a space, so that neither case nor layout tells languages apart.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """The words of a text in lower case, as they are compressed."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes by language, from a bounded sample of the labelled rows that aren't held out.

    The sample takes, of each language, the SAMPLES distinct texts of smallest hash, and of each a stretch that starts
    where the hash says, so that no part of the texts is preferred and copies, however many, count once.  Rows with a
    null id, text or label teach nothing; an empty table teaches no language.  More than MOST_LANGUAGES is an error.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull() & lang.isNotNull() & ~held_out(F.col(f"`{id_col}`"))).select(lang.alias("lang"), F.xxhash64(text).alias("h"), text.alias("text"))
    counts = dict(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # Hashes below a share that holds three times the sample, so that few rows of a large language are sorted.
    scale = 1 << 30
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(scale, scale * 3 * SAMPLES // max(n, 1) + 1))).otherwise(share)
    some = rows.where(F.pmod("h", F.lit(scale)) < share)
    at = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - STRETCH + 1, F.lit(1))).cast("int")
    some = some.select("lang", F.pmod("h", F.lit(scale)).alias("order"), "h", F.substring("text", at + 1, F.lit(STRETCH)).alias("stretch")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "h", "stretch"))
    some = some.withColumn("place", place).where(F.col("place") <= SAMPLES)
    by: dict[str, list[tuple]] = {name: [] for name in counts}
    for row in some.select("lang", "place", "stretch").collect():  # SAMPLES rows of each language at most
        by[row.lang].append((row.place, row.stretch))
    return {name: b" ".join(plain(stretch) for _, stretch in sorted(own))[:DICTIONARY] for name, own in sorted(by.items())}


def _compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for name, data in dictionaries.items():
        d = zstandard.ZstdCompressionDict(data or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return out


def decide(text: str | None, compressors: dict) -> tuple[str, float, bool]:
    """(language, score, rejected): the score is m / (m + 0.05) for the margin m of the second size over the first."""
    if not compressors or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = plain(text) or text.encode("utf-8", "surrogatepass")
    blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in compressors.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = sizes[1][0] / sizes[0][0] - 1
    return sizes[0][1], margin / (margin + 0.05), margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score (0 to 1), rejected.

    lang_pred is the language of the smallest size, ties to the first name, even where the decision is rejected;
    it is `und`, with score 0 and rejected, if the text is null, has no letter, or nothing was learned.  Only
    the whole text decides.  Repeated rows and null ids have rows of their own (null ids aren't held out); an
    empty table gives no rows; other columns are not read.
    """

    def of(batches):
        compressors = _compressors(dictionaries)
        for batch in batches:
            texts = batch.column(2)
            for a, b in tv.slices(tv.as_strings(texts)):
                lang, score, rejected = zip(*(decide(t, compressors) for t in texts.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tv.trimmed(of), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay, whatever their names.

    Null texts, texts without a letter, and all texts where nothing was learned are rejected.  Ids aren't read, so null
    and repeated ones make no difference; each row is decided for itself; an empty table stays empty.
    """

    def of(batches):
        compressors = _compressors(dictionaries)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in tv.slices(tv.as_strings(texts)):
                keep = [not decide(t, compressors)[2] for t in texts.slice(a, b - a).to_pylist()]
                yield batch.slice(a, b - a).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tv.trimmed(of), docs.schema)
