"""Fill-in-middle: a text is cut in three at unit borders and put together again in another order.

A unit is one match of a pattern, left to right; what lies between matches belongs to the unit that follows, what comes
after the last match to the last unit.  The ends of all units of a text are collected from the regex library's finditer
into one array of 4-byte offsets, and a cut after k units is a lookup there.  Where to cut, and in which form, follows
from the sha256 of a seed and the row's id alone, so reruns and any partitioning give the same rows.  It is a narrow
operation: no shuffle, one Arrow batch after another, memory bounded by the longest text of a batch and its offsets.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm.util import free

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: One code point, whatever it is.
CODE_POINT = r"(?s:.)"
#: Of a hundred documents, those from PLAIN on stay as they are; of the others, SPM are in suffix-prefix-middle order.
PLAIN, SPM = 90, 20
FORMS = ("plain", "psm", "spm")

_end = methodcaller("end")


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Offsets at which the units of a text end; the last is the text's length."""
    ends = array("I", map(_end, unit.finditer(text)))
    if text and (not ends or ends[-1] != len(text)):
        ends[-1:] = array("I", [len(text)])
    return ends


def numbers(seed: int | str, key: str) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the sha256 of "seed:key"."""
    hexed = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in range(0, 32, 8))


def arranged(text: str, key: str, unit: regex.Pattern, seed: int | str = 1, plain: int = PLAIN, spm: int = SPM) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, characters of the prefix, characters of the middle); the last two are None if plain."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, key)
    if not text or h3 % 100 >= plain or any(m in text for m in MARKS):
        return text, "plain", n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, a, b - a


def restored(output: str, form: str) -> str:
    """The text that an output was made of, by its marks.  No part holds a mark, and no mark can begin in a part and
    end in the mark after it, so the first of each is the right one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if form not in FORMS or not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _cut(texts, ids, unit: str, seed, plain: int, spm: int, with_output: bool):
    """The column of structs: what is done with each row, and digests of the output and of what it gives back."""
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for text, key in batches:
            rows = []
            for t, k in zip(text, key):
                output, form, n, a, m = arranged(t, k, pattern, seed, plain, spm)
                rows.append((n, form, a, m, _sha(output), _sha(restored(output, form)), *([output] if with_output else [])))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut(F.coalesce(texts, F.lit("")), F.coalesce(ids.cast("string"), F.lit("null")))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int | str = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs with the text replaced by its output, and a column `form` (with underscores after it where docs has that name).

    Null and empty texts are plain and come out empty; so are texts that hold a mark, unchanged.  A null id counts as the
    text "null".  Repeated rows are cut alike, each for itself; an empty table stays empty; other columns stay.
    """
    form, made = free("form", docs), free("made", docs)
    rows = docs.withColumn(made, _cut(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), unit, seed, plain, spm, True))
    return rows.select(*[F.col(f"`{made}`.output").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(f"`{made}`.form").alias(form))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int | str = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, and restored_sha256, of the text that
    the output alone gives back.

    Null text counts as empty: n is 0, the form plain.  Null ids, repeated rows and an empty table are as in transform();
    other columns of docs are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _cut(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), unit, seed, plain, spm, False).alias("made"))
    return rows.select("doc_id", "made.*")


SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hex FROM documents),
drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(CAST('0x' || substr(hex, 1, 8) AS UBIGINT) AS BIGINT) AS h1, CAST(CAST('0x' || substr(hex, 9, 8) AS UBIGINT) AS BIGINT) AS h2, CAST(CAST('0x' || substr(hex, 17, 8) AS UBIGINT) AS BIGINT) AS h3, CAST(CAST('0x' || substr(hex, 25, 8) AS UBIGINT) AS BIGINT) AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
