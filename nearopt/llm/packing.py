"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) is cut into floor(n / 4096) pieces of 4096 and one piece for each
bit of the rest, longest first.  A piece is a sequence of its own in the bucket of its length, so a batch from a
bucket has equal lengths, nothing is padded, and no sequence crosses documents.  There is no shuffle.

Token ids come from a tokenizers file.  Encoding every word of a large corpus again and again is slow, so a
worker cuts text into the pieces that the tokenizer's own splitting makes (runs of letters, single digits, runs
of other signs, never across white space), hashes them in numpy, and encodes only pieces it has not seen; runs
with any character outside a plain table are handed over whole, cut at white space.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv

#: Longest sequence, and the id that ends each document.
LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Distinct pieces that a worker keeps; then it starts anew.
MEMO = 1_000_000
#: Characters that are tokenised at a time.
CHARS = 1 << 19

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_TOP = 0x180
_CLASS = np.full(_TOP + 1, _ODD, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum() and chr(_c) != "'":  # an apostrophe may start a piece of its own kind
        _CLASS[_c] = _SIGN
for _c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, _TOP)]:
    if _c not in (0xD7, 0xF7, 0x130, 0x149, 0x17F):
        _CLASS[_c] = _LETTER
_FOLD = np.arange(_TOP + 1, dtype=np.uint32)
for _c in range(_TOP):
    if _CLASS[_c] == _LETTER:
        _FOLD[_c] = ord(chr(_c).lower())
#: The sign that byte-level vocabularies write for each byte: printable ones are themselves, the rest follow 255.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_VALUE = tv.splitmix(np.arange(_TOP + 1, dtype=np.uint64) + np.uint64(1))[_FOLD]


# The rules of a tokenizer's file for which texts may be cut and cached as here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
    return t


def follows_rules(path: str) -> bool:
    """Whether a tokenizer's file has the rules that pieces are cut and cached by."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    return rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTER and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")


class Ids:
    """Token ids of texts, equal to tokenizer.encode(text, add_special_tokens=False).ids.

    known says that the file follows the rules; if it doesn't, the tokenizer encodes whole texts itself.
    """

    def __init__(self, path: str, known: bool | None = None):
        self.t = tokenizer(path)
        self.known = follows_rules(path) if known is None else known
        self.forget()

    def forget(self) -> None:
        self.keys, self.rank = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces.  A plain one goes straight to the tokenizer's merges, as its normaliser would
        only lower it and its splitter leave it whole; any other goes through the whole tokenizer."""
        merge, each = self.t.model.tokenize, []
        for piece, short in zip(pieces, plain.tolist()):
            if short:
                low = piece.lower()
                each.append([x.id for x in merge(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_SIGNS))])
            else:
                each.append(self.t.encode(piece, add_special_tokens=False).ids)
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((x for ids in each for x in ids), np.uint32, int(counts.sum())), counts

    def _learn(self, keys: np.ndarray, pieces: list[str], plain: np.ndarray) -> None:
        ids, counts = self._encode(pieces, plain)
        n = len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.keys, keys)  # keys are sorted
        self.keys, self.rank = np.insert(self.keys, at, keys), np.insert(self.rank, at, n + np.arange(len(keys)))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of the texts one after another, and their number by text."""
        whole = "\n".join(texts) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(cp, _TOP)
        kind = _CLASS[low]
        solid = kind != _SPACE
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        run_start = np.flatnonzero(opens)
        counts = np.zeros(len(texts), np.int64)
        if not len(run_start):
            return np.empty(0, np.uint32), counts
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        run_end = np.flatnonzero(closes) + 1
        odd_run = odd[run_end] > odd[run_start]
        starts = opens.copy()
        starts[1:] |= solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        if odd_run.any():
            inside = np.zeros(len(cp) + 1, np.int32)
            np.add.at(inside, run_start[odd_run] + 1, 1)
            np.add.at(inside, run_end[odd_run], -1)
            starts &= np.cumsum(inside)[:-1] <= 0
        start = np.flatnonzero(starts)
        end = np.minimum(np.append(start[1:], len(cp)), run_end[np.searchsorted(run_end, start, "right")])
        value = _VALUE[low]
        far = np.flatnonzero(cp >= _TOP)
        value[far] = tv.splitmix(cp[far].astype(np.uint64) + np.uint64(7))
        run = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(value * tv.powers(tv._BASE, len(cp)), out=run[1:])
        size = end - start
        key = tv.splitmix(((run[end] - run[start]) * tv.powers(tv._BASE_INV, len(cp))[start]) ^ (size.astype(np.uint64) * tv._MIX[5]))
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = at >= len(self.keys)
        new[~new] = self.keys[at[~new]] != unique[~new]
        if new.any() and len(self.keys) + new.sum() > MEMO:
            self.forget()
            new[:] = True
        if new.any():
            some = first[new]
            self._learn(unique[new], [whole[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())], odd[end[some]] == odd[start[some]])
            at = np.searchsorted(self.keys, unique)
        rank = self.rank[at][inverse]
        lens = self.bounds[rank + 1] - self.bounds[rank]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[np.repeat(self.bounds[rank] - upto[:-1], lens) + np.arange(upto[-1])]
        breaks = np.cumsum([len(x) + 1 for x in texts])
        return ids, np.diff(upto[np.searchsorted(start, breaks, "left")], prepend=0)


def _segments(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of about CHARS characters, with the text each part belongs to; long texts are cut at white space."""
    part, owner, n = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > CHARS:
                end = at + CHARS
                while end < len(text) and text[end] not in " \t\n\v\f\r":
                    end += 1
            part.append(text[at:end])
            owner.append(i)
            n += end - at
            at = end
            if n >= CHARS:
                yield part, owner
                part, owner, n = [], [], 0
            if at >= len(text):
                break
    if part:
        yield part, owner


def all_ids(ids: Ids, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of each text in order."""
    if not ids.known:
        for i, text in enumerate(texts):
            yield i, np.array(ids.t.encode(text, add_special_tokens=False).ids, np.uint32)
        return
    held, now = [], 0
    for part, owner in _segments(texts):
        flat, counts = ids.of(part)
        at = 0
        for i, n in zip(owner, counts.tolist()):
            if i != now:
                yield now, np.concatenate(held) if len(held) > 1 else held[0]
                held, now = [], i
            held.append(flat[at : at + n])
            at += n
    if held:
        yield now, np.concatenate(held) if len(held) > 1 else held[0]


def lengths(n: int, most: int = LENGTH) -> list[int]:
    """The pieces of n tokens: whole sequences, then the bits of the rest, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids, ids.

    path is a tokenizers file.  Pieces are cached only for files with the rules of word_bpe_49k.json; with any other the
    tokenizer encodes each text whole, which is slower and needs memory for the longest text.  Null and empty texts are
    one piece, the end id.  Every row of docs is packed for itself, repeated rows and null ids included; no rows give no
    pieces; other columns are not read.  offset is 0, as each piece is a sequence; length is its bucket (see bucketed).
    sequence_id counts within the input partition, so it is the same when a lost task runs again.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    known = follows_rules(path)  # here, once: tasks don't parse the whole file
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))

    def packed(batches):
        ids = Ids(path, known)
        for batch in batches:
            texts = tv.as_strings(batch.column(1))
            for a, b in tv.slices(texts):
                doc_ids = batch.column(0).slice(a, b - a).to_pylist()
                out: list[list] = [[] for _ in fields]
                for i, own in all_ids(ids, texts.slice(a, b - a).to_pylist()):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    raw, at = own.tobytes(), 0
                    for n in lengths(len(own), most):
                        for column, value in zip(out, (doc_ids[i], at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(own), own[at : at + n].astype(np.int32) if with_ids else None)):
                            column.append(value)
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], [f for f, _ in fields])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tv.trimmed(packed), schema)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def bucketed(pieces: DataFrame) -> DataFrame:
    """pieces with equal lengths together: by length within each partition, so that no row moves between tasks, however
    common a length is.  Written as Parquet, a reader of one length passes over the row groups of the others."""
    return pieces.sortWithinPartitions("length", "sequence_id")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as Parquet, a folder for each length; a task writes one after another."""
    bucketed(pieces).write.partitionBy("length").parquet(path)
