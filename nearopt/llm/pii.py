"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The field labels words: runs without ASCII white space, quotes, brackets, commas, colons, equals signs and slashes, so
that glued text (JSON, logs, addresses of pages) falls into words as well.  Whole words make features, however long.
Words without a digit or @ are outside any entity by a hard constraint of the model, in training as in decoding; so the
chain of a document falls into its runs of the other words, which are decoded exactly by Viterbi, all runs of a batch
at once in numpy.  What it finds beside the spans of the patterns is added to them, if it passes its kind's test.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv

# ---------------------------------------------------------------------------------------------- fixed patterns
KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends where its run of digits does, so none can start inside a run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind that pass its test."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------------------------------------- word shapes
LABELS = ("O", "email", "ip", "B-card", "I-card", "B-phone", "I-phone")
#: What each label adds to the spans; a span runs from its first label over I- labels of the same kind.
ADDED = ("crf-email", "crf-ip", "crf-card", "crf-phone")
_KIND_OF = {"email": 0, "ip": 1, "B-card": 2, "I-card": 2, "B-phone": 3, "I-phone": 3}
#: Characters between words, and signs around a word that a span leaves out: of all kinds, and of all but phones.
_BETWEEN = " \t\n\v\f\r\"'<>[]{}|,;:=/"
_EDGE = ".!?"
_MORE_EDGE = _EDGE + "()"
_WORD = re.compile(r"[^\x20\x09-\x0D\"'<>\[\]{}|,;:=/]+")
_HINT = re.compile(r"[0-9@]")
_RUNS = re.compile(r"(.)\1+", re.S)
_DIGITS, _ZEROS = re.compile(r"[0-9]"), re.compile(r"0+")
#: Shapes up to this length are remembered; longer ones are worked out each time.
_SHORT = 60
#: Signs of the collapsed shape and groups of digits that a feature shows of a word's beginning, and another of its end.
_ENDS, _GROUPS = 12, 6
_SHAPE = {**{ord(c): "0" for c in "0123456789"}, **{c: "a" for c in range(ord("a"), ord("z") + 1)}, **{c: "A" for c in range(ord("A"), ord("Z") + 1)}}


def _of_shape(shape: str) -> tuple[str, ...]:
    """Features of a word's shape, in which 0 is a digit, a another letter or sign above ASCII, A a capital."""
    core = shape.strip(_EDGE)
    digits = core.count("0")
    groups = [str(min(len(m[0]), 9)) for m in _ZEROS.finditer(core)]
    runs = _RUNS.sub(lambda m: m[1], core)
    out = [f"runs={runs[:_ENDS]}", f"digits={digits if digits < 8 else 8 if digits < 13 else 13 if digits < 20 else 20}", f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 3)}"]
    if len(runs) > _ENDS or len(groups) > _GROUPS:  # the other end as well, and a number of the whole
        out += [f"end={runs[-_ENDS:]}", f"last-groups={'.'.join(groups[-_GROUPS:])}", f"whole={zlib.crc32('.'.join([runs, *groups]).encode()) % 65536}"]
    out += [f"has={c}" for c in "@+()-%#$_aA" if c in core]
    out += [f"first={core[:1]}", f"last={core[-1:]}", f"groups={'.'.join(groups[:_GROUPS])}", f"long={len(core) > 40}"]
    return tuple(out)


_remembered = functools.lru_cache(100_000)(_of_shape)


def features(word: str) -> tuple[str, ...]:
    """Features of a whole word: of its shape, and whether the digits of a long number pass Luhn's test."""
    shape = word.translate(_SHAPE) if word.isascii() else "".join(_SHAPE.get(ord(c), c if ord(c) < 128 else "a") for c in word)
    out = _remembered(shape) if len(shape) <= _SHORT else _of_shape(shape)
    if 13 <= shape.count("0") <= 19 and not shape.strip(_MORE_EDGE).strip("0-"):
        out = (*out, f"luhn={luhn(''.join(_DIGITS.findall(word)))}")
    return out


def is_plain(word: str) -> bool:
    return not _HINT.search(word)


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a word: s for white space and the ends of the text, else the sign."""
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    return "s" if before.isspace() else before, "s" if after.isspace() else after


def words(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _WORD.finditer(text)]


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table that the field learns from: made-up texts with their (kind, start, end)."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a=2, b=9: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))

    def email():
        return f"{word()}{pick('.', '_', '', '+')}{pick(num(2), word())}@{word()}{pick('', num(1))}.{pick('', word() + '.')}{pick('com', 'org', 'net', 'de')}"

    def ip():
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def long_number(valid: bool):
        while True:
            n = pick("4", "5", "6", "3") + num(15)
            if luhn(n) == valid:
                return n

    def card():
        n = long_number(True)
        return pick(n, "-".join(n[k : k + 4] for k in (0, 4, 8, 12)), " ".join(n[k : k + 4] for k in (0, 4, 8, 12)))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"+{num(11)}", f"+{num(1)}-{a}-{b}-{c}", f"{a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"({a}){b}-{c}", f"00{num(2)} {a} {num(3)} {num(4)}")

    def other():
        hexed = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(12, 40)))
        n = long_number(False)
        return pick(
            num(rng.integers(1, 6)), f"{num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)},{num(3)}", f"{num(1)},{num(3)},{num(3)}",
            f"${num(3)}.{num(2)}", f"${num(2)},{num(3)}", f"password={hexed}", hexed, f"AKIA{word(8, 9).upper()}{num(4)}", f"{word()}{num(2)}", f"@{word()}", f"https://{word()}.com/{num(5)}", f"{num(2)}%", f"#{num(3)}", f"{num(4)} {num(4)}", f"{num(1)}/{num(2)}", num(rng.integers(6, 13)), n,
            f"{num(4)}-{num(4)}", f"{num(2)}-{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(2)}.{num(2)}.20{num(2)}", f"[{num(1)}, {num(2)}, {num(3)}]", f"({num(2)})", f"({num(4)})", f"{num(3)} {num(2)}", f"{word().upper()}-{num(4)}-{num(3)}",
        )

    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 5)):
                text += word() + pick("", "", "", ".", ",", ":") + pick(" ", " ", " ", "\n")
            kind = pick(0, 1, 2, 3, 3, 4, 4, 4, 4)
            made = (email, ip, card, phone, other)[kind]()
            before, after = pick(("", ""), ("", ""), ("", pick(".", ",", ";", "!")), ('"', pick('"', '",', '"}')), (f"{word()}{pick(':', '=')}", ""), (f'{{"{word()}":"', '"}'), ("<", ">"), ("(", ")"), (f"{word()}/", ""))
            text += before
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(made)))
            text += made + after + " "
        table.append((text.rstrip(" ") if rng.integers(2) else text, spans))
    return table


def _labels(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each word: of the span that it overlaps, I- from the second word on; words without digit or @ are O."""
    out, seen = [], set()
    for start, w in words(text):
        own = next((k for k, (_, a, b) in enumerate(spans) if a < start + len(w) and start < b), None)
        if own is None or is_plain(w):
            out.append(0)
        else:
            kind = spans[own][0]
            out.append(1 + kind if kind < 2 else 2 * kind - 1 + (own in seen))
            seen.add(own)
    return out


# ---------------------------------------------------------------------------------------------- the field
class Field:
    """Weights of the chain: own, before and after by feature, and moves between labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self._seen: dict[tuple[str, ...], np.ndarray] = {}

    @staticmethod
    def keys(run: list[tuple[str, str, str]]) -> list[tuple]:
        """What each word of a run (before, word, after) is scored by: its features, its neighbours' and the signs beside it."""
        own = [features(w) for _, w, _ in run]
        return [(own[k], own[k - 1][:4] if k else None, own[k + 1][:4] if k + 1 < len(run) else None, run[k][0], run[k][2]) for k in range(len(run))]

    @staticmethod
    def names(key: tuple) -> list[str]:
        own, before, after, left, right = key
        out = [*own, f"left={left}", f"right={right}"]
        for tag, there in (("before", before), ("after", after)):
            out += [f"{tag}:plain"] if there is None else [f"{tag}:{f}" for f in there]
        return out

    def scores(self, run: list[tuple[str, str, str]]) -> np.ndarray:
        """Label scores of each word of a run of words that aren't plain."""
        out = np.zeros((len(run), len(LABELS)))
        for k, key in enumerate(self.keys(run)):
            row = self._seen.get(key)
            if row is None:
                row = np.zeros(len(LABELS))
                for f in self.names(key):
                    if f in self.index:
                        row = row + self.weights[self.index[f]]
                if len(self._seen) < 50_000:
                    self._seen[key] = row
            out[k] = row
        return out


def train(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 120, rate: float = 0.2, penalty: float = 1e-3) -> Field:
    """Maximum penalised likelihood by Adam, with forward and backward sums over all texts at once."""
    index: dict[str, int] = {}
    sentences = [words(text) for text, _ in table]
    n, most = len(table), max(map(len, sentences))
    gold, there, plain = np.zeros((n, most), int), np.zeros((n, most), bool), np.ones((n, most), bool)
    found = []
    for s, (text, spans) in enumerate(table):
        gold[s, : len(sentences[s])] = _labels(text, spans)
        there[s, : len(sentences[s])] = True
        at = {start: k for k, (start, _) in enumerate(sentences[s])}
        for run in _runs(text):
            for (start, *_), key in zip(run, Field.keys([x[1:] for x in run])):
                plain[s, at[start]] = False
                found.append((s, at[start], [index.setdefault(f, len(index)) for f in Field.names(key)]))
    plain &= there
    x = np.zeros((n, most, len(index)), np.float32)
    for s, k, on in found:
        x[s, k, on] = 1
    used = there & ~plain
    xs = x[used]
    size = len(LABELS)
    weights, moves = np.zeros((len(index), size)), np.zeros((size, size))
    state = [np.zeros_like(a) for a in (weights, weights, moves, moves)]
    add = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    one = np.eye(size)
    gold_moves = np.zeros((size, size))
    for k in range(most - 1):
        both = there[:, k + 1]
        np.add.at(gold_moves, (gold[both, k], gold[both, k + 1]), 1)
    for step in range(1, steps + 1):
        e = np.full((n, most, size), 0.0)
        e[used] = xs @ weights
        e[plain] = np.where(np.arange(size) == 0, 0.0, -1e4)
        ahead, back = np.zeros((n, most, size)), np.zeros((n, most, size))
        ahead[:, 0] = e[:, 0]
        for k in range(1, most):
            new = add(ahead[:, k - 1, :, None] + moves, 1) + e[:, k]
            ahead[:, k] = np.where(there[:, k, None], new, ahead[:, k - 1])
        for k in range(most - 2, -1, -1):
            new = add(moves + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2)
            back[:, k] = np.where(there[:, k + 1, None], new, 0.0)
        whole = add(ahead[:, -1], 1)
        belief = np.exp(ahead + back - whole[:, None, None])
        pairs = np.zeros((size, size))
        for k in range(most - 1):
            both = there[:, k + 1]
            pairs += np.exp(ahead[both, k, :, None] + moves + (e[both, k + 1] + back[both, k + 1])[:, None, :] - whole[both, None, None]).sum(0)
        gradients = (xs.T @ (belief[used] - one[gold[used]]) / n + penalty * weights, (pairs - gold_moves) / n + penalty * moves)
        for p, g, m, v in ((weights, gradients[0], state[0], state[1]), (moves, gradients[1], state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights, moves)


def viterbi(runs: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best labels of each run; a run stands between plain words, which are O, or the ends of the text."""
    if not runs:
        return []
    size = np.array([len(r) for r in runs])
    order = np.argsort(-size, kind="stable")
    flat, first = np.concatenate([runs[i] for i in order]), np.concatenate([[0], np.cumsum(size[order])[:-1]])
    size = size[order]
    best = flat[first] + moves[0]
    back = np.zeros(flat.shape, np.int8)
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
        paths = best[:live, :, None] + moves
        back[first[:live] + t] = paths.argmax(1)
        best[:live] = paths.max(1) + flat[first[:live] + t]
    now = (best + moves[:, 0]).argmax(1)
    labels = np.zeros(len(flat), np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        labels[first[:live] + t] = now[:live]
        if t:
            now[:live] = back[first[:live] + t, now[:live]]
    out: list = [None] * len(runs)
    for k, i in enumerate(order):
        out[i] = labels[first[k] : first[k] + size[k]]
    return out


def _runs(text: str) -> list[list[tuple[int, str, str, str]]]:
    """Runs of words with a digit or @ and none without between them: each word's start, and the word between its signs."""
    out, at, last = [], 0, -1
    while found := _HINT.search(text, at):
        start = found.start()
        while start > at and text[start - 1] not in _BETWEEN:
            start -= 1
        word = _WORD.match(text, start)
        left, right = _beside(text, start, word.end())
        if last >= 0 and not text[last:start].strip(_BETWEEN):
            out[-1].append((start, left, word[0], right))
        else:
            out.append([(start, left, word[0], right)])
        at = last = word.end()
    return out


def _passes(kind: int, found: str) -> bool:
    """The test of a kind that a span of the field must pass to be added."""
    digits = _DIGITS.findall(found)
    if kind == 0:
        return 0 < found.find("@") < len(found) - 1
    if kind == 1:
        return len(parts := found.split(".")) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= len(digits) <= 19 and luhn("".join(digits)) if kind == 2 else 7 <= len(digits) <= 15


def crf_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the field finds in each text; kinds are positions in ADDED."""
    runs = [_runs(t) if _HINT.search(t) else [] for t in texts]
    scores = [field.scores([x[1:] for x in run]) for own in runs for run in own]
    labels = iter(viterbi(scores, field.moves))
    out = []
    for text, own in zip(texts, runs):
        spans: list[tuple[int, int, int]] = []
        for run in own:
            open_kind = None
            for (start, _, word, _), label in zip(run, next(labels)):
                name = LABELS[label]
                kind = _KIND_OF.get(name)
                edge = _EDGE if kind == 3 else _MORE_EDGE
                lead = len(word) - len(word.lstrip(edge))
                a, b = start + lead, start + max(lead, len(word.rstrip(edge)))
                if kind is not None and a < b:
                    if name.startswith("I-") and open_kind == kind and spans:
                        spans[-1] = (kind, spans[-1][1], b)
                    else:
                        spans.append((kind, a, b))
                open_kind = kind
        out.append([s for s in spans if _passes(s[0], text[s[1] : s[2]])])
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base, added) spans of each text; an added span overlaps no base span."""
    out = []
    for text, more in zip(texts, crf_spans(texts, field)):
        base = base_spans(text) if _HINT.search(text) else []
        out.append((base, sorted(s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base))))
    return out


def _joined(spans, names) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_added, n_found, base_sha256, spans.

    Counts by kind and base_sha256 are those of the fixed patterns; spans has these, by kind and start, then the field's,
    and n_found counts all of them.
    Places are code points, ends exclusive.  Null and empty texts have none; repeated rows and null ids have rows
    of their own; an empty table gives no rows; other columns are not read.  field defaults to one trained on
    labelled_table().
    """
    field = field or default_field()
    counts = [f"n_{k}" for k in KINDS]

    def of(batches):
        for batch in batches:
            texts = tv.as_strings(batch.column(1))
            for a, b in tv.slices(texts):
                found = all_spans(texts.slice(a, b - a).to_pylist(), field)
                base = [_joined(x, KINDS) for x, _ in found]
                columns = [pa.array([sum(s[0] == k for s in x) for x, _ in found], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *columns, pa.array([len(y) for _, y in found], pa.int64()), pa.array([len(x) + len(y) for x, y in found], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(filter(None, (x, _joined(y, ADDED)))) for x, (_, y) in zip(base, found)])],
                    ["doc_id", *counts, "n_added", "n_found", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, n_added long, n_found long, base_sha256 string, spans string")


@functools.cache
def default_field() -> Field:
    return train(labelled_table())
