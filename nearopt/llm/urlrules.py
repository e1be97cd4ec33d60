"""URL rules as one bit-parallel automaton: all wildcard patterns walk over each URL at the same time.

A pattern (glob) is a row of elements, each a literal or `?` (any character but /), between which `*` stands for any run
of characters without / and `**` for any run at all.  An automaton has one bit for each number of elements passed, and
all patterns' bits stand side by side in as many 64-bit words as they need.  A character c takes the words D to

    ((D << 1) & step[c])  |  (D & stay[c])

where step[c] has the bits whose element takes c, and stay[c] those behind a wildcard that takes c.  The bit a pattern
starts from is in no step[c], so what the shift carries over from the pattern before it is dropped.  A pattern matches if
its last bit is set after the last character.  Characters are told apart only if a pattern names them, so the tables
have a row for each such character and one for the rest.

Canonical URL: a dot, the host in small letters, the path.  The host ends at the first /, so `*` stays within it, and a
rule (host, path) is the glob `*.host path **`: with the dot in front `*` also matches where there is no subdomain.

The walk is a narrow operation: no shuffle, and arrays of a batch's URLs and the words of their automata.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv

#: (verdict, host, path): a host with its subdomains, and the paths that begin so.  The longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: (verdict, glob over the canonical URL) where no rule fits; the first that fits wins.  Nothing to fetch, downloads that
#: aren't pages, calls of programs, sessions and calendars without end.
GLOBS = (
    ("block", "."), ("block", "./**"), ("block", "**.exe"), ("block", "**.zip"), ("block", "**.tar.gz"), ("block", "**.iso"), ("block", "**/cgi-bin/**"), ("block", "**/wp-login*"), ("block", "**/calendar/????-??-??**"), ("block", "*.ads.*/**"), ("block", "**;jsessionid=**"),
)
#: Where no glob fits either.
DEFAULT = "allow"
VERDICTS = ("allow", "block")


class Automaton:
    """Wildcard patterns packed into words."""

    def __init__(self, globs: list[str]):
        takes: list[tuple[str, int] | None] = []  # of each bit: the character it is entered by, "?" as ("", 1)
        loops: list[int] = []  # of each bit: 0 no wildcard, 1 *, 2 **
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(takes))
            takes.append(None)
            loops.append(0)
            at = 0
            while at < len(glob):
                if glob[at] == "*":
                    wide = glob.startswith("**", at)
                    loops[-1] = max(loops[-1], 1 + wide)
                    at += 1 + wide
                    continue
                takes.append(("", 1) if glob[at] == "?" else (glob[at], 0))
                loops.append(0)
                at += 1
            self.last.append(len(takes) - 1)
        self.words = max(1, -(-len(takes) // 64))
        named = sorted({"/", *(t[0] for t in takes if t and not t[1])})
        self.codes = np.array([ord(c) for c in named], np.uint32)
        kinds = [*named, None]  # the last stands for every other character
        step, stay = (np.zeros((len(kinds), self.words * 64), bool) for _ in range(2))
        for k, c in enumerate(kinds):
            for bit, (take, loop) in enumerate(zip(takes, loops)):
                step[k, bit] = take is not None and (c != "/" if take[1] else c == take[0])
                stay[k, bit] = loop == 2 or (loop == 1 and c != "/")
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        self.step, self.stay = pack(step), pack(stay)
        start = np.zeros(self.words * 64, bool)
        start[self.first] = True
        self.start = pack(start)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """The row of the tables for each code point."""
        at = np.searchsorted(self.codes, codes)
        return np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == codes, at, len(self.codes))

    def matches(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which patterns match which of the texts that lie end to end in codes: a flag for each text and pattern.

        The longest texts come first, so those that still have characters are the first rows at every step.  Automata
        that have died aren't walked on.
        """
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        kinds, begins, left = self.kinds(codes), bounds[:-1][order], size[order]
        out = np.zeros((len(size), len(self.last)), bool)
        state, rows, at = np.tile(self.start, (len(size), 1)), order, 0
        one, top = np.uint64(1), np.uint64(63)
        last = np.array(self.last)
        while True:
            n = int(np.searchsorted(-left, -at, "left"))  # texts longer than at
            done = state[n:]
            if len(done):
                out[rows[n:]] = (done[:, last // 64] >> (last % 64).astype(np.uint64) & one).astype(bool)
                state, rows, begins, left = state[:n], rows[:n], begins[:n], left[:n]
            if not n:
                return out
            k = kinds[begins + at]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.step[k]) | (state & self.stay[k])
            at += 1
            if at % 16 == 0 and not (alive := state.any(1)).all():
                state, rows, begins, left = state[alive], rows[alive], begins[alive], left[alive]


def glob_of(host: str, path: str) -> str:
    """The glob of a rule."""
    if any(c in host + path for c in "*?"):
        raise ValueError("rules have no wildcards; give a glob")
    return f"*.{host}{path}**"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to /, ?, # or the end, A-Z as small letters; then up to ? or #.  Both
    empty for null and where no :// is."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _checked(rules, globs, default: str) -> None:
    for verdict in [default, *(r[0] for r in rules), *(g[0] for g in globs)]:
        if verdict not in VERDICTS:
            raise ValueError(f"a verdict must be one of {', '.join(VERDICTS)}")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, host, path, rule (host and path of the longest rule that fits, or null), verdict (that rule's,
    else the first fitting glob's, else the default), glob (that glob, or null).

    A null url, or one without ://, has an empty host and path.  Null ids stay null.  Equal rules of
    equal length: the first.  Repeated rows are judged each for itself; other columns aren't read; an empty table gives
    no rows.
    """
    _checked(rules, globs, default)
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    patterns = [glob_of(host, path) for _, host, path in ranked] + [g for _, g in globs]
    m = len(ranked)
    names = [host + path for _, host, path in ranked] + [g for _, g in globs]
    verdicts = [v for v, *_ in ranked] + [v for v, _ in globs]
    automaton = Automaton(patterns)  # a few hundred bytes a pattern, sent with each task

    def walk(batches):
        names_of, verdicts_of = pa.array([*names, None], pa.string()), pa.array([*verdicts, default])
        for batch in batches:
            texts = tv.as_strings(batch.column(3))
            for a, b in tv.slices(texts):
                part, rows = texts.slice(a, b - a), batch.slice(a, b - a)
                codes = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32)
                bounds = np.concatenate([[0], np.cumsum(pa.compute.utf8_length(part).to_numpy())])
                hit = automaton.matches(codes, bounds)
                hit = np.concatenate([hit, np.ones((len(hit), 1), bool)], 1)
                first = hit.argmax(1)
                rule = np.where(first < m, first, len(names))
                glob = np.where(first >= m, first, len(names))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], names_of.take(pa.array(rule)), verdicts_of.take(pa.array(first)), names_of.take(pa.array(glob))], ["page_id", "host", "path", "rule", "verdict", "glob"])

    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(walk, f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


def keep_allowed(pages: DataFrame, url_col: str = "url", rules=RULES, globs=GLOBS, default: str = DEFAULT) -> DataFrame:
    """The pages whose verdict is allow; all columns stay as they are, whatever their names.  Rows are told apart by
    themselves: repeated and null ids don't matter, and no join is made."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url_col}`").alias("url"))
    return judge(rows, "row", "url", rules, globs, default).where("verdict = 'allow'").select("page_id.*")


def _regex(glob: str) -> str:
    """A glob as a regular expression, for the SQL."""
    out, at = "^", 0
    while at < len(glob):
        if glob[at] == "*":
            wide = glob.startswith("**", at)
            out += "(?s:.*)" if wide else "[^/]*"
            at += 1 + wide
            continue
        out += "[^/]" if glob[at] == "?" else f"[{glob[at]}]"
        at += 1
    return out + "$"


SQL = rf"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
globs(place, verdict, pattern, re) AS (VALUES {", ".join(f"({i}, '{v}', '{g}', '{_regex(g).replace('$', chr(92) + 'z')}')" for i, (v, g) in enumerate(GLOBS))}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
fitting AS (SELECT page_id, host, path, (SELECT max_by({{'rule': h || p, 'verdict': verdict}}, length(h || p)) FROM rules WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)) AS r, (SELECT min_by({{'pattern': pattern, 'verdict': verdict}}, place) FROM globs WHERE regexp_matches('.' || host || path, re)) AS g FROM parts)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, g.verdict, '{DEFAULT}') AS verdict, CASE WHEN r IS NULL THEN g.pattern END AS "glob" FROM fitting
"""
