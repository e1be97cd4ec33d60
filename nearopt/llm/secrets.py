"""Secret scans in DataFrame operations only: fixed patterns, and sliding-window entropy over candidate strings.

Positions come without Python: the text is split at a pattern, and the running lengths of the pieces and of the
matches between them give each start.  The entropy pass walks each candidate once; an aggregate over its
characters keeps the window and the sum of c * log2(c) over the counts of its characters, which changes with the
counts of the one character that enters and the one that leaves.  There is no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.llm.util import free

# Fixed values of the base kinds, in the order in which spans at one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: Least length of group 2 of an assign match, and of an access and a hex match.
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Window of the entropy pass, and the least bits a character of a window to report, by character class.
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 4.0}
#: The same of a thorough scan, by the class of the window's own characters: 20 random characters of a class reach it.
WINDOW_BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.6}
#: Candidates of the entropy pass: whole runs of these characters, with a digit and a letter.
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Candidates that match are no secrets: documented example keys, counting or repeating runs, and UUIDs.
ALLOW = (
    r"(?i)example",
    r"(?i)0123456789|abcdefghijkl",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(.)\1{7}",
)

_SPAN = "struct<start:long,kind:int,end:long>"
#: Lengths are summed in blocks of this many, so that long lists cost no square.
_BLOCK = 64
#: A text is cut at positions by way of pieces of this many code points.
_PIECE = 1024


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """A list that isn't empty, in lists of _BLOCK; items is a value, as it is looked up for each of them."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _before(lengths: Column) -> Column:
    """Exclusive running sums of an array of longs, by blocks."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")
    start = F.struct(zero.alias("s"), none.alias("o"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o"))
    sums = lambda parts: F.aggregate(F.transform(parts, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), start, step)["o"]
    within = lambda x, s: F.aggregate(x, F.struct(s.alias("s"), none.alias("o")), step)["o"]
    return _let(_let(lengths, _blocks), lambda parts: F.flatten(F.zip_with(parts, sums(parts), within)))


def _running(items: Column, start: Column, after, put, row: str) -> Column:
    """put(state, x) for each item, where the state goes from start to after(state, x): an array of `row`.

    Results are gathered by blocks, so a list of n costs n times the size of a block and not the square of n."""
    none = F.array().cast(f"array<{row}>")

    def within(block: Column, s: Column) -> Column:
        return F.aggregate(block, F.struct(s.alias("s"), none.alias("o")), lambda acc, x: F.struct(after(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(put(acc["s"], x))).alias("o")))

    def over(acc: Column, block: Column) -> Column:
        return _let(within(block, acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    first = F.struct(start.cast("long").alias("s"), F.array().cast(f"array<array<{row}>>").alias("o"))
    return _let(items, lambda x: F.when(F.size(x) > 0, F.flatten(F.aggregate(_blocks(x), first, over)["o"])).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that matches no empty string: array of (start, hit)."""
    row = "array<struct<start:long,hit:string>>"

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda x: F.length(x).cast("long"))
        steps = F.zip_with(gaps, hits, lambda g, h: g + F.length(h))
        return F.zip_with(F.zip_with(gaps, _before(steps), lambda g, b: g + b), hits, lambda s, h: F.struct(s.alias("start"), h.alias("hit")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(F.array().cast(row)))


def _spans(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["hit"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, unordered.  Patterns that only drop short runs match long ones directly."""
    # Searching for a word is much cheaper than the pattern, which needs one of these.
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    hits = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST["assign"])
    assign = F.when(named, hits).otherwise(F.array().cast("array<struct<start:long,hit:string>>"))
    # A run too short fails at each of its starts, and an access match inside a dropped one is shorter still.
    access = matches(text, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
    hexed = matches(text, rf"[0-9a-f]{{{LEAST['hex']},}}")
    return F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(hexed, "hex"))


def hot_window(run: Column, window: int = WINDOW, thorough: bool = False) -> Column:
    """(first, last) starts of the windows of run whose entropy reaches its class's bits; nulls if there are none.

    thorough also takes windows with a digit and a letter that reach the bits of their own class, so that a sign
    elsewhere in the run (key=, prefix_) doesn't raise what a window has to reach.

    A window of n characters has log2(n) - s / n bits, s being the sum of c * log2(c) over the counts c of its
    characters.  The state holds the window and s; a step counts the characters that enter and leave, and changes s by
    what their counts change.
    """
    most = lambda b: window * (math.log2(window) - b + 1e-9)
    limit = F.when(run.rlike("^[0-9a-fA-F]+$"), F.lit(most(BITS["hex"]))).when(run.rlike("^[0-9A-Za-z]+$"), F.lit(most(BITS["alnum"]))).otherwise(F.lit(most(BITS["base64"])))
    clog = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    rise = F.array(*[F.lit(b - a) for a, b in zip(clog, clog[1:])])  # what one more adds to a count
    flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    digit = lambda c: c.between(48, 57)
    letter = lambda c: c.between(65, 90) | c.between(97, 122)
    hexed = lambda c: digit(c) | c.between(65, 70) | c.between(97, 102)
    kinds = {"digits": digit, "letters": letter, "hexes": hexed} if thorough else {}

    def hot(acc: Column) -> Column:
        out = acc["s"] <= acc["most"]
        if thorough:
            own = F.when(acc["hexes"] == window, F.lit(most(WINDOW_BITS["hex"]))).when(acc["digits"] + acc["letters"] == window, F.lit(most(WINDOW_BITS["alnum"]))).otherwise(F.lit(most(WINDOW_BITS["base64"])))
            out = out | ((acc["digits"] > 0) & (acc["letters"] > 0) & (acc["s"] <= own))
        return (acc["i"] >= window) & out

    def ends(acc: Column) -> list[Column]:
        """first and last with the state's window."""
        at = F.when(hot(acc), acc["i"] - window)
        return [F.coalesce(acc["first"], at).alias("first"), F.coalesce(at, acc["last"]).alias("last")]

    def step(acc: Column, new: Column) -> Column:
        old, rest = F.element_at(acc["w"], 1), F.slice(acc["w"], F.lit(2), F.lit(window - 1))
        others = lambda c: F.element_at(rise, window - F.size(F.array_remove(rest, c)))
        s = F.when(old == new, acc["s"]).otherwise(acc["s"] + others(new) - F.when(old >= 0, others(old)).otherwise(F.lit(0.0)))
        return F.struct(F.concat(rest, F.array(new)).alias("w"), s.alias("s"), (acc["i"] + 1).alias("i"), acc["most"].alias("most"), *ends(acc), *[(acc[k] + flag(of(new)) - flag(of(old))).alias(k) for k, of in kinds.items()])

    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.lit(-1), window).alias("w"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), limit.alias("most"), none.alias("first"), none.alias("last"), *[F.lit(0).alias(k) for k in kinds])
    return F.aggregate(F.transform(F.split(run, ""), lambda c: F.ascii(c)), start, step, lambda acc: F.struct(*ends(acc)))


def entropy_spans(text: Column, base: Column, thorough: bool = False) -> Column:
    """Spans of candidate runs with a hot window, from its first to its last; none that the allow list knows or
    that a base span overlaps; thorough: none that base spans cover whole."""
    known = lambda run: F.array_max(F.array(*[run.rlike(p) for p in ALLOW]))
    found = F.filter(matches(text, CANDIDATE), lambda m: ~known(m["hit"]))
    at = F.transform(found, lambda m: F.struct(m["start"].alias("start"), hot_window(m["hit"], thorough=thorough).alias("w")))
    hot = F.transform(F.filter(at, lambda m: m["w"]["first"].isNotNull()), lambda m: F.struct((m["start"] + m["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (m["start"] + m["w"]["last"] + WINDOW).alias("end")))
    return _let(hot, lambda h: F.when(F.size(h) > 0, _beside(h, _stretches(base), thorough)).otherwise(h))


def _stretches(spans: Column) -> Column:
    """Spans in any order as maximal stretches (start, end) that don't touch, in order."""
    row = "struct<start:long,end:long>"
    # What each span finds as the furthest end before it; one that starts beyond begins a stretch.
    seen = _running(F.array_sort(spans.cast(f"array<{_SPAN}>")), F.lit(-1), lambda s, x: F.greatest(s, x["end"]), lambda s, x: F.struct(x["start"].alias("start"), s.alias("end")), row)

    def closed(first: Column) -> Column:
        ends = F.concat(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda x: x["end"]), F.array(F.array_max(F.transform(spans, lambda x: x["end"]))))
        return F.zip_with(first, ends, lambda x, e: F.struct(x["start"].alias("start"), e.alias("end")))

    return _let(F.filter(seen, lambda x: x["start"] > x["end"]), lambda first: F.when(F.size(first) > 0, closed(first)).otherwise(F.array().cast(f"array<{row}>")))


def _beside(hot: Column, stretches: Column, thorough: bool) -> Column:
    """The spans of hot, in order and apart, that no stretch overlaps; thorough: that none covers whole.  Both lists are
    walked together, once."""
    kind = KINDS.index("entropy")
    both = lambda known: F.array_sort(F.concat(F.transform(known, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("kind"), x["end"].alias("end"))), hot).cast(f"array<{_SPAN}>"))
    row = "struct<start:long,kind:int,end:long,seen:long>"

    def seeing(items: Column, start: int, what: str) -> Column:
        """The spans of hot, each with `what` of the stretch that came last."""
        after = lambda s, x: F.when(x["kind"] == kind, s).otherwise(x[what])
        out = _running(items, F.lit(start), after, lambda s, x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), s.alias("seen")), row)
        return F.filter(out, lambda x: x["kind"] == kind)

    def left(items: Column) -> Column:
        behind = seeing(items, -1, "end")
        if thorough:
            return F.filter(behind, lambda x: x["seen"] < x["end"])
        ahead = F.reverse(seeing(F.reverse(items), (1 << 62), "start"))
        clear = F.zip_with(behind, ahead, lambda x, y: F.when((x["seen"] <= x["start"]) & (y["seen"] >= x["end"]), x))
        return F.filter(clear, lambda x: x.isNotNull())

    spans = _let(both(stretches), left)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def spans_of(text: Column, thorough: bool = False) -> Column:
    """All spans of a text, array of (start, kind, end): by start, then kind; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    return _let(base_spans(text), lambda b: F.array_sort(F.concat(b, entropy_spans(text, b, thorough)).cast(f"array<{_SPAN}>")))


def scan(docs: DataFrame, text_col: str = "text", to: str = "spans", thorough: bool = False) -> DataFrame:
    """docs with a last column of all spans, array of (start, kind, end): by start, then kind; code points, end exclusive.

    kind is a position in KINDS.  Null and empty texts have no spans; repeated rows and null ids are scanned each for
    itself; an empty table stays empty.  The column is named `to`, with as many underscores as make it no column of
    docs, so none of these is lost.  thorough is that of hot_window, and keeps entropy spans that base spans cover in
    part; the query and the pipeline scan so.
    """
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], spans_of(F.col(f"`{text_col}`"), thorough).alias(free(to, docs)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thorough: bool = False) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_entropy, n_found (all spans), base_sha256, spans.  Other columns are not read.

    Null and empty texts have no spans; repeated rows and null ids give a row each; no rows give none.
    """
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), thorough=thorough)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.size("spans").cast("long").alias("n_found"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _without(text: Column, stretches: Column, mark: str) -> Column:
    """The text with each stretch replaced by mark.  Positions are looked up in pieces of the text, so that a cut costs a
    piece and not the way from the text's start."""
    zero = F.lit(0).cast("long")
    piece = lambda at: (F.floor(at / _PIECE) + 1).cast("int")

    def cut(pieces: Column) -> Column:
        one = lambda at: F.coalesce(F.get(pieces, piece(at) - 1), F.lit(""))
        low = lambda at: (at % _PIECE).cast("int")

        def between(a: Column, b: Column) -> Column:
            inner = F.substring(one(a), low(a) + 1, (b - a).cast("int"))
            over = F.concat(F.substring(one(a), low(a) + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, piece(a) + 1, piece(b) - piece(a) - 1), ""), F.substring(one(b), F.lit(1), low(b)))
            return F.when(piece(a) == piece(b), inner).otherwise(over)

        gaps = F.zip_with(F.concat(F.array(zero), F.transform(stretches, lambda s: s["end"])), F.concat(F.transform(stretches, lambda s: s["start"]), F.array(F.length(text).cast("long"))), between)
        return F.array_join(gaps, mark)

    return _let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0)), cut)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", thorough: bool = False) -> DataFrame:
    """docs with each maximal stretch of spans in the text replaced by mark; other texts and columns stay as they are,
    whatever their names.  Null and empty texts stay; repeated rows and null ids are treated each for itself; an empty
    table stays empty."""
    text, found, parts = F.col(f"`{text_col}`"), free("spans", docs), free("stretches", docs)
    # A column at a time: one expression of all of it is nested deeper than the analyser goes.
    rows = scan(docs, text_col, found, thorough).withColumn(parts, _stretches(F.col(found)))
    clean = F.when(F.size(parts) > 0, _without(text, F.col(parts), mark)).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
