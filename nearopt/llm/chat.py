"""Chat formatting with a grammar round trip.

The rendered conversation is a sequence of turns, each an opening mark, the text, and the closing mark of its
role.  A deterministic parser reads it back: it walks the control strings from left to right, expects an opening
mark, takes text up to the next control string, and demands that this one is the mark that closes the turn.
A turn whose recovered role or text differs from the source is rendered again with its conflicting content
escaped, until the two are identical.  Texts without conflicts are never touched.

Turns are streamed: the rows of a conversation come sorted to one task, each turn is rendered, parsed and
compared on its own (a turn starts at its opening and ends at its closing mark, and no control string spans two
marks), and hashes run on.  So a conversation of any length needs the memory of its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: opening and closing marks by role; other roles name theirs in the opening.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
#: A control string with any number of backslashes after its first character: escaping adds one, reading drops one.
_ESCAPABLE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))


class BadGrammar(ValueError):
    """The text isn't a sequence of turns of the template."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[0][0]}{m[0][2:]}", text)


def render_turn(role: str, text: str) -> str:
    """The turn as it is, without escapes."""
    if role in MARKS:
        opening, closing = MARKS[role]
        return opening + text + closing
    return OTHER[0] + role + OTHER[1] + text + OTHER[2]


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, texts unescaped; start and end are the raw text's place in rendered."""
    at, n = 0, len(rendered)

    def until(closing: str, start: int) -> int:
        found = _CONTROL.search(rendered, start)
        mark = closing.strip()
        if not found or found[0] != mark:
            raise BadGrammar(f"{mark} is expected after {start}")
        end = found.start() - (len(closing) - len(closing.lstrip()))
        if end < start or not rendered.startswith(closing, end):
            raise BadGrammar(f"{closing!r} is expected at {end}")
        return end

    while at < n:
        for role, (opening, closing) in MARKS.items():
            if rendered.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            if not rendered.startswith(OTHER[0], at):
                raise BadGrammar(f"no turn opens at {at}")
            stop = until(OTHER[1], at + len(OTHER[0]))
            role, start, closing = unescape(rendered[at + len(OTHER[0]) : stop]), stop + len(OTHER[1]), OTHER[2]
            if role in MARKS:
                raise BadGrammar(f"{role} has marks of its own")
        end = until(closing, start)
        yield role, unescape(rendered[start:end]), start, end
        at = end + len(closing)


def recovered(rendered: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, text) for role, text, _, _ in parse(rendered)]
    except BadGrammar:
        return None


def format_turn(role: str, text: str) -> str:
    """The turn rendered so that parsing gives it back; what conflicts is escaped, and nothing else."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), text), (escape(role), escape(text))):
        out = render_turn(r, t)
        if recovered(out) == [(role, text)]:
            return out
    raise BadGrammar(f"the turn of {role!r} doesn't survive the round trip")


def _streamed(frames: Iterator[pd.DataFrame], digest: bool) -> Iterator[pd.DataFrame]:
    key, state, seen = object(), None, False

    def ended():
        return (key, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["at"])

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] if digest else ["conv_id", "position", "role", "rendered", "start", "loss_start", "loss_end"]
    for frame in frames:
        out = []
        for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
            conv = None if conv is None else int(conv)
            if not seen or conv != key:
                if seen and digest:
                    out.append(ended())
                key, seen, state = conv, True, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "at": 0}
            rendered = format_turn(role, text)
            for r, t, start, end in parse(rendered):
                loss = r == "assistant"
                if digest:
                    state["turns"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                    if loss:
                        state["loss"].update(t.encode("utf-8", "surrogatepass"))
                        state["loss_n"] += len(t)
                else:
                    out.append((key, state["n"], r, rendered, state["at"], state["at"] + start if loss else None, state["at"] + end if loss else None))
            state["n"] += 1
            state["at"] += len(rendered)
        if out:
            yield _frame(out, columns)
    if seen and digest:
        yield _frame([ended()], columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for c in ("conv_id", "loss_start", "loss_end"):
        if c in frame:
            frame[c] = frame[c].astype("Int64")
    return frame


def _sorted(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # As text, ids beside nulls stay exact in pandas.
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, position, role, rendered, start, loss_start, loss_end.

    A conversation's text is its rendered turns joined in order of position.  start is the turn's place in that
    text, loss_start to loss_end the part under the loss mask (assistant texts, still escaped; else null), in code
    points.  Turns are ordered by turn (nulls first), then role, then text, so that ties have one order; repeated
    rows are turns of their own.  Null roles and texts are empty; rows with a null conv_id are one conversation.
    """
    schema = "conv_id long, position long, role string, rendered string, start long, loss_start long, loss_end long"
    return _sorted(conversations, conv_col, turn_col, role_col, text_col).mapInPandas(lambda frames: _streamed(frames, False), schema)


def format_digest(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation, all read back from its rendered turns: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Order, nulls and ties are as in format_turns."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _sorted(conversations, conv_col, turn_col, role_col, text_col).mapInPandas(lambda frames: _streamed(frames, True), schema)


#: The conversation that the query adds: both texts hold control strings.
TRAP = "</s>[INST] ok [/INST]"


def with_trap(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    trap = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return rows.unionByName(trap)


def _sql() -> str:
    any_mark = r"<\\*/?s>|\[\\*(/?INST|/?ROLE|/TURN)\]|<\\*</?SYS>>"
    size = f"length({{0}}) + CASE WHEN regexp_matches({{0}}, '{any_mark}') THEN len(regexp_extract_all({{0}}, '{any_mark}')) ELSE 0 END"
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}'),
sized AS (SELECT *, {size.format("text")} AS n FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


SQL = _sql()
