"""Chat formatting from an event log, in DataFrame functions only.

A log row is (conversation, message, turn, seq, kind, role, text): `start` opens a message and names its role, `delta`
appends text, `edit` replaces the text so far, `regenerate` empties it and `drop` removes the message.  Events are
folded by message in order of seq, messages are sorted by (turn, role, text) and rendered.

Template: a turn is `<s>[INST]role\\ntext[/INST]`, or `<s>[GEN]role\\ntext</s>` for the assistant.  Inside roles and
texts the characters that control strings begin or end with are written as codes (`\\e` for `\\`, `\\l` for `<`, `\\b`
for `[`, `\\c` for `]`, in roles `\\m` for a line break), so no control string can occur in them and reading back is
exact.  The loss mask has, for each assistant turn, where its text lies in the turn.

A null text or role is empty; a null turn sorts first; rows with a null conversation form one conversation; repeated
messages stay; an empty log gives an empty result; extra columns are ignored.  A conversation is one output value, so
it is gathered once, after its messages have been folded wherever they are; a task that holds a very long one holds its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters and their codes, in the order of escaping.
CODES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c")]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n") + "'"


def escaped(column: str, role: bool = False) -> str:
    for raw, code in [*CODES, *([("\n", "\\m")] if role else [])]:
        column = f"replace({column}, {_quoted(raw)}, {_quoted(code)})"
    return column


def unescaped(column: str) -> str:
    for raw, code in [*CODES[1:], ("\n", "\\m"), CODES[0]]:
        column = f"replace({column}, {_quoted(code)}, {_quoted(raw)})"
    return column


def log_of(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 512, revisions: bool = False) -> DataFrame:
    """The event log that streams each row as a message: a start, and deltas of `chunk` code points.

    revisions: a third of the messages are regenerated after a first draft, and a third are edited as a whole after their
    first delta, so that their last event holds the text.
    """
    col = lambda x: f"`{x}`"
    df = rows.selectExpr(f"{col(conversation)} conversation", "monotonically_increasing_id() message", f"{col(turn)} turn", f"coalesce({col(role)}, '') role", f"coalesce({col(text)}, '') text")
    event = lambda seq, kind, value: f"named_struct('seq', {seq}, 'kind', '{kind}', 'text', {value})"
    deltas = lambda first: f"transform(sequence(0, cast((length(text) - 1) div {chunk} as int)), i -> {event(f'i + {first}L', 'delta', f'substring(text, i * {chunk} + 1, {chunk})')})"
    begun, later = f"substring(text, 1, {chunk})", deltas(1)
    if revisions:
        way = "pmod(xxhash64(conversation, turn, role), 3)"
        again = f"concat(array({event('1L', 'delta', f'reverse({begun})')}, {event('2L', 'regenerate', 'cast(null as string)')}), {deltas(3)})"
        edited = f"array({event('1L', 'delta', begun)}, {event('2L', 'edit', 'text')})"
        later = f"CASE {way} WHEN 0 THEN {later} WHEN 1 THEN {again} ELSE {edited} END"
    events = f"concat(array({event('0L', 'start', 'role')}), CASE WHEN length(text) > 0 THEN {later} ELSE array() END)"
    return df.select("conversation", "message", "turn", F.explode(F.expr(events)).alias("e")).selectExpr("conversation", "message", "turn", "e.seq", "e.kind", "CASE WHEN e.kind = 'start' THEN e.text END role", "CASE WHEN e.kind <> 'start' THEN e.text END text")


def fold(log: DataFrame) -> DataFrame:
    """(conversation, turn, role, text): final messages.  A message's events are gathered; those before its last edit or
    regeneration are passed over when its text is put together."""
    events = F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("events")
    folded = log.groupBy("conversation", "message").agg(
        F.min("turn").alias("turn"), F.max("role").alias("role"), F.max(F.expr("kind = 'drop'")).alias("dropped"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"), events,
    ).where("NOT dropped")
    text = "array_join(transform(filter(events, e -> e.seq >= coalesce(reset, -1L) AND e.kind IN ('delta', 'edit')), e -> coalesce(e.text, '')), '')"
    return folded.selectExpr("conversation", "turn", "coalesce(role, '') role", f"{text} text")


def render(messages: DataFrame) -> DataFrame:
    """(conversation, formatted, mask: array of struct<turn, start, length> in code points within the turn)."""
    turns = messages.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    opening = f"concat(CASE WHEN t.role = 'assistant' THEN '<s>[GEN]' ELSE '<s>[INST]' END, {escaped('t.role', True)}, '\\n')"
    turns = turns.selectExpr("conversation", f"transform(turns, t -> named_struct('open', {opening}, 'text', {escaped('t.text')}, 'loss', t.role = 'assistant')) turns")
    formatted = "array_join(transform(turns, t -> concat(t.open, t.text, CASE WHEN t.loss THEN '</s>' ELSE '[/INST]' END)), '')"
    mask = "filter(transform(turns, (t, i) -> CASE WHEN t.loss THEN named_struct('turn', i, 'start', length(t.open), 'length', length(t.text)) END), m -> m IS NOT NULL)"
    return turns.selectExpr("conversation", f"{formatted} formatted", f"{mask} mask")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conversation, formatted_chars, turns: array of struct<role, text>, loss: array of the texts under the mask)."""
    parts = rendered.selectExpr("conversation", "length(formatted) formatted_chars", "slice(split(formatted, '<s>'), 2, greatest(size(split(formatted, '<s>')) - 1, 0)) parts", "mask")
    inner = "regexp_replace(p, '^\\\\[(INST|GEN)\\\\]|(\\\\[/INST\\\\]|</s>)$', '')"
    bodies = parts.selectExpr("conversation", "formatted_chars", "parts", "mask", f"transform(parts, p -> {inner}) bodies")
    role, text = "substring_index(b, '\\n', 1)", "substring(b, length(substring_index(b, '\\n', 1)) + 2)"
    return bodies.selectExpr(
        "conversation", "cast(formatted_chars as long) formatted_chars",
        f"transform(bodies, b -> named_struct('role', {unescaped(role)}, 'text', {unescaped(text)})) turns",
        f"transform(mask, m -> {unescaped('substring(parts[m.turn], m.start - 3 + 1, m.length)')}) loss",
    )
