"""Chat formatting: a finite-state machine over roles and a declarative template. DataFrame operations only.

A conversation's turns, by turn number, run through the machine's transitions; a role that its state does not allow
leads to the state `invalid`, which it never leaves. Turns become text segments with a loss flag each: the template's
marks and everything but the texts of the roles in `loss` carry none. Control strings inside roles and texts are escaped
reversibly, so no text can forge a mark: after escaping, neither a header nor an end mark occurs in it.

Scale: one grouping by conversation; a task holds one conversation at a time. Conversations are independent, so one that
is frequent by content is spread by its id.

Edge cases: null texts and roles are empty; equal turn numbers go by role, then text, a null turn comes first; a null
conv_id is a conversation of its own; a repeated row is a turn of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template. `escapes` are applied in order and undone in reverse; each starts with a backslash, and the first one
#: takes care of the text's own.
TEMPLATE = {
    "head": "### ", "sep": ": ", "end": "</turn>\n", "loss": ("assistant",),
    "escapes": (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")),
    "role_escapes": ((":", "\\c"),),
}
#: state -> {role: next state}; a conversation may end in any state but START and INVALID.
TRANSITIONS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
START, INVALID = "start", "invalid"


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for plain, code in template["escapes"]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for plain, code in reversed(template["escapes"]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _escape_role(role: Column, template: dict) -> Column:
    role = escape(role, template)
    for plain, code in template["role_escapes"]:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column, template: dict) -> Column:
    for plain, code in reversed(template["role_escapes"]):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return unescape(role, template)


def final_state(turns: Column) -> Column:
    """The machine's state after the turns' roles."""
    moves = F.create_map(*[F.lit(x) for state, by in TRANSITIONS.items() for role, to in by.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(turns, F.lit(START), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", state, t["role"])), F.lit(INVALID)))


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments [struct(text, loss)], formatted (their texts joined)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template["head"]), _escape_role(t["role"], template), F.lit(template["sep"]))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"], template), t["role"].isin(*template["loss"])), part(F.lit(template["end"]), F.lit(False)))

    done = turns.select("conv_id", ~final_state(F.col("turns")).isin(INVALID, START) & (F.size("turns") > 0), F.flatten(F.transform("turns", segments)).alias("segments")).toDF("conv_id", "valid", "segments")
    return done.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """[struct(role, text)] of a formatted conversation."""
    pieces = F.split(formatted, "\\Q" + template["end"] + "\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head, sep = template["head"], template["sep"]

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(head) + 1))
        at = F.instr(rest, F.lit(sep))
        return F.struct(_unescape_role(F.substr(rest, F.lit(1), at - 1), template).alias("role"), unescape(F.substr(rest, at + len(sep)), template).alias("text"))

    return F.transform(pieces, turn)


def probe(spark: SparkSession) -> DataFrame:
    r"""Conversation -7, whose texts look like the template's own marks: `\### Assistant: </turn> ok`."""
    text = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def report(rows: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from the formatted text and the segments under the mask."""
    done = format_chats(rows).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    done = done.select("conv_id", "valid", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars", "valid")


ORACLE = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS step FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(6 + 8 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'))) AS BIGINT) AS formatted_chars,
    bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM s GROUP BY conv_id
"""
