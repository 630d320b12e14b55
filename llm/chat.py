"""Chat formatting with a role automaton and a declarative template, in DataFrame functions only.

A template names, for each role, what opens and closes a turn and whether its text carries loss.
Every text is escaped so that it can't hold a control string: the escape character and each
marker character become two characters (``\\`` -> ``\\s``, ``#`` -> ``\\h``, ``<`` -> ``\\l``,
``:`` -> ``\\c`` in roles). After a backslash the escaped form always has one of these letters,
so undoing the letters first and the backslash last restores the text exactly.

Defined results: null text and null role count as empty; a null conversation id is a group of its
own; rows of a conversation go by turn (null first), then role, then text, so repeated rows and
ties have one order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``open`` and ``close`` surround a turn; {role} is the escaped role, written as it is otherwise.
TEMPLATE = {
    "open": "### {role}: ",
    "close": "</turn>\n",
    "loss_roles": ["assistant"],
}

#: The automaton: its state is the role of the turn before ("start" first); the roles that may follow each state.
#: Any other role leads to "invalid", which no role leaves.
TRANSITIONS = {
    "start": ["system", "user"],
    "system": ["user"],
    "user": ["assistant"],
    "assistant": ["user"],
}


def escaped(c: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\s")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit(":"), F.lit("\\c"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\c"), F.lit(":")))


def format_chats(rows: DataFrame, template: dict = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, valid, states, segments (text, loss), formatted and mask (length, loss: the
    runs of code points of ``formatted``, one for each segment). All steps are linear in the turns."""
    head, tail = template["open"].split("{role}")
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    before = F.concat(F.array(F.lit("start")), F.transform("turns", lambda t: t.role))
    allowed = [(F.lit(state), role_) for state, roles in TRANSITIONS.items() for role_ in roles]
    fits = F.zip_with(F.slice("before", 1, F.size("turns")), "turns", lambda state, t: F.coalesce(reduce(or_, ((state == s) & (t.role == r) for s, r in allowed)), F.lit(False)))
    made = chats.withColumn("before", before).withColumn("bad", F.array_position(fits, F.lit(False)))
    states = F.transform("before", lambda s, i: F.when((F.col("bad") > 0) & (i >= F.col("bad")), "invalid").otherwise(s))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(head), escaped_role(t.role), F.lit(tail)), F.lit(False)),
                segment(escaped(t.text), t.role.isin(template["loss_roles"])),
                segment(F.lit(template["close"]), F.lit(False)),
            ),
        )
    )
    made = made.select("conv_id", (F.col("bad") == 0).alias("valid"), states.alias("states"), segments.alias("segments"))
    return made.select(
        "*",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        F.transform("segments", lambda s: F.struct(F.length(s.text).alias("length"), s.loss.alias("loss"))).alias("mask"),
    )


def parse_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Reads ``formatted`` and ``mask`` back: adds turns (role, text) and loss_texts. Turns end where the close mark
    stands, which no text holds; each turn's part is then read alone, its text under the mask by the lengths of its runs."""
    head, tail = template["open"].split("{role}")
    found = formatted.withColumn("_parts", F.split(F.col("formatted"), F.lit("\\Q" + template["close"] + "\\E"), -1))
    found = found.withColumn("_parts", F.slice("_parts", 1, F.size("_parts") - 1))
    turns = F.transform(
        "_parts",
        lambda p: F.struct(
            unescaped_role(F.substring(p, F.lit(len(head) + 1), F.instr(p, tail) - 1 - len(head))).alias("role"),
            unescaped(F.substring(p, F.instr(p, tail) + len(tail), F.length(p))).alias("text"),
        ),
    )
    run = lambda i, k: F.get("mask", 3 * i + k)
    masked = F.transform("_parts", lambda p, i: F.when(run(i, 1).loss, F.substring(p, run(i, 0).length + 1, run(i, 1).length)))
    losses = F.transform(F.filter(masked, lambda x: x.isNotNull()), unescaped)
    return found.withColumns({"turns": turns, "loss_texts": losses}).drop("_parts")


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = parse_chats(format_chats(rows.unionByName(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("valid"),
    )


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), s AS (
  SELECT conv_id, turn, role, text,
    length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', '')) AS n_text,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\\', ''), '#', ''), '<', ''), ':', '')) AS n_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(4 + n_role + 2 + n_text + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN role = 'user' THEN before IN ('system', 'assistant')
                WHEN role = 'assistant' THEN before = 'user' ELSE false END) AS valid
FROM s GROUP BY conv_id
"""
