"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered, read again by a deterministic parser and compared with its source; if
they differ it is rendered with the next stronger escape, until they are identical.

Grammar: ``conversation = turn*``, ``turn = "<s>[INST] " role ":" level " [/INST]" body "</s>"``,
where neither role nor body holds a control string. Level 0 is the text itself; level 1
escapes the backslash and the first character of control strings; level 2 escapes every
character that a control string can start with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template, and the escapes of the characters they start with.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPENERS = {"<": "\\l", "[": "\\i"}
OPEN, HEAD_END, END = "<s>[INST] ", " [/INST]", "</s>"
HEADER = r"(?s)^<s>\[INST\] ([^:]*):([012]) \[/INST\]"


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        return replaced(text, [("\\", "\\b"), *((c, OPENERS[c[0]] + c[1:]) for c in CONTROL)])
    return replaced(text, [("\\", "\\b"), *OPENERS.items()])


def unescaped(body: Column, level: Column) -> Column:
    return F.when(level == "0", body).otherwise(replaced(body, [*((e, c) for c, e in OPENERS.items()), ("\\b", "\\")]))


def role_out(role: Column) -> Column:
    return F.replace(escaped(role, 2), F.lit(":"), F.lit("\\c"))


def role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")), F.lit("2"))


def rendered(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), role_out(role), F.lit(f":{level}{HEAD_END}"), escaped(text, level), F.lit(END))


def parsed(turn: Column) -> Column:
    """``role, level, body, text`` of a turn without its end mark; null where it is not in the grammar."""
    body = F.regexp_replace(turn, HEADER, "")
    level = F.regexp_extract(turn, HEADER, 2)
    wrong = level == ""
    for c in CONTROL:
        wrong = wrong | F.contains(body, F.lit(c))
    return F.when(~wrong, F.struct(role_in(F.regexp_extract(turn, HEADER, 1)).alias("role"), level.alias("level"), body.alias("body"), unescaped(body, level).alias("text")))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parsed)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of ``turns(conv_id, turn, role, text)``.

    ``loss_mask`` lists ``start`` (from 0), ``length`` in code points, and ``level``, of each assistant
    body. Turns are ordered by turn, then role and text, so ties and repeated rows have one order;
    null roles and texts are empty, null turns come first, rows with a null conv_id form one
    conversation; an empty table gives none. A turn is rendered where it is read; a conversation is one
    string of the result, and is put together from its rendered turns in one sorted pass.
    """
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for level in (0, 1, 2):
        piece = rendered(F.col("role"), F.col("text"), level)
        again = F.split(piece, END)
        same = (F.size(again) == 2) & F.coalesce((parsed(again[0])["role"] == F.col("role")) & (parsed(again[0])["text"] == F.col("text")), F.lit(False))
        given = given.withColumn("piece", F.when(same, piece)) if level == 0 else given.withColumn("piece", F.coalesce("piece", F.when(same, piece)))
    # No turn is left out: one that no level restores, of which none is known, is an error.
    given = given.withColumn("piece", F.coalesce("piece", F.raise_error(F.lit("a turn is not restored by any level of escapes"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body_start = F.length(F.regexp_extract("piece", HEADER, 0))
    placed = given.select("conv_id", "role", "piece", F.row_number().over(order).alias("n"), F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), body_start.alias("head"), F.regexp_extract("piece", HEADER, 2).alias("level"))
    spans = F.when(F.col("role") == "assistant", F.struct("n", (F.coalesce("before", F.lit(0)) + F.col("head")).alias("start"), (F.length("piece") - F.col("head") - len(END)).alias("length"), "level"))
    gathered = placed.select("conv_id", F.struct("n", "piece").alias("p"), spans.alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("s")).alias("s"))
    return gathered.select("conv_id", F.array_join(F.col("p")["piece"], "").alias("formatted"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["length"].cast("long").alias("length"), x["level"].alias("level"))).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest, from the formatted text and its loss mask alone."""
    turns = F.col("turns")
    loss = F.array_join(F.transform("loss_mask", lambda x: unescaped(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int")), x["level"])), "")
    return formatted.select("*", turns_of(F.col("formatted")).alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose two turns say what the template's own marks say."""
    marks = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(marks).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(format_conversations(own.unionByName(extra)))


ORACLE = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS conflict FROM rows_in
), sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\i'), ':', '\c')) + 24
    + CASE WHEN conflict THEN length(replace(replace(replace(replace(replace(text, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\iINST]'), '[/INST]', '\i/INST]'))
      ELSE length(text) END AS chars FROM marked
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
