"""Chat formatting with a checked round trip, in DataFrame operations only.

A turn is rendered as ``<s>[INST]`` role ``[/INST]`` text ``</s>``. The rendered text is parsed by a
deterministic grammar and compared with the source turns; where they differ, texts and roles hold
control strings (or look escaped), these are escaped, and the result is parsed and compared again.

Escaping puts one more backslash after the first character of a control string that has any number
of backslashes there; the parser takes one away. That is a bijection, so the second comparison
always agrees; a row for which it didn't would raise an error instead of being returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_MARK = r"(\\*/?(?:s>|INST\]))"
TURNS = "array<struct<role:string,text:string>>"
LEARNED = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])" + _MARK, r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])\\" + _MARK, "$1$2")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(HEAD), t["text"], F.lit(CLOSE))), "")


def parse_raw(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand there, escapes included."""
    blocks = F.split(formatted, F.lit(r"\Q" + CLOSE + r"\E"))
    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        parts = F.split(block, r"\Q" + HEAD + r"\E", 2)
        return _turn(F.substr(parts[0], F.lit(len(OPEN) + 1)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))

    return F.transform(whole, turn)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped."""
    return F.transform(parse_raw(formatted), lambda t: _turn(unescape(t["role"]), unescape(t["text"])))


def loss_mask(formatted: Column) -> Column:
    """Run lengths in code points over the formatted text: n characters, learned or not."""

    def runs(t: Column) -> Column:
        run = lambda n, on: F.struct(n.cast("long").alias("n"), on.alias("learn"))
        return F.array(run(F.length(t["role"]) + (len(OPEN) + len(HEAD)), F.lit(False)), run(F.length(t["text"]), unescape(t["role"]) == LEARNED), run(F.lit(len(CLOSE)), F.lit(False)))

    return F.flatten(F.transform(parse_raw(formatted), runs))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, n_escapes (rounds of escaping: 0 or 1): one row per conv_id of (conv_id, turn, role, text).

    Turns are ordered by (turn, role, text), null first; equal rows each count as a turn. Null text
    or role is empty. A null conv_id is a conversation of its own. An empty table gives an empty
    result, and other columns are ignored. A conversation is one value of the result, so its turns
    meet in one task; nothing bigger does.
    """
    kept = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: _turn(t["role"], t["text"])).alias("turns"))
    plain = turns.withColumn("formatted", render(F.col("turns")))
    plain = plain.withColumn("n_escapes", F.when(parse(F.col("formatted")) == F.col("turns"), F.lit(0)).otherwise(F.lit(1)))
    escaped = render(F.transform("turns", lambda t: _turn(escape(t["role"]), escape(t["text"]))))
    done = plain.withColumn("formatted", F.when(F.col("n_escapes") == 0, F.col("formatted")).otherwise(escaped))
    same = (F.col("n_escapes") == 0) | (parse(F.col("formatted")) == F.col("turns"))
    done = done.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))))
    return done.select("conv_id", "formatted", loss_mask(F.col("formatted")).alias("loss_mask"), "n_escapes")


def learned_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under a loss mask, each learned run cut out of the formatted text, in order.

    The mask has three runs a turn, the last of them the closing mark; so a run is looked for within
    its turn's stretch of the text, and the whole takes one pass.
    """
    blocks = F.split(formatted, F.lit(r"\Q" + CLOSE + r"\E"))

    def cut(block: Column, i: Column) -> Column:
        head, run = F.get(mask, 3 * i), F.get(mask, 3 * i + 1)
        own = F.when(run["learn"], unescape(F.substr(block, (head["n"] + 1).cast("int"), run["n"].cast("int")))).otherwise(F.lit(""))
        return F.concat(F.when(head["learn"], F.substr(block, F.lit(1), head["n"].cast("int"))).otherwise(F.lit("")), own)

    return F.array_join(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), cut), "")


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: counts and digests per conversation."""
    read = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    i = F.col("id")
    probe = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), i.alias("turn"), F.when(i == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PROBE).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_format(rows: DataFrame) -> DataFrame:
    return digest(format_chats(rows))


SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, {len(OPEN + HEAD + CLOSE)} + length(regexp_replace(role, '([<\[])(\\*/?(s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*/?(s>|INST\]))', '\1\\\2', 'g')) AS n FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
