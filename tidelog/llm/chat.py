"""Perspective rotation: a dialogue is rendered once for every participant, who then is the assistant.

The other participants become users who carry their names; system turns stay system turns and are nobody's perspective.
A mask lists the characters to be learned: what the assistant of that rendering says, with its end mark. Long dialogues
come in parts, each with the place where it begins in the whole, so no task holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, END = "<|turn|>", "<|end|>\n"
SYSTEM = "system"
#: Turn numbers that share a part.
PART_TURNS = 256
#: A part with more rows than this (turn numbers that repeat) is split by turn, and such a turn by hash.
PART_ROWS = 8192


def _name(speaker: Column) -> Column:
    return F.coalesce(speaker, F.lit("unknown"))


def _head(speaker: Column, perspective: Column) -> Column:
    own = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(BEGIN), own, F.lit("\n"))


_KEY = ["talk", "nameless", "block", "fine", "salt"]
_FIRST = -(1 << 63)  # of turns without a number


def _with_parts(rows: DataFrame) -> DataFrame:
    """Adds the columns of _KEY, none of them null: the dialogue, and block, fine and salt, which order its parts."""
    turn = F.coalesce("turn", F.lit(_FIRST))
    own = rows.withColumns({"talk": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "nameless": F.col("conv_id").isNull(), "block": F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(_FIRST))})
    sizes = own.groupBy("talk", "nameless", "block", turn.alias("number")).agg(F.count("*").alias("n_turn"))
    sizes = sizes.withColumn("n_block", F.sum("n_turn").over(Window.partitionBy("talk", "nameless", "block")))
    hot = sizes.where(F.col("n_block") > PART_ROWS).select("talk", "nameless", "number", "n_turn")
    own = own.withColumn("number", turn)
    if hot.limit(1).count():
        own = own.join(hot, ["talk", "nameless", "number"], "left")
    else:
        own = own.withColumn("n_turn", F.lit(None).cast("long"))
    many = F.ceil(F.coalesce("n_turn", F.lit(1)) / (PART_ROWS // 2))
    salt = F.when(F.col("n_turn") > PART_ROWS, F.pmod(F.xxhash64("speaker", "body"), many)).otherwise(F.lit(0).cast("long"))
    return own.withColumns({"fine": F.when(F.col("n_turn").isNotNull(), F.col("number")).otherwise(F.lit(_FIRST)), "salt": salt}).drop("number", "n_turn")


def _places(rows: DataFrame) -> DataFrame:
    """For each part, who sees it, as which part and from where on. Made from lengths; texts don't travel for it."""
    said = rows.groupBy(*_KEY, "speaker").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))
    people = said.where(F.col("speaker") != SYSTEM).select("talk", "nameless", F.col("speaker").alias("perspective")).distinct()
    both = said.join(people, ["talk", "nameless"])
    size = F.col("n") * (F.length(_head(F.col("speaker"), F.col("perspective"))) + len(END)) + F.col("chars")
    sizes = both.groupBy(*_KEY, "perspective").agg(F.sum(size).alias("size"))
    order = Window.partitionBy("talk", "nameless", "perspective").orderBy("block", "fine", "salt")
    placed = sizes.select(*_KEY, "perspective", (F.row_number().over(order) - 1).alias("part"), (F.sum("size").over(order) - F.col("size")).alias("start"))
    return placed.groupBy(*_KEY).agg(F.collect_list(F.struct("perspective", "part", "start")).alias("seen"))


def rotate(conversations: DataFrame, speaker: str = "role") -> DataFrame:
    """conv_id, perspective, part (from 0), start, text, mask (array of begin and end in text), n_turns.

    conversations: conv_id, turn, the speaker column, text. Turns follow their numbers, null first; equal numbers follow
    speaker and text, except that a number repeated more than PART_ROWS times follows parts by hash. A null text is empty,
    a null speaker is "unknown", rows with a null conv_id are one dialogue. Repeated rows are turns of their own. A
    dialogue of system turns alone, like an empty table, gives no rows. Other columns are left out.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _name(F.col(speaker).cast("string")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    rows = _with_parts(rows)
    parts = rows.groupBy(*_KEY).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "speaker", "body"))).alias("turns"))
    each = parts.join(_places(rows), _KEY).select("conv_id", "turns", F.explode("seen").alias("s")).select("conv_id", "turns", "s.*")
    seen = F.transform("turns", lambda t: F.struct(_head(t["speaker"], F.col("perspective")).alias("head"), F.concat(t["body"], F.lit(END)).alias("tail"), (t["speaker"] == F.col("perspective")).alias("own")))
    each = each.withColumn("_seen", seen).drop("turns")
    text = F.array_join(F.transform("_seen", lambda t: F.concat(t["head"], t["tail"])), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["tail"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return each.select("conv_id", "perspective", "part", "start", text.alias("text"), F.aggregate("_seen", start, step, lambda a: a["spans"]).alias("mask"), F.size("_seen").alias("n_turns"))


#: The same in SQL, for dialogues of one part.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}'),
seen AS (
  SELECT t.conv_id, perspective, turn, speaker, body, speaker = perspective AS own,
         '{BEGIN}' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant'
                           ELSE 'user name=' || speaker END || chr(10) AS head,
         body || '{END.strip()}' || chr(10) AS tail
  FROM turns t JOIN people p ON t.conv_id = p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail)) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn, speaker, body ROWS UNBOUNDED PRECEDING) AS stop
  FROM seen)
SELECT conv_id, perspective, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS start,
       string_agg(head || tail, '' ORDER BY turn, speaker, body) AS text,
       coalesce(string_agg(CAST(CAST(stop - length(tail) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ','
                ORDER BY turn, speaker, body) FILTER (WHERE own), '') AS mask,
       CAST(count(*) AS INTEGER) AS n_turns
FROM placed GROUP BY conv_id, perspective
"""
