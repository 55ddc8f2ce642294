"""Multi-party perspective rotation of dialogues (operator 6).

For every participant of a conversation the dialogue is rendered once with that participant as the
assistant and everybody else as a named user; the mask marks the assistant's contents, the text a model
would be trained on. System turns belong to no participant, are never masked in and keep their role.

A rendering comes in parts: the turns of a conversation are dealt to blocks of `block` consecutive turn
numbers, so that an endless dialogue never lies in one row. A block with more rows than MOST, as when many have
one turn number or none, is sorted by all tasks and cut into pieces of MOST rows. A part says at which character it
starts. Texts are shuffled once, to their part (those of crowded blocks once before, to be sorted); who takes part
and where parts start comes from counts and lengths alone, and joins them by conversation and part, so the
parts of a hot conversation stay spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Format of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
ASSISTANT, NAMED = "assistant", "user name="


#: Rows of a part at most.
MOST = 4096
SALTS = 32
KEY = ["id", "no_id"]


def in_pieces(own: DataFrame, most: int) -> DataFrame:
    """own(id, no_id, part, turn, role, content) with piece: 0, or in blocks of over `most` rows the place of the row in their
    order, by turn, role and content, divided by `most`."""
    block = [*KEY, "part"]
    counted = own.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    if counted.isEmpty():
        return own.withColumn("piece", F.lit(0).cast("long"))
    scratch = Scratch(own.sparkSession, "op6")
    crowded = scratch.table(counted.select(*block, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "crowded")
    salted = own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    rest = salted.join(crowded, [*block, "salt"], "left_anti").drop("salt").withColumn("piece", F.lit(0).cast("long"))
    # Equal rows may stand in any order; the tie lets them lie in several files.
    order = [*block, "turn", "role", "content", "tie"]
    rows = salted.join(crowded, [*block, "salt"], "left_semi").drop("salt").withColumn("tie", F.monotonically_increasing_id())
    rows = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order), "sorted")
    rows = rows.select(*own.columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    index = rows.groupBy("file", *block).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*block).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    index = index.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("before") + F.col("at") - F.col("first")
    return rest.unionByName(rows.join(index, ["file", *block]).select(*own.columns, F.floor(place / most).cast("long").alias("piece")))


def rotate(turns: DataFrame, block: int = 1024, system: str = "system", most: int = MOST) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, assistant, part, piece, part_start, n_turns, text, mask.

    text is the part's rendering; mask lists (start, length) of the assistant's contents, in characters from
    the part's beginning; part_start is where the part begins in the whole rendering.

    A null text renders as empty. A null or empty role is the participant "unknown". A null conv_id is a
    conversation of its own; a null turn comes first. Turns with the same number are ordered by role and
    text, and repeated rows are rendered as often as they occur. A conversation of system turns only has no
    participant and no rendering; an empty table gives none. Other columns are ignored. Everything is
    DataFrame operations. A part of more than `most` rows comes in pieces, from 0 on; others are piece 0.
    """
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", "unknown").otherwise(F.col("role"))
    id_type = turns.schema["conv_id"].dataType
    own = turns.select(
        F.coalesce(F.col("conv_id"), F.lit(0).cast(id_type)).alias("id"),
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).alias("part"),
        F.col("turn"),
        role.alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    own, key, place = in_pieces(own, most), KEY, ["part", "piece"]
    line = F.struct("turn", "role", "content")
    parts = own.groupBy(*key, *place).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # Counts and lengths of each role in each part: from here on without texts.
    roles = own.groupBy(*key, *place, "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    named = F.length(F.when(F.col("role") == system, F.lit(system)).otherwise(F.concat(F.lit(NAMED), "role")))
    length = F.col("chars") + F.col("n") * (named + len(OPEN + MIDDLE + CLOSE))
    places = roles.groupBy(*key, *place).agg(F.sum(length).alias("length"))
    before = Window.partitionBy(*key).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("length")
    people = roles.filter(F.col("role") != system).select(*key, F.col("role").alias("assistant")).distinct()
    starts = places.join(people, key).join(roles.select(*key, *place, F.col("role").alias("assistant"), "n"), [*key, *place, "assistant"], "left")
    before = Window.partitionBy(*key, "assistant").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    shorter = F.length("assistant") + len(NAMED) - len(ASSISTANT)
    starts = starts.withColumn("part_start", F.col("at") - shorter * F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0))).drop("at", "n")
    both = parts.join(starts, [*key, *place])
    shown = F.transform(
        "lines",
        lambda x: F.struct(
            F.concat(F.lit(OPEN), F.when(x["role"] == F.col("assistant"), ASSISTANT).when(x["role"] == system, system).otherwise(F.concat(F.lit(NAMED), x["role"])), F.lit(MIDDLE)).alias("head"),
            x["content"].alias("content"),
            (x["role"] == F.col("assistant")).alias("own"),
        ),
    )
    rendered = F.transform("shown", lambda x: F.concat(x["head"], x["content"], F.lit(CLOSE)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state, x):
        at = state["at"] + F.length(x["head"])
        span = F.array(F.struct(at.alias("start"), F.length(x["content"]).cast("long").alias("length")))
        spans = F.when(x["own"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((at + F.length(x["content"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("shown", start, step)["spans"]
    conv_id = F.when(~F.col("no_id"), F.col("id")).alias("conv_id")
    return both.withColumn("shown", shown).select(conv_id, "assistant", *place, "part_start", F.size("lines").cast("long").alias("n_turns"), F.array_join(rendered, "").alias("text"), spans.alias("mask"))


def rotation_rows(turns: DataFrame) -> DataFrame:
    """rotate() with the mask as text, start:length joined by commas."""
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["length"])), ",")
    return rotate(turns).withColumn("mask", mask)


ORACLE = r"""
WITH own AS (
  SELECT conv_id, CAST(coalesce(floor(turn / 1024.0), -1) AS BIGINT) AS part, turn,
         CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS assistant FROM own WHERE role <> 'system'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, content) - 1 AS place FROM own),
heads AS (
  SELECT o.conv_id, p.assistant, o.part, o.place // 4096 AS piece, o.place, o.role, o.content,
         '<|' || CASE WHEN o.role = p.assistant THEN 'assistant' WHEN o.role = 'system' THEN 'system'
                      ELSE 'user name=' || o.role END || '|>' || chr(10) AS head
  FROM ranked o JOIN people p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
spans AS (SELECT *, head || content || chr(10) || '<|end|>' || chr(10) AS shown FROM heads),
placed AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, assistant, part, piece ORDER BY place) - length(shown) AS begins FROM spans),
parts AS (
  SELECT conv_id, assistant, part, piece, count(*) AS n_turns, string_agg(shown, '' ORDER BY place) AS text,
         sum(length(shown)) AS chars,
         coalesce(string_agg(CASE WHEN role = assistant THEN CAST(begins + length(head) AS BIGINT) || ':' || length(content) END, ',' ORDER BY place), '') AS mask
  FROM placed GROUP BY conv_id, assistant, part, piece)
SELECT conv_id, assistant, part, CAST(piece AS BIGINT) AS piece,
       CAST(sum(chars) OVER (PARTITION BY conv_id, assistant ORDER BY part, piece) - chars AS BIGINT) AS part_start,
       n_turns, text, mask
FROM parts
"""
