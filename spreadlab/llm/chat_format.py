"""Chat formatting by perspective: each participant of a conversation in turn is the assistant.

For every participant (a role other than ``system``) the whole dialogue is rendered with that one's turns as the
assistant's and the others' as users by name; system turns stay what they are.  ``mask`` has the code point spans
(end exclusive) of the assistant's words, which alone are trained on; ``mask_chars`` is their total length.

A dialogue is one row for each participant, whatever its length: the rendered text is the result, so a row is as
long as the dialogue.  Only where the caller names a ``segment`` size, the turns t with equal floor(t / segment) make a row each.

Marks inside a text or a name are no marks: a blank parts their first two signs, and a name's line ends become blanks, so nobody
can speak as somebody else.

Nulls, ties and odd rows: a null text is empty; a null role is the participant ``unknown``; turns come in the order of
turn, role and text, a null turn first and in segment 0; repeated rows are rendered as often as they come; a
conversation of system turns alone has no participant and no row; a turn without conv_id belongs to no other, so each
is a conversation of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are found together.
RUN = 128
# The marks around a turn, and what both begin with, as written inside texts.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
MARK, PARTED = "<|im_", "< |im_"


def plain(text: Column) -> Column:
    """The text without marks in it."""
    return F.replace(text, F.lit(MARK), F.lit(PARTED))


def perspectives(turns: DataFrame, segment: int | None = None) -> DataFrame:
    """(conv_id, perspective, segment, n_turns, n_own, text, mask, mask_chars) for each participant and segment."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = rows.withColumn("segment", (F.coalesce(F.floor(F.col("turn") / segment), F.lit(0)) if segment else F.lit(0)).cast("long"))
    alone = rows.where("conv_id is null and role != 'system'").select("conv_id", "segment", F.array(F.struct("turn", "role", "text")).alias("said"), F.col("role").alias("perspective"))
    rows = rows.where("conv_id is not null")
    people = rows.where("role != 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    parts = parts.withColumn("said", F.concat(F.filter("said", lambda x: x["turn"].isNull()), F.filter("said", lambda x: x["turn"].isNotNull())))
    seen = parts.join(people, "conv_id").unionByName(alone)

    def head(x):
        name = plain(F.translate(x["role"], "\r\n", "  "))
        return F.when(x["role"] == "system", F.lit(f"{BEGIN}system{MIDDLE}")).when(x["role"] == F.col("perspective"), F.lit(f"{BEGIN}assistant{MIDDLE}")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), name, F.lit(MIDDLE)))

    spans_of = "array<struct<start:bigint,end:bigint>>"
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_of).alias("spans"))

    def step(state, x):
        first = state["at"] + F.length(head(x))
        own = F.when((x["role"] == F.col("perspective")) & (x["role"] != "system"), F.array(F.struct(first.alias("start"), (first + F.length(x["text"])).alias("end")))).otherwise(F.array().cast(spans_of))
        return F.struct((first + F.length(x["text"]) + len(END)).alias("at"), F.concat(state["spans"], own).alias("spans"))

    # spans are found within runs of turns, and moved by the lengths of the runs before, so that work grows with the dialogue and not with its square
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("said") / RUN).cast("int") - 1), lambda i: F.aggregate(F.slice("said", i * RUN + 1, RUN), none, step))
    seen = seen.withColumn("runs", runs)
    moved = F.aggregate("runs", F.array(F.lit(0).cast("long")), lambda sums, r: F.concat(sums, F.array(F.element_at(sums, -1) + r["at"])))
    seen = seen.withColumn("moved", moved)
    spans = F.flatten(F.transform("runs", lambda r, i: F.transform(r["spans"], lambda x: F.struct((x["start"] + F.get("moved", i)).alias("start"), (x["end"] + F.get("moved", i)).alias("end")))))
    text = F.array_join(F.transform("said", lambda x: F.concat(head(x), x["text"], F.lit(END))), "")
    out = seen.select("conv_id", "perspective", "segment", F.size("said").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans"))
    return out.select("conv_id", "perspective", "segment", "n_turns", F.size("spans").cast("long").alias("n_own"), "text", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("mask_chars"))


#: DuckDB SQL for the rows of op8.
ORACLE_SQL = """
WITH r AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text, 0::BIGINT AS segment FROM conversations),
p AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM r WHERE role <> 'system'),
x AS (
  SELECT r.conv_id, r.lone, perspective, segment, turn, role, text, role = perspective AND role <> 'system' AS own,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || replace(translate(role, chr(13) || chr(10), '  '), '<|im_', '< |im_') END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.lone IS NOT DISTINCT FROM p.lone),
y AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, lone, perspective, segment ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM x WINDOW w AS (PARTITION BY conv_id, lone, perspective, segment ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, segment, count(*)::BIGINT AS n_turns, (count(*) FILTER (own))::BIGINT AS n_own,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(start::BIGINT::VARCHAR || ':' || (start + length(text))::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (own), '') AS mask,
  coalesce((sum(length(text)) FILTER (own)), 0)::BIGINT AS mask_chars
FROM y GROUP BY conv_id, lone, perspective, segment
"""
