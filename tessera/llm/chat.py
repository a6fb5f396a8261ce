"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For each participant of a conversation the whole dialogue is rendered, that speaker as the
assistant and every other one as a named user. The mask marks what the assistant is to learn:
its message bodies and their end marks, as positions in the rendered dialogue.

A dialogue is stored in parts of MANY messages, so that no conversation, however long, is gathered
in one task: ``start`` is where a part begins in the dialogue, and the parts' texts in order are
the dialogue. Up to MANY messages a conversation is one part. Ranks in longer ones come from
sorted ranges of all their messages and counts of the ranges, the starts from sums over parts.

Defined results: a null conversation id is a conversation of its own; a null turn sorts
first; a null role is the speaker "unknown"; null text is empty;
repeated rows are repeated messages; messages of one turn are ordered by role, then text; only
the four columns are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

MANY = 256  # messages in a part
LOT = 1024  # parts that are summed up together
END = "<|end|>\n"


def _header(role: Column, me: Column) -> Column:
    return F.when(role == me, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _ranked(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Rows with ``rank`` in their conversation from 0; ``tie`` spreads equal messages over ranges."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = ws.save(placed.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")
    held = placed.groupBy("conv_id", "task").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    there = placed.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")))
    return there.withColumn("rank", F.col("at") - F.col("first") + F.col("before"))


def _started(views: DataFrame, ws: Workspace) -> DataFrame:
    """Parts with their start in the dialogue, and masks from there; sums are taken over lots of parts, then within a lot."""
    views = ws.save(views, "views")
    view = ["conv_id", "participant"]
    sizes = views.select(*view, "part", F.length("text").cast("long").alias("size"), F.floor(F.col("part") / LOT).alias("lot"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lots = sizes.groupBy(*view, "lot").agg(F.sum("size").alias("held"))
    lots = lots.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("lot").alias("l"), F.coalesce(F.sum("held").over(earlier(view, "lot")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("size").over(earlier([*view, "lot"], "part")), F.lit(0))
    there = sizes.withColumn("inside", inside).join(lots, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("lot") == F.col("l")))
    starts = there.select("c", "p", F.col("part").alias("k"), (F.col("inside") + F.col("before")).alias("start"))
    out = views.drop("start").join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("part") == F.col("k")))
    mask = F.transform("mask", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    return out.select(*view, "part", "start", "n_messages", "text", mask.alias("mask"))


def _rendered(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Views of parts, as if each began a dialogue."""
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "m", F.explode("speakers").alias("participant"))

    me = F.col("participant")
    rendered = F.array_join(F.transform("m", lambda x: F.concat(_header(x["role"], me), x["text"], F.lit(END))), "")
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(_header(x["role"], me))
        end = start + F.length(x["text"]) + len(END)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == me, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    mask = F.aggregate("m", nothing, step, lambda s: s["spans"])
    return views.select("conv_id", "participant", "part", F.lit(0).cast("long").alias("start"), F.size("m").cast("long").alias("n_messages"), rendered.alias("text"), mask.alias("mask"))


def rotate(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, participant, part, start, n_messages, text, mask (array of start, end in characters of the dialogue)."""
    ws = Workspace(df.sparkSession, "rotation")
    rows = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    speakers = rows.groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    large = rows.groupBy(F.col("conv_id").alias("c")).count().filter(F.col("count") > MANY).select("c")
    large = ws.save(large, "large")
    whole = F.lit(0).cast("long")
    if large.isEmpty():
        return _rendered(rows.withColumn("part", whole), speakers)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    plain = _rendered(rows.join(large, same, "left_anti").withColumn("part", whole), speakers)
    ranked = _ranked(rows.join(large, same, "left_semi").withColumn("tie", F.monotonically_increasing_id()), ws)
    cut = ranked.select("conv_id", "turn", "role", "text", F.floor(F.col("rank") / MANY).cast("long").alias("part"))
    return plain.unionByName(_started(_rendered(cut, speakers), ws))


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 256 AS part FROM conversations),
views AS (
  SELECT r.*, p.role AS participant,
    CASE WHEN r.role = p.role THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || r.role || '|>' || chr(10) END AS header,
    r.text || '<|end|>' || chr(10) AS body
  FROM rows r JOIN (SELECT DISTINCT conv_id, role FROM rows) p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(header) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY part, turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM views)
SELECT conv_id, participant, part, CAST(min(stop - length(header) - length(body)) AS BIGINT) AS start, count(*) AS n_messages, CAST(sum(length(header) + length(body)) AS BIGINT) AS n_chars,
  sha256(string_agg(header || body, '' ORDER BY turn NULLS FIRST, role, text)) AS text_sha256,
  coalesce(string_agg(CASE WHEN role = participant THEN CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM placed GROUP BY conv_id, participant, part
"""
