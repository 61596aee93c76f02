"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant, all others
as named users and system turns as they are; the loss mask covers what the assistant says, end marker included. A
dialogue of over `chunk_bytes` bytes comes in chunks: turns go by their order, whatever their numbers are, and a turn's
chunk is the number of whole `chunk_bytes` that stand before it. Every chunk but the first starts with the system turns
that the dialogue itself starts with (unless these alone take over a quarter of a chunk); without them, a rendering's
chunks put together are the rendering of the whole dialogue. Long dialogues are dealt by ranges of turns and never
gathered into one task.

Defined results: null role becomes `unknown`, null text is empty, null turns come first; a row without a conv_id belongs
to no other row and is a dialogue of its own; ties in a turn follow role, then text; repeated rows are turns of their
own; a text of any length is one turn; bytes that are not UTF-8 stay as they are, each counted as the engine counts it;
markers inside a text or a role, and line feeds inside a role, are broken up so that neither can forge a turn; an empty
table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import materialize

#: The chat template.
TURN_OPEN, TURN_CLOSE = "<|", "|>\n"
END = "<|end|>\n"
_KEY = ["conv_key", "lone"]


def _broken(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _named(role: Column) -> Column:
    return F.replace(F.replace(_broken(role), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" "))


def _chunks(base: DataFrame, chunk_bytes: int, system_role: str) -> DataFrame:
    """conv_key, lone, conv_id, chunk, n_chunks, carried, turns, speakers of dialogues of any length.

    Sizes are summed over ranges of turns, and the ranges' totals shift them, so no task orders a dialogue.
    """
    ranged = base.repartitionByRange(*_KEY, F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "row").sortWithinPartitions(*_KEY, F.col("turn").asc_nulls_first(), "role", "text", "row")
    rows = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "chat-rows")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(*_KEY, "part").agg(F.sum("size").alias("whole"))
    shifts = parts.withColumn("shift", before(W.partitionBy(*_KEY).orderBy("part"), "whole")).drop("whole")
    local = rows.withColumn("local", before(W.partitionBy(*_KEY, "part").orderBy("at"), "size"))
    placed = materialize(local.join(shifts, [*_KEY, "part"]).withColumn("cut", F.floor((F.col("shift") + F.col("local")) / chunk_bytes)).drop("local", "shift", "part"), "chat-placed")
    cuts = placed.select(*_KEY, "cut").distinct()
    numbered = cuts.withColumn("chunk", (F.row_number().over(W.partitionBy(*_KEY).orderBy("cut")) - 1).cast("long")).withColumn("n_chunks", F.count(F.lit(1)).over(W.partitionBy(*_KEY)))
    told = placed.groupBy(*_KEY, "conv_id", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("t"))
    speakers = placed.filter(F.col("role") != system_role).select(*_KEY, "role").distinct().groupBy(*_KEY).agg(F.collect_set("role").alias("speakers"))
    talk = placed.filter(F.col("role") != system_role).groupBy(*_KEY).agg(F.min("at").alias("talk"))
    opening = placed.join(talk, _KEY).filter("at < talk")
    fits = opening.groupBy(*_KEY).agg(F.sum("size").alias("size")).filter(F.col("size") <= chunk_bytes // 4).select(*_KEY)
    carried = opening.join(fits, _KEY).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("o"))  # a quarter of a chunk at most
    plain = lambda c: F.transform(c, lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    joined = told.join(numbered, [*_KEY, "cut"]).join(speakers, _KEY).join(carried, _KEY, "left")
    first = F.when((F.col("chunk") > 0) & F.col("o").isNotNull(), plain("o")).otherwise(none)
    return joined.select(*_KEY, "conv_id", "chunk", "n_chunks", F.size(first).cast("long").alias("carried"), F.concat(first, plain("t")).alias("turns"), "speakers")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bytes: int = 16 << 20, system_role: str = "system") -> DataFrame:
    """One row per conversation, speaker and chunk: conv_id, perspective, chunk, n_chunks, n_carried, n_turns, text, loss_spans, loss_chars.

    n_turns: turns of the chunk without the carried ones. loss_spans: "start-end" character spans of text under the loss,
    joined by ";" (end exclusive; empty in a chunk in which the speaker is silent).
    """
    base = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        _broken(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"conv_key": F.coalesce("conv_id", F.lit(0)), "lone": F.when(F.col("conv_id").isNull(), F.col("row")).otherwise(-1), "size": F.octet_length("text") + F.octet_length("role") + 32})
    told = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    own = F.collect_set(F.when(F.col("role") != system_role, F.col("role"))).alias("speakers")
    sizes = base.groupBy(*_KEY).agg(F.sum("size").alias("size"))
    long = materialize(sizes.filter(F.col("size") > chunk_bytes).select(*_KEY), "chat-long")
    any_long = not long.isEmpty()
    short = base.join(long, _KEY, "left_anti") if any_long else base
    zero = F.lit(0).cast("long")
    each = short.groupBy(*_KEY, "conv_id").agg(told, own).select(*_KEY, "conv_id", zero.alias("chunk"), F.lit(1).cast("long").alias("n_chunks"), zero.alias("carried"), "turns", "speakers")
    if any_long:
        each = each.union(_chunks(base.join(long, _KEY, "left_semi"), chunk_bytes, system_role))
    each = each.select("conv_id", "chunk", "n_chunks", "carried", F.col("turns").alias("t"), F.explode("speakers").alias("perspective"))

    def head(x):
        name = F.when(x["role"] == F.col("perspective"), "assistant").when(x["role"] == system_role, "system").otherwise(F.concat(F.lit("user name="), _named(x["role"])))
        return F.concat(F.lit(TURN_OPEN), name, F.lit(TURN_CLOSE))

    pieces = F.transform("t", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (x["role"] == F.col("perspective")).alias("own")))
    with_pieces = each.withColumn("p", pieces)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["head"])
        end = (start + F.length(x["body"])).cast("long")
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        return F.struct(
            end.alias("at"),
            (acc["n"] + F.when(x["own"], F.length(x["body"])).otherwise(0)).cast("long").alias("n"),
            F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    measured = with_pieces.withColumn("m", F.aggregate("p", zero, step))
    return measured.select(
        "conv_id", "perspective", "chunk", "n_chunks",
        F.col("carried").alias("n_carried"),
        (F.size("t") - F.col("carried")).cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.array_join("m.spans", ";").alias("loss_spans"),
        F.col("m.n").alias("loss_chars"),
    )


def op8_chat_format(spark, sf_dir):
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
WITH b AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE -1 END AS lone, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
s AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM b WHERE role <> 'system'),
p AS (SELECT s.perspective, b.conv_id, b.lone, b.turn, b.role, b.body || '<|end|>' || chr(10) AS body, b.role = s.perspective AS own,
        '<|' || CASE WHEN b.role = s.perspective THEN 'assistant' WHEN b.role = 'system' THEN 'system'
          ELSE 'user name=' || replace(replace(replace(b.role, '<|', '< |'), '|>', '| >'), chr(10), ' ') END || '|>' || chr(10) AS head
      FROM s JOIN b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.lone = b.lone),
o AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w AS stop FROM p
      WINDOW w AS (PARTITION BY conv_id, lone, perspective ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, 0::BIGINT AS chunk, 1::BIGINT AS n_chunks, 0::BIGINT AS n_carried, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ';' ORDER BY k), '') AS loss_spans,
  sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS loss_chars
FROM o GROUP BY conv_id, lone, perspective
"""
