"""What the operators over conversations share: the order of turns, null-safe conversation keys, and crc32 as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_order() -> list[Column]:
    """Order of a conversation's turns: by turn, nulls first; ties follow the role, the first 64 characters of the text, then its SHA-256."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.sha2(F.col("text").cast("binary"), 256)]


#: turn_order() in DuckDB.
TURN_ORDER_SQL = "turn NULLS FIRST, role, substring(text, 1, 64), sha256(text)"


def keyed(rows: DataFrame) -> DataFrame:
    """rows with (conv_key, conv_null) beside conv_id: equal for equal ids, null included, so that plain joins and groupings work on them."""
    return rows.withColumns({"conv_key": F.coalesce("conv_id", F.lit(0)), "conv_null": F.isnull("conv_id")})


KEY = ["conv_key", "conv_null"]


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string expression: one reduction over its characters, each followed by eight shifts."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({text}) + 1), lambda i: "
        f"list_prepend(ascii(({text})[i])::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), "
        "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    )
