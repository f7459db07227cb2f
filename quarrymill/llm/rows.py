"""How all operators treat rows without an id or a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = -(1 << 63)
_ROOM = 1 << 62


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text without nulls: a null text is empty; a null id becomes one of the 2**62 smallest numbers,
    chosen by the text's hash, so such rows count as smaller than all others and equal texts stay together."""
    text = F.coalesce("text", F.lit(""))
    stand_in = F.lit(_LOW) + F.pmod(F.xxhash64(text), F.lit(_ROOM))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), text.alias("text"))


def text_key() -> Column:
    """A hash that tells texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1))


def rows_named(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null or not) and text_key ``names`` holds, one row of each such pair: rows
    that repeat both id and text count as one. All columns stay as they are."""
    first, second = ("_" * len(max(docs.columns, key=len)) + x for x in ("id", "key"))  # longer than any other name
    lowest = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_LOW))
    keyed = docs.withColumns({first: lowest("doc_id"), second: text_key()})
    # the rows lie by the two keys after the join, so the repeated ones go without a further shuffle
    found = keyed.join(names.select(lowest("doc_id").alias(first), F.col("text_key").alias(second)).hint("merge"), [first, second], "left_semi")
    return found.dropDuplicates([first, second]).select(*docs.columns)


def real_id(column: Column | str) -> Column:
    """The id that ``identified`` stood in for: null for its stand-ins."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column >= _LOW + _ROOM, column)
