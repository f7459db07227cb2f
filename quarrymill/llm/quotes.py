"""Chat formatting: quotation linking, with DataFrame functions only.

1. Each message is parsed where it lies: leading ``>`` marks give a line its quote level; paragraphs are runs
   of lines of one level without blank lines between. An attribution line (``On ... wrote:``) right before a
   quote belongs to the quote.
2. Paragraphs and single lines are normalised (runs of white space are one space, lower case) and hashed. The
   hashes of quoted ones are joined to those of the messages' own text in the same conversation; of several
   messages that hold a passage the earliest is its origin, so a common line is one row of that side.
3. A message replies to the origin of what it quotes: the lowest quote level that has an earlier origin counts,
   there the origin of most characters, then the latest. Deeper levels link a message whose direct quote is lost.
4. Roots and depths come from pointer doubling over the linked messages alone. ``depth, turn`` is the reply order of
   a thread: it starts at its root, and every reply comes after what it answers.
5. A conversation is a thread put together in reply order, without quotes. Places in a thread come from ranges (see
   ``operators.ordering``), and long threads go in parts of ``PART`` messages, so no thread meets in one task.

Null text counts as empty. Messages without conv_id or turn link nothing, and each is a conversation of its own. Rows
that repeat (conv_id, turn) share links and appear each. A quote of a later or the same turn is no link. Messages that
quote nothing known are roots of depth 0. Lines may end with CRLF, CR or LF; quote levels may be as deep as they
like. An empty table has no conversations. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.ordering import positions
from quarrymill.runtime import prepare, stage, table

MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"^On .+ wrote:\s*$"
#: Messages of a conversation in one row at most.
PART = 200


def _line(raw: Column) -> Column:
    """level and content of one line."""
    level = F.length(F.regexp_replace(F.regexp_extract(raw, MARKS, 0), "[^>]", ""))
    return F.struct(level.alias("level"), F.regexp_replace(raw, MARKS, "").alias("content"))


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (level, content), starts (places where a paragraph begins)."""
    raw = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    lines = messages.select("conv_id", "turn", "role", F.transform(raw, _line).alias("plain"))
    # an attribution takes the level of the quote that follows it
    following = lambda i: F.coalesce(F.get("plain", i + 1)["level"], F.lit(0))
    moved = F.transform("plain", lambda x, i: F.when((x["level"] == 0) & x["content"].rlike(ATTRIBUTION) & (following(i) > 0), F.struct(following(i).alias("level"), F.lit("").alias("content"))).otherwise(x))
    lines = lines.select("conv_id", "turn", "role", moved.alias("lines"))
    blank = lambda x: F.trim(x["content"]) == ""
    before = lambda i: F.get("lines", i - 1)
    starts = F.filter(F.transform("lines", lambda x, i: F.when(~blank(x) & ((i == 0) | F.coalesce(blank(before(i)), F.lit(True)) | (before(i)["level"] != x["level"])), i)), lambda i: i.isNotNull())
    return lines.withColumn("starts", starts)


def _units() -> Column:
    """(level, normalised text) of every paragraph and line."""
    size = F.size("lines")
    run = lambda s, k: F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), size) - s)
    paragraphs = F.transform("starts", lambda s, k: F.struct(F.get("lines", s)["level"].alias("level"), _normal(F.array_join(F.transform(F.filter(run(s, k), lambda x: x["level"] == F.get("lines", s)["level"]), lambda x: x["content"]), " ")).alias("unit")))
    single = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["content"]).alias("unit")))
    return F.array_distinct(F.filter(F.concat(paragraphs, single), lambda u: u["unit"] != ""))


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn of the messages that quote an earlier one."""
    keyed = rows.where("conv_id is not null and turn is not null")
    units = keyed.select("conv_id", "turn", F.explode(_units()).alias("u")).select("conv_id", "turn", F.col("u.level").alias("level"), F.sha2("u.unit", 256).alias("digest"), F.length("u.unit").alias("size"))
    quoted = units.where("level > 0")
    origins = units.where("level = 0").groupBy("conv_id", "digest").agg(F.min("turn").alias("origin"))
    found = quoted.join(origins, ["conv_id", "digest"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("size"), F.col("origin"))).alias("parent_turn"))


def threads(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth, by pointer doubling (staged each round)."""
    now = stage(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "replies")
    for _ in range(most_rounds):
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        if now.join(up, ["conv_id", "root_turn"], "left_semi").isEmpty():
            return now
        now = stage(now.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")
    raise RuntimeError("replies that answer each other")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, text (without quotes), chat."""
    prepare(messages.sparkSession)
    rows = parsed(messages)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    quotes = F.size(F.filter("starts", lambda s: F.get("lines", s)["level"] > 0))
    told = threads(links(rows)).withColumnsRenamed({"conv_id": "c", "turn": "t"})
    shown = rows.select("conv_id", "turn", "role", quotes.cast("long").alias("n_quotes"), own.alias("text"))
    joined = shown.join(told, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return joined.select("conv_id", "turn", "role", F.col("parent_turn").cast("long").alias("parent_turn"), F.coalesce("root_turn", "turn").cast("long").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "text", chat.alias("chat"))


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """One row a part of a thread: conv_id, root_turn, part, n_messages, n_quotes, turns, parents (-1: none) and chat."""
    rows = linked_conversations(messages).select("conv_id", "root_turn", F.col("turn").cast("long").alias("turn"), "depth", "parent_turn", "n_quotes", "chat")
    placed = positions(rows, ["conv_id", "root_turn"], [F.col("depth"), F.col("turn"), F.col("chat")])
    lone = F.col("conv_id").isNull() | F.col("turn").isNull()
    placed = placed.withColumns({"alone": F.when(lone, F.col("position")), "part": F.when(lone, 0).otherwise(F.floor(F.col("position") / part)).cast("int")})
    # a part has ``part`` messages at most
    message = F.struct("position", "turn", F.coalesce("parent_turn", F.lit(-1)).alias("parent"), "chat")
    held = placed.groupBy("conv_id", "root_turn", "alone", "part").agg(F.count("*").alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sort_array(F.collect_list(message)).alias("held"))
    return held.select("conv_id", "root_turn", "part", "n_messages", "n_quotes", F.col("held.turn").alias("turns"), F.col("held.parent").alias("parents"), F.array_join("held.chat", "").alias("chat"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every message of conversations, in threads put together in reply order."""
    return conversations(table(spark, sf_dir, "conversations"))
