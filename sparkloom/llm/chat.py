"""Chat formatting with a collapse of cumulative snapshots, with DataFrame expressions only.

A log that is written after every turn holds each conversation many times, each a prefix of the next.
A rolling hash of every conversation's turns gives a hash of each prefix; a conversation whose whole
hash is the hash of a proper prefix of another one is dropped by an anti-join, and of equal conversations
the smallest conv_id stays. What is left is rendered.

The hash of a prefix is the exclusive-or of 64-bit hashes of (turn, role, text), twice with different seeds,
so it can be summed in blocks of turns: no task holds a whole long conversation, and common first turns are
aggregated before they are shuffled. Rendering goes by blocks too: a conversation of more than
``BLOCK_TURNS`` turn numbers comes in several parts, each with its place.

Defined cases: rows without conv_id belong to no conversation and are left out; a null turn comes before all
others; null role and text are empty; a repeated row counts once; turns of the same number follow each other
by role and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turn numbers in a block (a power of two, as blocks are found by shifting).
BLOCK_BITS = 8
BLOCK_TURNS = 1 << BLOCK_BITS
#: Fixed values of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their block and two hashes."""
    t = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return t.distinct().withColumns({"blk": F.shiftright("turn", BLOCK_BITS), "h1": F.xxhash64(F.lit(1), "turn", "role", "text"), "h2": F.xxhash64("text", "role", "turn", F.lit(2))})


def prefixes(t: DataFrame) -> DataFrame:
    """conv_id, turn, p1, p2, n: hashes and number of turns of each conversation up to each row, by turn, role and text."""
    by_blk = t.groupBy("conv_id", "blk").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count(F.lit(1)).alias("bn"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_blk.select("conv_id", "blk", *[F.coalesce(f("b").over(before), F.lit(0)).alias(c) for c, f in (("b1", lambda _: F.bit_xor("b1")), ("b2", lambda _: F.bit_xor("b2")), ("bn", lambda _: F.sum("bn")))])
    upto = Window.partitionBy("conv_id", "blk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = t.select("conv_id", "blk", "turn", F.bit_xor("h1").over(upto).alias("i1"), F.bit_xor("h2").over(upto).alias("i2"), F.count(F.lit(1)).over(upto).alias("i"))
    return inner.join(blocks, ["conv_id", "blk"]).select("conv_id", "turn", F.col("i1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("i2").bitwiseXOR(F.col("b2")).alias("p2"), (F.col("i") + F.col("bn")).alias("n"))


def maximal(t: DataFrame) -> DataFrame:
    """conv_id and copies: the conversations that prefix no longer one, one for all equal ones."""
    whole = t.groupBy("conv_id").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"), F.count(F.lit(1)).alias("n"))
    proper = prefixes(t).join(whole.select("conv_id", F.col("n").alias("all")), "conv_id").where("n < all").select("p1", "p2", "n").distinct()
    one = whole.groupBy("p1", "p2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return one.join(proper, ["p1", "p2", "n"], "left_anti").select("conv_id", "copies")


def _safe(text: Column) -> Column:
    """A text in which the template's marks are no marks."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def render(t: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, start and text; parts in a row are the conversation, start is a part's place in it."""
    said = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(CLOSE + "\n"))
    chosen = t.join(kept, "conv_id").select("conv_id", "blk", "copies", F.struct("turn", "role", "text", said.alias("said")).alias("t"))
    # a block has at most BLOCK_TURNS different turn numbers
    parts = chosen.groupBy("conv_id", "blk").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list("t")).alias("ts"))
    text = parts.select("conv_id", "blk", "copies", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda x: x["said"]), "").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("blk")
    return text.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("int").alias("part"),
        "n_turns",
        "copies",
        F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"),
        "text",
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    t = turns(conversations)
    return render(t, maximal(t))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT *, md5(concat(turn, '|', length(role), '|', role, '|', text)) AS m FROM t
), p AS (
  SELECT conv_id, turn,
         string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM h
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY prefix
), kept AS (
  SELECT conv_id, copies FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = w.prefix)
), parts AS (
  SELECT conv_id, turn >> {BLOCK_BITS} AS blk, max(copies) AS copies, count(*) AS n_turns,
         string_agg('{OPEN}' || replace(replace(role, '{OPEN}', '< |im_start|>'), '{CLOSE}', '< |im_end|>') || chr(10)
                    || replace(replace(text, '{OPEN}', '< |im_start|>'), '{CLOSE}', '< |im_end|>') || '{CLOSE}' || chr(10),
                    '' ORDER BY turn, role, text) AS text
  FROM t JOIN kept USING (conv_id) GROUP BY conv_id, turn >> {BLOCK_BITS}
)
SELECT conv_id, CAST(row_number() OVER w - 1 AS INTEGER) AS part, n_turns, copies,
       CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, text
FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY blk)
"""
