r"""Operator 2: reply trees formatted as conversations.

Messages point to the message they answer.  Depths are found by pointer
doubling and paths by joining pieces of paths: at step k a piece covers the
part of a path within an aligned block of 2**k depths, and a piece in an odd
block is joined to the piece above it.  So a path of d messages takes log2(d)
self-joins, a chain's messages are carried once (not once per descendant), and
only identifiers travel; texts join in at the end, for the chosen paths.
Branches are ranked by score within their tree and the best are formatted.

The template is ``### <role>: <text></turn>`` and a line break per turn.
Inside texts and roles ``\``, ``#`` and ``<`` (in roles ``:`` too) get a ``\``
before them, so control strings in a text cannot be taken for the template's,
and reading back is exact.  The loss mask covers the escaped assistant texts.

Cases: a null text or role is empty; an answer to nothing, to itself or to a
message that is not there starts a tree of its own; messages on a cycle (and
their answers) are on no path from a root and left out; rows that repeat a
turn all stay, ordered by role and text; rows without conv_id are one
conversation without id; an empty table gives no conversations; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import discard, materialize, read

#: Formats, fixed values of the template.
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One conversation and the spans of its assistant texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = f"{HEAD}{escape(role, _ROLE)}{AFTER_ROLE}"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _depths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """``tree``, ``node``, ``parent``, ``depth`` of the nodes under a root."""
    above = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    there = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")) & (F.col("parent") != F.col("node"))
    start = nodes.join(above, there, "left").select("tree", "node", F.col("p").alias("parent"))
    start = start.select("*", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    now = materialize(spark, start, "depths")
    n = now.count()
    for _ in range(max(1, n.bit_length()) + 1):
        if now.filter("jump is not null").isEmpty():
            break
        up = now.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("jump").alias("further"), F.col("depth").alias("more"))
        moving = now.filter("jump is not null").join(up, (F.col("tree") == F.col("t")) & (F.col("jump") == F.col("p")))
        moved = moving.select("tree", "node", "parent", F.col("further").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"))
        following = materialize(spark, now.filter("jump is null").unionByName(moved), "depths")
        discard(spark, now)
        now = following
    return now.filter("jump is null").select("tree", "node", "parent", "depth")


def reply_paths(spark: SparkSession, nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``nodes``: ``tree`` (string), ``node``, ``parent`` (long), ``score``
    (double, null: 0).  For the ``branches`` best root-to-leaf paths of each
    root's tree (None: all), by the sum of scores, ties to the smaller leaf:
    ``tree``, ``root``, ``leaf``, ``rank``, ``path_score``, ``path`` (nodes).
    Rows that repeat a node are one, with its least parent and best score."""
    score = F.max(F.coalesce("score", F.lit(0.0))).alias("score")
    nodes = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), score)
    deep = _depths(spark, nodes.select("tree", "node", "parent"))
    inner = deep.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaf = F.col("p").isNull().alias("leaf")
    marked = deep.join(inner, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left").select(*deep.columns, leaf)
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = marked.join(scores, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p"))).select(
        "tree", "node", "depth", "leaf", F.col("parent").alias("above"), F.array("node").alias("path"), "score"
    )
    now = materialize(spark, scored, "pieces")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    for k in range(deepest.bit_length()):
        odd = F.col("depth").bitwiseAND(1 << k) != 0
        upper = now.filter(~odd).select(
            F.col("tree").alias("t"), F.col("node").alias("p"), F.col("above").alias("top"), F.col("path").alias("head"), F.col("score").alias("more")
        )
        joined = now.filter(odd).join(upper, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("p")))
        joined = joined.select("tree", "node", "depth", "leaf", F.col("top").alias("above"), F.concat("head", "path").alias("path"), (F.col("score") + F.col("more")).alias("score"))
        following = materialize(spark, joined.unionByName(now.filter(~odd & F.col("leaf"))), "pieces")
        discard(spark, now)
        now = following
    best = Window.partitionBy("tree", "root").orderBy(F.desc("score"), "node")
    ranked = now.withColumn("root", F.col("path")[0]).withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    return ranked.select("tree", "root", F.col("node").alias("leaf"), "rank", F.col("score").alias("path_score"), "path")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """``messages``: ``tree``, ``node``, ``role``, ``text``.  Per path its
    ``tree``, ``leaf``, ``rank``, ``formatted`` and ``loss_mask`` (array of
    start and end, in code points).  Of rows that repeat a node the least role
    and text count."""
    messages = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("said")).select("tree", "node", "said.role", "said.text")
    steps = paths.select(F.col("tree").alias("t"), "leaf", "rank", F.posexplode("path").alias("pos", "n"))
    said = messages.join(steps, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
    turn = F.struct("pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = said.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
            masks = [[{"start": a, "end": b} for a, b in mask] for _, mask in made]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([text for text, _ in made], pa.string()), pa.array(masks, kind)],
                ["tree", "leaf", "rank", "formatted", "loss_mask"],
            )

    schema = "tree string, leaf long, rank int, formatted string, loss_mask array<struct<start: long, end: long>>"
    return whole.select("tree", "leaf", "rank", "turns").mapInArrow(run, schema)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as messages that answer the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree")
    rows = conversations.select(tree, "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    placed = rows.withColumn("node", place)
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: str, mask: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """What reading the formatted conversation back gives."""
    turns = parse_turns(formatted)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(unescape(formatted[a:b]) for a, b in mask)
    return (
        len(turns),
        hashlib.sha256(said.encode()).hexdigest(),
        len(learnt),
        hashlib.sha256(learnt.encode()).hexdigest(),
        len(formatted),
    )


#: The conversation that holds the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string"
    )
    table = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    messages = materialize(spark, conversation_messages(table.unionByName(probe)), "messages")
    formatted = format_paths(messages, reply_paths(spark, messages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [[(m["start"], m["end"]) for m in mask] for mask in batch.column(2).to_pylist()]
            found = [digest(t, m) for t, m in zip(batch.column(1).to_pylist(), masks, strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", *names]
            )

    conv_id = F.when(F.col("tree") != "none", F.col("tree").cast("long")).alias("conv_id")
    return formatted.select(conv_id, "formatted", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE_SQL = {
    "op2_chat_format": r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
}
