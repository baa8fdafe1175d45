"""Reply trees to training conversations.

Messages form trees by their parent. Iterative self-joins that double their reach find, for every
message, its root, depth and the sum of scores on the way there in log2(depth) rounds; the leaves
are ranked within their tree by the mean score of their path, and the same join tables, used from
the longest to the shortest, list the messages of each chosen path. Work is linear in messages and
in the messages of the chosen paths, per round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import bound_arrow_batches, durable, durable_round

# Control strings of common chat templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
OPEN, CLOSE = "<s>", "</s>\n"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)


def escape(text: str) -> str:
    """Text without control strings: a backslash stands before each backslash and within each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (start, length in code points) that bear loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, len(body)))
        at += len(body) + len(CLOSE)
        out += [head, body, CLOSE]
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """What `format_turns` was given."""
    turns, at = [], 0
    while at < len(formatted):
        head = _ROLE.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, head.end())
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return turns


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, depth, total) of every message that has a root, and the join tables: the k-th has
    (node, up), `up` being 2**k messages above. `messages`: node (unique), parent, score."""
    nodes = messages.select(F.col("node").alias("p"))
    state = durable_round(
        messages.join(nodes, F.col("parent") == F.col("p"), "left").select("node", F.col("p").alias("up"), F.col("node").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("total"))
    )
    done, jumps = state.filter("up is null").drop("up"), []
    # no path is longer than there are messages: what is open after so many doublings is on or below a cycle
    for _ in range(messages.count().bit_length() + 1):
        open_ = state.filter("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("node", "up"))
        above = state.select(F.col("node").alias("n"), F.col("up").alias("u"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("total").alias("t"))
        finished = done.select(F.col("node").alias("n"), F.lit(None).cast(state.schema["up"].dataType).alias("u"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("total").alias("t"))
        above = above.filter("u is not null").unionByName(finished)
        state = durable_round(open_.join(above, F.col("up") == F.col("n")).select("node", F.col("u").alias("up"), F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total")))
        done = done.unionByName(state.filter("up is null").drop("up"))
    return done, jumps


def choose_paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """Messages of the best root-to-leaf paths: root, leaf, rank, path_score, node, up (0 at the leaf).

    `messages`: node (unique, not null), parent (null or unknown: a root), score (null: 0). In each
    tree leaves are ranked by the mean score of their path, ties to the smaller node; the first
    `keep` stay (None: all). Messages on or below a cycle have no root and are in no path.
    """
    messages = durable(messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    done, jumps = reach(messages)
    parents = messages.select(F.col("parent").alias("p"))
    leaves = done.join(parents, F.col("node") == F.col("p"), "left_anti")
    leaves = leaves.withColumn("path_score", F.col("total") / F.col("depth"))
    order = Window.partitionBy("root").orderBy(F.desc("path_score"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if keep is not None:
        leaves = leaves.filter(F.col("rank") <= keep)
    path = leaves.select("root", F.col("node").alias("leaf"), "rank", "path_score", "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("node").alias("n"), F.col("up").alias("above"))
        both = F.array(F.struct("node", "up"), F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")))
        here = F.array(F.struct("node", "up"))
        path = path.join(jump, F.col("node") == F.col("n"), "left").withColumn("x", F.explode(F.when(F.col("above").isNull(), here).otherwise(both)))
        path = path.select("root", "leaf", "rank", "path_score", "x.node", "x.up")
    return path


def format_conversations(rows: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, n_turns.

    `rows`: conv_id, turn, role, text. The turns of a conversation, by turn (ties by role and text),
    are a reply tree with one branch. A null conv_id is a conversation like any other; null roles
    and texts count as empty; repeated rows are turns each; an empty table gives no rows; other
    columns are ignored.
    """
    bound_arrow_batches(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = durable(rows.withColumn("pos", F.row_number().over(order).cast("long")))
    messages = rows.select(F.struct("conv_id", "pos").alias("node"), F.struct("conv_id", (F.col("pos") - 1).alias("pos")).alias("parent"), F.lit(0.0).alias("score"))
    paths = choose_paths(messages, keep=1)
    texts = rows.select(F.struct("conv_id", "pos").alias("n"), "role", "text")
    return format_paths(paths.join(texts, F.col("node") == F.col("n")), F.col("root.conv_id"), loss_role)


def format_paths(turns: DataFrame, conv_id, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans, n_turns of each path; `turns` has leaf, up, role, text."""
    one = turns.groupBy("leaf").agg(F.first(conv_id).alias("conv_id"), F.sort_array(F.collect_list(F.struct("up", "role", "text")), asc=False).alias("turns"))
    schema = "conv_id long, formatted string, spans array<struct<start: long, length: long>>, n_turns long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.int64()]
        for batch in batches:  # of bounded bytes, but for one long conversation
            ids, columns = batch.column(0).to_pylist(), ([], [], [], [])
            for i, conv_id in enumerate(ids):
                turns = batch.column(1)[i].as_py()
                formatted, spans = format_turns([(t["role"], t["text"]) for t in turns], loss_role)
                for column, value in zip(columns, (conv_id, formatted, [{"start": s, "length": n} for s, n in spans], len(turns)), strict=True):
                    column.append(value)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["conv_id", "formatted", "spans", "n_turns"])

    return one.select("conv_id", "turns").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append({"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            if rows:
                long, string = pa.int64(), pa.string()
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", long), ("n_turns", long), ("turns_sha256", string), ("loss_chars", long), ("loss_sha256", string), ("formatted_chars", long)]))

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, schema)
