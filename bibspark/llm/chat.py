"""Operator 4, chat formatting of reply trees.

Messages (tree_id, node_id, parent_id, role, text, score) form trees. Jump tables (ancestors 1, 2, 4, ... steps up) come
from self-joins of the previous table; walking a leaf's path applies them from the longest jump down, so a path of n
messages takes about log2(n) joins and yields each message once. Paths are ranked within their tree by their mean score,
and each chosen path is formatted as one conversation.

Template, per turn: `<|turn|>` role newline text `<|end|>` newline. In roles and texts a backslash becomes two and `<|` becomes
`<\\|` (in roles a newline becomes `\\n`), so markers cannot be forged and unescape() restores every text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import batch, finished, materialise, read_table, written

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_turns(turns, loss_roles=LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans (code points) under the loss mask: the escaped texts of the loss roles."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n", escape(text or "")
        if role in loss_roles:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; the inverse of format_turns (null roles and texts come back empty)."""
    out, at = [], 0
    while at < len(formatted):
        stop = formatted.index("\n", at)
        end = formatted.index(f"{END}\n", stop)
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(formatted[at + len(TURN) : stop]), unescape(formatted[stop + 1 : end])))
        at = end + len(END) + 1
    return out


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up): the ancestor 1, 2, 4, ... steps up, until no node has one."""
    step = materialise(nodes.where("up is not null").select("tree", "node", "up"), "jump")
    out = []
    while len(out) < 40 and not step.isEmpty():  # 2 ** 40 turns: a cycle of parents
        out.append(step)
        far = step.select("tree", F.col("node").alias("up"), F.col("up").alias("farther"))
        step = materialise(step.join(far, ["tree", "up"]).select("tree", "node", F.col("farther").alias("up")), "jump")
    if len(out) == 40:
        raise ValueError("a reply tree has a cycle")
    return out


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, turns array<struct<pos,role,text>>): root-to-leaf paths, best first within each tree.

    messages: (tree, node, parent, role, text, score), nodes distinct within their tree. A parent that is null or not
    in the tree makes a root; null scores count as 0. Ties of the mean score go to the smaller leaf. top: the best so
    many paths of each tree (a feature of the ranking; None keeps all)."""
    here = messages.select("tree", "node", "parent")
    known = here.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    nodes = here.join(known, here.tree.eqNullSafe(known.t) & (here.parent == known.up), "left").select("tree", "node", "up")
    nodes = materialise(nodes, "nodes")
    parents = nodes.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = nodes.join(parents, nodes.tree.eqNullSafe(parents.t) & (nodes.node == parents.p), "left_anti")
    jumps = _jumps(nodes.where("tree is not null"))
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k, jump in reversed(list(enumerate(jumps))):
        more = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        path = materialise(path.unionByName(more), "path")
    full = path.join(messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = full.groupBy("tree", "leaf").agg(
        F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"),
        F.count("*").alias("depth"),
        F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("pos"), "role", "text"))).alias("turns"),
    )
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def format_branches(paths: DataFrame, loss_roles=LOSS_ROLES) -> DataFrame:
    """(tree, leaf, rank, formatted, loss array<struct<start,end>>) of each path."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            got = [format_turns([(t["role"], t["text"]) for t in turns], loss_roles) for turns in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([f for f, _ in got], pa.string()), pa.array([[{"start": x, "end": y} for x, y in m] for _, m in got], pa.list_(span))], names=["tree", "leaf", "rank", "formatted", "loss"])

    kinds = dict(paths.dtypes)
    return paths.select("tree", "leaf", "rank", "turns").mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, formatted string, loss array<struct<start:long,end:long>>")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Each conversation's rows by turn (ties by role and text, nulls first) as a tree of one branch: node is the position."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text").withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def op4_chat(spark, sf_dir):
    """Rows with a null conv_id form no conversation and are left out; repeated rows are turns of their own."""
    added = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", added), (-7, 1, "assistant", added)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    before = written()
    messages = materialise(linear_messages(rows.where("conv_id is not null")), "messages")
    formatted = format_branches(branches(messages))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            out = []
            for conv, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse_turns(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), digest(under), len(text)))
            yield batch(schema, *zip(*out, strict=True)) if out else batch(schema, *[[]] * 6)

    read_back = formatted.select("tree", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return finished(read_back, "conversations", before)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(r) + 1 + length(t) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
