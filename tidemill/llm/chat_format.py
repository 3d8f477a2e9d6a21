r"""Chat formatting by a prefix tree (operator 3).

Conversations that share their first turns share the nodes of a tree: a node stands for a
turn after all the turns before it, named by a digest of that chain.  Each node's formatted
turn is emitted once, in depth-first order over all trees, with the position id of its first
token (tokens are code points), the intervals of the emitted stream that it attends to: those of
its ancestors, joined where they touch; and the interval under the loss mask: the text of an
assistant's turn, without role, marks and end.

A turn is ``### Role: text</turn>\n``; a backslash, ``###`` and ``</turn>`` inside a role or a
text, and a colon inside a role, get a backslash in front, so control strings stand only
where the template put them and the texts can be read back.

Depth-first order is the order of the chains of digests; it is made by a range partitioning,
sums inside the partitions and one number per partition, so a tree may be of any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

START, COLON, END = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"\\|###|</turn>")
_ROLE_ESCAPED = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>\n))*)</turn>\n")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")
#: Bytes of a node's digest in the tree, and in the sort path.
DIGEST = 16

TURNS = "conv_id bigint, k int, node string, path string, role string, segment string, size int, position bigint, loss_from int, loss_to int"
#: The role whose texts are learned.
LEARNED = "assistant"


def formatted(role: str, text: str) -> str:
    return START + _ROLE_ESCAPED.sub(r"\\\g<0>", role) + COLON + _ESCAPED.sub(r"\\\g<0>", text) + END


def read_turns(stream: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(stream):
        m = _TURN.match(stream, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_BACK.sub(r"\1", m[1]), _BACK.sub(r"\1", m[2])))
        at = m.end()
    return out


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TURNS.split(", ")]
    for batch in batches:
        rows: dict[str, list] = {x: [] for x in names}
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            digest, path, position = b"", "", 0
            for k, turn in enumerate(turns):
                role, text = turn["role"], turn["text"]
                key = hashlib.blake2b(digest_size=DIGEST)
                for part in (digest, role.encode(), text.encode()):
                    key.update(len(part).to_bytes(8, "little") + part)
                digest = key.digest()
                path += digest.hex()
                segment = formatted(role, text)
                end = len(segment) - len(END)
                start = end - len(_ESCAPED.sub(r"\\\g<0>", text)) if role == LEARNED else end
                for name, value in zip(names, (conv, k, digest.hex(), path, role, segment, len(segment), position, start, end), strict=True):
                    rows[name].append(value)
                position += len(segment)
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types, strict=True)], names=names)


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        starts = []
        for size in batch.column("size").to_pylist():
            starts.append(start)
            start += size
        columns = [batch.column(c) for c in NODE]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64())], names=[*NODE, "part", "start"])


NODE = ("node", "tree", "role", "segment", "size", "position", "loss_from", "loss_to")
LAID = "node string, tree string, role string, segment string, size int, position bigint, loss_from int, loss_to int, part int, start bigint"


def chained(conversations: DataFrame) -> DataFrame:
    """One row per turn with its node: conv_id, k, node, path, role, segment, size, position."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_conv = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return by_conv.mapInArrow(_chain, TURNS)


def emitted(turns: DataFrame) -> DataFrame:
    """One row per node of chained()'s rows: node, tree, role, segment, size, position, loss_from, loss_to, start (in the stream of all trees)."""
    first = [F.first(c).alias(c) for c in ("path", "role", "segment", "size", "position", "loss_from", "loss_to")]
    nodes = turns.groupBy("node").agg(*first).withColumn("tree", F.substring("path", 1, 2 * DIGEST))
    laid = C.cut(nodes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_laid, LAID))
    sizes = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("size").alias("n")).collect()}  # a number per partition
    base, bases = 0, []
    for part in sorted(sizes):
        bases.append((part, base))
        base += sizes[part]
    before = turns.sparkSession.createDataFrame(bases, "part int, base bigint")
    return laid.join(F.broadcast(before), "part").select(*NODE, (F.col("start") + F.col("base")).alias("start"))


ATTENTION = "node string, attends array<struct<start: bigint, stop: bigint>>"


def _attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        nodes, lists = [], []
        for own in batch.column("own").to_pylist():
            before: list[dict] = []
            for x in own:
                nodes.append(x["node"])
                lists.append([dict(y) for y in before])
                stop = x["start"] + x["size"]
                if before and before[-1]["stop"] == x["start"]:
                    before[-1]["stop"] = stop
                else:
                    before.append({"start": x["start"], "stop": stop})
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(lists, kind)], names=["node", "attends"])


def packed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with attends and the loss interval, and conv_id, node of the conversations' paths, of chained()'s rows."""
    nodes = emitted(turns)
    paths = turns.select("conv_id", "node")
    own = paths.join(nodes.select("node", "start", "size"), "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "size", "node"))).alias("own"))
    attention = own.mapInArrow(_attended, ATTENTION).groupBy("node").agg(F.first("attends").alias("attends"))
    loss = F.when(F.col("loss_from") < F.col("loss_to"), F.struct((F.col("start") + F.col("loss_from")).alias("start"), (F.col("start") + F.col("loss_to")).alias("stop")))
    return nodes.join(attention, "node").withColumn("in_loss", F.col("role") == LEARNED).withColumn("loss", loss).drop("loss_from", "loss_to"), paths


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """The packed output, a row per node: node, tree, role, segment, size, position, start, attends, in_loss, loss.

    conversations has conv_id, turn, role, text.  Turns are ordered by turn, then role and
    text; a null role or text is empty; rows without a conv_id are one conversation; repeated
    conversations share all nodes; a very long text is one node; the sort key of a node grows
    with its depth; an empty table gives an empty one; other columns are ignored.  Tokens of a
    node attend to attends and to what precedes them in the node; loss is the interval of the
    stream whose tokens are learned (null for none).
    """
    return packed(chained(conversations).persist(StorageLevel.MEMORY_AND_DISK))[0]


READ = "conv_id bigint, formatted_chars bigint, loss_text string, turns array<struct<role: string, text: string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        texts, learned = [], []
        for own in batch.column("own").to_pylist():
            # the last node sees its own tokens and what it attends to: that is the conversation
            leaf = own[-1]
            seen = [(x["start"], x["stop"]) for x in leaf["attends"]] + [(leaf["start"], leaf["start"] + leaf["size"])]
            row = [x for x in own if any(a <= x["start"] and x["start"] + x["size"] <= b for a, b in seen)]
            at = 0
            for x in row:
                if x["position"] != at:
                    raise ValueError(f"position {x['position']} in place of {at}")
                at += x["size"]
            if at != sum(b - a for a, b in seen):
                raise ValueError("attention and nodes differ")
            texts.append("".join(x["segment"] for x in row))
            masked = [x["segment"][x["loss"]["start"] - x["start"] : x["loss"]["stop"] - x["start"]] for x in row if x["loss"] is not None]
            learned.append("".join(_BACK.sub(r"\1", x) for x in masked))
        turns = [[{"role": r, "text": t} for r, t in read_turns(x)] for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(learned, pa.string()), pa.array(turns, kind)], names=["conv_id", "formatted_chars", "loss_text", "turns"])


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, loss_text, turns (role, text) of each conversation, read from the packed output.

    A conversation is what its last node attends to, and that node, in order of position;
    loss_text is cut out of the stream by the loss intervals and unescaped.
    """
    nodes, paths = packed(chained(conversations).persist(StorageLevel.MEMORY_AND_DISK))
    read = F.struct("position", "start", "size", "segment", "loss", "attends")
    own = paths.join(nodes.select("node", "position", "start", "size", "segment", "loss", "attends"), "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(read)).alias("own"))
    return own.mapInArrow(_read, READ)


def digest(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: DuckDB SQL for the digest, with conversation -7 added.
DIGEST_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
  || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10) AS segment FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
