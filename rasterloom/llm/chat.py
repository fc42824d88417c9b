"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the tree nodes of these turns. A node's key is a digest of its
parent's key and its turn, so a key stands for a whole prefix. Sorted by their sequences of keys, leaves
are in depth-first order, and each leaf emits the nodes that no leaf before it has: one segment of the
stream. A segment's tokens attend to those before them in the segment and to the intervals of the stream
that hold its ancestors; position ids go on from the ancestors' tokens. A token is a code point, or, with a
tokenizer, one of the ids that it gives for a formatted turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import column, materialize, parallelism

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts bear loss.
LOSS_ROLE = "assistant"
#: In texts a backslash is doubled, and one is put after the first character of each control string.
_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _encoder(tokenizer: str | None):
    """A function from a formatted turn to its ids; None without a tokenizer."""
    if tokenizer is None:
        return None
    if tokenizer.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        return lambda s: tok.encode(s, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer).encode


def _turns(tokenizer: str | None):
    """Rows sorted by conversation and turn: the formatted turn and its node; with the last one, the path."""
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("size", pa.int64()), ("before", pa.int64()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        conv, key, depth, before, path = object(), b"", 0, 0, []
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for c, role, text, last in zip(*(column(batch, x).to_pylist() for x in ("conv_id", "role", "text", "last")), strict=True):
                if c != conv:
                    conv, key, depth, before, path = c, b"", 0, 0, []
                role, text = role or "", text or ""
                s = format_turn(role, text)
                ids = encode(s) if encode else None
                size = len(s if ids is None else ids)
                parent, key = key, hashlib.blake2b(key + s.encode(), digest_size=16).digest()
                path.append(key)
                for o, x in zip(out, (c, depth, key, parent, role, s, ids, size, before, b"".join(path) if last else None), strict=True):
                    o.append(x)
                depth, before = depth + 1, before + size
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return run


_TURNS = "conv bigint, depth int, node binary, parent binary, role string, formatted string, ids array<int>, size bigint, before bigint, path binary"


def conversation_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Formatted turns with node, parent, depth and tokens before; `path` (all nodes) in a conversation's last row.

    A conversation streams through one task in the order of (turn, role, text), nulls first, and only its 16-byte
    keys are held."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    last = F.lead(F.lit(1)).over(Window.partitionBy("conv_id").orderBy(*order[1:])).isNull()
    return rows.withColumn("last", last).select("conv_id", "role", "text", "last").mapInArrow(_turns(tokenizer), _TURNS)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([column(batch, "path"), pa.array(range(at, at + n), pa.int64())], names=["path", "leaf"])
        at += n


def prefix_tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The depth-first stream of shared turns.

    In: conversations(conv_id, turn, role, text, any more), and the path of a .json or .model tokenizer if
    places are to count its ids instead of code points; null roles and texts are empty, a null conv_id is
    one conversation, and rows that repeat (conv_id, turn) are turns of their own in the order of role, text.

    Out, as tables in the shared folder (nodes: such a table joined with a row for each range of leaves):
    segments: leaf (long, in depth-first order), start, end (places in the stream), position (of the first
      token; they go on by one, see position_ids), tokens (string), ids (array<int>, null without a
      tokenizer; each turn is encoded by itself), attention (array<struct<leaf, start, end>>: the ancestors' intervals, and whose
      segment each lies in);
    nodes: node, parent, depth, role, formatted, leaf (whose segment has it), start, end, position;
    leaves: leaf, node (last of its path), path;
    members: conv_id, node (last of its path), n_turns."""
    parts = parallelism(conversations.sparkSession)
    turns = materialize(conversation_turns(conversations, tokenizer))
    ends = turns.where("path IS NOT NULL")
    members = ends.select(F.col("conv").alias("conv_id"), "node", (F.col("depth") + 1).cast("bigint").alias("n_turns"))
    # Equal conversations are one leaf. Ranges of paths split trees, so a common first turn is no hot group.
    paths = ends.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path")
    leaves = materialize(paths.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_ranked, "path binary, leaf bigint"))
    leaves = leaves.withColumn("node", F.expr("substring(path, length(path) - 15, 16)"))
    steps = F.expr("transform(sequence(1, cast(length(path) as int), 16), (p, i) -> struct(i as depth, substring(path, p, 16) as node))")
    on_path = leaves.select("leaf", F.explode(steps).alias("x")).select("leaf", "x.depth", "x.node")
    owner = on_path.groupBy("node").agg(F.min("leaf").alias("leaf"))
    one = turns.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("formatted").alias("formatted"), F.first("ids").alias("ids"), F.first("size").alias("size"), F.first("before").alias("position"))
    # Places in the stream: running sums in each range of leaves, after the sums of the ranges before it. The texts
    # are written once, with the running sums; a row for each range is broadcast to what reads them.
    order = Window.partitionBy("part").orderBy("leaf", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = materialize(one.join(owner, "node").withColumn("part", F.shiftrightunsigned("leaf", 40)).withColumn("sum", F.sum("size").over(order)))
    sums = owned.groupBy("part").agg(F.sum("size").alias("size"))
    base = materialize(sums.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("base")))
    end = F.col("base") + F.col("sum")
    nodes = owned.join(F.broadcast(base), "part").select("node", "parent", "depth", "role", "formatted", "ids", "leaf", (end - F.col("size")).alias("start"), end.alias("end"), "position")
    segments = nodes.groupBy("leaf").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("position").alias("position"), F.sort_array(F.collect_list(F.struct("depth", "formatted", "ids"))).alias("parts"))
    ancestors = on_path.join(nodes.select("node", F.col("leaf").alias("owner"), "start", "end"), "node").where("owner <> leaf")
    spans = ancestors.groupBy("leaf", "owner").agg(F.min("start").alias("start"), F.max("end").alias("end"))  # a path meets a segment in one stretch
    attention = spans.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct(F.col("owner").alias("leaf"), "start", "end"))).alias("attention"))
    none = F.array().cast("array<struct<leaf:bigint,start:bigint,end:bigint>>")
    segments = segments.join(attention, "leaf", "left").select("leaf", "start", "end", "position", F.array_join("parts.formatted", "").alias("tokens"), F.flatten("parts.ids").alias("ids"), F.coalesce("attention", none).alias("attention"))
    return materialize(segments), nodes, leaves, members


def position_ids(segments: DataFrame) -> DataFrame:
    """segments with `position_ids` (array<bigint>): the position of each token."""
    last = F.col("position") + F.col("end") - F.col("start") - 1
    return segments.withColumn("position_ids", F.sequence("position", last))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a leaf's tokens in order, parsed turn by turn and digested; only an unfinished turn is held."""
    schema = pa.schema([("leaf", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    leaf = None

    def closed() -> tuple:
        if text:
            raise ValueError("a formatted conversation ends within a turn")
        return leaf, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for at, piece in zip(column(batch, "leaf").to_pylist(), column(batch, "piece").to_pylist(), strict=True):
            if at != leaf:
                if leaf is not None:
                    out.append(closed())
                leaf, turns, loss, loss_chars, chars, text = at, hashlib.sha256(), hashlib.sha256(), 0, 0, ""
            chars += len(piece)
            text += piece
            if text.endswith(CLOSE):
                for role, said in parse_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    if role == LOSS_ROLE:
                        loss.update(said.encode())
                        loss_chars += len(said)
                text = ""
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
    if leaf is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, closed(), strict=True))], schema=schema)


def read_conversations(segments: DataFrame, leaves: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the stream.

    The tree must have been made without a tokenizer. A leaf's tokens are what its attention intervals and its own segment hold, in order of place."""
    own = F.array(F.struct("leaf", "start", "end"))
    wanted = segments.select(F.col("leaf").alias("reader"), F.explode(F.concat("attention", own)).alias("x")).select("reader", "x.leaf", "x.start", "x.end")
    held = segments.select("leaf", F.col("start").alias("origin"), "tokens")
    pieces = wanted.join(held, "leaf").select(F.col("reader").alias("leaf"), "start", F.expr("substring(tokens, cast(start - origin + 1 as int), cast(end - start as int))").alias("piece"))
    pieces = pieces.repartition(parallelism(segments.sparkSession), "leaf").sortWithinPartitions("leaf", "start").select("leaf", "piece")
    read = pieces.mapInArrow(_read_back, "leaf bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return members.join(leaves.select("leaf", "node").join(read, "leaf"), "node").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
