"""Chat formatting (operator 2): a prefix tree of conversations, laid out depth-first.

Every turn is rendered by a template with reversible escapes, and is a node of the tree, named by a hash
of all turns up to it, so that conversations share their initial turns. A depth-first layout emits each
node once. It needs no recursion: conversations in the order of their paths are in depth-first order,
and a node belongs to the first that has it. What a conversation owns is the tail of its path, one run
of the layout, called a segment; within it attention is causal, and before it reaches only the
ancestors, which are initial parts of other segments. So a segment carries its place, the position id
of its first token (later ones count up), and the intervals of the layout that its tokens attend to.

A conversation's turns are hashed in one pass over sorted rows, without gathering them. Paths are only
as long as what is shared. Ranks come from a range partitioning, places from sums per partition.
Tokens are code points here.

Cases: null text and null role are empty; a null conv_id is a conversation; turns are in order of turn,
role and text, null first; repeated rows are turns of their own; equal conversations share everything,
and each is read back; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What opens and closes a turn (fixed values); other roles are named in the opening.
ROLES = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<|", "|> ", " <|end|>")
_CONTROL = r"([<\[]){}(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|)"
_PLAIN, _ESCAPED = re.compile(_CONTROL.format("")), re.compile(_CONTROL.format(r"\\"))


def escape(text: str) -> str:
    """Control strings get a backslash after their first character, one more than they have."""
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string, and start and length of what the loss is taken on."""
    if role in ROLES:
        before, after = ROLES[role]
    else:
        before, after = OTHER[0] + quote(role, safe="") + OTHER[1], OTHER[2]
    body = escape(text)
    learnt = len(body) if role == "assistant" else 0
    return before + body + after, len(before) if learnt else 0, learnt


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted conversation; start and end are the body's."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            named = formatted.index(OTHER[1], at)
            role, after = unquote(formatted[at + len(OTHER[0]) : named]), OTHER[2]
            start = named + len(OTHER[1])
        else:
            role = next(r for r, (before, _) in ROLES.items() if formatted.startswith(before, at))
            before, after = ROLES[role]
            start = at + len(before)
        end = formatted.index(after, start)
        yield role, unescape(formatted[start:end]), start, end
        at = end + len(after)


TURNS = (
    "cid string, conv_id long, seq long, node string, part string, size long, position long, "
    "loss_start long, loss_size long"
)


def nodes(conversations: DataFrame) -> DataFrame:
    """A row per turn: its node, rendered part, and position in its conversation."""
    schema = pa.schema(
        [
            pa.field(n, pa.string() if t == "string" else pa.int64())
            for n, t in (x.split() for x in TURNS.split(", "))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, position, state = None, 0, 0, b""
        for batch in batches:
            out: list[tuple] = []
            for cid, conv, role, text in zip(
                *(batch.column(c).to_pylist() for c in ("cid", "conv_id", "role", "text"))
            ):
                if cid != now:
                    now, seq, position, state = cid, 0, 0, b""
                part, start, size = render(role, text)
                state = hashlib.blake2b(state + part.encode(), digest_size=16).digest()
                out.append((cid, conv, seq, state.hex(), part, len(part), position, start, size))
                seq += 1
                position += len(part)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )

    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("cid").sortWithinPartitions("cid", "turn", "role", "text")
    return rows.mapInArrow(run, TURNS)


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, paths) of conversations(conv_id, turn, role, text).

    segments: rank, start, position, text, losses (start and size within text), ancestors (intervals of
    the layout). paths: rank, conv_id, owner, size, step: a conversation is the initial `size` tokens of
    each owner's segment, by step.
    """
    turns, _ = cut(nodes(conversations), "turns")
    shared = turns.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(1).alias("s"))
    shared, _ = cut(shared, "shared")
    marked = turns.select("cid", "conv_id", "seq", "node").join(shared, "node", "left")
    # The path up to the first node that no other conversation has.
    keyed = marked.groupBy("cid", "conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("seq", "node")))).alias("with_others"),
        F.min(F.when(F.col("s").isNull(), F.struct("seq", "node"))).alias("alone"),
    )
    key = F.concat(F.array_join("with_others.node", ""), F.coalesce("alone.node", F.lit("")))
    order = keyed.select(key.alias("key"), "cid", "conv_id")
    ordered = order.repartitionByRange("key", "cid").sortWithinPartitions("key", "cid")
    ranks, _ = cut(ordered.select("cid", F.monotonically_increasing_id().alias("rank")), "ranks")

    ranked, _ = cut(turns.join(ranks, "cid"), "ranked")
    owners = ranked.join(shared, "node", "left_semi").groupBy("node").agg(F.min("rank").alias("owner"))
    owners, _ = cut(owners, "owners")
    owned = ranked.join(owners, "node", "left").withColumn("owner", F.coalesce("owner", "rank"))
    owned, _ = cut(owned, "owned")
    own = owned.where("owner = rank").groupBy("rank").agg(
        F.sum("size").alias("size"),
        F.min("position").alias("position"),
        F.sort_array(F.collect_list(F.struct("seq", "part", "loss_start", "loss_size", "position"))).alias("parts"),
    )
    own = own.select(
        "rank",
        "size",
        "position",
        F.array_join("parts.part", "").alias("text"),
        F.transform(
            F.filter("parts", lambda p: p["loss_size"] > 0),
            lambda p: F.struct(
                (p["position"] - F.col("position") + p["loss_start"]).alias("start"), p["loss_size"].alias("size")
            ),
        ).alias("losses"),
    )
    own, _ = cut(own, "segments")
    # Places: sums over the range partitions before, and within the own one.
    part = F.shiftright("rank", 33).alias("part")
    sums = own.select(part, "size").groupBy("part").agg(F.sum("size").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    places = own.select(part, "rank", "size").join(sums, "part")
    places = places.select(
        "rank", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start")
    )
    places, _ = cut(places, "places")
    paths = owned.groupBy("rank", "conv_id", "owner").agg(F.sum("size").alias("size"), F.min("seq").alias("step"))
    paths, _ = cut(paths, "paths")
    others = paths.where("owner != rank").join(places.withColumnRenamed("rank", "owner"), "owner")
    ancestors = others.groupBy("rank").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end")))
        ).alias("ancestors")
    )
    segments = own.join(places, "rank").join(ancestors, "rank", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    segments = segments.select(
        "rank", "start", "position", "text", "losses", F.coalesce("ancestors", none).alias("ancestors")
    )
    return segments, paths


def read_back(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_segments) from the
    tree's segments and each conversation's path through them."""
    segments, _ = cut(segments, "tree")
    pieces = paths.join(
        segments.select(F.col("rank").alias("owner"), "text", "losses"), "owner"
    )
    inside = F.filter("losses", lambda x: x["start"] + x["size"] <= F.col("size"))
    pieces = pieces.select(
        "rank",
        "conv_id",
        F.struct(
            "step", F.substring("text", F.lit(1), F.col("size").cast("int")).alias("text"), inside.alias("losses")
        ).alias("p"),
    )
    whole = pieces.groupBy("rank", "conv_id").agg(
        F.sort_array(F.collect_list("p")).alias("p"), F.count("*").alias("n_segments")
    )
    rows = whole.select("conv_id", "p.text", "p.losses", "n_segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, texts, losses, n in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "text", "losses", "n_segments"))
            ):
                formatted = "".join(texts)
                turns, learnt = hashlib.sha256(), []
                count = 0
                for role, text, _, _ in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    count += 1
                for text, spans in zip(texts, losses):
                    learnt += [unescape(text[x["start"] : x["start"] + x["size"]]) for x in spans]
                loss = "".join(learnt)
                out.append(
                    (
                        conv,
                        count,
                        turns.hexdigest(),
                        len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(),
                        len(formatted),
                        n,
                    )
                )
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_segments"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_segments long",
    )
