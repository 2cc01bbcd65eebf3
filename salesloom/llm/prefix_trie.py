"""Conversation prefix trie, built as a burst trie.

A node is a distinct sequence of first turns. A box is a head, the node that all its sequences go on from, with the suffixes of
those sequences. All sequences begin in the box of the root. A box that holds too many bytes bursts: what its suffixes
share becomes a chain of nodes, and every suffix that goes on falls to a new box by its next turn. When all boxes are
small each is sorted and swept once, which gives its nodes with the sums of their subtrees. The sums of bursted boxes are put
together from their children's, last burst first.

Equal sequences are one row from the start, with how many there are, so copies never fill a box. A sequence longer than
STRETCH turns is cut: what follows hangs under the node where it was cut, as a box of its own, and is
worked off before the stretch above it. So no row, box or task holds a whole long conversation or a whole large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.arrow import Collector, map_arrow
from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

BOX_BYTES = 256 << 10
STRETCH = 1024  # turns of a sequence in one row
_ID = 16  # bytes of a turn id
ROOT = hashlib.md5(b"root").digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_id, size: turns in order of turn (null first), then role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), role.alias("role"), text.alias("text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    narrow = rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(said.cast("binary"))).alias("turn_id"), F.length("text").cast("long").alias("size"), "role", "text"
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return narrow.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "turn_id", "size")


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, place, turn_id, size: conversation c takes the first crc32(c) % ``heads`` turns of c - c % ``group`` and then its own turns
    after as many. A conversation without any turn left has one row with a null turn_id; places have no gaps only in order."""
    own = materialize(numbered(conversations))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    conv = own.where("place = 1").select("conv_id", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = own.where(F.col("conv_id") % group == 0).where(F.col("place") < heads)
    base = base.select(F.col("conv_id").alias("base"), "place", "turn_id", "size")
    put = conv.join(base, "base").where(F.col("place") <= F.col("taken")).select("conv_id", "place", "turn_id", "size")
    rest = own.where(F.col("place") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    none = conv.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("size"))
    # place 0 stands for the conversation itself: one without turns is still a member of the root
    return put.unionByName(rest.select("conv_id", "place", "turn_id", "size")).unionByName(none)


def _stretches(turns: DataFrame, stretch: int) -> DataFrame:
    """conv_id, level, head, end, seq, sizes, last: the sequence of each conversation in stretches. ``head`` and ``end`` are digests
    of all turns up to its beginning and its end. One pass over rows in order, which holds one stretch."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("level", pa.int32()), ("head", pa.binary()), ("end", pa.binary()), ("seq", pa.binary()), ("sizes", pa.list_(pa.int64())), ("last", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        conv, level, head, ids, sizes = None, 0, ROOT, [], []

        def closed(last: bool) -> tuple:
            seq = b"".join(ids)
            return conv, level, head, hashlib.md5(head + seq).digest() if ids else head, seq, sizes, last

        for batch in batches:
            for c, turn_id, size in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn_id", "size"))):
                if c != conv:
                    if conv is not None and out.add(closed(True), 24 * len(ids) + 96):
                        yield out.take()
                    conv, level, head, ids, sizes = c, 0, ROOT, [], []
                if turn_id is None:
                    continue
                if len(ids) == stretch:
                    row = closed(False)
                    if out.add(row, 24 * len(ids) + 96):
                        yield out.take()
                    level, head, ids, sizes = level + 1, row[3], [], []
                ids.append(turn_id)
                sizes.append(size)
        if conv is not None:
            out.add(closed(True))
        yield out.take()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kinds = "conv_id long, level int, head binary, end binary, seq binary, sizes array<bigint>, last boolean"
    return map_arrow(ordered.select("conv_id", "turn_id", "size"), run, kinds)


def _ends(stretches: DataFrame) -> DataFrame:
    """end, ends_sha256: of the conversations that end at a node, in order of their ids as they stream by."""
    schema = pa.schema([("end", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, digest = Collector(schema), None, None
        for batch in batches:
            for end, conv in zip(*(batch[n].to_pylist() for n in ("end", "conv_id"))):
                if end == node:
                    digest.update(b",%d" % conv)
                    continue
                if node is not None and out.add((node, digest.hexdigest())):
                    yield out.take()
                node, digest = end, hashlib.sha256(b"%d" % conv)
        if node is not None:
            out.add((node, digest.hexdigest()))
        yield out.take()

    at = stretches.where("last").select("end", "conv_id").repartition("end").sortWithinPartitions("end", "conv_id")
    return map_arrow(at, run, "end binary, ends_sha256 string")


_NODES = [
    ("conv_id", pa.int64(), "long"),
    ("depth", pa.int64(), "long"),
    ("parent_conv_id", pa.int64(), "long"),
    ("n_convs", pa.int64(), "long"),
    ("n_children", pa.int64(), "long"),
    ("n_leaves", pa.int64(), "long"),
    ("saved_tokens", pa.int64(), "long"),
    ("end", pa.binary(), "binary"),
    ("box", pa.binary(), "binary"),  # of a box's top node only
]
_NODE_SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in _NODES)


def sweep(rows: list[tuple]) -> list[list]:
    """Nodes of one box from its rows (box, depth, top_size, parent, seq, sizes, n, low, end, kids, leaves, saved) in order of seq. ``seq`` goes on from
    the box's top node; kids, leaves and saved belong to what hangs below a row's last node. A null ``top_size`` marks the
    top of a stretch: it is a node of the stretch above, whose least member is ``parent``."""
    box, depth, top_size, parent = rows[0][:4]

    def node(at: int, size: int) -> list:
        # conv, depth, parent, n, children, leaves, saved, end, box; the text's size and the place of the parent at the end
        return [None, at, None, 0, 0, 0, 0, None, None, size]

    done: list[list] = []
    path = [node(depth, top_size or 0)]
    path[0][8] = box
    if top_size is None:
        path[0][0] = parent
    before = b""

    def close() -> None:
        last = path.pop()
        if not last[4]:
            last[5] = 1
        last[6] += (last[3] - 1) * last[9]
        done.append(last)
        if path:
            above = path[-1]
            above[0] = last[0] if above[0] is None else min(above[0], last[0])
            above[3] += last[3]
            above[4] += 1
            above[5] += last[5]
            above[6] += last[6]
            last[2] = above  # its least member is known when it is closed

    for _, _, _, _, seq, sizes, n, low, end, kids, leaves, saved in rows:
        same, most = 0, min(len(seq), len(before))
        while same < most and seq[same : same + _ID] == before[same : same + _ID]:
            same += _ID
        while len(path) > same // _ID + 1:
            close()
        for i in range(same // _ID, len(seq) // _ID):
            path.append(node(depth + i + 1, sizes[i]))
        at = path[-1]
        at[0] = low if at[0] is None else min(at[0], low)
        at[3] += n
        at[4] += kids
        at[5] += leaves
        at[6] += saved
        at[7] = end
        before = seq
    while path:
        close()
    for one in done:
        one[2] = one[2][0] if one[2] else parent
        del one[9:]
    return done


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of all boxes; a box's rows are gathered, which BOX_BYTES bounds."""
    schema = pa.schema([(name, kind) for name, kind, _ in _NODES])
    columns = ["box", "depth", "top_size", "parent", "seq", "sizes", "n", "low", "end", "kids", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Collector(schema), []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                if held and held[0][0] != row[0]:
                    for node in sweep(held):
                        if out.add(tuple(node), 128):
                            yield out.take()
                    held = []
                held.append(row)
        for node in sweep(held) if held else ():
            if out.add(tuple(node), 128):
                yield out.take()
        yield out.take()

    ordered = rows.select(*columns).repartition("box").sortWithinPartitions("box", "seq")
    return map_arrow(ordered, run, _NODE_SCHEMA)


def _common(one: Column, two: Column) -> Column:
    """How many turns two sequences begin with alike."""
    nth = lambda s, i: F.substring(s, i * _ID + 1, F.lit(_ID))
    both = F.least(F.octet_length(one), F.octet_length(two)) / _ID
    places = F.filter(F.sequence(F.lit(0), both.cast("int")), lambda i: ~((i < both) & (nth(one, i) == nth(two, i))))
    return F.array_min(places)


def _tail(seq: Column, turns: Column) -> Column:
    return F.substring(seq, turns * _ID + 1, F.octet_length(seq))


def _level(rows: DataFrame, box_bytes: int) -> DataFrame:
    """Nodes of the boxes in ``rows`` (the columns of `sweep`), each row a distinct sequence of its box."""
    spark = rows.sparkSession
    sums: list[tuple[DataFrame, int]] = []
    small: list[DataFrame] = []
    while True:
        weight = F.octet_length("seq") + 8 * F.size("sizes") + 96
        sizes = rows.groupBy("box").agg(F.sum(weight).alias("bytes"), F.count("*").alias("rows"))
        large = materialize(sizes.where((F.col("bytes") > box_bytes) & (F.col("rows") > 1)).select("box"))
        n_large = large.count()
        if not n_large:
            small.append(rows)
            break
        few = broadcast_up_to(large, n_large)
        small.append(rows.join(few, "box", "left_anti"))
        held = rows.join(few, "box")
        # the first and the last sequence share what all share
        edges = held.groupBy("box").agg(
            F.min("seq").alias("first"), F.max("seq").alias("last"), F.min_by("sizes", "seq").alias("chain"),
            F.first("depth").alias("depth"), F.first("top_size").alias("top_size"), F.first("parent").alias("parent"),
            F.sum("n").alias("n"), F.min("low").alias("low"),
        )
        common = _common(F.col("first"), F.col("last"))
        burst = edges.withColumn("common", common).withColumn("chain", F.slice("chain", 1, F.col("common"))).drop("first", "last")
        burst = materialize(burst)
        # the least member of the node that the box's top stands for, and of the one its children hang from
        least = F.when(F.col("top_size").isNull(), F.col("parent")).otherwise(F.col("low"))
        info = burst.select("box", "common", F.when(F.col("common") == 0, least).otherwise(F.col("low")).alias("box_low"))
        met = held.join(broadcast_up_to(info, n_large), "box")
        over = F.octet_length("seq") > F.col("common") * _ID
        next_id = F.substring("seq", F.col("common") * _ID + 1, F.lit(_ID))
        dealt = met.select(
            F.col("box").alias("above"), F.when(over, F.unhex(F.md5(F.concat("box", next_id)))).alias("box"),
            (F.col("depth") + F.col("common") + over.cast("int")).alias("depth"),
            F.when(over, F.element_at("sizes", F.col("common") + 1)).otherwise(F.lit(0).cast("long")).alias("top_size"),
            F.col("box_low").alias("parent"),
            _tail(F.col("seq"), F.col("common") + 1).alias("seq"),
            F.slice("sizes", F.col("common") + 2, F.greatest(F.size("sizes"), F.lit(1))).alias("sizes"),
            "n", "low", "end", "kids", "leaves", "saved",
        )
        dealt = materialize(dealt)
        sums.append((burst, dealt))
        rows = dealt.where("box IS NOT NULL").drop("above")

    todo = small[0]
    for more in small[1:]:
        todo = todo.unionByName(more)
    nodes = materialize(_swept(todo))
    done = [nodes]
    tops = nodes.where("box IS NOT NULL").select("box", "n_leaves", "saved_tokens")
    for burst, dealt in reversed(sums):
        below = dealt.where("box IS NOT NULL").select("above", "box").distinct().join(tops, "box")
        children = below.groupBy("above").agg(
            F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        ).withColumnRenamed("above", "box")
        # the one sequence that ends where the others part
        own = dealt.where("box IS NULL").select(
            F.col("above").alias("box"), "end", *(F.col(c).alias(f"own_{c}") for c in ("kids", "leaves", "saved"))
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        met = burst.join(children, "box").join(own, "box", "left")
        met = met.select(
            "box", "depth", "parent", "n", "low", "common", "end",
            F.col("top_size").alias("top"), F.concat(F.array(F.coalesce("top_size", F.lit(0).cast("long"))), "chain").alias("texts"),
            *((zero(c) + zero(f"own_{c}")).alias(c) for c in ("kids", "leaves", "saved")),
        )
        each = met.select("*", F.explode(F.sequence(F.lit(0), F.col("common"))).alias("i"))
        here = F.slice("texts", F.col("i") + 1, F.col("common") - F.col("i") + 1)
        shared = F.aggregate(here, F.lit(0).cast("long"), lambda total, x: total + x) * (F.col("n") - 1)
        deepest = F.col("i") == F.col("common")
        made = materialize(
            each.select(
                F.col("low").alias("conv_id"),
                (F.col("depth") + F.col("i")).cast("long").alias("depth"),
                F.when((F.col("i") == 0) | ((F.col("i") == 1) & F.col("top").isNull()), F.col("parent"))
                .otherwise(F.col("low"))
                .alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(deepest, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                (F.col("saved") + shared).alias("saved_tokens"),
                F.when(deepest, F.col("end")).alias("end"),
                F.when(F.col("i") == 0, F.col("box")).alias("box"),
            )
        )
        done.append(made)
        tops = tops.unionByName(made.where("box IS NOT NULL").select("box", "n_leaves", "saved_tokens"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def trie(turns: DataFrame, stretch: int = STRETCH, box_bytes: int = BOX_BYTES) -> DataFrame:
    """One row for each node of the trie over ``turns`` (see `rebuilt`).

    conv_id (least member), depth (0: the root), parent_conv_id (the parent's conv_id; root: null), n_convs (members), n_children, n_leaves
    (childless nodes of its subtree), saved_tokens (over its subtree, members but one times the size of a node's last turn),
    ends_sha256 (of the ids of the conversations that end there, ascending, with commas).

    Turns with equal role and text are one turn; repeated rows of a conversation are turns of their own, in any of their orders. Rows without
    a conv_id take no part. Null roles and texts are empty, other columns are ignored, and no conversations give no rows.
    """
    pieces = materialize(_stretches(turns, stretch))
    ends = materialize(_ends(pieces))
    each = pieces.groupBy("level", "head", "end").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max("last").alias("ended"),
        F.first("seq").alias("seq"), F.first("sizes").alias("sizes"),
    )
    each = materialize(each)
    deepest = each.agg(F.max("level")).first()[0]
    whole, below = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = each.where(F.col("level") == level)
        zero = F.lit(0).cast("long")
        if below is None:
            here = here.withColumns({"kids": zero, "leaves": zero, "saved": zero})
        else:
            hung = below.select(F.col("box").alias("end"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            here = here.join(hung, "end", "left").fillna(0, ["kids", "leaves", "saved"])
        if level:
            # the least member of the node a stretch hangs from
            above = each.where(F.col("level") == level - 1).select(F.col("end").alias("head"), F.col("low").alias("parent"))
            here = here.join(above, "head")
        else:
            here = here.withColumn("parent", F.lit(None).cast("long"))
        rows = here.select(
            F.col("head").alias("box"), F.lit(level * stretch).cast("long").alias("depth"),
            (F.lit(None).cast("long") if level else zero).alias("top_size"), "parent",
            "seq", "sizes", "n", "low", F.when(F.col("ended"), F.col("end")).alias("end"), "kids", "leaves", "saved",
        )
        nodes = _level(materialize(rows), box_bytes)
        if level:
            # the head itself is a node of the stretch above
            below = materialize(nodes.where(F.col("depth") == level * stretch))
            nodes = nodes.where(F.col("depth") > level * stretch)
        whole = nodes if whole is None else whole.unionByName(nodes)
    if whole is None:
        return turns.sparkSession.createDataFrame([], _RESULT)
    named = whole.join(ends, "end", "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


_RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
