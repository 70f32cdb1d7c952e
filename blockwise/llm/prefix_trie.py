"""Prefix trie of conversations by ROLLUP over positional turn columns.

A node of depth d is a distinct sequence of d turns (role and text); its members are the conversations that start with
it. A turn id is half of the SHA-256 of role and text; the text's code points go with it.

1. ``numbered``: turns are sorted by (conversation, turn, role, id) over range partitions and numbered in a streaming
   pass; a conversation that crosses partitions is continued by the rows that it has in earlier ones (at most one
   conversation a partition needs that), so a conversation of any length is spread over tasks.
2. ``blocks``: a row per conversation and ``WIDTH`` positions, with the turn ids as columns ``t0 ..``. A row is keyed by
   the prior block's node: a 128-bit digest of all turns before the block, which adds up over turns and so needs no
   order; it is made in two levels of windows of at most ``SPAN`` blocks.
3. ``nodes``: one ``GROUP BY ROLLUP (t0 ..)`` within (block, key) aggregates all prefixes of all blocks together;
   ``grouping_id`` tells how many columns a row still has, and thereby the depth.
4. Subtree sums need no walk over the tree. A conversation is the smallest member of the nodes on a lower part of its
   path, from the depth ``joins + 1`` on; the node of depth ``joins`` belongs to a smaller conversation (``host``). What a
   subtree saves is the sum over members, other than the smallest, of the code points they share from the subtree's top
   to ``joins``; its leaves are the leaves that its members are the smallest member of. A second ROLLUP adds up these
   numbers per member.
5. ``ends``: the conversations that end at a node, sorted over range partitions, are written in pieces and hashed in a
   stream, so that a node may be the end of any number of conversations.

Defined results: turns are ordered by turn (null first), role, then id; null role or text is empty; repeated rows are
repeated turns; rows without a conversation id belong to no conversation; a conversation may be turnless; an empty table
gives no rows (there is no conversation, so no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwise.llm.common import by_value, fixed, skew_left_join

by_value(__name__)

#: Turn columns of a block.
WIDTH = 8
#: Blocks of a conversation in one window.
SPAN = 1024
#: Conversation ids in a written piece.
PIECE = 10_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, id, chars`` of each row that has a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    written = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(F.unhex(F.sha2(written, 256)), 1, 16).alias("id"), F.char_length(text).cast("long").alias("chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, id, chars``: the position from 0 of each turn in its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = np.asarray(batch.column(0))
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            pos = np.arange(n) - begin
            pos[: n if new.sum() == 0 else int(np.argmax(new))] += held
            last, held = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pos), batch.column(2), batch.column(3)], names=["conv_id", "part", "pos", "id", "chars"])

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "id"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().cast("long").alias("part"), "id", "chars")
    counted = fixed(placed.mapInArrow(run, "conv_id long, part long, pos long, id binary, chars long"), "trie-turns")
    # Rows in earlier partitions: only for the first conversation of a partition, so at most a row for each.
    whole = counted.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    cut = whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = whole.join(cut, "conv_id").withColumn("before", F.sum("rows").over(before)).where("before is not null").drop("rows")
    return counted.join(F.broadcast(crossing), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "chars")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: rows ``conv_id, pos, id, chars``, and ``conv_id, length`` of all of them.

    Conversation c gets the first h turns of conversation ``c - c % every``, then its own turns after its first h, with
    ``h = crc32(c) % heads``. ``turns`` are numbered.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    lengths = fixed(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every), "trie-lengths")
    first = turns.where(F.col("pos") < heads - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("first"))
    heads_of = lengths.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array())
    plan = fixed(heads_of.select("conv_id", "own", "h", taken.alias("taken")), "trie-heads")
    borrowed = plan.select("conv_id", F.inline("taken")).select("conv_id", "pos", "id", "chars")
    shift = plan.select("conv_id", "h", (F.size("taken") - F.col("h")).alias("shift"))
    own = skew_left_join(turns, shift, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id", "chars")
    length = plan.select("conv_id", (F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return borrowed.unionByName(own), length


def _turn(i: int) -> Column:
    return F.col(f"t{i}")


def _chars(n: Column | int, width: int) -> Column:
    """Code points of the first ``n`` turns of a block."""
    return reduce(lambda a, b: a + b, [F.when(F.lit(i) < n, F.coalesce(_turn(i)["chars"], F.lit(0))).otherwise(0) for i in range(width)]).cast("long")


def blocks(turns: DataFrame, lengths: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """``conv_id, block, k1, k2, before, length, t0 ..``: key and code points of what precedes the block."""
    slot = F.pmod("pos", F.lit(width))
    turn = F.struct("id", "chars")
    digest = [F.xxhash64(F.lit(seed), F.col("pos"), F.col("id")) for seed in (17, 71)]
    sums = [F.bit_xor(digest[0]).alias("x1"), F.bit_xor(digest[1]).alias("x2"), F.sum("chars").alias("c")]
    columns = [F.max(F.when(slot == i, turn)).alias(f"t{i}") for i in range(width)]
    rows = fixed(turns.groupBy("conv_id", F.floor(F.col("pos") / width).alias("block")).agg(*columns, *sums), "trie-blocks")
    long = rows.where("block > 0").select("conv_id").distinct()
    totals = rows.join(long, "conv_id", "left_semi").select("conv_id", "block", F.floor(F.col("block") / span).alias("s"), "x1", "x2", "c")
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0))
    above = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.groupBy("conv_id", "s").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("c").alias("c"))
    spans = spans.select("conv_id", "s", xor("x1", above).alias("a1"), xor("x2", above).alias("a2"), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("ac"))
    here = totals.select("conv_id", "block", "s", xor("x1", within).alias("b1"), xor("x2", within).alias("b2"), F.coalesce(F.sum("c").over(within), F.lit(0)).alias("bc"))
    keys = here.join(spans, ["conv_id", "s"]).select("conv_id", "block", F.col("a1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("a2").bitwiseXOR(F.col("b2")).alias("k2"), (F.col("ac") + F.col("bc")).alias("before"))
    names = [f"t{i}" for i in range(width)]
    later = rows.where("block > 0").join(keys, ["conv_id", "block"]).select("conv_id", "block", "k1", "k2", "before", *names)
    # Every conversation has a first block, turnless ones an empty one.
    zero = [F.lit(0).cast("long").alias(c) for c in ("block", "k1", "k2", "before")]
    first = lengths.select("conv_id").join(rows.where("block = 0").drop("block"), "conv_id", "left").select("conv_id", *zero, *names)
    return skew_left_join(first.unionByName(later), lengths, "conv_id")


def rolled(rows: DataFrame, *measures: str, width: int = WIDTH) -> DataFrame:
    """All prefixes of all blocks with ``measures``, as ``block, k1, k2, before, t0 .., depth``; ``kept`` columns of a row are its own.

    A prefix of no column is the prior block's node and is left out, except for the root.
    """
    names = [f"t{i}" for i in range(width)]
    # grouping_id has a bit for each rolled-up column, the lowest for the last one.
    kept = " + ".join(f"if(g & {1 << (width - 1 - i)} = 0, 1, 0)" for i in range(width))
    there = " or ".join(f"kept = {i + 1} and t{i} is not null" for i in range(width))
    query = f"""
        select *, block * {width} + kept as depth from (select *, {kept} as kept from (
            select block, k1, k2, before, {", ".join(names)}, grouping_id() as g, {", ".join(measures)}
            from {{rows}} group by block, k1, k2, before, rollup ({", ".join(names)})))
        where {there} or kept = 0 and block = 0"""
    return rows.sparkSession.sql(query, rows=rows)


def _place(depth: Column, width: int) -> Column:
    """128 bits of a node: of its block's key and the block's columns up to the depth."""
    seen = [F.when(F.lit(i) < depth, _turn(i)["id"]) for i in range(width)]
    return F.concat(*[F.hex(F.xxhash64(F.lit(seed), F.col("block"), F.col("k1"), F.col("k2"), depth, *seen)) for seed in (1, 2)]).alias("place")


def ends(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of the nodes (``conv_id, depth``) at which conversations ``end`` end."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, piece):
                conv, depth, end = (np.asarray(c) for c in batch.slice(a, piece).columns)
                cut = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])]))
                written = [",".join(map(str, x)) for x in np.split(end, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(conv[cut]), pa.array(depth[cut]), pa.array(end[cut]), pa.array(written, pa.string())], names=["conv_id", "depth", "first", "written"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, written in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if node == (conv, depth):
                    state.update(b"," + written.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(written.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    order = ["conv_id", "depth", "end"]
    written = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, first long, written string")
    by_node = written.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").select("conv_id", "depth", "written")
    return by_node.mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """The trie's nodes; ``turns``: ``conv_id, pos, id, chars``, ``lengths``: ``conv_id, length`` (0 too).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node; a node is
    named by its smallest member and its depth.
    """
    rows = fixed(blocks(turns, lengths, width, span), "trie-rows")
    found = rolled(rows, "min(conv_id) as owner", "max(length) as longest", width=width)
    nodes = fixed(found.select("owner", "depth", "longest", _place(F.col("kept"), width)), "trie-nodes")
    # Where each conversation's own nodes begin, and whether its last node is a leaf of its own.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("begin"), F.max(F.when(F.col("depth") == F.col("longest"), 1).otherwise(0)).alias("leaf"))
    convs = lengths.join(owned, "conv_id", "left")
    convs = convs.select("conv_id", "length", F.coalesce(F.col("begin") - 1, "length").alias("joins"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    # The node of depth ``joins`` on its path, in the block that has it: its owner is the host.
    at = F.greatest(F.floor((F.col("joins") - 1) / width), F.lit(0))
    met = convs.where("joins >= 0").withColumn("block", at).join(rows.drop("length"), ["conv_id", "block"])
    here = (F.col("joins") - F.col("block") * width).cast("int")
    met = fixed(met.select("conv_id", (F.col("before") + _chars(here, width)).alias("shared"), _place(here, width)), "trie-met")
    hosts = skew_left_join(met, nodes.select("place", F.col("owner").alias("host")), "place").select("conv_id", "host", "shared")
    convs = fixed(convs.join(hosts, "conv_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0))), "trie-convs")

    carried = skew_left_join(rows.drop("length"), convs.select("conv_id", "shared", "leaf"), "conv_id")
    summed = rolled(carried, "min(conv_id) as conv_id", "count(*) as n_convs", "sum(shared) as all_shared", "sum(leaf) as n_leaves", width=width)
    above = (F.col("before") + _chars(F.col("kept") - 1, width)).alias("above")
    sums = fixed(summed.select("conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", "all_shared", "n_leaves", above), "trie-sums")
    # Children: the owner's own next node, and those of conversations that leave the owner's path here.
    leaving = convs.where("length > joins and joins >= 0").groupBy(F.col("host").alias("conv_id"), F.col("joins").alias("depth")).agg(F.count(F.lit(1)).alias("leaving"))
    ending = ends(convs.select(F.when(F.col("joins") == F.col("length"), F.col("host")).otherwise(F.col("conv_id")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("end")))
    out = skew_left_join(sums, convs.drop("leaf"), "conv_id").join(leaving, ["conv_id", "depth"], "left").join(ending, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("joins") == F.col("depth") - 1, F.col("host")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("leaving", F.lit(0)) + F.when(F.col("length") > F.col("depth"), 1).otherwise(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("all_shared") - F.col("shared") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, every: int | None = None, heads: int = 6, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``); with ``every``, of rebuilt ones (see ``rebuilt``)."""
    turns = fixed(numbered(turns_of(conversations)), "trie-numbered")
    if every:
        turns, lengths = rebuilt(turns, every, heads)
    else:
        lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return trie(turns, fixed(lengths, "trie-lengths"), width, span)
