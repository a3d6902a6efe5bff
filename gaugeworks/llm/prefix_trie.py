"""A prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are put in order and numbered by a range sort: each task numbers its own stretch and hands the count and
the hash of its last conversation on, so a conversation of any length is dealt over many tasks. The hash of a
prefix is a polynomial over the digests of its turns, so stretches of it can be put together. Equal prefixes are
one node.

Totals of subtrees come from tree contraction. Every round rakes the leaves, whose totals are then known and
added to their parents, and compresses the chains of nodes with one child: pointer jumping in join rounds gives
every node of a chain the sum down to the chain's end, and the node below is linked to the one above the chain.
After each round every node but the root has at least two children or is a leaf, so the leaves at least halve.
At last the chains are expanded again, in reverse order, from the totals of the nodes below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHARED = 9  # the first turns of a rebuilt conversation come from another: fewer than so many,
FAMILY = 5  # from the conversation at the last multiple of this
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B
PIECE = 4096  # ids of one text to digest
BLOCK = 8192  # nodes of a chain that are expanded by one copy of the node below it


def ordered(turns: DataFrame) -> DataFrame:
    """``conv, i, digest, bytes`` of every turn of a conversation, numbered from 0 by turn (null first), role and text.

    Null roles and texts are empty; rows without a conversation are left out.
    """
    cols = [F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).select(cols)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    return _numbered(rows.select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")))


def _numbered(rows: DataFrame, hashed: bool = False) -> DataFrame:
    """Number the turns of each conversation (``i``) of sorted rows ``conv, digest, bytes``; with the hash of each
    prefix (``hash``) and of the one before it (``above``, null for the first) if ``hashed``.

    Only a conversation that goes on from another task needs what stands before: one for each task at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, h = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            out, numbers = [], []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != last:
                    last, n, h = conv, 0, 0
                above = h
                if hashed:
                    h = (h * BASE + int.from_bytes(digest, "big")) % PRIME
                numbers.append(n)
                out.append((h.to_bytes(16, "big"), above.to_bytes(16, "big")) if hashed else (digest, None))
                n += 1
            hashes, aboves = zip(*out, strict=True) if out else ((), ())
            columns = [batch.column(0), pa.array([part] * len(out), pa.int32()), pa.array(numbers, pa.int64()), pa.array(hashes, pa.binary()), pa.array(aboves, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "at", "hash", "above", "bytes"])

    local = stored(rows.mapInArrow(run, "conv long, part int, at long, hash binary, above binary, bytes long"))
    ends = local.groupBy("conv", "part").agg(F.max("at").alias("at"), F.max_by("hash", "at").alias("hash"))
    # A conversation of several tasks: rows here are at most twice the tasks, and those of one conversation at most the tasks.
    spread = local.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("conv")
    before = ends.join(spread, "conv").groupBy("conv").applyInPandas(_before, "conv long, part int, n_before long, h_before binary")
    rows = local.join(F.broadcast(before), ["conv", "part"], "left").withColumn("i", F.col("at") + F.coalesce("n_before", F.lit(0)))
    if not hashed:
        return rows.select("conv", "i", F.col("hash").alias("digest"), "bytes")
    plain = rows.filter("h_before IS NULL").select("conv", "i", "hash", "above", "bytes")
    moved = rows.filter("h_before IS NOT NULL").select("conv", "i", "at", "hash", "above", "h_before", "bytes").mapInArrow(_carried, "conv long, i long, hash binary, above binary, bytes long")
    return plain.union(moved)


def _before(group: pd.DataFrame) -> pd.DataFrame:
    """What stands of a conversation before each of its stretches but the first: number of turns and their hash."""
    group, out, n, h = group.sort_values("part"), [], 0, 0
    for conv, part, at, own in zip(group["conv"], group["part"], group["at"], group["hash"], strict=True):
        if n:
            out.append((conv, part, n, h.to_bytes(16, "big")))
        n, h = n + at + 1, (h * pow(BASE, at + 1, PRIME) + int.from_bytes(own, "big")) % PRIME
    return pd.DataFrame(out, columns=["conv", "part", "n_before", "h_before"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of rows of a stretch, with the turns before the stretch."""
    for batch in batches:
        hashes, aboves = [], []
        for at, own, above, before in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            shifted = int.from_bytes(before, "big") * pow(BASE, at, PRIME)
            aboves.append(((shifted + int.from_bytes(above, "big")) % PRIME).to_bytes(16, "big"))
            hashes.append(((shifted * BASE + int.from_bytes(own, "big")) % PRIME).to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(aboves, pa.binary()), batch.column(6)], ["conv", "i", "hash", "above", "bytes"])


def shared_turns(conv: Column) -> Column:
    """How many of the first turns of a conversation come from the first of its family."""
    return (F.crc32(conv.cast("string")) % SHARED).cast("long")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, d, hash, above, bytes`` of every turn of the rebuilt conversations; ``d`` counts from 1.

    The turns are those of ``ordered``. A conversation's own turns after its first h follow the first h of the
    first of its family, for every h of its own.
    """
    own = turns.filter(F.col("i") >= shared_turns(F.col("conv"))).select("conv", F.lit(1).alias("branch"), "i", "digest", "bytes")
    first = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("i") < SHARED - 1))
    reach = F.sequence(F.coalesce(F.try_subtract("conv", F.lit(FAMILY - 1)), "conv"), F.coalesce(F.try_add("conv", F.lit(FAMILY - 1)), "conv"))
    member = F.explode(reach).alias("member")
    lent = first.select(member, F.lit(0).alias("branch"), "i", "digest", "bytes", "conv")
    lent = lent.filter((F.col("member") - F.col("member") % FAMILY == F.col("conv")) & (F.col("i") < shared_turns(F.col("member"))))
    lent = lent.join(convs.select(F.col("conv").alias("member")), "member", "left_semi").select(F.col("member").alias("conv"), "branch", "i", "digest", "bytes")
    order = ["conv", "branch", "i"]
    rows = own.union(lent).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes")
    return _numbered(rows, hashed=True).select("conv", (F.col("i") + 1).alias("d"), "hash", F.when(F.col("i") > 0, F.col("above")).alias("above"), "bytes")


def id_digests(ends: DataFrame) -> DataFrame:
    """``d, hash, ends_sha256``: the SHA-256 of the sorted ids ``conv`` of each node of ``ends``, joined by commas.

    Ids are sorted by range and joined to texts of up to PIECE ids where they lie. A digest has to be taken in
    one go, so the texts of a node go through one task, one after another; no more than one is held.
    """
    order = ["d", "hash", "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, last = [], None
            for d, key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, key) != last or len(out[-1][4]) >= PIECE:
                    last = (d, key)
                    out.append((d, key, part, no, []))
                    no += 1
                out[-1][4].append(str(conv))
            rows = [(*x[:4], ",".join(x[4])) for x in out]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["d", "hash", "part", "no", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.binary(), pa.string()), strict=True)], ["d", "hash", "ends_sha256"])

        last, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for d, key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if (d, key) == last:
                    state.update(b",")
                else:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = (d, key), hashlib.sha256()
                state.update(ids.encode())
            yield batch_of(out)
        yield batch_of([(*last, state.hexdigest())] if last else [])

    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "d long, hash binary, part int, no long, ids string")
    return joined.repartition("d", "hash").sortWithinPartitions("d", "hash", "part", "no").mapInArrow(digests, "d long, hash binary, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, bytes, ends_sha256``; a node is told by its first two.

    ``turns`` is the table of ``rebuilt``, ``convs`` all conversations (``conv``).
    """
    merged = turns.groupBy("d", "hash").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.any_value("above").alias("above"), F.any_value("bytes").alias("bytes"))
    last = turns.groupBy("conv").agg(F.max("d").alias("d"), F.max_by("hash", "d").alias("hash"))
    # The root is the node of depth 0 with an empty hash.
    every = convs.join(last, "conv", "left").select("conv", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("hash", F.lit(b"")).alias("hash"))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("d"), F.lit(b"").alias("hash"), "conv", "n_convs", F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("bytes"))
    merged = stored(merged.withColumn("above", F.coalesce("above", F.lit(b""))).union(root))
    kids = merged.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("above").alias("hash")).agg(F.count("*").alias("n_children"))
    known = merged.join(kids, ["d", "hash"], "left").join(id_digests(every), ["d", "hash"], "left")
    # The root's children can be any share of all nodes and need no join.
    least = root.select(F.col("conv").alias("root_conv"))
    upper = merged.filter("d > 0").select((F.col("d") + 1).alias("d"), F.col("hash").alias("above"), F.col("conv").alias("upper_conv"))
    known = known.join(upper, ["d", "above"], "left").join(F.broadcast(least), F.col("d") == 1, "left")
    none = F.sha2(F.lit(b""), 256)
    return known.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("upper_conv", "root_conv").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


SUMS = ["leaves", "saved"]


def _plus(a: str, b: str) -> list[Column]:
    return [(F.col(f"{a}{s}") + F.col(f"{b}{s}")).alias(f"{a}{s}") for s in SUMS]


def _chains(links: DataFrame) -> DataFrame:
    """For every ``v`` of ``links`` (``v, ptr, leaves, saved``) the first node ``ptr`` on its way that is no ``v``, the
    sums up to there, and their number ``n``: pointer jumping, a chain of length n takes log2 n joins.
    """
    known = links.select(F.col("v").alias("ptr"), F.lit(True).alias("more"))
    all_rows = stored(links.withColumn("n", F.lit(1).cast("long")).join(known, "ptr", "left").select("v", "ptr", *SUMS, "n", F.coalesce("more", F.lit(False)).alias("more")))
    done = [all_rows.filter("NOT more")]
    going = all_rows.filter("more")
    while not going.isEmpty():
        # Only pointers to nodes that jump go on, and each is met once: no key is hot.
        there = all_rows.select(F.col("v").alias("ptr"), F.col("ptr").alias("to"), *[F.col(s).alias(f"to_{s}") for s in SUMS], F.col("n").alias("to_n"), F.col("more").alias("to_more"))
        jumped = going.join(there, "ptr")
        jumped = stored(jumped.select("v", F.col("to").alias("ptr"), *[(F.col(s) + F.col(f"to_{s}")).alias(s) for s in SUMS], (F.col("n") + F.col("to_n")).alias("n"), F.col("to_more").alias("more")))
        done.append(jumped.filter("NOT more"))
        going = jumped.filter("more")
        all_rows = reduce(DataFrame.union, [*done, going])
    return reduce(DataFrame.union, done).select("v", "ptr", *SUMS, "n")


def subtree_sums(tree: DataFrame) -> DataFrame:
    """``node, leaves, saved`` of every node of ``tree`` (``node, parent, k, leaves, saved``): both summed over its subtree.

    ``parent`` is null for the root, ``k`` the number of children. An edge has sums of its own (``e_``), those of
    the nodes that were taken out between its ends.
    """
    live = stored(tree.select("node", "parent", "k", *SUMS, *[F.lit(0).cast("long").alias(f"e_{s}") for s in SUMS]))
    known, rounds = [live.filter("k = 0").select("node", *SUMS)], []
    while not live.filter("parent IS NOT NULL").isEmpty():
        # Rake: leaves go, their sums and those of their edges are added to their parents.
        leaf, below = F.col("k") == 0, live.filter("parent IS NOT NULL")
        gains = [F.sum(F.when(leaf, F.col(s) + F.col(f"e_{s}")).otherwise(0)).alias(f"g_{s}") for s in SUMS]
        edge = [F.sum(F.when(leaf, 0).otherwise(F.col(f"e_{s}"))).alias(f"o_{s}") for s in SUMS]
        met = below.groupBy("parent").agg(F.count_if(~leaf).alias("rest"), F.min(F.when(~leaf, F.col("node"))).alias("only"), *gains, *edge).withColumnRenamed("parent", "node")
        raked = live.filter("k > 0").join(met, "node").select("node", "parent", F.col("rest").alias("k"), "only", *[(F.col(s) + F.col(f"g_{s}")).alias(s) for s in SUMS], *[f"e_{s}" for s in SUMS], *[f"o_{s}" for s in SUMS])
        raked = stored(raked)
        # Compress: nodes with one child go, and the child below a chain is linked to the node above it.
        unary = (F.col("k") == 1) & F.col("parent").isNotNull()
        links = raked.filter(unary).select(F.col("node").alias("v"), F.col("only").alias("ptr"), *[(F.col(s) + F.col(f"o_{s}")).alias(s) for s in SUMS])
        rest = raked.filter(~unary).select("node", "parent", "k", *SUMS, *[f"e_{s}" for s in SUMS])
        if links.isEmpty():
            live = rest
        else:
            chains = _chains(links)
            tops = raked.filter(unary).join(links.select(F.col("ptr").alias("node")), "node", "left_anti").select(F.col("node").alias("v"), "parent", *[f"e_{s}" for s in SUMS])
            ends = stored(chains.join(tops, "v").select(F.col("ptr").alias("node"), F.col("parent").alias("up"), *[(F.col(s) + F.col(f"e_{s}")).alias(f"n_{s}") for s in SUMS], "n"))
            rounds.append((chains, ends.select("node", "n")))
            linked = rest.join(ends.drop("n"), "node", "left")
            live = stored(linked.select("node", F.coalesce("up", "parent").alias("parent"), "k", *SUMS, *[F.coalesce(f"n_{s}", f"e_{s}").alias(f"e_{s}") for s in SUMS]))
        known.append(live.filter("k = 0").select("node", *SUMS))
    totals = reduce(DataFrame.union, known)
    # Expand: a node of a chain has the sum along the chain and the total of the node below it.
    for chains, ends in reversed(rounds):
        block = F.explode(F.sequence(F.lit(0), (F.col("n") / BLOCK).cast("int"))).alias("block")
        below = totals.join(ends, "node").select(F.col("node").alias("ptr"), *[F.col(s).alias(f"b_{s}") for s in SUMS], block)
        found = chains.withColumn("block", (F.col("n") / BLOCK).cast("int")).join(below, ["ptr", "block"])
        totals = totals.union(stored(found.select(F.col("v").alias("node"), *[(F.col(s) + F.col(f"b_{s}")).alias(s) for s in SUMS])))
    return totals


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (``conv_id, turn, role, text``), a row for each node:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by turn, null first, equal ones by role and text; repeated rows are turns of their own. A
    null role or text is empty; rows without a conv_id are left out. A very long text is held only where it is
    sorted and digested. A conversation without turns of its own left ends at the root. An empty table has no
    conversations and gives no node; other columns are ignored.
    """
    turns = stored(ordered(conversations))
    convs = stored(turns.select("conv").distinct())
    found = stored(nodes(stored(rebuilt(turns, convs)), convs))
    node = F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d"))
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d")))
    own = (F.col("n_convs") - 1) * F.col("bytes")
    tree = found.select(node.alias("node"), parent.alias("parent"), F.col("n_children").alias("k"), (F.col("n_children") == 0).cast("long").alias("leaves"), own.alias("saved"))
    sums = subtree_sums(tree).select(F.col("node.c").alias("conv_id"), F.col("node.d").alias("depth"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return found.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
