"""Conversation prefix trie: which conversations share which opening turns, by digests of fixed-length blocks of turns.

Method. A turn is two 64-bit digests of its place, role and text; texts go no further. ``BLOCK`` turns in a row are a block, and a
block is known by the digests of all turns up to its end, put together by exclusive or, so that running values of
conversations of any length are cut into chunks and carried on. Conversations are grouped by their successive blocks first: a group of
copies is one row a block from there on, however large it is. A block that is the only one after its predecessor has the
same conversations at each of its turn boundaries, so these nodes follow from it as they are. Only where blocks with the same predecessor
diverge are their turn boundaries grouped, to find the turn up to which siblings agree.

Sums over subtrees need no walk through the levels. Each node belongs to its smallest conversation, which owns every node from some depth
on to its end; the nodes below a node are those that the conversations through it own further down. What a
conversation owns after a block is a running sum along its blocks; it is added up per group of blocks, and the nodes owned
inside a block are added at its turn boundaries. The number of jobs does not depend on the depth.

The ids of the conversations that end at a node are sorted by range, joined in pieces of ``PIECE`` ids by many tasks, and the pieces go
through SHA-256 as a stream, so a node at which a third of all conversations end holds neither a task's memory nor its time.

Edge cases. Null roles and texts count as empty. Turns are ordered by turn (nulls first), then by role and by the digest of
the text; repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left
out. Conversations without turns end at the root. An empty table has no root and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import ordering
from latticework.session import attach, materialize

BLOCK = 4
#: Blocks of one conversation that one window runs over.
CHUNK = 1 << 12
#: Conversation ids in one piece of a list.
PIECE = 1 << 12
NODE = ("depth", "d1", "d2")


def digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, g1, g2, words`` of every turn: its place from 0, digests of role and text, and words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("g1"),
        F.xxhash64(F.lit(2), role, text).alias("g2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ranked = ordering.rank_in_group(rows, ["conv_id"], [(c, True) for c in ("turn", "role", "g1", "g2")], "place")
    return ranked.select("conv_id", (F.col("place") - 1).alias("place"), "g1", "g2", "words")


def _earlier(rows: DataFrame, totals: dict[str, tuple], last_first: bool = False) -> DataFrame:
    """``{name: (aggregate, column)}`` over the earlier blocks of each conversation; over the later ones with ``last_first``.

    Chunks of blocks are totalled first, so that one conversation of any length goes through many tasks.
    """
    along = (lambda c: F.col(c).desc()) if last_first else F.col
    chunked = rows.withColumn("_chunk", F.floor(F.col("block") / CHUNK))
    of_chunks = chunked.groupBy("conv_id", "_chunk").agg(*[total(column).alias(f"_{name}") for name, (total, column) in totals.items()])
    before = Window.partitionBy("conv_id").orderBy(along("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = of_chunks.select("conv_id", "_chunk", *[total(f"_{name}").over(before).alias(f"_before_{name}") for name, (total, _) in totals.items()])
    carried = carried.filter(F.coalesce(*[F.col(f"_before_{name}") for name in totals]).isNotNull())
    here = Window.partitionBy("conv_id", "_chunk").orderBy(along("block")).rowsBetween(Window.unboundedPreceding, -1)
    ran = attach(chunked.withColumns({name: total(column).over(here) for name, (total, column) in totals.items()}), carried, ["conv_id", "_chunk"])

    def both(name: str, total) -> Column:
        near, far = F.coalesce(name, F.lit(0)), F.coalesce(f"_before_{name}", F.lit(0))
        return near.bitwiseXOR(far) if total is F.bit_xor else near + far

    return ran.withColumns({name: both(name, total) for name, (total, _) in totals.items()}).drop("_chunk", *[f"_before_{name}" for name in totals])


def _slots(block: int, *names: str) -> list[str]:
    return [f"{name}_{j}" for j in range(block) for name in names]


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation and block: its turns side by side (``h1_j, h2_j, w_j``), how many, and the digests of all turns before and up to its end."""
    placed = turns.select(
        "conv_id", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).alias("slot"),
        F.xxhash64("g1", "place").alias("h1"), F.xxhash64("g2", "place").alias("h2"), F.col("words").alias("w"),
    )
    side = [F.max(F.when(F.col("slot") == j, F.col(name))).alias(f"{name}_{j}") for j in range(block) for name in ("h1", "h2", "w")]
    rows = materialize(placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), *side))
    ran = _earlier(rows, {"in1": (F.bit_xor, "x1"), "in2": (F.bit_xor, "x2")})
    out = {"p1": F.col("in1").bitwiseXOR(F.col("x1")), "p2": F.col("in2").bitwiseXOR(F.col("x2"))}
    return materialize(ran.withColumns(out).drop("x1", "x2"))


def _boundaries(block: int, more: dict[str, list[Column]]) -> Column:
    """An array with one struct per turn of a block: its node, the node before it, the words of its text, and columns of ``more`` by slot."""
    out, d1, d2 = [], F.col("in1"), F.col("in2")
    for j in range(block):
        q1, q2 = d1, d2
        d1, d2 = d1.bitwiseXOR(F.col(f"h1_{j}")), d2.bitwiseXOR(F.col(f"h2_{j}"))
        entry = F.struct(
            (F.col("block") * block + j + 1).alias("depth"), d1.alias("d1"), d2.alias("d2"), q1.alias("q1"), q2.alias("q2"), F.col(f"w_{j}").alias("words"),
            F.lit(j).alias("slot"), *[columns[j].alias(name) for name, columns in more.items()],
        )
        out.append(F.when(F.col("n") > j, entry))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def grouped_blocks(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct block with its predecessor: conversations through it, the smallest of them, and whether siblings ``diverge``."""
    path = ["block", "in1", "in2", "p1", "p2"]
    same = blocks.groupBy(*path).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in _slots(block, "h1", "h2", "w")]
    )
    same = materialize(same)
    only = same.groupBy("block", "in1", "in2").agg(F.count(F.lit(1)).alias("_many"), F.min("p1").alias("p1"), F.min("p2").alias("p2")).filter("_many = 1")
    alone = only.select("block", "p1", "p2", F.lit(False).alias("_diverge"))  # joined on its own digests: both sides are unique
    return materialize(same.join(alone, ["block", "p1", "p2"], "left").withColumn("diverge", F.coalesce("_diverge", F.lit(True))).drop("_diverge"))


def _nodes(groups: DataFrame, block: int, more: dict[str, list[Column]]) -> DataFrame:
    """The nodes of all blocks; turn boundaries of blocks without siblings as they are, those of diverging siblings grouped."""
    each = groups.select("diverge", "n_convs", "owner", F.explode(_boundaries(block, more)).alias("_e")).select("diverge", "n_convs", "owner", "_e.*").drop("slot")
    kept = [*NODE, "q1", "q2", "words", "n_convs", "owner", *more]
    refined = each.filter("diverge").groupBy(*NODE).agg(
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"),
        *[F.sum(name).alias(name) for name in more],
    )
    return each.filter("not diverge").select(*kept).unionByName(refined.select(*kept))


def end_lists(ends: DataFrame) -> DataFrame:
    """Per node of ``ends (conv_id, depth, d1, d2)``: the SHA-256 of its ids, ascending and joined by commas."""
    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 4 + [pa.string()])], names=[*NODE, "first", "ids"])

    def join_pieces(batches):
        now, ids, found = None, [], []
        for *node, conv in rows(batches):
            if node != now or len(ids) >= PIECE:
                if ids:
                    found.append((*now, ids[0], ",".join(map(str, ids))))
                now, ids = node, []
                if len(found) >= 1000:
                    yield batch(found)
                    found = []
            ids.append(conv)
        if ids:
            yield batch([*found, (*now, ids[0], ",".join(map(str, ids)))])

    def hash_pieces(batches):
        now, digest, found = None, None, []
        for *node, _, ids in rows(batches):
            if node == now:
                digest.update(f",{ids}".encode())
                continue
            if now is not None:
                found.append((*now, 0, digest.hexdigest()))
            now, digest = node, hashlib.sha256(ids.encode())
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        if now is not None:
            yield batch([*found, (*now, 0, digest.hexdigest())])

    pieces = ranged.mapInArrow(join_pieces, "depth long, d1 long, d2 long, first long, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(hash_pieces, "depth long, d1 long, d2 long, first long, ids string").select(*NODE, F.col("ids").alias("ends_sha256"))


def build(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns (conv_id, place, g1, g2, words)``; ``conversations (conv_id)`` names all, those without turns too.

    ``conv_id`` is the smallest conversation through the node; the columns after the contract's are the node's digests.
    """
    blocks = blocks_of(turns, block)
    groups = grouped_blocks(blocks, block)
    lengths = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    last = blocks.join(lengths, ["conv_id", "block"]).select("conv_id", (F.col("block") * block + F.col("n")).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    zero = F.lit(0).cast("long")
    ends = materialize(conversations.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE]))
    ended = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_ends"))

    inner = _nodes(groups, block, {})
    root = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*NODE, "q1", "q2", "words")], "n_convs", "owner")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = root.unionByName(inner).join(ended, list(NODE), "left").join(children, list(NODE), "left").na.fill(0, ["n_ends", "n_children"])
    nodes = materialize(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}))

    owned = nodes.filter("depth > 0").withColumns({"block": F.floor((F.col("depth") - 1) / block), "slot": (F.col("depth") - 1) % block})
    by_slot = [F.sum(F.when(F.col("slot") == j, F.col(name))).alias(f"{name}_{j}") for j in range(block) for name in ("leaf", "saved")]
    owned = materialize(owned.groupBy(F.col("owner").alias("conv_id"), "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), *by_slot))
    owners = blocks.select("conv_id", "block", "in1", "in2", "p1", "p2").join(owned.select("conv_id").distinct(), "conv_id", "left_semi")
    later = _earlier(
        owners.join(owned.select("conv_id", "block", "leaf", "saved"), ["conv_id", "block"], "left").na.fill(0, ["leaf", "saved"]),
        {"later_leaf": (F.sum, "leaf"), "later_saved": (F.sum, "saved")}, last_first=True,
    )
    below = later.groupBy("block", "p1", "p2").agg(F.sum("later_leaf").alias("later_leaf"), F.sum("later_saved").alias("later_saved"))
    full = groups.join(below, ["block", "p1", "p2"], "left").join(
        owned.drop("leaf", "saved").withColumnRenamed("conv_id", "owner"), ["owner", "block"], "left"
    ).na.fill(0, ["later_leaf", "later_saved", *_slots(block, "leaf", "saved")])

    def onwards(name: str) -> list[Column]:
        out = [F.col(f"later_{name}")] * block
        for j in reversed(range(block)):
            out[j] = (out[j + 1] if j + 1 < block else F.col(f"later_{name}")) + F.col(f"{name}_{j}")
        return out

    sums = _nodes(full, block, {"n_leaves": onwards("leaf"), "saved_tokens": onwards("saved")}).select(*NODE, "n_leaves", "saved_tokens")
    whole = nodes.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).filter("n_leaves > 0")
    sums = sums.unionByName(whole.select(*[zero.alias(c) for c in NODE], "n_leaves", "saved_tokens"))

    top = nodes.filter("depth = 0").select(F.col("owner").alias("_top"))
    above = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("owner").alias("_above"))
    named = nodes.join(sums, list(NODE)).join(end_lists(ends), list(NODE), "left").join(above, ["depth", "q1", "q2"], "left").join(F.broadcast(top))  # top: one row
    parent = F.when(F.col("depth") == 1, F.col("_top")).when(F.col("depth") > 1, F.col("_above"))
    return named.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def replant(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` in which each conversation begins with the first turns of its group's first one, and goes on with its own.

    The first of a group has an id divisible by ``group``; how many turns (up to ``most``) are taken follows from the CRC-32 of the id.
    """
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("taken")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    first = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first_id"), F.col("size").alias("first_size"))
    all_of = sizes.select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % group).alias("first_id")).join(first, "first_id", "left")
    all_of = materialize(all_of.select("conv_id", "first_id", "taken", F.least("taken", F.coalesce("first_size", F.lit(0))).alias("given")))
    own = turns.join(all_of.select("conv_id", "taken", "given"), "conv_id").filter("place >= taken").withColumn("place", F.col("place") - F.col("taken") + F.col("given"))
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "first_id")
    given = heads.join(all_of.select("conv_id", "first_id", "given"), "first_id").filter("place < given")
    columns = ["conv_id", "place", "g1", "g2", "words"]
    return own.select(*columns).unionByName(given.select(*columns)), all_of.select("conv_id")
