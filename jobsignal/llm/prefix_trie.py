"""Prefix trie of conversations by Spark SQL's ROLLUP over positional columns of turn ids.

A conversation is cut in blocks of WIDTH turns, a row each with a turn's id in each column; ROLLUP over the columns,
grouped by the block's place and by the node that the blocks before lead to, aggregates all prefixes together, and
grouping_id tells their depths. A node is known by an order-aware exclusive-or of its turns' hashes, so blocks need no
round each: the node before a block is the exclusive-or over the blocks before it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import joined_sha256, numbered
from .shared import written

#: Turns in a block, and blocks whose running sums one window takes; longer conversations add those of whole spans.
WIDTH, SPAN = 8, 1024
_KEY = ["depth", "p1", "p2"]
#: Turns of a prefix that conversations may share by ``shared_openings``: GROUP ids share one, MODULUS - 1 turns at most.
GROUP, MODULUS = 5, 9


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, a, b): each turn's role and text as 96 bits of hash and the text's bytes in UTF-8. Null
    roles and texts are empty ones; rows without a conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    b = F.shiftleft(F.octet_length(text).cast("long"), 32).bitwiseOR(F.xxhash64(F.lit(1), text, role).bitwiseAND(0xFFFFFFFF))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), b.alias("b"))


def _size(b: Column) -> Column:
    return F.shiftright(b, 32)


def _mark(pos: Column, a: Column, b: Column, which: int) -> Column:
    """What a turn at a position adds to the hash of its node."""
    return F.xxhash64(pos.cast("long"), a, b) if which == 1 else F.xxhash64(a, F.lit(2), b, pos.cast("long"))


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b) of turn_ids in order of (turn, role, hash), null turns first."""
    t = numbered(turns, "conv_id", [F.col("turn"), F.col("role"), F.col("a"), F.col("b")])
    return t.select("conv_id", F.col("_pos").alias("pos"), "a", "b")


def shared_openings(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): conversation c opens with the first h turns of c - c % GROUP, as far as there are any, and
    goes on with its own after its first h; h is the CRC-32 of c in decimal modulo MODULUS. A conversation that is left
    without turns has one row with a null pos."""
    heads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < MODULUS - 1, F.struct("pos", "a", "b")))).alias("heads"))
    heads = written(heads, "openings")
    base = heads.select(F.col("conv_id").alias("base"), F.col("heads").alias("opening"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MODULUS
    convs = heads.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")).join(base.hint("merge"), "base", "left")
    convs = written(convs.withColumn("opening", F.expr("slice(coalesce(opening, array()), 1, cast(h AS int))")), "rebuilt")
    own = turns.join(convs.select("conv_id", "h", F.size("opening").alias("taken")).hint("merge"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b")
    first = convs.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.pos", "t.a", "t.b")
    none = convs.where("n <= h AND size(opening) = 0").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("pos", "a", "b")))
    return own.unionByName(first).unionByName(none)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, k1, k2, before, a0, b0, ..., marks and bytes of the block) of turns (conv_id, pos, a, b): k1, k2
    are the node that the blocks before lead to, before is their texts' bytes."""
    i = F.coalesce(F.col("pos") % WIDTH, F.lit(0))
    block = F.coalesce(F.floor(F.col("pos") / WIDTH), F.lit(0)).alias("block")
    t = turns.select("conv_id", "pos", "a", "b", i.alias("i"), block).withColumn("span", F.floor(F.col("block") / SPAN)).repartition("conv_id", "span")
    columns = [F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c}{k}") for k in range(WIDTH) for c in "ab"]
    sums = [F.bit_xor(F.when(F.col("pos").isNotNull(), _mark(F.col("pos"), F.col("a"), F.col("b"), w))).alias(f"z{w}") for w in (1, 2)]
    g = t.groupBy("conv_id", "span", "block").agg(*columns, *sums, F.sum(_size(F.col("b"))).alias("bytes"), F.count("pos").alias("turns"))
    g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("z1", "z2", "bytes")})

    def running(w) -> list[Column]:
        return [F.coalesce(F.bit_xor("z1").over(w), F.lit(0)), F.coalesce(F.bit_xor("z2").over(w), F.lit(0)), F.coalesce(F.sum("bytes").over(w), F.lit(0))]

    near = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    g = written(g.withColumns(dict(zip(("n1", "n2", "n3"), running(near)))), "blocks")
    spans = g.groupBy("conv_id", "span").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("bytes").alias("bytes"))
    far = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", *(c.alias(n) for c, n in zip(running(far), ("f1", "f2", "f3")))).where("span > 0")
    zero = F.lit(0).cast("long")
    g = g.join(spans.hint("merge"), ["conv_id", "span"], "left")
    k1, k2 = (F.col(f"n{w}").bitwiseXOR(F.coalesce(f"f{w}", zero)).alias(f"k{w}") for w in (1, 2))
    return written(g.select("conv_id", "block", k1, k2, (F.col("n3") + F.coalesce("f3", zero)).alias("before"), *[f"{c}{k}" for k in range(WIDTH) for c in "ab"], "z1", "z2", "bytes", "turns"), "keyed-blocks")


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """(depth, p1, p2, and of nodes below the root last, the bytes of their last text, q1 and q2, their parent, and start,
    the bytes before the last text) with the measures, summed over the conversations that begin with each node."""
    pairs = ", ".join(f"(a{k}, b{k})" for k in range(WIDTH))
    columns = ", ".join(f"a{k}, b{k}" for k in range(WIDTH))
    filled = " + ".join(f"int(a{k} IS NOT NULL)" for k in range(WIDTH))
    # columns that are rolled up are null, as are those after a conversation's end: only full prefixes are nodes
    g = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {columns}, {WIDTH} - cast(bit_count(grouping_id()) / 2 AS int) AS d, min(before) AS before, {measures} FROM {{t}} GROUP BY block, k1, k2, ROLLUP({pairs}) "
        f"HAVING {filled} = {WIDTH} - cast(bit_count(grouping_id()) / 2 AS int) AND ({filled} > 0 OR block = 0)",
        t=blocks,
    )
    first = F.col("block") * WIDTH
    marks = {w: [F.when(F.col(f"a{k}").isNotNull(), _mark(first + k, F.col(f"a{k}"), F.col(f"b{k}"), w)).otherwise(0) for k in range(WIDTH)] for w in (1, 2)}
    xor = lambda xs: reduce(lambda x, y: x.bitwiseXOR(y), xs)
    sizes = [F.coalesce(_size(F.col(f"b{k}")), F.lit(0).cast("long")) for k in range(WIDTH)]
    last = F.coalesce(_size(F.element_at(F.array(*(F.col(f"b{k}") for k in range(WIDTH))), F.greatest("d", F.lit(1)))), F.lit(0).cast("long"))
    g = g.withColumns({"p1": F.col("k1").bitwiseXOR(xor(marks[1])), "p2": F.col("k2").bitwiseXOR(xor(marks[2])), "last": last})
    g = g.withColumns({f"q{w}": F.col(f"p{w}").bitwiseXOR(F.element_at(F.array(*marks[w]), F.greatest("d", F.lit(1)))) for w in (1, 2)})
    start = F.col("before") + reduce(lambda x, y: x + y, sizes) - F.col("last")
    return g.withColumn("depth", (first + F.col("d")).cast("long")).withColumn("start", start).drop("block", "k1", "k2", "d", "before", *[f"{c}{k}" for k in range(WIDTH) for c in "ab"])


def trie(turns: DataFrame) -> DataFrame:
    """turns(conv_id, pos, a, b) -> a row for each distinct sequence of first turns, the root's without any included.

    conv_id is the smallest conversation that begins so, parent_conv_id that of the node above; n_convs, n_children and
    n_leaves are counts, saved_tokens what sharing saves in the node's subtree, ends_sha256 the digest of the ids that
    end there. A conversation owns the nodes whose smallest one it is, which are the last ones of its path; so sums over
    a subtree are sums over its conversations, and no pass per depth is needed. An empty table has no node. Equal
    conversations share all nodes; very long ones take a row a block. Turn ids of 96 bits and nodes of 128 stand for
    texts.
    """
    blocks = _blocks(turns)
    nodes = written(_rollup(blocks.drop("z1", "z2", "bytes", "turns"), "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    family = nodes.join(below.hint("merge"), _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # the root's children are left out of this join: all hold its key, and its conversation is the smallest of all
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("_root"))
    family = family.join(above.where("depth > 1").hint("merge"), ["depth", "q1", "q2"], "left").join(F.broadcast(root), F.col("depth") == 1, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_root")).drop("_root", "q1", "q2")
    family = written(family, "family")

    owned = family.groupBy("conv_id").agg(F.sum("last").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    ends = blocks.select("conv_id", (F.col("block") * WIDTH + F.col("turns")).alias("depth"), F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), (F.col("before") + F.col("bytes")).alias("total"))
    packed = ends.groupBy("conv_id").agg(F.max("depth").alias("depth"), *(F.max_by(c, "depth").alias(c) for c in ("p1", "p2", "total")))
    ends = written(packed.join(owned.hint("merge"), "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("own", "leaf")}).withColumn("id", F.col("conv_id").cast("string")), "ends")
    parts = blocks.drop("z1", "z2", "bytes", "turns").join(ends.select("conv_id", "total", "own", "leaf").hint("merge"), "conv_id")
    sums = _rollup(parts, "sum(total) AS total, sum(own) AS own, sum(leaf) AS n_leaves, min_by(own, conv_id) AS own1, min_by(total, conv_id) AS total1").select(*_KEY, "total", "own", "n_leaves", "own1", "total1")
    sha = joined_sha256(ends, _KEY, ["conv_id"], "id", ",").withColumnRenamed("sha256", "ends_sha256")
    out = family.join(sums.hint("merge"), _KEY).join(sha.hint("merge"), _KEY, "left")
    # every member's bytes from this node on, less the bytes of the distinct nodes there
    saved = F.col("total") - F.col("n_convs") * F.col("start") - (F.col("own") - F.col("own1") + F.col("total1") - F.col("start"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) with shared openings. Turns of equal number are ordered by
    role, then hash; further columns are ignored."""
    return trie(shared_openings(placed(turn_ids(conversations))))
