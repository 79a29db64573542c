"""The trie of conversation prefixes by ROLLUP over positional columns of turn ids.

A turn is told by 128 bits of hash of its role and text. A conversation is cut into blocks of ``BLOCK`` turns, one column
per place; a block is keyed by the node that the blocks before it lead to. One ``GROUP BY block, node, ROLLUP(t0, t1, ..)``
then makes the nodes of all depths of all blocks together; grouping_id tells the depth inside the block, and groups that end
beyond their conversation fall away. A node is named by its depth and 128 bits that every turn on its path, with its place,
adds to, so the key of a block is a running sum.

Sums over subtrees are a second ROLLUP, over the nodes. What lies in later blocks reaches earlier ones through the smallest
member of its node: each conversation carries the values of the nodes it stands for to its own earlier blocks.

Places and running sums are taken in parts and shifted by the totals of the parts before, so one very long conversation is
not one task. Parents with very many children are broadcast, others joined. The ids of the conversations that end at a node
are put together in stretches and hashed as a stream.

Turns of equal number are ordered by their hash. Null roles and texts are empty. Rows without a conversation id are left
out. Repeated rows are turns of their own. An empty table has no nodes. Further columns are not used.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.llm.common import col, shuffle_partitions, small_batches, staged

BLOCK = 4
PART = 65_536  # rows of one conversation in one window
STRETCH = 256  # conversation ids in one row of the ends of a node
#: A parent with more than this share of all nodes as children is broadcast. There are at most 1 / HEAVY of them.
HEAVY = 1 / 1024
NODE = ["depth", "nh", "ng"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, id, size): turns numbered from 1 in their order; ``size`` is the text's bytes."""
    r, t = (F.coalesce(col(x), F.lit("")) for x in (role, text))
    told = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)), 1, 16)
    rows = df.filter(col(conv).isNotNull()).select(
        col(conv).alias("c"), col(turn).alias("turn"), told.alias("id"), F.octet_length(t).cast("bigint").alias("size"))
    order = [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("id").asc()]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "turns")
    inside = F.row_number().over(W.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "id"))
    rows = shifted(dealt.withColumn("pos", inside), F.sum(F.lit(1)), "pos")
    return rows.select("c", F.col("pos").cast("int").alias("pos"), "id", "size")


def shifted(rows: DataFrame, total: Column, name: str, after: bool = False, add=lambda a, b: a + b) -> DataFrame:
    """``name`` of each (c, part) plus the ``total`` of the parts of c before it (or after it)."""
    parts = rows.groupBy(F.col("c").alias("x"), F.col("part").alias("y")).agg(total.alias("whole"))
    order = F.desc("y") if after else F.asc("y")
    before = reduce_over("whole", add, W.partitionBy("x").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("x", "y", before.alias("before")).filter("before IS NOT NULL AND before <> 0")  # only what is cut
    out = rows.join(parts, (F.col("c") == F.col("x")) & (F.col("part") == F.col("y")), "left")
    return out.withColumn(name, add(F.col(name), F.coalesce("before", F.lit(0)))).drop("x", "y", "before")


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def reduce_over(name: str, add, window) -> Column:
    return (F.bit_xor(name) if add is xor else F.sum(name)).over(window)


def running(rows: DataFrame, value: str, name: str, after: bool = False, add=lambda a, b: a + b) -> DataFrame:
    """``name``: the sum of ``value`` over the blocks of c before this one (or after it); rows are (c, block, ..)."""
    rows = rows.withColumn("part", F.floor(F.col("block") / PART))
    order = F.desc("block") if after else F.asc("block")
    window = W.partitionBy("c", "part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(reduce_over(value, add, window), F.lit(0)))
    total = F.bit_xor(value) if add is xor else F.sum(value)
    return shifted(rows, total, name, after, add).drop("part")


def place_hash(lane: int, pos: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(lane), pos.cast("int"), turn)


def block_rows(turns: DataFrame) -> DataFrame:
    """(c, block, ph, pg, t0.., s0..): a conversation's turns in blocks, with the node that the blocks before lead to."""
    at = (F.col("pos") - 1) % BLOCK
    rows = turns.select("c", F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("block"), at.alias("at"), "id", "size",
                        *[place_hash(i, F.col("pos"), F.col("id")).alias(x) for i, x in enumerate(("zh", "zg"))])
    rows = rows.groupBy("c", "block").agg(
        *[F.max(F.when(F.col("at") == i, F.col("id"))).alias(f"t{i}") for i in range(BLOCK)],
        *[F.max(F.when(F.col("at") == i, F.col("size"))).alias(f"s{i}") for i in range(BLOCK)],
        F.bit_xor("zh").alias("zh"), F.bit_xor("zg").alias("zg"))
    return running(running(rows, "zh", "ph", add=xor), "zg", "pg", add=xor)


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """One row per node of (block, ph, pg, t0..): its name, its parent's (``mh``, ``mg``), level in the block, aggregates."""
    places = ", ".join(f"t{i}" for i in range(BLOCK))
    groups = rows.sparkSession.sql(
        f"SELECT block, ph, pg, {places}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY block, ph, pg, ROLLUP({places})", rows=rows)
    last = reduce(lambda out, i: F.when(F.col("level") == i + 1, F.col(f"t{i}")).otherwise(out), range(BLOCK), F.lit(None).cast("binary"))
    groups = groups.filter(last.isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))

    def name(lane: int, start: str, levels: Column) -> Column:
        out = F.col(start)
        for i in range(BLOCK):
            out = xor(out, F.when(levels > i, place_hash(lane, F.col("block") * BLOCK + i + 1, F.col(f"t{i}"))).otherwise(F.lit(0)))
        return out

    level = F.col("level")
    return groups.select("*", (F.col("block") * BLOCK + level).alias("depth"), name(0, "ph", level).alias("nh"), name(1, "pg", level).alias("ng"),
                         name(0, "ph", level - 1).alias("mh"), name(1, "pg", level - 1).alias("mg"))


def on_node(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return left.join(right, NODE, how)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, nh, ng, ends_sha256) of (c, depth, nh, ng): the ids that end at a node, ascending and joined by commas."""
    spark = ends.sparkSession
    small_batches(spark)
    rows = ends.groupBy(*NODE, F.expr(f"c DIV {STRETCH}").alias("stretch")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))  # at most 2 * STRETCH ids
    rows = rows.repartition(shuffle_partitions(spark), *NODE).sortWithinPartitions(*NODE, "stretch")

    def task(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            yield named(done)
        if now:
            yield named([(*now, digest.hexdigest())])

    def named(done):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=[*NODE, "ends_sha256"])

    return rows.mapInArrow(task, "depth int, nh bigint, ng bigint, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Append ``parent_conv_id``; the root's is null."""
    limit = HEAVY * nodes.count()
    parents = nodes.filter("n_children > 0").select(
        F.col("depth").alias("d"), F.col("nh").alias("h"), F.col("ng").alias("g"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    match = (F.col("depth") - 1 == F.col("d")) & (F.col("mh") == F.col("h")) & (F.col("mg") == F.col("g"))
    heavy = parents.filter(F.col("n_children") > limit).drop("n_children")  # at most 1 / HEAVY rows
    light = parents.filter(F.col("n_children") <= limit).drop("n_children")
    below = nodes.filter("depth > 0")
    keep = [*nodes.columns, "parent_conv_id"]
    out = below.join(F.broadcast(heavy), match).select(keep)
    out = out.unionAll(below.join(F.broadcast(heavy.select("d", "h", "g")), match, "left_anti").join(light, match).select(keep))
    root = nodes.filter("depth = 0")
    return out.unionByName(root.withColumn("parent_conv_id", F.lit(None).cast(out.schema["parent_conv_id"].dataType)))


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of ``turns`` (c, pos, id, size), places from 1 without gaps, and of ``convs`` (c), which names all members.

    Gives NODE, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = staged(block_rows(turns), "trie-blocks")
    without = convs.join(blocks.filter("block = 0").select("c"), "c", "left_anti")
    without = without.select("c", F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("ph"), F.lit(0).cast("bigint").alias("pg"))
    members = blocks.drop("zh", "zg").unionByName(without, allowMissingColumns=True)
    sizes = ", ".join(f"max(s{i}) AS s{i}" for i in range(BLOCK))
    nodes = rolled_up(members, f"min(c) AS conv_id, count(*) AS n_convs, {sizes}")
    size = reduce(lambda out, i: F.when(F.col("level") == i + 1, F.col(f"s{i}")).otherwise(out), range(BLOCK), F.lit(0))
    nodes = staged(nodes.withColumn("saved", (F.col("n_convs") - 1) * size).drop(*[f"s{i}" for i in range(BLOCK)]), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("mh").alias("nh"), F.col("mg").alias("ng"))
    nodes = on_node(nodes, children.agg(F.count("*").alias("n_children"))).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "trie-children")

    values = nodes.filter("block > 0").groupBy(F.col("conv_id").alias("c"), "block").agg(F.sum("leaf").alias("v"), F.sum("saved").alias("w"))
    long = blocks.filter("block > 0").select("c").distinct()
    paths = blocks.join(long, "c", "left_semi").join(values, ["c", "block"], "left").fillna(0, ["v", "w"])
    paths = running(running(paths, "v", "leaf", after=True), "w", "saved", after=True).filter("leaf <> 0 OR saved <> 0")
    columns = ["block", "ph", "pg", *[f"t{i}" for i in range(BLOCK)], "leaf", "saved"]
    sums = rolled_up(nodes.select(columns).unionByName(paths.select(columns)), "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens")
    sums = sums.select(*NODE, "n_leaves", "saved_tokens")

    ends = blocks.groupBy("c").agg(F.bit_xor("zh").alias("nh"), F.bit_xor("zg").alias("ng"), F.sum(
        sum((F.col(f"t{i}").isNotNull().cast("int") for i in range(BLOCK)), F.lit(0))).cast("int").alias("depth"))
    ends = ends.unionByName(without.select("c", F.lit(0).alias("depth"), F.col("ph").alias("nh"), F.col("pg").alias("ng")))
    out = on_node(on_node(with_parents(nodes), sums), hashed_ends(ends))
    return out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; ``conv`` is a whole number."""
    turns = staged(turn_rows(df, conv, turn, role, text), "turn-places")
    return trie_of(turns, turns.select("c").distinct())


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that start with the first turns of their family's first one.

    Conversation c takes the first h turns of c - c % ``family`` in place of its own, h being the crc32 of its number modulo
    ``most`` + 1.
    """
    head = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", head.cast("int").alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    convs = staged(convs, "convs")
    first = convs.select(F.col("c").alias("b"), F.col("n").alias("in_base"))
    convs = convs.join(first, F.col("base") == F.col("b"), "left").select("c", "h", "base", F.coalesce("in_base", F.lit(0)).alias("in_base"))
    heads = turns.filter(F.col("pos") <= most).withColumnRenamed("c", "b")  # at most ``most`` rows for ``family`` conversations
    heads = heads.join(convs, (F.col("b") == F.col("base")) & (F.col("pos") <= F.col("h"))).select("c", "pos", "id", "size")
    own = turns.join(convs.select(F.col("c").alias("k"), "h", "in_base"), F.col("c") == F.col("k")).filter(F.col("pos") > F.col("h"))
    place = F.col("pos") - F.col("h") + F.least(F.col("h").cast("bigint"), F.col("in_base"))
    own = own.select("c", place.cast("int").alias("pos"), "id", "size")
    return heads.unionByName(own), convs.select("c")


def op12_prefix_rollup(spark, folder):
    turns = staged(turn_rows(spark.read.parquet(f"{folder}/conversations.parquet"), "conv_id", "turn", "role", "text"), "turn-places")
    out = trie_of(*rebuilt(turns))
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256")


OP12_SQL = """
WITH t AS (
  SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS pos
  FROM (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS size,
               sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS id
        FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n, c::VARCHAR AS s FROM t GROUP BY c),
h AS (
  SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::BIGINT, 1))::BIGINT),
    lambda x, y: list_reduce([xor(x, y)] || range(8), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END))) % 9 AS h
  FROM n),
f AS (SELECT h.*, coalesce(b.n, 0) AS in_base FROM h LEFT JOIN n b ON b.c = h.base),
r AS (
  SELECT f.c, t.pos, t.id, t.size FROM f JOIN t ON t.c = f.base AND t.pos <= f.h
  UNION ALL SELECT f.c, t.pos - f.h + least(f.h, f.in_base), t.id, t.size FROM f JOIN t ON t.c = f.c AND t.pos > f.h),
p AS (
  SELECT f.c, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes
  FROM f LEFT JOIN (SELECT c, list(id ORDER BY pos) AS ids, list(size ORDER BY pos) AS sizes FROM r GROUP BY c) USING (c)),
m AS (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM p),
g AS (
  SELECT d, array_to_string(ids[1:d], ',') AS k, min(c) AS conv_id, count(*) AS n_convs, any_value(ids[1:d]) AS path,
         CASE WHEN d = 0 THEN 0 ELSE any_value(sizes[d]) END AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ids) = d), '')) AS ends_sha256
  FROM m GROUP BY d, k),
q AS (SELECT d - 1 AS d, array_to_string(path[1:d - 1], ',') AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT g.*, coalesce(q.n, 0) AS n_children FROM g LEFT JOIN q USING (d, k)),
u AS (SELECT *, unnest(range(0, d + 1)) AS e FROM v),
s AS (
  SELECT e AS d, array_to_string(path[1:e], ',') AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM u GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, w.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (d, k) LEFT JOIN g w ON w.d = v.d - 1 AND w.k = array_to_string(v.path[1:v.d - 1], ',')
"""
