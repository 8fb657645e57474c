"""Conversation prefix trie, rolled up by centroid decomposition.

Conversations are rebuilt (`rebuilt`), every distinct sequence of first turns is a node (`trie`), and
subtree sums are taken by `rollup`. A node is named by its smallest member and its depth: the smallest
member of a node is also the smallest of the nodes on its path below, so the pair is unique.

**Rollup.** The parent-edge forest is split component by component. A node weighs as many as it has
members, so the weight of a whole subtree follows from the members' lengths without a walk. In a component
the nodes that hold more than half of its weight are the path from its top to the centroid. A round sums
the values of the centroid's part (the centroid and all below it in the component), adds that sum to every
node of the path, takes the centroid out and leaves its children's parts and the upper part as new
components; path nodes lose the centroid's weight. A component's weight halves, so the rounds are as the
logarithm of the rows, however deep the trie is. A round is three joins on unique keys and partial
aggregates; its rows are written to the shared folder.

**No group in one task.** Turns are numbered by a range sort and one row per conversation and partition.
Prefix names are running XORs of 2 x 64-bit hashes of (place, role, text), over segments of `SEGMENT` turns
and then over the segments, so one endless conversation is spread too. Names stand for the sequences: two
different ones share a name with a chance of 2**-120 a pair.

**Digest of the ends.** Ids are joined to strings per `BLOCK` consecutive values in Spark. SHA-256 is
sequential by definition, so the strings of one node go in order through one task, one string at a time;
memory stays that of one string.

Null roles and texts count as empty, null turns come first; turns of one number are ordered by role and
then by digest, and rows that are repeated are turns of their own. Rows without conv_id belong to no
conversation and are left out. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchload.session import cut

#: turns of one conversation that one window group takes
SEGMENT = 4_096
#: conversation ids whose decimals one string takes: 2**BLOCK_BITS at most
BLOCK_BITS = 12
FAMILY = 20          # conversations c - c % FAMILY lend their first turns
LENT = 4             # crc32(c) % LENT turns
WORD = r"[^\x20\x09-\x0D]+"


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, k, m1, m2, words) with k = 1.. in a conversation's order, and (conv, n)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv IS NOT NULL")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select("conv", "turn", "role", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
                       *[F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"m{i + 1}") for i in (0, 1)])
    order = ["conv", "turn", "role", "m1", "m2"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
               .select("conv", "words", "m1", "m2", F.monotonically_increasing_id().alias("at")), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    blocks = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("cnt"))
    before = F.coalesce(F.sum("cnt").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cut(blocks.withColumn("before", before), "blocks")
    turns = rows.join(blocks, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("k"), "m1", "m2", "words")
    return cut(turns, "numbered"), blocks.groupBy("conv").agg(F.sum("cnt").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, d, len, m1, m2, words), and all conversations (conv, len), turnless ones too."""
    turns, sizes = numbered(conversations)
    heads = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
                         (F.crc32(F.col("conv").cast("string").cast("binary")) % LENT).alias("h"))
    lent = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    heads = heads.join(lent, "base", "left").withColumn("p", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = cut(heads.select("conv", "base", "h", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "heads")
    own = turns.join(heads, "conv").where("k > h").withColumn("d", F.col("p") + F.col("k") - F.col("h"))
    first = turns.where(F.col("k") < LENT).withColumnsRenamed({"conv": "base", "k": "d"}).join(heads, "base").where("d <= h")
    cols = ["conv", "d", "len", "m1", "m2", "words"]
    return own.select(cols).unionByName(first.select(cols)), heads.select("conv", "len")


def running_xor(rows: DataFrame, at: str, cols: list[str]) -> DataFrame:
    """`cols` XORed over each conv's rows up to this one; `at` counts a conv's rows from 1."""
    seg = f"{at}_segment"
    here = Window.partitionBy("conv", seg).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(seg, F.expr(f"(`{at}` - 1) div {SEGMENT}"))
    got = rows.withColumns({c: F.bit_xor(c).over(here) for c in cols})
    if (rows.agg(F.max(at)).first()[0] or 0) <= SEGMENT:
        return got.drop(seg)
    sums = rows.groupBy("conv", (F.col(seg) + 1).alias(seg)).agg(*[F.bit_xor(c).alias(c) for c in cols])
    sums = running_xor(cut(sums, "segments"), seg, cols).select("conv", seg, *[F.col(c).alias(f"_{c}") for c in cols])
    got = got.join(sums, ["conv", seg], "left")
    return got.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in cols}).drop(seg, *[f"_{c}" for c in cols])


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (c, d, parent, n, words, weight, kids); paths (conv, d, s, p): the node and its parent that each
    naming conversation passes at depth d; ends (c, d, conv): the node at which each conversation ends."""
    turns, convs = rebuilt(conversations)
    turns = cut(turns.withColumns({"h1": F.xxhash64("d", "m1", "m2"), "h2": F.xxhash64(F.lit(1), "m2", "d", "m1")})
                .withColumns({"x1": F.col("h1"), "x2": F.col("h2")}).drop("m1", "m2"), "rebuilt")
    steps = running_xor(turns, "d", ["h1", "h2"])
    steps = cut(steps.withColumns({"p1": F.col("h1").bitwiseXOR(F.col("x1")), "p2": F.col("h2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2"), "steps")
    top = convs.agg(F.min("conv").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("len") + 1).alias("weight")).where("n > 0")
    top = top.select(F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(x) for x in ("h1", "h2")],
                     *[F.lit(None).cast("long").alias(x) for x in ("p1", "p2")], "c", "n", F.lit(0).cast("long").alias("words"), "weight")
    named = cut(steps.groupBy("d", "h1", "h2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("c"), F.count(F.lit(1)).alias("n"),
        F.min("words").alias("words"), F.sum(F.col("len") - F.col("d") + 1).alias("weight")).unionByName(top), "named")
    above = named.select((F.col("d") + 1).alias("d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("c").alias("parent"))
    named = cut(named.join(above, ["d", "p1", "p2"], "left").select("d", "h1", "h2", "c", "parent", "n", "words", "weight"), "parents")
    kids = named.where("d > 0").groupBy(F.col("parent").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = cut(named.drop("h1", "h2").join(kids, ["c", "d"], "left").fillna(0, ["kids"]), "nodes")
    passed = steps.select("conv", "d", "len", "h1", "h2").join(named.select("d", "h1", "h2", "c", "parent"), ["d", "h1", "h2"])
    passed = cut(passed.select("conv", "d", "len", F.col("c").alias("s"), F.col("parent").alias("p")), "passed")
    ends = passed.where("d = len").select(F.col("s").alias("c"), "d", "conv").unionByName(
        convs.where("len = 0").select("conv").crossJoin(F.broadcast(top.select("c", "d"))))   # one row
    paths = passed.drop("len").join(nodes.select(F.col("c").alias("conv")).distinct(), "conv", "left_semi")
    return nodes, cut(paths, "paths"), ends


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, *values): for each node the sums of `values` over its subtree, itself included.

    `nodes` are (c, d, weight, *values) of one tree, the weight being that of the node's whole subtree;
    `paths` as from `trie`.
    """
    part = ["tc", "td"]
    top = nodes.where("d = 0").select(F.col("c").alias("tc"), F.col("d").alias("td"))
    live = nodes.select("c", "d", "weight", *values).crossJoin(F.broadcast(top))   # one row
    at = paths.select(F.col("conv").alias("_c"), F.col("d").alias("_d"), "s", "p")
    shares = []
    while not live.isEmpty():
        whole = live.groupBy(*part).agg(F.max("weight").alias("whole"))
        marked = live.join(whole, part).withColumn("on_path", 2 * F.col("weight") > F.col("whole")).drop("whole")
        centre = marked.where("on_path").groupBy(*part).agg(F.max(F.struct("d", "c", "weight")).alias("z"))
        seen = marked.join(centre.select(*part, F.col("z.c").alias("zc"), F.col("z.d").alias("zd"), F.col("z.weight").alias("zw")), part)
        seen = seen.join(at, (F.col("c") == F.col("_c")) & (F.col("zd") + 1 == F.col("_d")) & (F.col("d") > F.col("zd")), "left")
        seen = seen.withColumns({"below": F.coalesce(F.col("p") == F.col("zc"), F.lit(False)), "is_z": (F.col("c") == F.col("zc")) & (F.col("d") == F.col("zd"))})
        seen = cut(seen.drop("_c", "_d", "p"), "round")
        sums = seen.where("below OR is_z").groupBy(*part).agg(*[F.sum(v).alias(v) for v in values])
        shares.append(seen.where("on_path").select("c", "d", *part).join(sums, part).select("c", "d", *values))
        live = seen.where("NOT is_z").select(
            "c", "d", F.when(F.col("on_path"), F.col("weight") - F.col("zw")).otherwise(F.col("weight")).alias("weight"), *values,
            F.when(F.col("below"), F.col("s")).otherwise(F.col("tc")).alias("tc"),
            F.when(F.col("below"), F.col("zd") + 1).otherwise(F.col("td")).alias("td"))
    if not shares:
        return nodes.select("c", "d", *values).limit(0)
    every = shares[0]
    for s in shares[1:]:
        every = every.unionByName(s)
    return every.groupBy("c", "d").agg(*[F.sum(v).alias(v) for v in values])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(c, d, ends_sha256): digest of the comma-joined decimal conv_ids, numerically ascending."""
    block = F.shiftright("conv", BLOCK_BITS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    packed = ends.groupBy("c", "d", block.alias("block")).agg(joined.alias("ids"))
    packed = packed.repartition("c", "d").sortWithinPartitions("c", "d", "block")

    def digests(frames):
        now, state = None, None
        for pdf in frames:
            out = []
            for c, d, ids in zip(pdf["c"], pdf["d"], pdf["ids"]):
                if (c, d) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (c, d), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["c", "d", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["c", "d", "ends_sha256"])

    return packed.mapInPandas(digests, "c long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, paths, ends = trie(conversations)
    valued = nodes.withColumns({"leaves": (F.col("kids") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")})
    sums = rollup(valued, paths, ["leaves", "saved"])
    got = nodes.join(sums, ["c", "d"]).join(ends_digest(ends), ["c", "d"], "left")
    return got.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: DuckDB twin. CRC-32 is worked out bit by bit; subtrees are summed along each naming conversation's path.
ORACLE = r"""WITH t AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, count(*) AS n, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split_regex(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y:
    CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 3) % 4 AS h FROM t GROUP BY c),
g AS (SELECT a.c, a.base, a.h, a.n, least(a.h, coalesce(b.n, 0)) AS p FROM h a LEFT JOIN h b ON b.c = a.base),
r AS (SELECT g.c, t.k AS d, t.m, t.words FROM g JOIN t ON t.c = g.base AND t.k <= g.h
      UNION ALL SELECT g.c, g.p + t.k - g.h, t.m, t.words FROM g JOIN t ON t.c = g.c AND t.k > g.h),
s AS (SELECT c, d, words, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM g),
p AS (SELECT c, d, words, min(c) OVER (PARTITION BY d, path) AS s FROM s),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
e AS (SELECT p.s, p.d, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l USING (c, d) GROUP BY p.s, p.d),
n AS (SELECT a.s, a.d, min(b.s) AS parent, count(*) AS n, min(a.words) AS words FROM p a LEFT JOIN p b ON b.c = a.c AND b.d = a.d - 1 GROUP BY a.s, a.d),
k AS (SELECT parent AS s, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN k USING (s, d)),
u AS (SELECT p.s, p.d, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.words) AS saved
      FROM v JOIN p ON p.c = v.s AND p.d <= v.d GROUP BY p.s, p.d)
SELECT v.s AS conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN u USING (s, d) LEFT JOIN e USING (s, d)"""
