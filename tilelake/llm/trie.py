"""A prefix trie of conversations: one node for each distinct beginning, rolled up by centroid decomposition.

A node is known by its smallest member and its depth, so no text is in the trie. Turns take their places by one range
sort, in which a long conversation lies in many partitions; a beginning's identity is the XOR of 128-bit hashes of its
turns with their places, a running aggregate that is taken in blocks of turns and carried on by the blocks' totals. What
crosses tasks are some 60 bytes a turn. Members are counted by one aggregate, partial before the shuffle, so that the root
and other common beginnings cost no task more than the rest.

Sums over subtrees go up the forest of parent edges by its centroids. A beginning with one member is a chain with one leaf
that saves nothing, so only shared beginnings stay in the forest. Then, in rounds, all components at once: the centroid of
a component is its deepest node with more than half of the component's weight (a node's weight is its members times
what follows, of which sums over subtrees are known from the members alone); what it and all below it in the component have
is summed and added to each node on the path from the centroid to the component's top; the centroid is done, what hangs
below it falls apart into components, the rest stays one. Each has at most half of the weight, so the rounds are the
logarithm of the turns, however deep or lopsided the trie. A path is found from the centroid's smallest member, whose
turns pass through it: one join of narrow rows a round.

Defined results: turns without a conversation are ignored; null turn numbers come first, equal ones are ordered by hashes
of role and text; null role or text is empty; repeated rows are turns of their own; an empty table gives no rows (there is
no conversation that would have the root); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.common import crc32_text, drop_staged, numbered, stage, table
from tilelake.llm.merkle import CRC

#: Turns of a conversation that one task orders at once, and ids that one chunk of an id list spans (a power of two).
BLOCK, ID_BITS = 4096, 12
#: Rebuilding: conversations in a family, and how many turns of the family's first one may come first.
FAMILY, MOST = 5, 9
KEY = ("k1", "k2", "depth")
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, a1, a2, bytes): each turn's place from 0, a hash of role and text in two halves, its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit("again"), text, role).alias("a2"), F.octet_length(text).cast("long").alias("bytes")
    )
    return numbered(rows, "conv", ["turn", "a1", "a2"]).drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth from 1, a1, a2, bytes, len) and conversations (conv, len) after each took its family's opening."""
    family = F.col("conv") - F.col("conv") % FAMILY
    opening = F.struct("pos", "a1", "a2", "bytes")
    heads = own.where(F.col("pos") < MOST - 1).groupBy(F.col("conv").alias("family")).agg(F.sort_array(F.collect_list(opening)).alias("head"))
    known = own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("family", family)
    h = (crc32_text(F.col("conv").cast("string")) % MOST).cast("int")
    known = known.join(heads, "family", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    known = known.withColumn("head", head).withColumn("len", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = stage(known.select("conv", "n", "h", "head", "len"))
    first = known.select("conv", "len", F.posexplode("head").alias("at", "x")).select("conv", (F.col("at") + 1).cast("long").alias("depth"), "x.a1", "x.a2", "x.bytes", "len")
    # A long conversation's rows meet its row of known in blocks.
    blocks = known.select("conv", "h", "len", F.size("head").alias("opened"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    rest = own.where(F.col("pos") >= crc32_text(F.col("conv").cast("string")) % MOST).withColumn("block", F.floor(F.col("pos") / BLOCK))
    rest = rest.join(blocks, ["conv", "block"]).select("conv", (F.col("opened") + F.col("pos") - F.col("h") + 1).alias("depth"), "a1", "a2", "bytes", "len")
    return first.union(rest), known.select("conv", "len")


def _beginnings(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes, len): each conversation's beginnings, the empty one as well, and their parents."""
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).withColumns({"e1": F.xxhash64("depth", "a1", "a2"), "e2": F.xxhash64("a2", "depth", "a1")})
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({"x1": F.bit_xor("e1").over(upto), "x2": F.bit_xor("e2").over(upto)})
    totals = rows.where(F.col("len") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    carried = totals.select("conv", (F.col("block") + 1).alias("block"), F.bit_xor("t1").over(earlier).alias("t1"), F.bit_xor("t2").over(earlier).alias("t2"))
    inner = inner.join(carried, ["conv", "block"], "left")
    k1, k2 = (F.col(f"x{i}").bitwiseXOR(F.coalesce(f"t{i}", F.lit(0))) for i in (1, 2))
    inner = inner.withColumns({"k1": k1, "k2": k2}).select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "bytes", "len")
    none = F.lit(0).cast("long")
    return inner.union(convs.select("conv", none, none, none, none, none, none, "len"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's id list from its chunks in order: of a list only one chunk and the hash's state are held."""
    now, state = None, None

    def out(keys: list, hashes: list) -> pa.RecordBatch:
        return pa.record_batch({**{c: pa.array([k[i] for k in keys], pa.int64()) for i, c in enumerate(KEY)}, "ends_sha256": pa.array(hashes, pa.string())})

    for batch in batches:
        keys, hashes = [], []
        for *key, chunk in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != now:
                if now is not None:
                    keys.append(now)
                    hashes.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.encode())
        yield out(keys, hashes)
    if now is not None:
        yield out([now], [state.hexdigest()])


def _ends(members: DataFrame) -> DataFrame:
    """For each node at which conversations end, the digest of their ids: ascending, decimal, joined by commas."""
    last = members.where("depth = len").groupBy(*KEY, F.shiftright("conv", ID_BITS).alias("chunk"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")  # 2^ID_BITS ids at most
    chunks = last.agg(ids.alias("ids")).repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return chunks.select(*KEY, "ids").mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")


def _nodes(members: DataFrame) -> DataFrame:
    """A row for each node: its name (conv, depth), its parent's, its counts, and its own part of the sums."""
    n = members.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight")
    )
    n = stage(n)
    up = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    below = n.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    parents = n.join(n.where("depth > 0").select(*up).distinct(), list(KEY), "left_semi")
    parents = parents.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"))
    own = n.join(below, list(KEY), "left").join(_ends(members), list(KEY), "left")
    own = stage(own.fillna(0, ["n_children", "lone"]).fillna(EMPTY, ["ends_sha256"]))
    # A parent with many children is a hot key; no aggregate follows in this stage, so adaptive execution may split it.
    out = stage(own.join(parents, ["p1", "p2", "depth"], "left"))
    drop_staged(n, own)
    return out


def _walk(members: DataFrame, shared: DataFrame) -> DataFrame:
    """(at, depth, node, parent): through which shared node, and from which parent, conversation `at` passes at a depth.

    Only conversations that name a shared node are kept: copies and all others name none.
    """
    names = shared.select("conv").distinct()
    own = members.select("conv", *KEY).join(names, "conv", "left_semi")
    nodes = shared.select(*KEY, F.col("conv").alias("node"), "parent_conv")
    return stage(own.join(nodes, list(KEY)).select(F.col("conv").alias("at"), "depth", "node", F.col("parent_conv").alias("parent")))


def _rolled_up(shared: DataFrame, walk: DataFrame) -> DataFrame:
    """(conv, depth, n_leaves, saved_tokens) of shared nodes, by centroid decomposition of their parent edges."""
    spark, done = shared.sparkSession, []
    top = shared.where("depth = 0").select("conv", "weight").first()
    fields = ["conv", "depth", "top_conv", "top_depth", "total", "weight", "leaves", "saved", "below_leaves", "below_saved"]
    schema = ", ".join(f"{c} long" for c in ("conv", "depth", "n_leaves", "saved_tokens"))
    if top is None:
        return spark.createDataFrame([], schema)
    long = lambda v: F.lit(v).cast("long")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("lone")
    nodes = stage(shared.select("conv", "depth", long(top[0]).alias("top_conv"), long(0).alias("top_depth"), long(top[1]).alias("total"), "weight", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), long(0).alias("below_leaves"), long(0).alias("below_saved")))
    comp = ["top_conv", "top_depth"]
    while True:
        centroids = nodes.where(F.col("weight") * 2 > F.col("total")).groupBy(*comp).agg(F.max_by(F.struct("conv", "depth", "weight"), "depth").alias("c"))
        # Where a node is deeper than the centroid, its own member tells what it passes below there; where it is
        # shallower, the centroid's member tells whether the path passes through it.
        deeper = F.col("depth") > F.col("c.depth")
        asked = nodes.join(centroids, comp).withColumns({"at": F.when(deeper, F.col("conv")).otherwise(F.col("c.conv")), "place": F.when(deeper, F.col("c.depth") + 1).otherwise(F.col("depth"))})
        known = walk.select("at", F.col("depth").alias("place"), "node", "parent")
        is_centroid = (F.col("conv") == F.col("c.conv")) & (F.col("depth") == F.col("c.depth"))
        side = (
            F.when(is_centroid, "centroid")
            .when(deeper & (F.col("parent") == F.col("c.conv")), "below")
            .when((F.col("depth") < F.col("c.depth")) & (F.col("node") == F.col("conv")), "above")
            .otherwise("aside")
        )
        is_below = F.col("side") == "below"
        split = asked.join(known, ["at", "place"], "left").select(*fields, F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"), "node", side.alias("side"))
        # The top of the component that a node is in from now on.
        split = stage(split.withColumns({"new_conv": F.when(is_below, F.col("node")).otherwise(F.col("top_conv")), "new_depth": F.when(is_below, F.col("c_depth") + 1).otherwise(F.col("top_depth"))}))
        fallen = split.where(F.col("side").isin("centroid", "below")).groupBy(*comp).agg(F.sum("leaves").alias("sum_leaves"), F.sum("saved").alias("sum_saved"))
        fallen = fallen.select(F.col("top_conv").alias("new_conv"), F.col("top_depth").alias("new_depth"), "sum_leaves", "sum_saved", F.lit(None).cast("long").alias("new_total"))
        tops = split.where(is_below & (F.col("conv") == F.col("node")) & (F.col("depth") == F.col("c_depth") + 1))
        tops = tops.select("new_conv", "new_depth", F.lit(None).cast("long").alias("sum_leaves"), F.lit(None).cast("long").alias("sum_saved"), F.col("weight").alias("new_total"))
        on_path, less = F.col("side").isin("centroid", "above"), F.when(F.col("side") == "above", F.col("c_weight")).otherwise(0)
        after = split.join(fallen.union(tops), ["new_conv", "new_depth"]).select(
            "conv",
            "depth",
            F.col("new_conv").alias("top_conv"),
            F.col("new_depth").alias("top_depth"),
            F.coalesce("new_total", F.col("total") - F.col("c_weight")).alias("total"),
            (F.col("weight") - less).alias("weight"),
            "leaves",
            "saved",
            (F.col("below_leaves") + F.when(on_path, F.col("sum_leaves")).otherwise(0)).alias("below_leaves"),
            (F.col("below_saved") + F.when(on_path, F.col("sum_saved")).otherwise(0)).alias("below_saved"),
            (F.col("side") == "centroid").alias("done"),
        )
        after = stage(after)
        done.append(after.where("done").select("conv", "depth", F.col("below_leaves").alias("n_leaves"), F.col("below_saved").alias("saved_tokens")))
        drop_staged(split)
        nodes = after.where("not done")
        if nodes.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all beginnings of conversations: rows as rebuilt() gives them, convs with those without turns."""
    members = stage(_beginnings(rows, convs))
    nodes = _nodes(members)
    shared = nodes.where("n_convs > 1")
    walk = _walk(members, shared)
    sums = _rolled_up(shared, walk)
    drop_staged(members, walk)
    out = nodes.join(sums, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        "ends_sha256",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


SQL = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {CRC.format("c")} % {MOST} AS h FROM (SELECT DISTINCT c FROM own)),
again AS (
  SELECT convs.c, pos, r, t FROM convs JOIN own ON own.c = convs.c - convs.c % {FAMILY} AND pos < h
  UNION ALL
  SELECT convs.c, pos, r, t FROM convs JOIN own ON own.c = convs.c AND pos >= h),
members AS (
  SELECT c, row_number() OVER w AS depth, strlen(t) AS bytes, sha256(string_agg(strlen(r)::varchar || ':' || r || strlen(t)::varchar || ':' || t, '') OVER w) AS k
  FROM again WINDOW w AS (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT depth, k, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes FROM members GROUP BY depth, k),
passed AS (SELECT c, depth, conv AS node FROM members JOIN nodes USING (depth, k)),
parents AS (SELECT n.depth, n.conv, n.n, n.bytes, p.node AS parent FROM nodes n LEFT JOIN passed p ON p.c = n.conv AND p.depth = n.depth - 1),
children AS (SELECT parent AS conv, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
own_sums AS (SELECT p.*, coalesce(n_children, 0) AS n_children, (n - 1) * bytes AS saved FROM parents p LEFT JOIN children USING (conv, depth)),
sums AS (
  SELECT u.node AS conv, u.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM own_sums s JOIN passed u ON u.c = s.conv AND u.depth <= s.depth GROUP BY ALL),
ends AS (
  SELECT node AS conv, depth, string_agg(c::varchar, ',' ORDER BY c) AS ids
  FROM passed JOIN (SELECT c, max(depth) AS depth FROM members GROUP BY c) USING (c, depth) GROUP BY ALL)
SELECT conv AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own_sums JOIN sums USING (conv, depth) LEFT JOIN ends USING (conv, depth)
"""
