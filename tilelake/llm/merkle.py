"""A Merkle manifest of a dataset: trees by language below one root, and proofs by checkpoint and recompute.

Only every STEP-th level of a tree is persisted (the leaves, then one node for each 2^STEP nodes below). The levels
between are never stored: what lies between two persisted levels falls into aligned subtrees of at most 2^STEP stored
descendants, and a proof regenerates a subtree's interior nodes from these, emits the siblings on each descendant's way
up, and discards the rest. Proofs go down from the root, one persisted level after another, so a descendant takes its
subtree's siblings and behind them those of the subtree's own top.

Leaves take their places by one range sort over (tree, id), in which a large language lies in many partitions; subtrees
are groups of at most 2^STEP rows whatever the sizes of languages; a level is 2^STEP times smaller than the one below, so
10^11 rows need five. What crosses tasks are digests, never texts. The subroots are leaves of one more tree of the same
kind. Nodes are hashed from the hexadecimal text of their children, a lone last child alone.

Defined results: a null field hashes as `-`, unlike an empty one; a null language is a tree of its own, which comes first;
null ids come first in their tree and are never tampered with; rows with equal ids are ordered by their digests, so
repeated rows are leaves side by side, each with its own proof; a tree of one leaf has that leaf as subroot, a dataset of
one tree that subroot as root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import crc32_text, numbered, stage, table

#: Levels from one persisted level to the next.
STEP = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' UTF-8 bytes one after another, in lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf(**values: Column) -> Column:
    """A row's digest: each field as its UTF-8 byte count, a colon and its value, or as `-` where it is null."""
    texts = (values.get(c, F.col(f"`{c}`")).cast("string") for c in FIELDS)
    return digest(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts))


def _packed(hexes: Column) -> Column:
    return F.unhex(hexes)


def _hex(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _parents(nodes: Column) -> Column:
    at = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(at, lambda k: digest(F.get(nodes, k * 2), F.coalesce(F.get(nodes, k * 2 + 1), F.lit(""))))


def _grown(nodes: Column, block: Column) -> Column:
    """The levels of an aligned subtree, from its stored descendants to its top.

    A tree's only subtree ends where one node is left; where a tree has several, each has STEP levels. A first subtree
    of fewer than 2^STEP nodes is the only one, and one of 2^STEP nodes has STEP levels anyway.
    """
    def add(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when((block > 0) | (F.size(top) > 1), F.concat(levels, F.array(_parents(top)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.array(nodes), add)


def _subtrees(level: DataFrame) -> DataFrame:
    """(tree, block, nodes): stored nodes by the subtree they lie in, in order; nodes keep their other columns."""
    rest = [c for c in level.columns if c != "tree"]
    node = F.struct("pos", *(F.col(c) for c in rest if c != "pos"))
    return level.groupBy("tree", F.shiftright("pos", STEP).alias("block")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The persisted levels above leaves (tree, pos, digest): the last one has one node for each tree."""
    level, out = leaves.select("tree", "pos", "digest"), []
    while (level.agg(F.max("pos")).first()[0] or 0) > 0:
        blocks = _subtrees(level).withColumn("digests", F.transform("nodes", lambda x: _hex(x["digest"])))
        top = F.element_at(F.element_at(_grown(F.col("digests"), F.col("block")), -1), 1)
        level = stage(blocks.select("tree", F.col("block").alias("pos"), _packed(top).alias("digest")))
        out.append(level)
    return out


@dataclass
class Manifest:
    """Persisted levels, lowest first: of the trees, and of the tree whose leaves are their roots."""

    trees: list[DataFrame]
    roots: list[DataFrame]

    def root(self) -> str | None:
        """The dataset's digest."""
        row = self.roots[-1].select(_hex(F.col("digest"))).first()
        return row and row[0]

    def save(self, path: str) -> None:
        """Write the persisted levels as Parquet: path/trees/level=8 and so on."""
        for name, levels in (("trees", self.trees), ("roots", self.roots)):
            for k, level in enumerate(levels):
                level.write.mode("overwrite").parquet(f"{path}/{name}/level={k * STEP}")


def manifest(leaves: DataFrame) -> Manifest:
    """Build the trees over leaves (tree: a string, pos from 0 without gaps, digest: binary, and any more columns)."""
    trees = [leaves, *_levels(leaves)]
    subroots = trees[-1].select("tree", "digest").select(F.lit("").alias("all"), F.col("tree").alias("own"), "digest")
    placed = numbered(subroots, "all", ["own"]).select(F.col("all").alias("tree"), "pos", "digest", "own")
    return Manifest(trees, [placed, *_levels(placed)])


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's rows with path: the siblings on the way up from each, and with the other columns of tops.

    tops has (tree, pos, path) and more for the top of each tree. A path's entry has whether the sibling is to the left,
    and its digest, null where a node has none.
    """
    carried = [c for c in tops.columns if c not in ("tree", "pos", "path")]
    paths = tops
    for level in reversed(levels):
        rest = [c for c in level.columns if c not in ("tree", "pos")]
        above = paths.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), *carried)
        blocks = _subtrees(level).join(above, ["tree", "block"])
        blocks = blocks.withColumn("digests", F.transform("nodes", lambda x: _hex(x["digest"])))
        blocks = blocks.withColumn("grown", _grown(F.col("digests"), F.col("block")))
        steps = F.slice(F.sequence(F.lit(0), F.lit(STEP - 1)), F.lit(1), F.size("grown") - 1)

        def siblings(at: Column) -> Column:
            def one(k: Column) -> Column:
                node = F.call_function("shiftright", at, k)
                return F.struct((node % 2 == 1).alias("left"), F.get(F.get(F.col("grown"), k), node.bitwiseXOR(F.lit(1))).alias("digest"))

            return F.transform(steps, one)

        each = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), siblings(i).alias("own")))
        rows = blocks.select("tree", "above", *carried, F.explode(each).alias("x"))
        if level is not levels[0]:
            rest = []
        paths = rows.select("tree", F.col("x.node.pos").alias("pos"), *(F.col(f"x.node.{c}").alias(c) for c in rest), F.concat("x.own", "above").alias("path"), *carried)
    return paths


def proofs(built: Manifest) -> DataFrame:
    """All leaves with subroot, root (hex) and path, the siblings on the way from a leaf to the root."""
    none = F.array().cast("array<struct<left: boolean, digest: string>>")
    top = built.roots[-1].select("tree", F.col("pos"), none.alias("path"), _hex(F.col("digest")).alias("root"))
    roots = _down(built.roots, top).select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", _hex(F.col("digest")).alias("subroot"), "root")
    return _down(built.trees, roots)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    def up(now: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.when(s["left"], digest(other, now)).otherwise(digest(now, other))

    return F.aggregate(path, start, up)


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings one after another."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["digest"], F.lit(""))), ""), 256)


def tree_of(lang: Column) -> Column:
    """A language as the name of its tree: never null, and in the order of languages with null first."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = crc32_text(F.col("doc_id").cast("string")) % TAMPERED == 0
    changed = F.when(hit, _packed(leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)))
    rows = docs.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id"), _packed(leaf()).alias("digest"), changed.alias("changed"))
    rows = proofs(manifest(numbered(rows, "tree", ["doc_id", "digest"])))
    out = rows.select(
        "doc_id",
        _hex(F.col("digest")).alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(_hex(F.coalesce("changed", "digest")), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _row(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: CRC-32 of a decimal number's text, as DuckDB has no function for it.
CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""

SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_row("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC.format("doc_id")} % 7 = 0 THEN {_row("(n_chars::hugeint + 1)")} ELSE {_row("n_chars")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree
  FROM rows_),
up AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY tree, level, pos // 2),
tops AS (
  SELECT 0 AS level, tree - 1 AS pos, digest, (SELECT max(tree) FROM leaves) AS n FROM up WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
fold_ AS (
  SELECT doc_id, leaf, tree, pos AS at, 0 AS level, n, FALSE AS above, changed AS now, '' AS sibs FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree,
    CASE WHEN f.n = 1 THEN f.tree - 1 ELSE f.at // 2 END,
    CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END,
    CASE WHEN f.n = 1 THEN (SELECT max(tree) FROM leaves) ELSE (f.n + 1) // 2 END,
    f.above OR f.n = 1,
    CASE WHEN f.n = 1 THEN f.now WHEN f.at % 2 = 1 THEN sha256(s.digest || f.now) ELSE sha256(f.now || coalesce(s.digest, '')) END,
    CASE WHEN f.n = 1 THEN f.sibs ELSE f.sibs || coalesce(s.digest, '') END
  FROM fold_ f LEFT JOIN (SELECT FALSE AS above, tree, level, pos, digest FROM up UNION ALL SELECT TRUE, NULL, level, pos, digest FROM tops) s
    ON s.above = f.above AND (f.above OR s.tree = f.tree) AND s.level = f.level AND s.pos = xor(f.at, 1)
  WHERE NOT (f.above AND f.n = 1))
SELECT f.doc_id, f.leaf, u.digest AS subroot, t.digest AS root, sha256(f.sibs) AS proof_sha256, f.now AS folded_root, f.now = t.digest AS verified
FROM fold_ f JOIN (SELECT tree, digest FROM up WHERE n = 1) u ON u.tree = f.tree CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
WHERE f.above AND f.n = 1
"""
