"""Operator 12: a Merkle manifest of a dataset: leaves, a tree per source, a tree over the sources, and proofs.

A row's leaf is the SHA-256 of its columns, each with its length. The leaves of a group (a source) stand in the order
of doc_id and are joined ``FAN`` by ``FAN`` until one node, the group's subroot, remains; the subroots, ordered by
group, are joined alike up to the root. All groups rise together, one level at a time: every node computes the
indices of its siblings by shifting its slot inside its run, finds them by equi-joins of the level with itself, and the
node in slot zero emits the parent. Coming down again, a node's path is its own step (the digests before and behind
it in its run) followed by its parent's path, so each level is joined once and the digests of a whole path are never
looked up leaf by leaf.

A leaf's index is its global rank by (group, doc_id, leaf, row) minus that of its group's first row: ranges and
prefix sums, so a hot group is spread over tasks. A level's table has a third of the rows of the level below.

Edge cases: a null column is told apart from an empty one; a null doc_id or group comes first; rows that share a
doc_id stand side by side, ordered by their leaves; equal rows are leaves each; a table of one row has its leaf as
root; an empty table gives no row. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import ranked
from .registry import query, table, written

FAN = 3
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<before: binary, after: binary>"


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon, and its text; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 (32 bytes) of texts side by side."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def levels(nodes: DataFrame, fan: int, name: str) -> list[DataFrame]:
    """All levels of the trees of ``nodes`` (``_tree``, ``_index``, ``_n`` nodes in the tree, ``_digest``; more columns stay).

    Each level has ``_before`` and ``_after``, the digests of the node's siblings side by side. A tree's root is its
    node with ``_n`` 1; it has no siblings and appears in no level above.
    """
    found = []
    most = nodes.agg(F.max("_n")).first()[0] or 0
    while True:
        slot = F.pmod(F.col("_index"), F.lit(fan))
        level = nodes.withColumn("_slot", slot)
        for shift in range(1, fan):
            wanted = F.col("_index") - F.col("_slot") + F.pmod(F.col("_slot") + shift, F.lit(fan))
            sibling = nodes.where("_n > 1").select(
                F.col("_tree"), F.col("_index").alias("_sibling"), F.col("_digest").alias(f"_shift{shift}")
            )
            level = level.withColumn("_sibling", wanted).join(sibling, ["_tree", "_sibling"], "left").drop("_sibling")
        shifts = F.array(F.col("_digest"), *[F.col(f"_shift{s}") for s in range(1, fan)])
        at = [F.coalesce(F.get(shifts, F.pmod(F.lit(j) - F.col("_slot"), F.lit(fan)).cast("int")), F.lit(b"")) for j in range(fan)]
        before = [F.when(F.lit(j) < F.col("_slot"), d).otherwise(F.lit(b"")) for j, d in enumerate(at)]
        after = [F.when(F.lit(j) > F.col("_slot"), d).otherwise(F.lit(b"")) for j, d in enumerate(at)]
        level = level.select(*nodes.columns, "_slot", F.concat(*before).alias("_before"), F.concat(*after).alias("_after"))
        found.append(written(level, f"{name}-{len(found)}"))
        if most <= 1:
            return found
        most = -(-most // fan)
        nodes = found[-1].where("_slot = 0 and _n > 1").select(
            "_tree", F.floor(F.col("_index") / fan).alias("_index"), F.ceil(F.col("_n") / fan).alias("_n"),
            digest(hexed(F.col("_digest")), hexed(F.col("_after"))).alias("_digest"),
        )


def paths(found: list[DataFrame], tops: DataFrame, fan: int, name: str) -> DataFrame:
    """The nodes of the lowest level with ``_path`` (steps up to the root of all) and ``_subroot``.

    ``tops`` gives ``_tree`` and ``_top``, the path of a tree's root.
    """
    step = F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))
    below = None
    for k in reversed(range(len(found))):
        roots = found[k].where("_n = 1").join(tops, "_tree")
        roots = roots.select(*found[k].columns, F.col("_top").alias("_path"), F.col("_digest").alias("_subroot"))
        if below is not None:
            inner = found[k].where("_n > 1").withColumn("_up", F.floor(F.col("_index") / fan))
            up = below.select("_tree", F.col("_index").alias("_up"), F.col("_path").alias("_rest"), "_subroot")
            steps = F.concat(F.array(step), F.col("_rest")).alias("_path")
            roots = roots.unionByName(inner.join(up, ["_tree", "_up"]).select(*found[k].columns, steps, "_subroot"))
        below = roots if k == 0 else written(roots.select("_tree", "_index", "_path", "_subroot"), f"{name}-{k}")
    return below


def manifest(
    docs: DataFrame, columns: list[str] = COLUMNS, group: str = "source", order: str = "doc_id", fan: int = FAN,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, ``leaf``, ``path`` (steps from the leaf to the root), ``subroot`` and ``root`` (32 bytes each) of every row.

    ``also`` names columns of the input to hand through, of fixed width as the leaf.
    """
    also = also or {}
    rows = docs.select(
        F.col(order).alias("_order"), F.col(group).alias("_group"), leaf([F.col(c) for c in columns]).alias("_digest"),
        *[value.alias(f"_also_{name}") for name, value in also.items()],
    )
    rows = written(rows, "merkle-leaves").withColumn("_row", F.monotonically_increasing_id())  # a number of the stored row
    placed = ranked(rows, [F.col(c).asc() for c in ("_group", "_order", "_digest", "_row")], "merkle-order").drop("_row")
    groups = placed.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = ranked(groups, [F.col("_first").asc()], "merkle-groups").select(
        F.col("_group").alias("_name"), "_first", "_n", F.col("_rank").alias("_tree")
    )
    here = placed.select("_range", "_group").distinct().join(groups, F.col("_group").eqNullSafe(F.col("_name")))
    here = here.select(F.col("_range").alias("_in"), "_name", "_first", "_n", "_tree")
    same = (F.col("_range") == F.col("_in")) & F.col("_group").eqNullSafe(F.col("_name"))  # a hot group is cut by its ranges
    kept = [f"_also_{name}" for name in also]
    leaves = placed.join(here, same).select("_tree", (F.col("_rank") - F.col("_first")).alias("_index"), "_n", "_digest", "_order", *kept)
    low = levels(written(leaves, "merkle-nodes"), fan, "merkle-level")
    roots = None
    for level in low:
        some = level.where("_n = 1").select("_tree", "_digest")
        roots = some if roots is None else roots.union(some)
    number = groups.count()
    tops = roots.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_index"), F.lit(number).cast("long").alias("_n"), "_digest")
    high = levels(written(tops, "merkle-subroots"), fan, "merkle-top")
    start = high[-1].select(F.lit(0).cast("long").alias("_tree"), F.array().cast(f"array<{STEP}>").alias("_top")).limit(1)
    above = paths(high, start, fan, "merkle-top-paths").select(
        F.col("_index").alias("_tree"), F.col("_path").alias("_top"), F.col("_subroot").alias("_whole")
    )
    above = written(above, "merkle-tops")
    root = above.select("_whole").first()
    found = paths(low, above.select("_tree", "_top"), fan, "merkle-paths")
    return found.select(
        F.col("_order").alias(order), F.col("_digest").alias("leaf"), F.col("_path").alias("path"), F.col("_subroot").alias("subroot"),
        F.lit(bytes(root[0]) if root else b"").alias("root"), *[F.col(f"_also_{name}").alias(name) for name in also],
    )


def folded(start: Column, path: Column) -> Column:
    """The root (32 bytes) that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, step: digest(hexed(step["before"]), hexed(node), hexed(step["after"])))


def proof(path: Column) -> Column:
    """Hex digest of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "").cast("binary"), 256)


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
named AS (
  SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
         list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
                     lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])) AS raw
  FROM documents, crc_table),
parts AS (
  SELECT id, doc_id, source, xor(raw, 4294967295) % 2 = 0 AS cut,
         coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS short
  FROM named),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(CASE WHEN cut THEN strlen(short) || ':' || short ELSE strlen(text) || ':' || text END, '-')) AS seen
  FROM parts),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
low AS (
  SELECT 0 AS level, tree, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM low WHERE n > 1 GROUP BY level, tree, n, idx // 3),
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM high WHERE n > 1 GROUP BY level, n, idx // 3),
low_runs AS (SELECT level, tree, idx // 3 AS run, list(digest ORDER BY idx) AS ds FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS ds FROM high WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT id, 0 AS level, tree, idx, '' AS proof, seen AS folded FROM placed
  UNION ALL
  SELECT id, w.level + 1, w.tree, run, proof || array_to_string(ds[:idx % 3] || ds[idx % 3 + 2:], ''),
         sha256(array_to_string(ds[:idx % 3] || [folded] || ds[idx % 3 + 2:], ''))
  FROM walk w JOIN low_runs r ON r.level = w.level AND r.tree = w.tree AND r.run = w.idx // 3),
low_ends AS (SELECT id, max(level) AS level, tree, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM walk GROUP BY id, tree),
climb AS (
  SELECT id, 0 AS level, tree AS idx, proof, folded FROM low_ends
  UNION ALL
  SELECT id, w.level + 1, run, proof || array_to_string(ds[:idx % 3] || ds[idx % 3 + 2:], ''),
         sha256(array_to_string(ds[:idx % 3] || [folded] || ds[idx % 3 + 2:], ''))
  FROM climb w JOIN high_runs r ON r.level = w.level AND r.run = w.idx // 3),
ends AS (SELECT id, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM climb GROUP BY id)
SELECT doc_id, leaf, subroot, h.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h.digest AS verified
FROM placed JOIN subroots USING (tree) JOIN ends USING (id), (SELECT digest FROM high WHERE n = 1) h
"""


def without_lines(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its line feeds, where the checksum of its doc_id is even; else its own leaf."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(struck, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf([text if c == "text" else F.col(c) for c in COLUMNS])


@query("op12_merkle", SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = manifest(docs, also={"seen": without_lines(docs)})
    found = found.withColumn("_folded", folded(F.col("seen"), F.col("path")))
    return found.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof(F.col("path")).alias("proof_sha256"), hexed(F.col("_folded")).alias("folded_root"),
        (F.col("_folded") == F.col("root")).alias("verified"),
    )
