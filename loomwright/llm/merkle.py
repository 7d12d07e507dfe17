"""A Merkle manifest of a data set: a tree for each group, a tree over their roots, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_lower, shared_dir, written

FANOUT = 16
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """The bytes of a field in a digest: `-` for null, else the number of UTF-8 bytes, `:`, and the value as text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _numbered(nodes: DataFrame, order: list[Column], folder: str, name: str) -> DataFrame:
    """nodes with idx, the place in the order within the group (column _g, first in the order), and n, its size.

    A group of any size spreads over sorted ranges. What meets by group is a row for each range that the group lies in.
    """
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), folder, name)
    runs = ranged.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    return ranged.join(runs, ["_g", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with parent (-1 at the top of a group) and run, the digests of all children of that parent in order."""
    nodes = nodes.withColumn("parent", F.when(F.col("n") > 1, F.expr(f"idx div {fanout}")).otherwise(F.lit(-1)))
    full = Window.partitionBy("_g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("hash").over(full))


def _levels(nodes: DataFrame, folder: str, name: str, fanout: int) -> list[DataFrame]:
    """The nodes (_g, idx, n, hash) of each level; a group ends with the level where one node remains."""
    levels = [nodes.select("_g", "idx", "n", "hash")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = _runs(levels[-1].where("n > 1"), fanout)
        up = runs.select("_g", F.col("parent").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("hash"))
        levels.append(written(up.distinct(), folder, f"{name}{len(levels)}"))
        most = -(-most // fanout)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame, folder: str, name: str, fanout: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of the lowest level with their path: what stands before and after each node on the way up, from the
    lowest, and then the path of the group's top. tops: _g, path, and columns that all nodes of the group get."""
    own = [c for c in tops.columns if c not in ("_g", "path")]
    ends = tops.select("_g", F.lit(-1).cast("bigint").alias("parent"), F.col("path").alias("rest"), *own)
    above, at = ends, F.expr(f"cast(idx % {fanout} as int)")
    for k in range(len(levels) - 1, -1, -1):
        step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fanout)), "").alias("after"))
        path = F.when(F.col("parent") >= 0, F.concat(F.array(step), F.col("rest"))).otherwise(F.col("rest"))
        nodes = _runs(levels[k], fanout).join(above, ["_g", "parent"]).select("_g", "idx", *(("hash", *keep) if k == 0 else ()), path.alias("path"), *own)
        if k:
            above = written(nodes, folder, f"{name}{k}").select("_g", F.col("idx").alias("parent"), F.col("path").alias("rest"), *own).unionByName(ends)
    return nodes


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: Column | None = None, text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """id, leaf, subroot (of the row's group), root, proof_sha256, folded_root and verified, for every row.

    A leaf is the digest of a row's fields. The leaves of a group ascend by id (nulls first; equal ids by leaf, so that
    rows that are alike in all fields may stand in either order); while several nodes remain every `fanout` consecutive
    ones become the digest of their digests. The roots of the groups (null is a group, and the first) go on in the same
    way to the root of the whole. A proof has the siblings of a row's node at each level, from the leaf to the root.

    Rows where `tampered` holds are checked as if A-Z in their text had been lower-cased: folded_root is the root that
    follows from that leaf and the original siblings, and verified tells whether it is the root. null in `tampered` is no.
    Ids and groups may be of any type that can be ordered. Empty tables give no row. Other columns are not read.

    Text is read once and only digests are shuffled: into sorted ranges, whatever the size of a group, and then level
    by level to at most `fanout` children of a parent. Levels are written to the shared folder, so that a lost executor
    costs what it ran.
    """
    folder = shared_dir(docs.sparkSession)
    cols = {c: docs[c] for c in fields}
    nodes = docs.select(docs[id_col].alias("_id"), docs[group_col].alias("_group"), encoded(docs[group_col]).alias("_g"), leaf(*cols.values()).alias("hash"),
        F.when(tampered, leaf(*(ascii_lower(v) if c == text_col else v for c, v in cols.items()))).alias("changed") if tampered is not None else F.lit(None).cast("string").alias("changed"))
    nodes = written(_numbered(nodes.drop("_group"), [F.col("_g"), F.col("_id"), F.col("hash")], folder, "ranged"), folder, "leaves")
    levels = _levels(nodes, folder, "level", fanout)
    subroots = levels[0].where("n = 1")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1"))
    groups = docs.select(encoded(docs[group_col]).alias("_key"), docs[group_col].alias("_group")).distinct()
    subroots = subroots.select(F.col("_g").alias("_key"), "hash").join(groups, "_key").withColumn("_g", F.lit(""))
    tree = written(_numbered(subroots, [F.col("_g"), F.col("_group"), F.col("_key")], folder, "rangedtops").drop("_group"), folder, "tops")
    upper = _levels(tree, folder, "upper", fanout)
    kind = "array<struct<before:string,after:string>>"
    root = upper[-1].select("_g", F.array().cast(kind).alias("path"), F.col("hash").alias("root"))
    tops = _paths([tree, *upper[1:]], root, folder, "down", fanout, keep=("_key",))
    tops = written(tops.select(F.col("_key").alias("_g"), F.col("hash").alias("subroot"), "path", "root"), folder, "subroots")
    rows = _paths([nodes, *levels[1:]], tops, folder, "path", fanout, keep=("_id", "changed"))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "hash"), lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))
    out = rows.select(F.col("_id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
