"""A Merkle manifest of a dataset, in which an aligned block of nodes keeps each of its levels as one hex string.

Leaves are numbered inside their group over range-partitioned slices and gathered into aligned blocks of ``fanout ** levels`` leaves.
The nodes of a block's level stand in one string, 64 hex digits each: substrings of ``64 * fanout`` digits hash to the parents, and the
digits left and right of a node inside its run are its siblings. The roots of the blocks are the nodes of the next round, until
each group is one block; the roots of the groups then form a tree of their own. Paths go down the same rounds by
joins of blocks with their parents, one row on either side, so a group with a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.ordered import position
from pageloom.session import stage

FANOUT, LEVELS = 16, 2
HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NO_PATH = "CAST(array() AS ARRAY<STRUCT<l: STRING, r: STRING>>)"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its value, or a dash if null."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*told), 256)


def _level(j: int) -> str:
    return f"level{j}"


def _steps(j: int, fanout: int) -> str:
    """Whether the nodes of level j are hashed further: a block that is full or not the first is not alone in its group."""
    return f"(block > 0 OR size > {fanout**j})"


def _blocks(nodes: DataFrame, payload: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """Nodes (key, at, hash, payload…) as (key, block, size, members, level0…), with the strings of all levels."""
    span, run = fanout**levels, HEX * fanout
    members = F.array_sort(F.collect_list(F.struct("at", "hash", *payload)))
    made = nodes.groupBy("key", F.expr(f"at DIV {span}").alias("block")).agg(members.alias("members"), F.count("*").alias("size"))
    made = made.withColumn(_level(0), F.expr("array_join(transform(members, m -> m.hash), '')"))
    for j in range(levels):
        own = _level(j)
        parents = f"array_join(transform(sequence(0L, (length({own}) - 1) DIV {run}), i -> sha2(substring({own}, CAST(i * {run} + 1 AS INT), {run}), 256)), '')"
        made = made.withColumn(_level(j + 1), F.expr(f"IF({_steps(j, fanout)}, {parents}, {own})"))
    return made


def _climb(nodes: DataFrame, payload: Sequence[str], fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds, lowest first, and the root of each key (key, root)."""
    rounds: list[DataFrame] = []
    while True:
        blocks = stage(_blocks(nodes, payload, fanout, levels), "blocks")
        rounds.append(blocks)
        if blocks.filter("block > 0").isEmpty():
            return rounds, blocks.select("key", F.col(_level(levels)).alias("root"))
        nodes, payload = blocks.select("key", F.col("block").alias("at"), F.col(_level(levels)).alias("hash")), ()


def _descend(rounds: list[DataFrame], above: DataFrame, carried: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """Per node of the lowest round (key, at, hash, payload…) its path of siblings up through ``above`` (key, path, carried…).

    A path is an array of (l, r), the digits left and right of the node on each level.
    """
    span, run = fanout**levels, HEX * fanout
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        sides = []
        for j in range(levels):
            at, own = f"((m.at % {span}) DIV {fanout**j})", _level(j)
            left = f"substring({own}, CAST({at} DIV {fanout} * {run} + 1 AS INT), CAST({at} % {fanout} * {HEX} AS INT))"
            right = f"substring({own}, CAST(({at} + 1) * {HEX} + 1 AS INT), CAST(({fanout - 1} - {at} % {fanout}) * {HEX} AS INT))"
            sides.append(f"IF({_steps(j, fanout)}, array(struct({left} AS l, {right} AS r)), {_NO_PATH})")
        placed = f"transform(members, m -> struct(m AS node, concat({', '.join(sides)}) AS own))"
        found = blocks.join(upper, ["key", "block"]).select("key", F.explode(F.expr(placed)).alias("m"), "path", *carried)
        found = found.select("key", "m.node.*", F.concat("m.own", "path").alias("path"), *carried)
        upper = found.withColumnRenamed("at", "block")
    return found


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, forged: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Merkle tree over all rows: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields``. Per ``group`` the leaves ascend by ``order`` (null first, equal ones by leaf); while
    several nodes remain, each run of ``fanout`` becomes the hash of its concatenated digits. The roots of the groups, ordered by group (null first),
    form the last tree in the same way. The proof is the hash of all siblings on the way up; ``folded_root`` is the root recomputed from
    ``forged``, the leaf hash of what is checked (null: the leaf itself), and these siblings.

    Null values have a form of their own in a leaf, texts of any length are hashed where they are read and never moved, repeated rows are
    leaves of their own. An empty table gives no rows. Columns that are not named are not read.
    """
    leaves = docs.select(
        F.col(order).alias("order"),
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("key"),
        leaf_hash(*map(F.col, fields)).alias("hash"),
        forged.alias("forged"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = position(leaves, ["key"], [F.asc_nulls_first("order"), F.col("hash"), F.col("row")], "at")
    nodes = ranked.select("key", (F.col("at") - 1).alias("at"), "hash", "order", "forged")
    rounds, subroots = _climb(nodes, ["order", "forged"], fanout, levels)

    groups = subroots.select(F.lit(0).alias("all"), F.col("key").alias("group"), "root")
    placed = position(groups, ["all"], [F.col("group")], "at")
    tops, roots = _climb(placed.select(F.col("all").alias("key"), (F.col("at") - 1).alias("at"), F.col("root").alias("hash"), "group"), ["group"], fanout, levels)
    top_paths = _descend(tops, roots.withColumn("path", F.expr(_NO_PATH)), ["root"], fanout, levels)
    above = stage(top_paths.select(F.col("group").alias("key"), F.col("hash").alias("subroot"), "path", "root"), "tops")

    found = _descend(rounds, above, ["subroot", "root"], fanout, levels)
    folded = F.expr("aggregate(path, coalesce(forged, hash), (node, p) -> sha2(concat(p.l, node, p.r), 256))")
    return found.select(
        F.col("order").alias(order),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.expr("sha2(array_join(transform(path, p -> concat(p.l, p.r)), ''), 256)").alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_letters(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)
