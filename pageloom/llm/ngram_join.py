"""Documents linked by the Jaccard similarity of their word n-grams: a grouped prefix join.

Two sets that are similar enough share an element among the first few of both, whatever the common order.
The order puts the most frequent shingles last, so that a passage which many documents carry links none of
them to all others. Documents with the same set are one class; classes with the same prefix and size are one
group. Candidate pairs of groups come from shared prefix elements under the size and position bounds,
are expanded into their classes and verified on the whole sets.

Verifying goes in rounds. First each group is compared with its likeliest neighbour by size and its likeliest
hub, the group that has a shared element nearest to its front: at most two pairs per group, which join up large
families of near copies. Then each class with its likeliest hub in another component. Last, classes that are
still in different components are compared, all of them, so no link that would change a component is
lost and no family is written out as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import hashing
from pageloom.llm.components import components
from pageloom.session import stage

SIZE = 5
PERCENT = 80
# the order's list of frequent shingles: it only makes the join cheaper, whatever is in it
FREQUENT = 1 << 19
# so many ids of documents or classes to verify are sent to all tasks; with more the join is Spark's to plan
BROADCAST_IDS = 1_000_000
_COUNTED = 1 << 22  # shingles counted at once in a task
_REPEATED = 3
_SHARE_BITS = 20

_SLOTS = 1 << 22


def _digest(*parts: bytes) -> int:
    state = hashlib.blake2b(digest_size=8)
    for part in parts:
        state.update(part)
    return int.from_bytes(state.digest(), "little", signed=True)


def frequent_shingles(texts: DataFrame, size: int = SIZE, most: int = FREQUENT) -> np.ndarray:
    """The shingles seen in most texts, rarest first: at most ``most``, counted over all rows of ``texts``.

    A task reports what repeats among the texts that it reads together; equal texts there count once. Of the shingles with
    the least count that still has room an even share by hash is taken.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(parts))
        heads = np.flatnonzero(np.concatenate([[len(every) > 0], every[1:] != every[:-1]]))
        values, counts = every[heads], np.diff(np.append(heads, len(every)))
        kept = counts >= _REPEATED
        return pa.RecordBatch.from_arrays(
            [pa.array(values[kept].view(np.int64)), pa.array(counts[kept].astype(np.int64))], ["token", "rows"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            parts.append(hashing.shingles(batch.column(0).unique(), size)[0])
            if sum(map(len, parts)) >= _COUNTED:
                yield counted(parts)
                parts = []
        if parts:
            yield counted(parts)

    every = texts.mapInArrow(count, "token long, rows long").groupBy("token").agg(F.sum("rows").alias("rows"))
    every = stage(every, "repeated")
    room, least, share = most, 0, 1 << _SHARE_BITS
    for rows, tokens in every.groupBy("rows").agg(F.count("*")).orderBy(F.desc("rows")).collect():
        if tokens >= room:
            least, share = rows, (room << _SHARE_BITS) // tokens
            break
        room -= tokens
    part = F.col("token").bitwiseAND((1 << _SHARE_BITS) - 1) < share
    found = every.filter((F.col("rows") > least) | (F.col("rows") == least) & part).toArrow()
    tokens, rows = (found.column(c).to_numpy() for c in ("token", "rows"))
    return tokens[np.lexsort((tokens, -rows))[:most]][::-1].view(np.uint64)


def prefix_length(count: int, percent: int) -> int:
    """How many first elements of a set of ``count`` must meet those of any set similar enough."""
    return count - -(-percent * count // 100) + 1


def _prefixes(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(id, text) → (id, n, cls, grp, prefix): the set's size, its digest, its prefix with size as digest and as list."""
    ranked = np.argsort(frequent)
    known = frequent[ranked]
    slots = np.zeros(_SLOTS, dtype=bool)
    slots[(known & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def ordered(values: np.ndarray) -> np.ndarray:
        """A sorted set in the common order."""
        maybe = np.flatnonzero(slots[(values & np.uint64(_SLOTS - 1)).astype(np.int64)])
        if not maybe.size:
            return values
        place = np.searchsorted(known, values[maybe])
        place[place == len(known)] = 0
        hit = known[place] == values[maybe]
        maybe, place = maybe[hit], place[hit]
        rest = np.ones(len(values), dtype=bool)
        rest[maybe] = False
        return np.concatenate([values[rest], values[maybe[np.argsort(ranked[place])]]])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, bounds = hashing.shingles(batch.column(1), size)
            counts, sets, groups, lists = [], [], [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                values = hashing.distinct(runs[low:high])
                n = len(values)
                head = ordered(values)[: prefix_length(n, percent)] if n else values
                counts.append(n)
                sets.append(_digest(values.tobytes()))
                groups.append(_digest(n.to_bytes(8, "little"), head.tobytes()))
                lists.append(head)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(sets, pa.int64()),
                    pa.array(groups, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ],
                ["id", "n", "cls", "grp", "prefix"],
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            *(T.StructField(name, T.LongType()) for name in ("n", "cls", "grp")),
            T.StructField("prefix", T.ArrayType(T.LongType())),
        ]
    )
    return docs.mapInArrow(prefix, schema)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, elements) of the classes in ``wanted`` (id, cls): the whole sorted set of one of the documents."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, bounds = hashing.shingles(batch.column(0), size)
            sets = [hashing.distinct(runs[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_digest, sets), pa.int64()), pa.array(sets, pa.binary())], ["cls", "elements"]
            )

    wanted = stage(wanted, "wanted")
    ids = wanted.select(F.col("id").alias("wanted")).distinct()
    if wanted.count() <= BROADCAST_IDS:  # else the texts are shuffled, or whatever Spark finds cheaper
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    found = texts.mapInArrow(whole, "cls long, elements binary")
    return stage(found.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    """(cls) of the pairs (a, b); each side is made distinct first, as a class may be in very many pairs."""
    sides = (pairs.select(F.col(side).alias("cls")).distinct() for side in "ab")
    return next(sides).unionAll(next(sides)).distinct()


def _possible(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough, which all similar ones do."""
    named = _ends(pairs)
    if 2 * pairs.count() <= BROADCAST_IDS:  # else the prefixes of all documents are shuffled
        named = F.broadcast(named)
    heads = rows.select("cls", "n", "prefix").join(named, "cls", "left_semi").dropDuplicates(["cls"])
    left, right = (heads.select(*(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "prefix"))) for x in "ab")
    met = pairs.join(left, F.col("a") == F.col("cls_a")).join(right, F.col("b") == F.col("cls_b"))
    return met.filter(_enough("size(array_intersect(prefix_a, prefix_b))", "n_a", "n_b", percent)).select("a", "b")


def _verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    pairs = stage(_possible(rows, pairs, percent), "possible")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                one = np.frombuffer(left.as_buffer(), dtype=np.uint64)
                two = np.frombuffer(right.as_buffer(), dtype=np.uint64)
                both = np.concatenate([one, two])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    named = _ends(pairs)
    sets = _sets(docs, classes.join(named, "cls", "left_semi").select("id", "cls"), size)
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return stage(joined.mapInArrow(similar, "a long, b long"), "links")


def _enough(common: str, n_a: str, n_b: str, percent: int) -> str:
    """Bound from all elements that two prefixes share: what is left of the prefix that ends first comes on top."""
    rest = "greatest({}, {})".format(*(f"(({percent} * {n} + 99) DIV 100 - 1)" for n in (n_a, n_b)))
    return f"({common} + {rest}) * {100 + percent} >= {percent} * ({n_a} + {n_b})"


def _first_shared(n_a: str, n_b: str, pos_a: str, pos_b: str, percent: int) -> str:
    """Size bound (a is not larger), and what two sets can share if this is the first element that both have.

    That first one of a similar pair always passes, so asking it of each shared element loses no pair.
    """
    return (
        f"100 * {n_a} >= {percent} * {n_b} AND "
        f"least({n_a} - {pos_a}, {n_b} - {pos_b}) * {100 + percent} >= {percent} * ({n_a} + {n_b})"
    )


def _hub_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Each posting with the one that has its element nearest to the front: the least edited of a family of near copies."""
    hubs = posted.groupBy("token").agg(F.min(F.struct("pos", "n", "cls")).alias("hub"))
    pairs = posted.join(hubs, "token").filter("cls <> hub.cls")
    if "label" in posted.columns:  # only those of other components
        own = posted.select(F.col("cls").alias("hub_cls"), F.col("label").alias("hub_label")).distinct()
        pairs = pairs.join(own, F.col("hub.cls") == F.col("hub_cls")).filter("label <> hub_label")
    pairs = pairs.filter(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    return pairs.select(F.col("hub.cls").alias("a"), F.col("hub.n").alias("n_a"), F.col("cls").alias("b"), F.col("n").alias("n_b"))


def _likeliest(pairs: DataFrame, percent: int) -> DataFrame:
    """For each b the a that it meets under most elements, if those are not far too few: at most one pair per class."""
    counted = pairs.groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("common"))
    counted = counted.filter(_enough("4 * common", "n_a", "n_b", percent))
    best = counted.groupBy("b").agg(F.max(F.struct("common", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def _apart(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their component, under elements that more than one component has."""
    named = posted.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "token", "pos", "n", "cls", F.coalesce("label", "cls").alias("label")
    )
    split = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
    return named.join(split, "token")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def ngram_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: the id column, ``n_shingles``, ``set_id`` (equal sets have the same), ``component_id``.

    Documents link when the intersection of their shingle sets is at least ``percent`` of the union;
    ``component_id`` is the smallest id reachable by links. Words are runs of anything but ASCII white
    space, A-Z lower-cased. A null or empty text has no shingles, ``n_shingles`` 0 and its own id. A null id
    takes part but names nothing: a component of such rows alone has a null ``component_id``. Rows that repeat an id are
    documents of their own with that id. Other columns are not looked at. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    frequent = frequent_shingles(docs.select("text"), size)
    rows = stage(_prefixes(docs, frequent, size, percent), "prefixes")
    filled = rows.filter("n > 0")
    classes = filled.groupBy("cls", "n", "grp").agg(F.min("id").alias("id"))
    group = Window.partitionBy("n", "grp")
    classes = stage(
        classes.withColumns({"rep": F.min("cls").over(group), "before": F.lag("cls").over(group.orderBy("cls"))}).drop("grp"), "classes"
    )

    groups = filled.groupBy("n", "grp").agg(
        F.first("prefix").alias("prefix"), F.min("cls").alias("low"), F.max("cls").alias("high")
    )
    posted = groups.select(
        "n", F.col("low").alias("rep"), (F.col("low") != F.col("high")).alias("many"), F.posexplode("prefix").alias("pos", "token")
    )
    along = Window.partitionBy("token").orderBy("n", "rep")
    near = {f"{name}_before": F.lag(name).over(along) for name in ("rep", "n", "pos")}
    shared = stage(
        posted.withColumns(near | {"after": F.lead("rep").over(along)})
        .filter("many OR rep_before IS NOT NULL OR after IS NOT NULL")
        .drop("after"),
        "postings",
    )

    before = shared.filter(_first_shared("n_before", "n", "pos_before", "pos", percent))
    before = before.select(F.col("rep_before").alias("a"), F.col("n_before").alias("n_a"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
    inside = classes.select(F.col("before").alias("a"), F.col("cls").alias("b"))
    hubs = _hub_pairs(shared.select("token", "pos", "n", F.col("rep").alias("cls")), percent)
    likely = _likeliest(before, percent).unionAll(_likeliest(hubs, percent)).unionAll(inside.filter("a IS NOT NULL"))
    links = _verified(docs, rows, classes, stage(likely.distinct(), "likely"), size, percent)
    labels = stage(components(links), "labels")

    posted = shared.select("token", "pos", "n", "rep").join(classes.select("rep", "n", "cls"), ["rep", "n"])
    members = stage(_apart(posted, labels), "members")
    hubs = _hub_pairs(members, percent)
    more = _verified(docs, rows, classes, stage(_likeliest(hubs, percent), "likely"), size, percent)
    labels = stage(components(_stars(labels).unionAll(more)), "labels")
    members = stage(_apart(members.drop("label"), labels), "members")
    one, two = members.alias("p"), members.alias("q")
    apart = one.join(two, F.expr("p.token = q.token")).filter(
        "p.label <> q.label AND (p.n < q.n OR p.n = q.n AND p.cls < q.cls) AND " + _first_shared("p.n", "q.n", "p.pos", "q.pos", percent)
    )
    second = apart.select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).distinct()
    more = _verified(docs, rows, classes, stage(second, "apart"), size, percent)
    labels = stage(components(_stars(labels).unionAll(more)), "labels")

    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "n", "id", F.coalesce("label", "cls").alias("label")
    )
    names = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = stage(named.join(names, "label").select("cls", "n", "component_id"), "named")
    out = rows.select("id", "n", "cls").join(named, ["cls", "n"], "left")
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("cls")).alias("set_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
