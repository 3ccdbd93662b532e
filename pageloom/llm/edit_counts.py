"""Token counts that follow edits: a segment tree of counts per document, of which only touched parts are encoded again.

Leaves are runs of whole pre-tokens: a text is cut before a space that stands between two other characters, where
a pre-token always begins whatever comes before or after. A cut stays one as long as the three characters around
it do, so an edit touches the leaves from the last such cut before it to the first after it. Those are
joined, edited, cut and encoded anew, and the sums on the way from their leaves to the root are
updated; nothing else of the text is encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.tokens import Encoder, encoder

LEAF_CHARS = 256
_AT_ONCE = 1 << 20  # characters encoded at once in a task
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")

EDITS = "array<struct<start:int,end:int,replacement:string>>"


def leaves(text: str, least: int = LEAF_CHARS) -> list[int]:
    """Where leaves begin: at 0 and at cuts that leave at least ``least`` characters before them."""
    begins, at = [0], least
    while found := _CUT.search(text, max(1, at)):
        begins.append(found.start())
        at = found.start() + least
    return begins if text else []


def tree_of(counts: np.ndarray) -> np.ndarray:
    """Sums in heap order: the root at 1, leaves from half of the length on."""
    width = 1 << max(0, (len(counts) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width : width + len(counts)] = counts
    while width > 1:
        tree[width // 2 : width] = tree[width : 2 * width].reshape(-1, 2).sum(axis=1)
        width //= 2
    return tree


def _merged(edits: Sequence[tuple[int, int, str]], begins: np.ndarray, length: int) -> list[tuple[int, int, list]]:
    """(first leaf, leaf after the last, edits) of touched regions, in order and apart from each other."""
    regions: list[tuple[int, int, list]] = []
    for start, end, text in edits:
        first = max(0, int(np.searchsorted(begins, start - 2, side="right")) - 1)
        last = int(np.searchsorted(begins, end + 1))
        if regions and first < regions[-1][1]:
            regions[-1] = (regions[-1][0], max(last, regions[-1][1]), [*regions[-1][2], (start, end, text)])
        else:
            regions.append((first, last, [(start, end, text)]))
    return regions


def valid_edits(edits, length: int) -> list[tuple[int, int, str]]:
    """The edits inside a text in order: bounds are cut to it; one that overlaps an earlier one, or is null, is left out."""
    out: list[tuple[int, int, str]] = []
    for e in sorted((e for e in edits or () if e and e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"])):
        start, end = max(0, e["start"]), min(length, e["end"])
        if start <= end and start <= length and (not out or start >= out[-1][1]):
            out.append((start, end, e["replacement"] or ""))
    return out


def apply_edits(text: str, begins: np.ndarray, tree: np.ndarray, edits: list[tuple[int, int, str]], encode) -> tuple[str, int]:
    """The edited text and how many characters were encoded again; ``tree`` is updated in place.

    ``encode`` gives the number of ids of each of a list of texts. A region's new leaves share the place of its first one.
    """
    if not len(begins):  # an empty text: all that is inserted is new
        new = "".join(t for _, _, t in edits)
        tree[1:2] = encode([new]) if new else 0
        return new, len(new)
    regions = _merged(edits, begins, len(text))
    ends = np.append(begins, len(text))
    parts, pieces, places, at, width = [], [], [], 0, len(tree) // 2
    for first, last, own in regions:
        low, high = int(begins[first]), int(ends[last])
        parts.append(text[at:low])
        inner, here = [], low
        for start, end, replacement in own:
            inner += [text[here:start], replacement]
            here = end
        region = "".join([*inner, text[here:high]])
        parts.append(region)
        cuts = leaves(region)
        new = [region[a:b] for a, b in zip(cuts, [*cuts, len(region)][1:], strict=True)] if region else []
        pieces += new
        places.append((first, last, len(new)))
        at = high
    parts.append(text[at:])
    counts, done = encode(pieces), 0
    for first, last, amount in places:
        tree[width + first : width + last] = 0
        tree[width + first] = int(sum(counts[done : done + amount]))
        done += amount
        low, high = (width + first) // 2, (width + last - 1) // 2
        while low:
            tree[low : high + 1] = tree[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
            low, high = low // 2, high // 2
    return "".join(parts), sum(map(len, pieces))


def _counts(made: Encoder, pieces: list[str]) -> np.ndarray:
    """How many ids each piece has. Encoded in runs of pieces, so that the ids of a whole batch are never held at once."""
    counts, begin, size = [np.zeros(0, np.int64)], 0, 0
    for end, piece in enumerate(pieces, 1):
        size += len(piece)
        if size >= _AT_ONCE or end == len(pieces):
            counts.append(np.diff(made.encode(pa.array(pieces[begin:end], pa.large_string()))[1]))
            begin, size = end, 0
    return np.concatenate(counts)


def build_trees(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``leaf_begins`` and ``token_tree``, both arrays of int: what later edits need.

    A null or empty text has no leaves and a tree of nothing. Existing columns of these names are replaced.
    """

    @F.pandas_udf("leaf_begins array<int>, token_tree array<int>")
    def built(texts):
        import pandas as pd

        made = encoder(tokenizer)
        begins = [leaves(text) for text in texts]
        cut = [text[a:b] for text, own in zip(texts, begins, strict=True) for a, b in zip(own, [*own, len(text)][1:], strict=True)]
        counts, done, trees = _counts(made, cut), 0, []
        for own in begins:
            trees.append(tree_of(counts[done : done + len(own)]).astype(np.int32))
            done += len(own)
        return pd.DataFrame({"leaf_begins": [np.array(b, dtype=np.int32) for b in begins], "token_tree": trees})

    made = docs.withColumn("_built", built(F.coalesce(F.col(text_column).cast("string"), F.lit(""))))
    return made.withColumns({"leaf_begins": F.col("_built.leaf_begins"), "token_tree": F.col("_built.token_tree")}).drop("_built")


def edited_counts(
    trees: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", edits_column: str = "edits"
) -> DataFrame:
    """The id column, edited ``text``, its ``token_tree``, ``tokens_before``, ``tokens_after``, ``edits_applied``, ``reencoded_chars``.

    ``trees`` comes from :func:`build_trees` and has an array of (start, end, replacement) per row, in code points of the
    text as it is there; null is no edit. See :func:`valid_edits` for odd ones. A null text counts as empty, so
    an insertion gives it a text. The tree that comes out has the old leaves' places, with the counts of what stands
    there now. Each row is on its own, whether or not ids or rows repeat. An empty table gives no rows.
    """
    rows = trees.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), "leaf_begins", "token_tree",
        F.col(edits_column).cast(EDITS).alias("edits"),
    )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, columns = encoder(tokenizer), [[] for _ in range(6)]
            for text, begins, tree, edits in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                text = text.as_py()
                tree = tree.values.to_numpy(zero_copy_only=False).astype(np.int64)
                begins = begins.values.to_numpy(zero_copy_only=False)
                before, again, own = int(tree[1]), 0, valid_edits(edits.as_py(), len(text))
                if own:
                    text, again = apply_edits(text, begins, tree, own, lambda pieces: _counts(made, pieces))
                for column, value in zip(columns, (text, tree, before, int(tree[1]), len(own), again), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.list_(pa.int32()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    longs = ("tokens_before", "tokens_after", "edits_applied", "reencoded_chars")
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("token_tree", T.ArrayType(T.IntegerType())),
            *(T.StructField(name, T.LongType()) for name in longs),
        ]
    )
    names = schema.names
    return rows.mapInArrow(edit, schema).withColumnRenamed("id", id_column)
