"""Document fingerprints: a Merkle tree over paragraphs and sections, whose root tells equality and whose branches locate edits.

Paragraphs are the lines of a text, hashed whole. A section ends after an empty line or a paragraph whose digest says so, so an
edit moves no section border but its own. Sections hash their paragraphs and the root hashes the sections.

Below a paragraph lie runs of words, cut where the hash of a word ends in zeros: one digit of base 4 more per level makes runs four times as
long. A run's digest is made from those of the level below, so a fine text can be told at a coarser level. The fingerprint
is the root and the run digests at the finest level with at most ``LEAVES`` runs more than lines; likeness is the share of runs that two have in common.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.hashing import bytes_of, mix, words
from pageloom.session import stage

LEAVES = 64
LONGEST = 16  # a run is made of at most so many of the level below
SECTION_PARAGRAPHS = 8  # a section has so many paragraphs on average

_DIGEST_BITS = 24
_TOP = 9  # levels told apart; the code of a paragraph's end
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_VALUES = np.zeros(256, np.uint64)
_VALUES[_ALPHABET] = np.arange(64, dtype=np.uint64)
_ROOT = 64  # hex digits of the root, then a digit for the level, then the runs
_RUN = 5  # characters of a run: four for its digest, one for the level of its end
_PLACE = np.uint64(0xA0761D6478BD642F)


def _short(values: np.ndarray) -> np.ndarray:
    return mix(values) >> np.uint64(64 - _DIGEST_BITS)


def _merge(digests: np.ndarray, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one level as runs of ``level``, the next: digests, end codes, and the place of each one's first part."""
    last = np.flatnonzero(codes >= level)
    first = np.concatenate([[0], last[:-1] + 1])
    # where no word cuts, as in one word over and over, a run ends at its longest
    longest = (np.arange(len(digests)) - np.repeat(first, last - first + 1)) % LONGEST == LONGEST - 1
    last = np.flatnonzero((codes >= level) | longest)
    first = np.concatenate([[0], last[:-1] + 1])
    sizes = last - first + 1
    place = (np.arange(len(digests)) - np.repeat(first, sizes)).astype(np.uint64)
    told = np.add.reduceat(mix(digests + (place + np.uint64(1)) * _PLACE), first)
    return _short(told + sizes.astype(np.uint64)), codes[last], first


def _sections(paragraphs: list[bytes]) -> list[tuple[int, int]]:
    """Where sections begin and end, of paragraph digests; the digest of an empty line ends one."""
    found, begin = [], 0
    for i, digest in enumerate(paragraphs, 1):
        if i == len(paragraphs) or digest[0] % SECTION_PARAGRAPHS == 0 or digest == _EMPTY_LINE:
            found.append((begin, i))
            begin = i
    return found


def _node(kind: bytes, children: bytes) -> bytes:
    return hashlib.sha256(kind + children).digest()


_EMPTY_LINE = _node(b"p", b"")


def _root(paragraphs: list[bytes]) -> str:
    return _node(b"r", b"".join(_node(b"s", b"".join(paragraphs[a:b])) for a, b in _sections(paragraphs))).hex()


def fingerprints(texts: pa.Array) -> list[str]:
    """Fingerprint of each text; a null is empty."""
    lines = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    flat, bounds = lines.flatten(), lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
    data, places = bytes_of(flat)
    view = memoryview(data)
    leaves = [_node(b"p", view[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
    roots = [_root(leaves[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    hashes, of_line = words(flat)
    digests = _short(hashes)
    cut = mix(hashes ^ _PLACE)
    codes = np.zeros(len(hashes), np.int64)
    for level in range(1, _TOP):
        codes += (cut & np.uint64(4**level - 1)) == 0
    ends = of_line[1:][np.diff(of_line) > 0] - 1
    codes[ends] = _TOP
    rows = np.repeat(np.arange(len(texts)), np.diff(of_line[bounds]))
    enough = LEAVES + np.bincount(rows[ends], minlength=len(texts))  # each line with words is a run at least
    todo = np.bincount(rows, minlength=len(texts)) > 0

    out = [f"{root}0" for root in roots]
    level = 0
    while todo.any():
        told = _written(digests, codes)
        begins = np.searchsorted(rows, np.arange(len(texts) + 1))
        done = todo & ((np.diff(begins) <= enough) | (level == _TOP - 1))
        for row in np.flatnonzero(done):
            out[row] = f"{roots[row]}{level}{told[begins[row] * _RUN : begins[row + 1] * _RUN]}"
        todo &= ~done
        level += 1
        digests, codes, first = _merge(digests, codes, level)
        rows = rows[first]
    return out


def _written(digests: np.ndarray, codes: np.ndarray) -> str:
    signs = np.empty((len(digests), _RUN), np.uint8)
    for i in range(4):
        signs[:, i] = _ALPHABET[(digests >> np.uint64(18 - 6 * i)) & np.uint64(63)]
    signs[:, 4] = codes + ord("0")
    return signs.tobytes().decode("ascii")


def _runs(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    signs = np.frombuffer(fingerprint[_ROOT + 1 :].encode("ascii"), np.uint8).reshape(-1, _RUN)
    digests = np.zeros(len(signs), np.uint64)
    for i in range(4):
        digests = digests << np.uint64(6) | _VALUES[signs[:, i]]
    return int(fingerprint[_ROOT]), digests, signs[:, 4].astype(np.int64) - ord("0")


def likeness(one: str, other: str) -> float:
    """From 0, nothing in common, to 1, which only equal texts have: the share of runs in common, by fingerprints alone."""
    if one[:_ROOT] == other[:_ROOT]:
        return 1.0
    told = [_runs(one), _runs(other)]
    level = max(x[0] for x in told)
    counts = []
    for own, digests, codes in told:
        for step in range(own + 1, level + 1):
            if len(digests):
                digests, codes, _ = _merge(digests, codes, step)
        counts.append(Counter(digests.tolist()))
    total = sum(map(Counter.total, counts))
    return min(2 * (counts[0] & counts[1]).total() / total, 1 - 1 / (total + 1)) if total else 0.0


def edited_paragraphs(before: str, after: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ, as paragraphs (from, to) of the one and (from, to) of the other, found in the differing branches of their trees."""
    sides = []
    for text in (before, after):
        digests = [_node(b"p", x.encode()) for x in text.split("\n")]
        parts = _sections(digests)
        sides.append((digests, [a for a, _ in parts] + [len(digests)], [_node(b"s", b"".join(digests[a:b])) for a, b in parts]))
    (one, of_one, sections), (other, of_other, others) = sides
    found = []
    for kind, a, b, c, d in SequenceMatcher(None, sections, others).get_opcodes():
        if kind == "equal":
            continue
        low, high = of_one[a], of_other[c]
        inner = SequenceMatcher(None, one[low : of_one[b]], other[high : of_other[d]])
        found += [(low + i, low + j, high + k, high + m) for what, i, j, k, m in inner.get_opcodes() if what != "equal"]
    return found


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(texts: list[str], told: list[str], following: list[str], told_next: list[str]) -> dict[str, list]:
    """The result columns of texts with their fingerprints, each with the text that follows and its fingerprint."""
    edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, following, strict=True)]
    told_edited = fingerprints(pa.array(edited, pa.large_string()))
    return {
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
        "fingerprint": told,
        "edited_fingerprint": told_edited,
        "near_edited": [likeness(a, b) for a, b in zip(told, told_edited, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(told, told_next, strict=True)],
    }


def _pieces(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded bytes, a longer text being one of its own."""
    sizes = np.maximum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), 1)
    numbers = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def compare_with_edits(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Each row of docs (``order``, text) against an edit of it and the next row: ``order``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last floor(n / 2) of a text's n code points by as many first ones of the next row's text, or all it has. Next is by ascending
    ``order`` (null first; equal ones by a hash of the text, then the text); after the last row comes the first, for a single row itself. Null texts are empty.
    Empty texts are alike only to empty ones. Repeated rows stay rows of their own; an empty table gives no rows. Other columns are not read.

    Texts are shuffled once, sorted by ranges of (``order``, hash), so many rows of one ``order`` are spread. What the last
    row of a range needs, the first row of the next one, is looked up between edge rows alone, two a range.
    """
    listed = docs.select(F.col(order).alias("order"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.asc_nulls_first("order"), F.xxhash64("text").asc()]
    ranged = listed.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    kind = docs.schema[order].dataType.simpleString()
    layout = f"order {kind}, part int, head boolean, tail boolean, text string, {_RESULT}"
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # held: the last row, whose next is not read yet
        schema = None

        def rows(orders, texts, heads, tail, judged) -> pa.RecordBatch:
            """Rows as a batch; only edge rows keep their text."""
            blank = pa.nulls(len(texts))
            columns = {"order": orders, "part": [part] * len(texts), "head": heads, "tail": [tail] * len(texts)}
            columns["text"] = [x if tail or h else None for x, h in zip(texts, heads, strict=True)]
            columns |= judged or dict.fromkeys(names, blank)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)

        for whole in batches:
            for batch in _pieces(whole):
                if schema is None:
                    of = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True))
                    schema = pa.schema([("order", batch.schema.field("order").type), ("part", pa.int32()), ("head", pa.bool_()), ("tail", pa.bool_()), ("text", pa.string()), *of.items()])
                orders, texts = batch.column("order"), batch.column("text").to_pylist()
                told = fingerprints(batch.column("text"))
                heads = [held is None, *[False] * (len(texts) - 1)]
                if held is not None:
                    orders, texts, told, heads = pa.concat_arrays([held[0], orders]), [held[1], *texts], [held[2], *told], [held[3], *heads]
                if len(texts) > 1:
                    yield rows(orders.slice(0, len(texts) - 1), texts[:-1], heads[:-1], False, _judged(texts[:-1], told[:-1], texts[1:], told[1:]))
                held = orders.slice(len(texts) - 1), texts[-1], told[-1], heads[-1]
        if held is not None:
            yield rows(held[0], [held[1]], [held[3]], True, None)

    told = stage(ranged.mapInArrow(neighbours, layout), "fingerprints")
    heads = told.filter("head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = told.filter("head").select("part")  # one row a range, without its text
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(whole)).alias("next_part"))
    ends = told.filter("tail").select("order", "part", "text").join(after, "part").join(heads, "next_part").select("order", "text", "next_text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text"), batch.column("next_text")
            judged = _judged(texts.to_pylist(), fingerprints(texts), following.to_pylist(), fingerprints(following))
            yield pa.RecordBatch.from_arrays([batch.column("order"), *map(pa.array, judged.values())], names=["order", *judged])

    last = ends.mapInArrow(pairs, f"order {kind}, {_RESULT}")
    return told.filter("NOT tail").select("order", *names).unionByName(last).withColumnRenamed("order", order)
