"""Training documents that contain benchmark items: BM25 over an inverted index of the items, then an overlap check.

Items are indexed, in segments of some 24 to 47 words; every passage of every document, a window of 80 words each 32
words so that any segment lies whole in one, is a query. An item's impacts are divided by the score
that it gives itself, so one threshold holds for all. As in WAND with block maxima, work is skipped by bounds that
never lose a segment above the threshold: a segment's frequent terms together cannot reach half of it, so only passages with enough
of the rarer ones count; blocks of segments are summed by their maxima first; and only blocks whose
bound reaches the threshold are scored. What is retrieved is verified on the words of question and answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import hashing

SIZE = 5
OVERLAP = 0.8
ANSWER_OVERLAP = 0.5
THRESHOLD = 0.4
WINDOW, STRIDE, SEGMENT = 80, 32, 24
K1, B = 1.2, 0.75
BLOCK = 16
# items of one index, which every task holds; more items are searched for index by index
ITEMS = 20_000

# slots a term: few enough for a processor's cache, so many that hardly a word falls into one by chance
_SLOTS_A_TERM = 16


def _csr(owner: np.ndarray, count: int) -> np.ndarray:
    """Where each owner's entries begin in a table sorted by owner."""
    return np.searchsorted(owner, np.arange(count + 1))


def _spread(begins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``of`` all places of its owner's entries: (which entry, place)."""
    counts = begins[of + 1] - begins[of]
    which = np.repeat(np.arange(len(of)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[of], counts)


@dataclass
class Index:
    names: list
    vocabulary: np.ndarray
    slots: np.ndarray
    segment_item: np.ndarray
    segment_begins: np.ndarray  # of each segment's terms
    segment_terms: np.ndarray
    segment_weights: np.ndarray
    rest: np.ndarray  # of each segment: what its frequent terms can give
    posting_begins: np.ndarray  # of each term's segments in which it is not among those
    posting_segments: np.ndarray
    posting_weights: np.ndarray
    block_begins: np.ndarray  # of each term's blocks of such segments
    blocks: np.ndarray
    block_maxima: np.ndarray
    block_rest: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def build_index(names: list, questions: list[str | None], answers: list[str | None], size: int = SIZE, threshold: float = THRESHOLD) -> Index:
    """An index of the items that have any words."""
    q_words, q_begins = hashing.words(pa.array(questions, pa.large_string()))
    joined = [f"{q or ''} {a or ''}" for q, a in zip(questions, answers, strict=True)]
    words, begins = hashing.words(pa.array(joined, pa.large_string()))
    shingles, s_begins = hashing.shingles(pa.array(joined, pa.large_string()), size)
    q_counts = np.diff(q_begins)
    kept, segments, owners, question, answer = [], [], [], [], []
    for i, (low, high) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        if low == high:
            continue
        parts = max(1, (high - low) // SEGMENT)
        segments += np.array_split(words[low:high], parts)
        owners += [len(kept)] * parts
        own = shingles[s_begins[i] : s_begins[i + 1]]
        # runs wholly inside the question, and those with a word of the answer
        inside = max(0, len(own) - (high - low - q_counts[i])) if q_counts[i] < high - low else len(own)
        question.append(np.unique(own[:inside]))
        answer.append(np.unique(own[inside:]))
        kept.append(names[i])
    terms = [np.unique(x, return_counts=True) for x in segments]
    count = len(segments)
    vocabulary, codes = np.unique(np.concatenate([t for t, _ in terms]) if terms else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(count), [len(t) for t, _ in terms]) if count else np.zeros(0, np.int64)
    df = np.bincount(codes, minlength=len(vocabulary))
    tf = np.concatenate([c for _, c in terms]).astype(float) if count else np.zeros(0)
    lengths = np.array([len(x) for x in segments], dtype=float)
    norm = K1 * (1 - B + B * lengths / lengths.mean()) if count else lengths
    weights = np.log1p((count - df[codes] + 0.5) / (df[codes] + 0.5)) * tf * (K1 + 1) / (tf + norm[owner])
    weights /= np.bincount(owner, weights, minlength=count)[owner]
    segment_begins = _csr(owner, count)
    # of each segment the most frequent terms that together stay below half the threshold
    rest, essential = np.zeros(count), np.ones(len(codes), dtype=bool)
    for s in range(count):
        own = np.arange(segment_begins[s], segment_begins[s + 1])
        own = own[np.lexsort((weights[own], -df[codes[own]]))]
        light = np.cumsum(weights[own]) < threshold / 2
        essential[own[light]] = False
        rest[s] = weights[own[light]].sum()
    blocks = -(-count // BLOCK)
    term_block = codes[essential] * max(1, blocks) + owner[essential] // BLOCK
    keys, at = np.unique(term_block, return_inverse=True)
    maxima = np.zeros(len(keys))
    np.maximum.at(maxima, at, weights[essential])
    block_rest = np.zeros(blocks)
    np.maximum.at(block_rest, np.arange(count) // BLOCK, rest)
    by_term = np.flatnonzero(essential)[np.argsort(codes[essential], kind="stable")]
    posting_begins = _csr(codes[by_term], len(vocabulary))
    slots = np.zeros(1 << max(10, (len(vocabulary) * _SLOTS_A_TERM).bit_length()), dtype=bool)
    slots[vocabulary[np.diff(posting_begins) > 0] & np.uint64(len(slots) - 1)] = True
    return Index(
        kept, vocabulary, slots, np.array(owners, dtype=np.int64), segment_begins, codes, weights,
        rest, posting_begins, owner[by_term], weights[by_term],
        _csr(keys // max(1, blocks), len(vocabulary)), keys % max(1, blocks), maxima, block_rest, question, answer,
    )


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(values[order], heads)


def retrieve(index: Index, words: np.ndarray, begins: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(row, item, best score) for every document row and item with a passage and a segment above the threshold."""
    slack = threshold - 1e-9
    maybe = np.flatnonzero(index.slots.take((words & np.uint64(len(index.slots) - 1)).view(np.int64)))
    term = np.searchsorted(index.vocabulary, words[maybe])
    term[term == len(index.vocabulary)] = 0
    hit = index.vocabulary[term] == words[maybe] if len(index.vocabulary) else np.zeros(len(maybe), bool)
    position, term = maybe[hit], term[hit]
    rare = np.diff(index.posting_begins)[term] > 0
    position, term = position[rare], term[rare]
    if not len(position):
        return []
    counts = np.diff(begins)
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE)), 0)
    window_begins = np.concatenate([[0], np.cumsum(windows)])
    row = np.searchsorted(begins, position, side="right") - 1
    inside = position - begins[row]
    last = np.minimum(inside // STRIDE, windows[row] - 1)
    first = np.maximum(0, -(-(inside - WINDOW + 1) // STRIDE))
    spans = last - first + 1
    which = np.repeat(np.arange(len(position)), spans)
    window = window_begins[row[which]] + first[which] + np.arange(len(which)) - np.repeat(np.cumsum(spans) - spans, spans)
    # each term counts once in a passage
    pairs = hashing.distinct(window * len(index.vocabulary) + term[which])
    window, term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    # by blocks of segments, then by segments of the blocks that can still reach the threshold
    blocks = len(index.block_rest)
    entry, place = _spread(index.block_begins, term)
    key, bound = _summed(window[entry] * blocks + index.blocks[place], index.block_maxima[place])
    alive = key[bound + index.block_rest[key % blocks] >= slack]
    if not len(alive):
        return []
    some = np.isin(window, alive // blocks)
    window, term = window[some], term[some]
    entry, place = _spread(index.posting_begins, term)
    segment = index.posting_segments[place]
    live = np.isin(window[entry] * blocks + segment // BLOCK, alive)
    segments = len(index.segment_item)
    key, bound = _summed((window[entry] * segments + segment)[live], index.posting_weights[place][live])
    key = key[bound + index.rest[key % segments] >= slack]
    best: dict[tuple[int, int], float] = {}
    own_window, own = -1, words[:0]
    for w, segment in zip((key // segments).tolist(), (key % segments).tolist(), strict=True):
        r = int(np.searchsorted(window_begins, w, side="right")) - 1
        at = begins[r] + (w - window_begins[r]) * STRIDE
        if w != own_window:
            own_window, own = w, np.sort(words[at : min(at + WINDOW, begins[r + 1])])
        a, b = index.segment_begins[segment], index.segment_begins[segment + 1]
        terms = index.vocabulary[index.segment_terms[a:b]]
        present = own[np.minimum(np.searchsorted(own, terms), len(own) - 1)] == terms
        score = float(index.segment_weights[a:b][present].sum())
        if score >= slack:
            found = r, int(index.segment_item[segment])
            best[found] = max(best.get(found, 0.0), score)
    return [(r, i, score) for (r, i), score in sorted(best.items())]


def _share(part: np.ndarray, runs: np.ndarray) -> float | None:
    return float(np.isin(part, runs).mean()) if len(part) else None


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    size: int = SIZE,
    overlap: float = OVERLAP,
    most: int = ITEMS,
) -> DataFrame:
    """One row per document row and item that it contains: both ids, ``score``, ``question_overlap``, ``answer_overlap``.

    ``items`` has the item column, ``question`` and ``answer`` (may be null). An overlap is the share of the part's runs of
    ``size`` words that the document has; runs with a word of the answer belong to the answer, and an item of
    fewer words is one run. It counts as contained if ``overlap`` of all its runs are there, or of the question's with half of the
    answer's. A null or empty text contains nothing; items without words are in nothing; equal items and equal
    documents each have their rows; null ids stay null. Empty tables give no rows. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    items = items.select(
        F.col(item_column).alias("item"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer")
    )
    schema = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("item", items.schema["item"].dataType),
            *(T.StructField(name, T.DoubleType()) for name in ("score", "question_overlap", "answer_overlap")),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    context = docs.sparkSession.sparkContext

    def searched(shared) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                words, begins = hashing.words(batch.column(1))
                found, kept = retrieve(index, words, begins), []
                rows = sorted({r for r, _, _ in found})
                runs = {r: hashing.shingles(batch.column(1).slice(r, 1), size)[0] for r in rows}
                for r, i, score in found:
                    question, answer = _share(index.question[i], runs[r]), _share(index.answer[i], runs[r])
                    both = _share(np.concatenate([index.question[i], index.answer[i]]), runs[r])
                    if both >= overlap or (question or 0) >= overlap and (answer is None or answer >= ANSWER_OVERLAP):
                        kept.append((batch.column(0)[r].as_py(), index.names[i], score, question, answer))
                columns = list(zip(*kept, strict=True)) if kept else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return docs.mapInArrow(search, schema)

    parts = max(1, -(-items.count() // most))
    out = None
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item", "question", "answer"), F.lit(parts)) == part) if parts > 1 else items
        rows = mine.orderBy("item", "question", "answer").collect()  # about ``most`` items
        index = build_index([r.item for r in rows], [r.question for r in rows], [r.answer for r in rows], size)
        found = searched(context.broadcast(index))
        out = found if out is None else out.unionAll(found)
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def question_and_answer(items: DataFrame, text_column: str = "text") -> DataFrame:
    """Items with the text's last sentence as ``answer`` and what is before it as ``question``; one sentence is a question."""
    last = F.regexp_extract(text_column, r"(?s)^.*[.?!]\s+(\S.*)$", 1)
    before = F.regexp_extract(text_column, r"(?s)^(.*[.?!])\s+\S.*$", 1)
    return items.withColumns(
        {
            "question": F.when(F.length(before) > 0, before).otherwise(F.col(text_column)),
            "answer": F.when(F.length(before) > 0, last),
        }
    )
