"""Collocations by Toivonen's sampling: phrases proposed by a sample and their negative border are counted exactly.

A phrase is frequent only if all phrases inside it are. A sample of the texts proposes phrases by a lowered threshold. The full
pass counts every phrase whose inner phrases are all proposed: the proposals and their negative border. Phrases of the border
that prove frequent are failures of the sample; they join the proposals, and a further pass counts only what these newly
allow, until a pass has no failure. Every phrase is counted as text in at most one pass, over all texts.

The sample counts by 64-bit hashes alone, and the first full pass does so with the border below ``max_words``, as most of it is rare. Phrases
that share a hash are counted together, so this only rules out: what reaches the threshold is suspect and counted as text, exactly, by the next pass.

Tasks know the proposals as a bit map of fixed size (``filter_bytes``), the only thing broadcast. A bit map lets some phrases through
that are not proposed, and more so the more it holds; they are counted for nothing and change no result. In a task the
phrases of a run of texts are told apart by 64-bit hashes, and leave it as text with their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.hashing import _LOWER, _ranges, bytes_of, mix, word_hashes
from pageloom.session import stage

MAX_WORDS, MIN_COUNT = 3, 10
SAMPLE_RATE, LOWERING = 0.25, 0.8
FILTER_BYTES = 8 << 20
PROBES = 3
RUN_WORDS = 200_000
MERGE_ROWS = 400_000  # phrases that occur again and again are added up in a task until there are so many
NEW, KNOWN = 0, 1  # marks of keys counted as text, by what the map says of them; a hash has no key
HOT_SHARE = 1024  # a part that more than one in so many lookups asks for is broadcast: there are at most as many of them

# a phrase and its lang leave a task as one key: no word holds a tab
_ARROW = pa.schema([("key", pa.string()), ("f", pa.int64())])
_HASHED = pa.schema([("hash", pa.int64()), ("f", pa.int64())])
_TAB = pa.scalar("\t", pa.large_string())
_SPACE = pa.scalar(" ", pa.large_string())
_CHAIN = np.uint64(0xD6E8FEB86659FD93)

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BLANK | _STOP


class _Run:
    """Words of a run of texts: hash with language, bytes from and to, number of the piece, row; ``own`` if first seen here."""

    def __init__(self, hashes, starts, ends, pieces, rows, own):
        self.columns = [hashes, starts, ends, pieces, rows, own]
        self.hashes, self.starts, self.ends, self.pieces, self.rows, self.own = self.columns

    def tail(self, words: int) -> list[np.ndarray]:
        """The last words, which phrases that go on in the next run begin with."""
        kept = [x[len(x) - min(words, len(x)) :] for x in self.columns]
        return [*kept[:5], np.zeros(len(kept[5]), bool)]


def _steps(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The words of a text column, a step of bytes at a time."""
    stops_before = 0
    for low, high in _ranges(_GAP[data], bounds):
        part = data[low:high]
        stop = _STOP[part]
        ink = ~(stop | _BLANK[part])
        inner = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low
        begins = ink.copy()
        begins[1:] &= ~ink[:-1]
        begins[inner] |= ink[inner]
        starts = np.flatnonzero(begins)
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        inner = inner[inner > 0]
        last[inner - 1] |= ink[inner - 1]
        ends = np.flatnonzero(last) + 1
        rows = np.searchsorted(bounds, starts + low, side="right") - 1
        hashes = mix(word_hashes(part, starts, ends) + seeds[rows])
        stops = np.cumsum(stop, dtype=np.int64) + stops_before
        stops_before = int(stops[-1])
        yield [hashes, starts + low, ends + low, stops[starts] + rows, rows, np.ones(len(starts), bool)]


def _runs(texts: pa.Array, seeds: np.ndarray, overlap: int, run_words: float = RUN_WORDS) -> Iterator[tuple[np.ndarray, _Run]]:
    """Runs of about ``run_words`` words; each begins with the last ``overlap`` words of the one before."""
    data, bounds = bytes_of(texts)
    held: list[list[np.ndarray]] = []
    words = 0
    for step in _steps(data, bounds, seeds):
        held.append(step)
        words += len(step[0])
        if words >= run_words:
            run = _Run(*map(np.concatenate, zip(*held, strict=True)))
            yield data, run
            held, words = [run.tail(overlap)], 0
    if words:
        yield data, _Run(*map(np.concatenate, zip(*held, strict=True)))


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words that begin and end there as strings, A-Z lower-cased."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = _LOWER[data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of phrases in a bit map of ``bits`` bits, a power of two."""
    step = mix(hashes ^ _CHAIN) | np.uint64(1)
    return [(hashes + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]


def _known(maps: list[np.ndarray | None], hashes: np.ndarray) -> list[np.ndarray]:
    """Per map, which phrases it knows; None knows nothing."""
    found = [np.full(len(hashes), x is not None) for x in maps]
    sizes = {len(x) for x in maps if x is not None}
    for size in sizes:
        for place in _probes(hashes, size * 64):
            cell, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
            for known, bitmap in zip(found, maps, strict=True):
                if bitmap is not None:
                    known &= (bitmap[cell] & bit) != 0
    return found


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a sorted column has a new value."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(data: np.ndarray, run: _Run, langs: pa.Array, max_words: int, now, before, words_too: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a run whose inner phrases ``now`` knows, less those whose inner phrases ``before`` knew.

    ``now`` of None stands for a map that knows every phrase.
    """
    for _, _, batch in _told(data, run, langs, max_words, now, before, words_too, False, False):
        yield batch


def _told(
    data: np.ndarray, run: _Run, langs: pa.Array, max_words: int, now, before, words_too: bool, by_hash: bool, resolve: bool
) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """Mark, whether the phrases are likely to occur again, and counts.

    With ``by_hash`` phrases below ``max_words`` that ``now`` does not know are counted by hash, without a map all phrases. ``resolve`` says that
    the pass before did so: of those, what ``now`` knows is counted as text.
    """
    sample = by_hash and now is None
    whole: list[pa.Array] = []
    wide_langs = langs.cast(pa.large_string())

    def words(places: np.ndarray, many: bool) -> pa.Array:
        if not many:
            return _words(data, run.starts[places], run.ends[places])
        if not whole:
            whole.append(_words(data, run.starts, run.ends))
        return whole[0].take(pa.array(places))

    def batch(size: int, last: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """Of occurrences by the place of their last word and the hash of the phrase."""
        own = run.own[last]
        last, keys = last[own], keys[own]
        order = np.argsort(keys)
        begins = _first(keys[order])
        total = np.zeros(len(run.hashes), np.int64)
        total[last[order[begins]]] = np.diff(begins, append=len(keys))
        places = np.flatnonzero(total)  # in the order of the text, whose words are then read in order
        many = 4 * size * len(places) > len(run.hashes)
        apart = [words(places - k, many) for k in range(size - 1, -1, -1)]
        told = pc.binary_join_element_wise(*apart, _SPACE) if size else pa.array([""] * len(places), pa.large_string())
        told = pc.binary_join_element_wise(told, wide_langs.take(pa.array(run.rows[places])), _TAB)
        return pa.record_batch([told.cast(pa.string()), pa.array(total[places])], schema=_ARROW)

    def hashed(last: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(keys[run.own[last]])
        begins = _first(keys)
        return pa.record_batch([pa.array(keys[begins].view(np.int64)), pa.array(np.diff(begins, append=len(keys)))], schema=_HASHED)

    # per place of a last word: the hash of the phrase that ends there, and whether the maps know it
    hashes = run.hashes
    known, old = _known([now, before], hashes)
    if words_too:
        everywhere = np.arange(len(hashes))
        if sample:
            yield None, False, hashed(everywhere, hashes)
        else:
            yield KNOWN, True, batch(1, everywhere[known], hashes[known])
            yield NEW, False, batch(1, everywhere[~known], hashes[~known])
            yield KNOWN, True, batch(0, everywhere, langs.dictionary_encode().indices.to_numpy(zero_copy_only=False)[run.rows])
    known |= now is None
    together = np.zeros(len(hashes), bool)
    together[1:] = run.pieces[1:] == run.pieces[:-1]
    for size in range(2, max_words + 1):
        fits = np.zeros(len(hashes), bool)
        fits[1:] = together[1:] & known[1:] & known[:-1]
        at = np.flatnonzero(fits)
        told = mix(hashes[at - 1] * _CHAIN + run.hashes[at])
        fresh = ~(old[at] & old[at - 1])
        if size == max_words and not sample:  # nothing is built on the longest phrases
            yield NEW, False, batch(size, at[fresh], told[fresh])
            return
        knows, knew = _known([now, before], told)
        new = fresh & ~knows
        yield (None, False, hashed(at[new], told[new])) if by_hash else (NEW, False, batch(size, at[new], told[new]))
        knows |= now is None
        met = ~new & knows & (fresh | ~knew if resolve else fresh)
        if not sample:
            yield KNOWN, by_hash, batch(size, at[met], told[met])
        hashes, known, old = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        # the map may know by chance what was not counted before, as its inner phrases were not known
        hashes[at], known[at], old[at] = told, knows, ~fresh & knew


def _merged(told: Iterator[tuple[int | None, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, hash, f): hashes without a key, keys with their mark; what occurs again is added up over the runs of a task."""

    def out(mark: int | None, batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        first, f = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in batch.columns)
        alone = pa.nulls(len(f), pa.string()) if mark is None else pa.array(np.full(len(f), mark, np.int64))
        return pa.record_batch([alone, first, f] if mark is None else [first, alone, f], names=["key", "hash", "f"])

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("f", "sum")]).select(["key", "f_sum"]).rename_columns(["key", "f"])

    held: list[pa.Table] = []
    for mark, again, batch in told:
        if again:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) > 2 * MERGE_ROWS:
                held = [added(held)]
                if held[0].num_rows > MERGE_ROWS:
                    yield out(KNOWN, held.pop())
        elif len(batch):
            yield out(mark, batch)
    if any(map(len, held)):
        yield out(KNOWN, added(held))


def _seeds(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    values = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(values, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, np.uint64)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Small batches as one table."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, place: int, kind: pa.DataType) -> pa.Array:
    chunks = table.column(place).cast(kind)
    return chunks.chunk(0) if chunks.num_chunks == 1 else pa.concat_arrays(chunks.chunks)


def count_phrases(
    docs: DataFrame,
    max_words: int,
    now: Broadcast | None,
    before: Broadcast | None,
    words_too: bool,
    least: int,
    by_hash: bool = False,
    resolve: bool = False,
) -> DataFrame:
    """(lang, size, phrase, f, hash) of phrases that occur ``least`` times in docs (lang, text); with ``words_too`` the words, and as the empty phrase their total.

    With ``by_hash`` the border, without ``now`` every phrase, comes as a hash without a phrase; ``resolve`` says that the pass before did so.
    The ``hash`` of phrases counted as text is 1 if ``now`` knows them, else 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [None if x is None else np.frombuffer(x.value, np.uint64) for x in (now, before)]

        def told():
            for table in _together(batches, 2 << 20):
                langs = _column(table, 0, pa.string())
                for data, run in _runs(_column(table, 1, pa.large_string()), _seeds(langs), max_words - 1):
                    yield from _told(data, run, langs, max_words, *maps, words_too, by_hash, resolve)

        yield from _merged(told())

    counted = docs.select("lang", "text").mapInArrow(work, "key string, hash long, f long").repartition("key", "hash").groupBy("key", "hash").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\t", 1)
    size = F.when(phrase == "", 0).when(phrase.isNotNull(), F.size(F.split(phrase, " ", -1)))
    return counted.filter((F.col("f") >= least) | F.startswith("key", F.lit("\t"))).select(
        F.expr("substring(key, locate('\t', key) + 1)").alias("lang"), size.alias("size"), phrase.alias("phrase"), "f", "hash"
    )


def bit_map(phrases: DataFrame, size: int, hashes: DataFrame | None = None, known: Broadcast | None = None) -> Broadcast:
    """Phrases (lang, phrase) and hashes of others (hash) as a bit map of ``size`` bytes, a power of two, for all tasks; with all that ``known`` knows."""
    bits = size * 8

    def cells(found: np.ndarray) -> pa.RecordBatch:
        places = np.unique(np.concatenate(_probes(found, bits)))
        cells, starts = np.unique(places >> np.uint64(6), return_index=True)
        masks = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), starts)
        return pa.record_batch([pa.array(cells.astype(np.int64)), pa.array(masks.view(np.int64))], names=["cell", "mask"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, 4 << 20):
            langs = _column(table, 0, pa.string())
            for _, run in _runs(_column(table, 1, pa.large_string()), _seeds(langs), 0, float("inf")):
                # words of one phrase follow each other: chain them as the counting does
                begins = np.flatnonzero(np.concatenate([[True], run.rows[1:] != run.rows[:-1]]))
                sizes = np.diff(np.concatenate([begins, [len(run.rows)]]))
                chained = run.hashes[begins]
                for k in range(1, int(sizes.max())):
                    longer = sizes > k
                    chained[longer] = mix(chained[longer] * _CHAIN + run.hashes[begins[longer] + k])
                yield cells(chained)

    def work_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, 4 << 20):
            if len(table):
                yield cells(_column(table, 0, pa.int64()).to_numpy().view(np.uint64))

    found = phrases.select("lang", "phrase").mapInArrow(work, "cell long, mask long")
    if hashes is not None:
        found = found.unionByName(hashes.select("hash").mapInArrow(work_hashes, "cell long, mask long"))
    told = found.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most size / 8 rows
    bitmap = np.zeros(size // 8, np.uint64)
    bitmap[told["cell"].to_numpy()] = told["mask"].to_numpy().view(np.uint64)
    if known is not None:
        bitmap |= np.frombuffer(known.value, np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def frequent_phrases(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    rate: float = SAMPLE_RATE,
    filter_bytes: int = FILTER_BYTES,
    seed: int = 11,
) -> DataFrame:
    """All phrases of up to ``max_words`` words with at least ``min_count`` occurrences, and totals as size 0, of docs (lang, text)."""
    lowered = max(1, int(min_count * rate * LOWERING))
    proposed = stage(count_phrases(docs.sample(rate, seed=seed), max_words - 1, None, None, True, lowered, True), "proposed")
    now, before = bit_map(proposed.filter("phrase IS NOT NULL"), filter_bytes, proposed), None
    found: DataFrame | None = None
    passes = 0
    while True:
        counted = stage(count_phrases(docs, max_words, now, before, passes == 0, min_count, passes == 0, passes == 1), "counted")
        texts = counted.filter("phrase IS NOT NULL").select("lang", "size", "phrase", "f")
        found = texts if found is None else found.unionByName(texts)
        # what proved frequent, was not known and may be part of something longer
        failures = counted.filter((F.col("size") > 0) & (F.col("size") < max_words) & (F.col("hash") == NEW))
        suspects = counted.filter("phrase IS NULL") if passes == 0 else None
        if failures.isEmpty() and (suspects is None or suspects.isEmpty()):
            return found
        now, before = bit_map(failures, filter_bytes, suspects, now), now
        passes += 1


def _looked_up(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """``wanted`` (lang, part, …) with f of the part. Parts that many ask for are broadcast, the others joined by key."""
    total = wanted.count()
    asked = wanted.groupBy("lang", "part").agg(F.count("*").alias("_asked")).filter(F.col("_asked") * HOT_SHARE > total)
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    hot = F.broadcast(asked.join(parts, ["lang", "part"]).select("lang", "part", F.col("f").alias("_f")))
    told = wanted.join(hot, ["lang", "part"], "left")
    rest = told.filter("_f IS NULL").drop("_f").join(parts, ["lang", "part"])
    return told.filter("_f IS NOT NULL").withColumnRenamed("_f", "f").unionByName(rest)


def _subphrase(first: Column, words: Column) -> Column:
    return F.array_join(F.slice("_words", first, words), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = 50, top: int = 2000, **mining) -> DataFrame:
    """Each lang's first ``top`` phrases of 2 to ``max_words`` words by score: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; texts (null: empty) end a piece at ``[.,;:!?\\x0A-\\x0D]`` and a word at a blank or tab; a null lang is
    ``und``. ``a`` is the count of the phrase, ``l`` and ``r`` those of its parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)), the first such cut on ties; ``n`` counts the lang's words. A phrase is dropped if a
    longer one that holds it and has ``min_count`` occurrences has ``inside_percent`` of its own. Equal scores go by larger ``a``, then by phrase.
    Repeated rows count as often as they stand there, very long texts are counted in runs that overlap,
    empty tables and texts give no rows, columns other than lang and text are not read. Products are exact while
    a * a * 1000000 has at most 38 digits.
    """
    listed = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = frequent_phrases(listed, max_words, min_count, **mining)
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    counts = found.filter("size > 0")
    candidates = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("_words"))

    # what each longer candidate says about the shorter ones in it
    around = (
        candidates.filter("size > 2")
        .withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("_first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_size") + 1)))
        .groupBy("lang", _subphrase(F.col("_first"), F.col("_size")).alias("phrase"))
        .agg(F.max("a").alias("_longer"))
    )
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(f"_longer IS NULL OR 100 * _longer < {inside_percent} * a").drop("_longer")

    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = F.array(_subphrase(F.lit(1), F.col("k")), _subphrase(F.col("k") + 1, F.col("size") - F.col("k")))
    wanted = cut.select("lang", "phrase", "a", "k", F.posexplode(parts).alias("side", "part"))
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = range(1, max_words)
    both = _looked_up(stage(wanted, "parts"), counts).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), *(side(k, s).alias(f"_{name}{k}") for k in cuts for s, name in enumerate("lr"))
    )
    wide = "CAST({} AS DECIMAL(19,0))".format
    scores = [
        F.when(
            F.col(f"_l{k}").isNotNull(),
            F.struct(
                F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({wide('a')} * {wide('a')})) DIV ({wide(f'_l{k}')} * {wide(f'_r{k}')})").alias("score"),
                F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r"),
            ),
        )
        for k in cuts
    ]
    scored = both.select("lang", "phrase", "a", F.array_min(F.array(*scores)).alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a lang's best are found among the best of its slices, so no lang is ranked whole in one task
    local = scored.withColumn("_slice", F.spark_partition_id())
    nearly = local.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
