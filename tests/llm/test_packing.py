"""Packing: every id once and in its place, no gaps, full windows; and the encoder against the library."""

import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm.packing import Packer, pack_documents
from pageloom.llm.queries import QUERIES, tokenizer_path
from pageloom.llm.tables import opened, table
from pageloom.llm.tokens import Encoder


def checked(rows, documents, tiers):
    """rows: (document, start, ids, total, sequence, offset, ...)"""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for document, start, ids, total, sequence, offset, size, _ in rows:
        assert len(ids) > 0 and total == len(documents[document]) and size <= max(tiers)
        pieces[document].append((start, ids))
        sequences[sequence].append((offset, len(ids), size))
    for document, ids in documents.items():
        own = sorted(pieces[document], key=lambda x: x[0])
        assert np.array_equal(np.concatenate([x for _, x in own]) if own else [], ids)
        assert [s for s, _ in own] == list(np.cumsum([0, *[len(x) for _, x in own]])[:-1])
    for own in sequences.values():
        own.sort()
        assert [o for o, _, _ in own] == list(np.cumsum([0, *[n for _, n, _ in own]])[:-1])
        assert sum(n for _, n, _ in own) == own[0][2] and own[0][2] & (own[0][2] - 1) == 0
    return sequences


@pytest.mark.parametrize("tiers", [(128, 256, 512, 1024), (64,)])
def test_packer(tiers):
    rng = random.Random(4)
    documents = {i: np.arange(rng.choice([0, 1, 3, 60, 64, 500, 1024, 1025, 9000]) + rng.randrange(40), dtype="<u4") for i in range(700)}
    packer = Packer(tiers, step_ids=4096, held=50)
    for name, ids in documents.items():
        packer.add(name, ids)
    packer.finish()
    rows = packer.take()
    sequences = checked(rows, documents, tiers)
    odd = [own for own in sequences.values() if own[0][2] not in tiers]
    assert len(odd) <= 10
    groups = defaultdict(set)
    for _, _, _, _, sequence, _, size, step in rows:
        groups[size, step].add(sequence)
    assert all(len(v) * size <= 4096 for (size, _), v in groups.items())


def test_encoder_is_the_library():
    made, rng = Encoder(tokenizer_path()), random.Random(1)
    texts = [None, "", " ", "a", " a", "a  b ", "a \n b", "it's 'll 's", "a <|endoftext|> b", "<|endoftext|>", "漢字, é.", "x" * 5000]
    signs = ["  ", " ", "\n", "a", "B", "é", "'", "s", "1", "!", ",", ".", "\t", "漢", " ", "\x1c", "​"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(6000)]
    ids, bounds = made.encode(pa.array(texts))
    assert made._pieces is not None
    for i, text in enumerate(texts):
        assert np.array_equal(ids[bounds[i] : bounds[i + 1]], made.whole(text or "")), repr(text)
    made._pieces = None
    assert np.array_equal(made.encode(pa.array(texts))[0], ids)


def test_odd_tables(spark):
    opened(spark)
    rows = [(1, "a b c", 5), (1, "a b c", 5), (None, "x", 5), (2, None, 5), (3, "word " * 200_000, 5), (4, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = pack_documents(docs, tokenizer_path()).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 8 and sum(r.length for r in out if r.doc_id == 3) == 200_002
    assert [(r.length, r.ids) for r in out if r.doc_id in (2, 4)] == [(1, [0]), (1, [0])]
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert pack_documents(docs.filter("doc_id = 2"), tokenizer_path(), end_id=None).collect() == []
    assert pack_documents(docs.limit(0), tokenizer_path()).collect() == []


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    made = Encoder(tokenizer_path())
    ids = {r.doc_id: np.append(made.whole(r.text or ""), 0).astype("<u4") for r in table(spark, folder, "documents").collect()}
    out = QUERIES["op6_packing"](spark, folder).collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in out)
    assert sum(r.length for r in out) == sum(map(len, ids.values())) and all(r.doc_tokens == len(ids[r.doc_id]) for r in out)
    rows = [(r.doc_id, r.start, ids[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in out]
    size = defaultdict(int)
    for row in rows:
        size[row[4]] += len(row[2])
    checked([(*row, size[row[4]], 0) for row in rows], ids, (1024,))


def test_a_column_is_encoded_in_parts_of_bounded_size(monkeypatch):
    """The room for the pieces of a batch follows the part and not the batch; ids and bounds are those of the library."""
    from pageloom.llm import tokens
    from pageloom.llm.queries import tokenizer_path

    monkeypatch.setattr(tokens, "AT_ONCE", 64)
    coder, seen, encoded = tokens.Encoder(tokenizer_path()), [], tokens.Encoder._encoded
    monkeypatch.setattr(tokens.Encoder, "_encoded", lambda self, texts: (seen.append(texts.nbytes), encoded(self, texts))[1])
    texts = ["A few words, here.", None, "", "x  y\n z", "long word " * 50, "Übung 12!", ""] * 9
    ids, bounds = coder.encode(pa.array(texts))
    assert len(seen) > 9 and len(bounds) == len(texts) + 1
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == coder.whole(text or "").tolist()
    for none in ([], [None], ["", None]):
        ids, bounds = coder.encode(pa.array(none, pa.string()))
        assert len(ids) == 0 and bounds.tolist() == [0] * (len(none) + 1)


def test_what_a_worker_remembers_is_small():
    """Two workers stand beside the JVM in an executor; pieces of a text that has only new ones must not fill it."""
    coder = Encoder(tokenizer_path())
    held = lambda: sys.getsizeof(coder._known) + sum(sys.getsizeof(x) for pair in coder._known.items() for x in pair)
    most = 0
    for low in range(0, 400_000, 20_000):
        texts = [" ".join(f"q{i:x}z" for i in range(at, at + 1_000)) for at in range(low, low + 20_000, 1_000)]
        coder.encode(pa.array(texts))
        most = max(most, held())
    assert 0 < most < 32_000_000
    ids, _ = coder.encode(pa.array(["q0z, again q1z"]))
    assert ids.tolist() == coder.whole("q0z, again q1z").tolist()
