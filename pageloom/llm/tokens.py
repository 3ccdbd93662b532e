"""Token ids of whole texts by a public byte-level BPE tokenizer, a column at a time.

Merges never cross pre-tokens, and before a space between two other characters a pre-token always ends.
Texts are therefore cut before every such space; the distinct pieces of a batch are found by Arrow, encoded
once and remembered up to a bound, and the ids of the texts are gathered from theirs. They are those
that the tokenizers library gives for the whole text. Texts where white space meets such a space, or that hold the
string of a special token, go to that library whole, as do all texts of a file of another kind.
"""

from __future__ import annotations

import itertools
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 100_000  # pieces that a worker holds, some 250 bytes each
AT_ONCE = 1 << 19  # bytes of text encoded together, which bounds the room for their pieces and ids
_ENDS = frozenset(",.;:!?")
# fixed value: the pre-token pattern of this kind of tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such a file: itself, or the next ones from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = itertools.count(256)
    return {chr(b if b in shown else next(others)): b for b in range(256)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._pieces = None
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, special = told["model"].get("vocab", {}), {x["content"] for x in told.get("added_tokens") or ()}
        self._special = sorted(special)
        before = told.get("pre_tokenizer") or {}
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in told["model"].get("merges", ())]
        plain = told["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if plain and not before.get("add_prefix_space") and not told.get("normalizer") and merged == sorted(set(merged)) and -1 not in merged:
            import tiktoken

            letters = _byte_alphabet()
            ranks = {bytes(letters[x] for x in token): i for token, i in vocabulary.items() if token not in special}
            self._pieces = tiktoken.Encoding("of-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        """By the tokenizers library alone."""
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _ids(self, piece: str) -> bytes:
        ids = self._known.get(piece)
        if ids is None:
            if piece[-1:] in _ENDS and piece[-2:-1].isalpha():  # a pre-token ends between a letter and such a mark
                ids = self._ids(piece[:-1]) + self._ids(piece[-1])
            else:
                ids = array("I", self._pieces.encode_ordinary(piece)).tobytes()
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in order, and where each row's begin; a null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self._pieces is None:
            return _joined([self.whole(x) for x in texts.to_pylist()])
        runs = np.cumsum(pc.binary_length(texts).to_numpy()) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]
        parts = [self._encoded(texts.slice(low, high - low)) for low, high in itertools.pairwise(cuts)]
        ids, bounds = zip(*parts, strict=True)
        ends = np.cumsum([0, *map(len, ids)])
        return np.concatenate(ids), np.concatenate([[0], *(x[1:] + end for x, end in zip(bounds, ends, strict=False))]).astype(np.int64)

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts that are no nulls, all at once."""
        split = pc.split_pattern(texts, " ")
        flat = split.flatten()
        rows = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(rows)])
        told = lambda of: np.fromiter(map(of, pieces), bool, len(pieces))[codes]
        first, last = begins[:-1], begins[1:] - 1
        after, before = np.ones(len(codes), bool), np.ones(len(codes), bool)  # has a space on its left, on its right
        after[first] = before[last] = False
        empty = told(lambda p: not p)
        bad = after & (empty | told(lambda p: p[:1].isspace())) | before & (empty & after | told(lambda p: p[-1:].isspace()))
        if self._special:
            bad |= told(lambda p: any(mark in p for mark in self._special))
        spoilt = np.logical_or.reduceat(bad, first) if len(rows) else np.zeros(0, bool)
        # the first piece of a text has no space before it; the others are looked up with one
        heads = [self._ids(pieces[c]) for c in codes[first]]
        found = [self._ids(" " + p) for p in pieces]
        bytes_of = found + heads
        codes[first] = len(found) + np.arange(len(heads))
        sizes = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        ids = np.frombuffer(b"".join(bytes_of), dtype="<u4")
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[begins]
        if not spoilt.any():
            return out, bounds
        own = texts.to_pylist()
        return _joined([self.whole(own[i]) if spoilt[i] else out[bounds[i] : bounds[i + 1]] for i in range(len(own))])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
