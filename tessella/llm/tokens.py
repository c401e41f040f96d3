"""Token ids of whole texts, as the tokenizers library gives them, for columns of texts.

Byte-level BPE encodes each pre-token by itself, and a pre-token never reaches
over a place where white space follows another character, where punctuation
follows a letter, or where a letter follows a line end that stands alone.  So the texts of a chunk are cut at such places, each
different piece is encoded once by the library, and the ids of the texts are
put together by index.

A text that holds one of the tokenizer's added tokens, and every text under a
tokenizer of another kind, is encoded by the library whole.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import common

#: Different pieces kept by a worker before they are dropped; about 30 bytes each.
CACHE_PIECES = 200_000
#: Bytes of texts cut at once.
CHUNK_BYTES = 1 << 19
#: Letters, perhaps after a space: one pre-token.
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"

_BLANK = common.is_space(np.arange(256, dtype=np.uint8))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that is neither a letter, a digit, white space, a control character nor an apostrophe (contractions start with one).
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True


def _byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _back(values: np.ndarray, n: int) -> np.ndarray:
    """values[i - n] at i, and False or 0 at the first n places."""
    return np.concatenate([np.zeros(min(n, len(values)), values.dtype), values[: max(0, len(values) - n)]])


def cut_places(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token surely begins at each byte of UTF-8 texts.

    Characters beyond ASCII count as white space where their first byte is one
    that some white space has; between those and white space no cut is made.
    """
    follows = np.zeros(len(data), bool)
    tail = (data & 0xC0) == 0x80
    one, two = _back(tail, 1), _back(tail, 2)
    first = _back(data, 2)
    follows |= _PRINTED[_back(data, 1)]
    follows |= one & (first >= 0xC3) & (first <= 0xDF)
    third = _back(data, 3)
    follows |= one & two & ((third == 0xE0) | (third >= 0xE4) & (third <= 0xEF))
    follows |= one & two & _back(tail, 3) & (_back(data, 4) >= 0xF0)
    letter = _LETTER[_back(data, 1)] | (first == 0xC3) & one & (_back(data, 1) != 0x97) & (_back(data, 1) != 0xB7)
    alone = _back((data == 10) & follows, 1)
    return _BLANK[data] & follows | _MARK[data] & letter | (_LETTER[data] | (data == 0xC3)) & alone


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        )
        spelled = {b: c.encode() for c, b in _byte_symbols().items()}
        self.widths = np.array([len(spelled[b]) for b in range(256)])
        self.spelled = np.array([list(spelled[b].ljust(2)) for b in range(256)], np.uint8)
        self._drop()

    def _drop(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids = np.zeros(0, self.dtype)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _symbols(self, pieces: pa.Array) -> list[str]:
        """Pieces in the byte-level alphabet."""
        data, offsets = common.utf8(pieces)
        width = self.widths[data]
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint8)
        out[at] = self.spelled[data, 0]
        out[at[width == 2] + 1] = self.spelled[data[width == 2], 1]
        ends = np.append(at, len(out))[offsets].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(out)]).to_pylist()

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode new pieces, those that are one pre-token straight by the library's model, others by all of it; returns their rows."""
        word = pc.match_substring_regex(pieces.cast(pa.string()), _WORD)
        rows = np.argsort(np.argsort(~word.to_numpy(zero_copy_only=False), kind="stable")) + len(self.known)
        plain, others = pieces.filter(word), pieces.filter(pc.invert(word))
        tokenize = self.tokenizer.model.tokenize
        own = [[t.id for t in tokenize(p)] for p in self._symbols(plain)]
        own += [e.ids for e in self.tokenizer.encode_batch(others.cast(pa.string()).to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, own), np.int32, len(own))
        self.known = pa.concat_arrays([self.known, plain, others])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(own), self.dtype)])
        return rows

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that hold no added token, and their number in each."""
        begin = cut_places(data)
        edges = offsets[:-1][np.diff(offsets) > 0]
        begin[edges] = True
        starts = np.flatnonzero(begin)
        bounds = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        found = column.dictionary_encode()
        own = found.dictionary
        at = pc.index_in(own, value_set=self.known)
        if len(self.known) + at.null_count > CACHE_PIECES:
            self._drop()
            at = pa.nulls(len(own), pa.int32())
        row = pc.fill_null(at, 0).to_numpy().copy()
        if at.null_count:
            new = pc.is_null(at)
            row[new.to_numpy(zero_copy_only=False)] = self._learn(own.filter(new))
        row = row[found.indices.to_numpy()]
        sizes = self.sizes[row]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[row] - ends + sizes, sizes) + np.arange(total, dtype=np.int32)]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)

    def chunks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For chunks of a string column, in order: the ids of all their texts, and how many each text has; none for null."""
        special = np.zeros(len(column), bool)
        if not self.by_piece:
            special[:] = True
        for token in self.added if self.by_piece else []:
            special |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in common.text_chunks(column, CHUNK_BYTES):
            at = 0
            for k in [*np.flatnonzero(special[a:b]).tolist(), b - a]:
                if k > at:
                    yield self._pieces(data[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at])
                if k < b - a:
                    ids = self._whole(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                    yield ids, np.array([len(ids)])
                at = k + 1

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text; none for null."""
        return np.concatenate([np.zeros(0, self.dtype), *(ids for ids, _ in self.chunks(pa.array([text], pa.string())))])


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with an end id after each, and the new sizes."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out[inner] = ids
    return out, sizes + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
