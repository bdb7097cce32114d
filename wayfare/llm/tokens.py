"""Token ids of whole texts by a tokenizers file, quickly: the distinct pieces between spaces are encoded, and their ids joined.

One kind of file has a fast path, which is told from the file when it is opened (``_FAST``): white space is dropped and
letters are lower-cased before the text is split, so pieces are encoded alone.  A piece of Latin letters followed by
ASCII marks is split once more, into a word for the model itself and the marks; any other piece is encoded by the
whole tokenizer, in its own spelling.  Texts go through the library as they are with any other file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfare.llm.text import NOT_SPACE, chunks, utf8

DEFAULT = "word_bpe_49k.json"
#: What a file of the fast path says: its normalizers and pre-tokenizers, and that words end with a mark of their own.
_FAST = {
    "normalizer": ["NFC", "Replace \\s+ by ' '", "Lowercase"],
    "pre_tokenizer": ["Split 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ Removed True", "ByteLevel False False"],
    "model": ["BPE", None, None, "</w>", False, False],
}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LATIN = "".join(c for c in map(chr, range(256)) if c.isascii() and c.isalpha() or c >= "\xc0" and c not in "\xd7\xf7")
#: Bytes, about, that a worker keeps of words, pieces and their ids: the first that it meets, among them the common ones.
KEEP_BYTES = 12 << 20
#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20


def vocabulary(name: str = DEFAULT) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable Latin-1 as such, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _said(path: str) -> dict:
    """What a tokenizer's file says, in the terms of ``_FAST``."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm, pre, model = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}, d["model"]
    pattern = lambda x: x.get("pattern", {}).get("Regex")
    return {
        "normalizer": [f"Replace {pattern(x)} by {x['content']!r}" if x["type"] == "Replace" else x["type"] for x in norm.get("normalizers", [])],
        "pre_tokenizer": [f"Split {pattern(x)} {x['behavior']} {x['invert']}" if x["type"] == "Split" else " ".join([x["type"], *(str(x.get(k)) for k in ("add_prefix_space", "use_regex"))]) for x in pre.get("pretokenizers", [])],
        "model": [model.get(k) for k in ("type", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")],
    }


class Encoder:
    """Texts -> ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = _said(path) == _FAST and all(not t.normalized and not t.single_word for t in self.whole.get_added_tokens_decoder().values())
        self.model, self.letter = self.whole.model, _letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.kept = 0

    def _known(self, texts: list[str], word: bool) -> list[bytes]:
        """The ids of words (for the model itself) or of pieces (for the whole tokenizer), of which new ones are encoded and kept."""
        known = self.words if word else self.pieces
        new = [t for t in texts if t not in known]
        if self.kept > KEEP_BYTES:  # what is new is for these texts only
            known = {t: known[t] for t in texts if t in known} if len(new) < len(texts) else {}
        if word:
            spell, model = self.letter.__getitem__, self.model
            ids = [[x.id for x in model.tokenize(t if t.isascii() else "".join(map(spell, t.encode())))] for t in new]
        else:
            ids = [self.whole.encode(t, add_special_tokens=False).ids for t in new]
        raw = np.array([x for own in ids for x in own], "<u4").tobytes()
        at = 0
        for t, own in zip(new, ids):
            known[t] = raw[at : (at := at + 4 * len(own))]
        if known is self.words or known is self.pieces:
            self.kept += 200 * len(new) + sum(map(len, new)) + len(raw)
        return [known[t] for t in texts]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): the ids of each distinct piece."""
        stems = pc.ascii_rtrim(pieces, characters=_MARKS)
        plain = pc.match_substring_regex(stems, _LETTERS)
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(pieces), pc.binary_length(stems)))
        words = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(pieces.filter(marked), characters=_LATIN).dictionary_encode()
        plain, marked = (x.to_numpy(zero_copy_only=False) for x in (plain, marked))
        rest = pieces.filter(pa.array(~plain)).to_pylist()
        n_words = len(words.dictionary)
        own = self._known(words.dictionary.to_pylist(), True) + self._known(rest, False)
        own += [b"", *self._known(marks.dictionary.to_pylist(), False)]
        size = np.array([len(x) // 4 for x in own], np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        # a piece is two parts: its word, or all of it; its marks, or nothing
        part = np.full((len(pieces), 2), n_words + len(rest), np.int32)
        part[plain, 0] = words.indices.to_numpy()
        part[~plain, 0] = n_words + np.arange(len(rest))
        part[marked, 1] += 1 + marks.indices.to_numpy()
        n = size[part].sum(1, dtype=np.int32)
        ids = _gathered(np.frombuffer(b"".join(own), "<u4"), first, size, part.reshape(-1))
        return ids, np.cumsum(n, dtype=np.int32) - n, n

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        pieces = split.values.dictionary_encode()
        del split
        ids, first, size = self._distinct(pieces.dictionary)
        code = pieces.indices.to_numpy()
        out = [_gathered(ids, first, size, code[k : k + (1 << 18)]) for k in range(0, len(code), 1 << 18)]
        return np.concatenate([np.empty(0, np.uint32), *out]), np.concatenate([[0], np.cumsum(size[code], dtype=np.int64)])[offsets]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after another, and the n + 1 bounds of the texts; null is empty."""
        if not self.fast:
            ids = [e.ids for e in self.whole.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([x for own in ids for x in own], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        data, offsets = utf8(column)
        cuts = _cuts(data, offsets)
        parts, bounds, base = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for a, b in chunks(cuts, AT_ONCE):
            own = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(cuts[a : b + 1] - cuts[a]), pa.py_buffer(data[cuts[a] : cuts[b]]))
            ids, ends = self._encoded(own)
            parts.append(ids)
            bounds.append(ends[1:] + base)
            base += len(ids)
        return np.concatenate(parts), np.concatenate(bounds)[np.searchsorted(cuts, offsets)]

    def documents(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``batch``, with an end id after each text."""
        ids, bounds = self.batch(column)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))

    def encode(self, text: str | None) -> bytes:
        """All ids of one text as little-endian unsigned 32-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[first[k] : first[k] + size[k]]`` for each k of ``which``, one after another."""
    n = size[which]
    end = np.cumsum(n, dtype=np.int32)
    at = np.repeat(first[which] - (end - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``offsets``, and places at white space in longer texts, so that parts are of about AT_ONCE bytes where spaces allow it."""

    def more() -> Iterator[int]:
        for k in np.flatnonzero(np.diff(offsets) > AT_ONCE).tolist():
            at = int(offsets[k]) + AT_ONCE
            while at < offsets[k + 1]:
                space = np.flatnonzero(~NOT_SPACE[data[at : min(at + AT_ONCE, int(offsets[k + 1]))]])
                if len(space):
                    at += int(space[0])
                    yield at
                at += AT_ONCE

    return np.sort(np.concatenate([offsets, np.fromiter(more(), np.int64)]))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker: the file is read once, and what it keeps between tasks is bounded by KEEP_BYTES."""
    return Encoder(path)
