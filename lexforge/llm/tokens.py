"""Exact token ids of whole texts by the ``tokenizers`` library, with a cache of encoded chunks."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from lexforge.llm import caches

#: ASCII white space, as the tokenizers take it. Both vocabularies used here start a new token
#: wherever white space follows other characters, so texts cut there encode chunk by chunk.
SPACE = np.zeros(256, bool)
SPACE[list(b"\t\n\x0b\x0c\r ")] = True
#: Signs before which a letter ends its token in both vocabularies, so texts are cut there too.
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?#$%&*")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Other characters that a tokenizer or Python may take for white space; texts with one are encoded whole.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Their first bytes in UTF-8; only texts that hold one are searched for ODD.
ODD_BYTES = np.zeros(256, bool)
ODD_BYTES[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Bytes of the characters below U+0180 that lower-casing and NFC leave at their length, and that start nothing new.
EVEN = np.ones(256, bool)
EVEN[[*range(0x1C, 0x20), 0xC2, 0xC4, *range(0xC6, 0x100)]] = False
#: Chunks a generation of the cache; a worker holds two at most, about 100 MB.
GENERATION = 250_000
#: Bytes of text cut at once; a longer text is cut alone.
SLICE = 1 << 23
#: Bytes the library encodes at once, but for a longer chunk: its results take some hundred times the ids' room.
CALL = 1 << 18
#: Bytes of chunks set side by side in one text, where the tokenizer drops white space.
SIDE = 1 << 12

_ENCODERS: dict[str, "Encoder"] = {}
caches.register("tokens", _ENCODERS.clear)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers, just as the library gives them for the whole text.

    The names of special tokens (``<|endoftext|>``) hold neither white space nor a stop, so no cut parts one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        # A tokenizer of lower-cased words that drops white space and marks the ends of words (word_bpe_49k).
        suffix = made["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        dropped = (splits[0].get("behavior"), splits[0].get("invert"), splits[-1].get("type")) == ("Removed", True, "ByteLevel")
        self.words = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and dropped
        if self.words:
            # Bytes that each id stands for: one a sign of the byte alphabet, without the mark.
            vocabulary = self.tokenizer.get_vocab()
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.width[i] = len(token.removesuffix(suffix))
        # Chunks seen of late, and those seen before; frequent ones move on, rare ones fall out.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        out, at, sizes = [], 0, np.cumsum([len(t) for t in texts])
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CALL, side="right")))
            out += (self._beside(texts[at:to]) if self.words else None) or self._each(texts[at:to])
            at = to
        return out

    def _each(self, texts: list[bytes]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in batch]

    def _beside(self, texts: list[bytes]) -> list[bytes] | None:
        """ids of chunks encoded side by side, which saves the library's cost of a text.

        White space parts words and has no ids, so a blank between chunks changes none; where a chunk ends is told by
        the bytes its ids stand for. Chunks with characters that may change their length are encoded each. None where
        an end falls within an id, which no vocabulary used here does.
        """
        n = len(texts)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        to = np.cumsum(np.fromiter(map(len, texts), np.int64, n))
        odd = np.unique(np.searchsorted(to, np.flatnonzero(~EVEN[raw]), side="right")).tolist()
        ends = np.append(0, np.cumsum(~SPACE[raw]))[to]  # bytes without white space
        if odd:
            held = np.ones(n, bool)
            held[odd] = False
            even = [texts[i] for i in np.flatnonzero(held)]
            ends, to = np.cumsum(np.diff(ends, prepend=0)[held]), np.cumsum(np.diff(to, prepend=0)[held])
        else:
            even = texts
        cuts = np.searchsorted(to, np.arange(SIDE, to[-1], SIDE)) if even else []
        edges = np.unique([0, *cuts, len(even)]).tolist()
        lines = [b" ".join(even[a:b]).decode() for a, b in zip(edges, edges[1:])]
        ids = array("I")
        for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids.extend(e.ids)
        upto = np.append(0, np.cumsum(self.width[np.frombuffer(ids, "<u4")]))
        at = np.searchsorted(upto, ends).clip(max=len(ids))
        if (upto[at] != ends).any() or (len(ends) and at[-1] != len(ids)):
            return None
        joined, at = ids.tobytes(), (4 * at).tolist()
        out = [joined[a:b] for a, b in zip([0, *at], at)]
        if odd:
            rest, each = iter(out), dict(zip(odd, self._each([texts[i] for i in odd])))
            out = [each[i] if i in each else next(rest) for i in range(n)]
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """ids of each text; a null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        if not n:
            return []
        ends = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
        out, at = [], 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            data = column.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[ends[at] : ends[to]] if data is not None else np.zeros(0, np.uint8)
            out += self._slice(raw, ends[at : to + 1] - ends[at])
            at = to
        return out

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        if len(young) > GENERATION:
            self.old, self.young = old, young = young, {}
        found = list(map(young.get, chunks))
        missed = [c for c, x in zip(chunks, found) if x is None]
        if not missed:
            return found
        again = list(map(old.get, missed))
        new = iter(self._encode([c for c, x in zip(missed, again) if x is None]))
        again = [next(new) if x is None else x for x in again]
        # Texts encoded whole are not worth a place.
        if max(map(len, missed)) <= 64:
            young.update(zip(missed, again))
        else:
            young.update((c, x) for c, x in zip(missed, again) if len(c) <= 64)
        rest = iter(again)
        return [next(rest) if x is None else x for x in found]

    def _alike(self, raw: np.ndarray) -> np.ndarray:
        """Letters from A to Z in lower case and ends of lines as blanks, which is what the tokenizer makes of them.

        A letter stays if a combining mark may follow it: NFC comes first, and knows some letters only in one case.
        Texts with the beginning of a special token are not given here, as its name stands for itself in lower case only.
        """
        capital = raw - np.uint8(0x41) < 26
        capital[:-1] &= raw[1:] < 0xC6
        out = raw | (capital.view(np.uint8) << np.uint8(5))
        out[(raw == 0x0A) | (raw == 0x0D) | (raw == 0x09)] = 0x20
        return out

    def _slice(self, raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts side by side in ``raw``, parted at ``ends``; each distinct chunk is looked up once."""
        begins = ends[:-1]
        if self.words and len(raw) and b"<|" not in raw.tobytes():
            raw = self._alike(raw)
        space = SPACE[raw]
        first = space.copy()
        first[1:] &= ~space[:-1]
        # A stop after an ASCII letter, or after one of the two-byte letters from U+00C0 to U+00FF.
        letter = LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        first[1:] |= STOP[raw[1:]] & letter[:-1]
        first[begins[begins < ends[1:]]] = True
        whole = {}
        suspect = np.flatnonzero(ODD_BYTES[raw])
        for i in np.unique(np.searchsorted(ends, suspect, side="right") - 1).tolist():
            text = raw[begins[i] : ends[i + 1]].tobytes()
            if ODD.search(text.decode()):
                whole[i] = text
                first[begins[i] + 1 : ends[i + 1]] = False
        starts = np.flatnonzero(first)
        if not len(starts):
            return [b""] * len(begins)
        edges = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(raw)]).dictionary_encode()
        _, edges, data = chunks.dictionary.buffers()
        edges, data = np.frombuffer(edges, np.int32, len(chunks.dictionary) + 1).tolist(), data.to_pybytes()
        ids, which = self._look_up([data[a:b] for a, b in zip(edges, edges[1:])]), chunks.indices.to_numpy()
        # Lay the ids of all chunks side by side: each id's place in the table is its rank within its chunk.
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, place = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        long = size[which]
        to = np.cumsum(long)
        flat = table[np.repeat(place[which] - (to - long), long) + np.arange(to[-1])]
        cuts = 4 * np.append(0, to)[np.searchsorted(starts, ends)]
        joined = flat.tobytes()
        cuts = cuts.tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; the caches of other operators are let go."""
    caches.claim("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
