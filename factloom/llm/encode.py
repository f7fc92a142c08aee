"""Token ids of whole texts through the ``tokenizers`` library, each distinct piece encoded once.

A text is cut where its tokenizer never joins characters, every piece's bytes
are hashed, and only pieces that this worker has not met are encoded.  The ids
equal those of encoding the whole text:

* byte-level vocabularies whose pattern gives a space to the word behind it:
  cut before a space that a non-space follows;
* vocabularies that drop white space: cut at ASCII white space.

Other tokenizers get their texts whole.  Strings of special tokens in a text
are ordinary text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from factloom.llm.textbytes import U, Rolling, chunks, runs

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A space before one of these bytes is no cut: control characters, white space and lead bytes of wider white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = " 0 "


class Encoder:
    """Encodes byte buffers of many texts. Not safe for threads."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        first = (pre.get("pretokenizers") or [{}])[0]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "byte"
            vocabulary = self.tokenizer.get_vocab()
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)  # a byte-level token has a character for each byte
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(norm):
            self.kind = "word"
            self.mark = self._ids(["0"])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids, one after the other, and how many each has.

        Pieces are encoded many at a time: behind one another, or with a mark
        between them, where that changes no id.
        """
        if self.kind == "byte":
            joins = np.array([x[0] == " " for x in pieces])
        else:
            joins = np.array(["0" not in x for x in pieces])
        sizes, parts = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)] * len(pieces)
        alone = np.flatnonzero(~joins)
        for i, ids in zip(alone, self._ids([pieces[i] for i in alone]), strict=True):
            parts[i] = np.array(ids, np.uint32)
        many = np.flatnonzero(joins)
        groups = [many[k : k + 2000] for k in range(0, len(many), 2000)]
        glue = "" if self.kind == "byte" else _MARK
        for group, ids in zip(groups, self._ids([glue.join(pieces[i] for i in g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            if self.kind == "byte":
                ends = np.cumsum([len(pieces[i].encode()) for i in group])
                stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1
                cut = np.split(ids, stops[:-1])
            else:
                cut = [x[1:] if n else x for n, x in enumerate(np.split(ids, np.flatnonzero(ids == self.mark)))]
            for i, x in zip(group, cut, strict=True):
                parts[i] = x
        sizes[:] = [len(x) for x in parts]
        return np.concatenate(parts) if parts else self.ids[:0], sizes

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "word":
            solid = ~_SPACE[data]
            starts, ends = runs(solid)
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            cuts = np.unique(cuts[solid[cuts] & solid[cuts - 1]]) if len(cuts) else cuts
            if len(cuts):
                starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
            return starts, ends
        begin = np.zeros(len(data), bool)
        begin[:-1] = (data[:-1] == 32) & ~_NO_CUT[data[1:]]
        begin[np.clip(offsets[1:-1][offsets[1:-1] > 0] - 1, 0, None)] = False  # a text's last space has no word behind it
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and the texts' offsets in them."""
        found = [self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        if not found:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        counts = np.concatenate([c for _, c in found])
        return np.concatenate([i for i, _ in found]), np.concatenate(([0], np.cumsum(counts)))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        raw = data.tobytes()
        if self.kind == "whole":
            out = self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.concatenate([np.array(x, np.uint32) for x in out]), np.array([len(x) for x in out])
        starts, ends = self._pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        keys, where, inverse = np.unique(Rolling(data).ranges(starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + new.sum() > self.most and len(self.keys):
                self._clear()
                new[:] = True
            w = where[new]
            ids, sizes = self._many([raw[a:b].decode() for a, b in zip(starts[w].tolist(), ends[w].tolist(), strict=True)])
            at = len(self.ids) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.ids = np.concatenate((self.ids, ids))
            spot = np.searchsorted(self.keys, keys[new])
            self.keys, self.at, self.size = np.insert(self.keys, spot, keys[new]), np.insert(self.at, spot, at), np.insert(self.size, spot, sizes)
        spot = np.searchsorted(self.keys, keys)[inverse]
        at, size = self.at[spot], self.size[spot]
        ends_ = np.cumsum(size)
        out = self.ids[np.repeat(at - (ends_ - size), size) + np.arange(ends_[-1])]
        owner = np.searchsorted(offsets, starts, "right") - 1
        return out, np.bincount(owner, size, texts).astype(np.int64)


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its pieces, for each worker process and vocabulary."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def append_id(ids: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``last`` behind each text's."""
    return np.insert(ids, offsets[1:], np.uint32(last)), offsets + np.arange(len(offsets))
