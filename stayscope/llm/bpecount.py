"""Token counts of byte-level pair merging, without the tokenizer library.

Texts are cut into pre-tokens on arrays of code points. Pre-tokens that a worker
has not counted yet are held as one ragged array of symbols; in each round every
sequence merges its own lowest-ranked pair, everywhere at once, until no pair
has a rank. Counts of symbols that survive are kept by hash of the pre-token.

Defined cases: a null or empty text has no token; a special token's string inside
a text is one token and cuts the text; a very long pre-token takes more rounds
but only its own symbols take part in them.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayscope.llm.textarrays import map_slices, range_hash

_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_NONE = np.int32(2**31 - 1)
# White space of the pre-token pattern
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KEPT_COUNTS = 1_000_000


def _kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kind = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    kind[_WHITE] = _SPACE
    return kind


class Merges:
    """Ranks of the pairs of a byte-level vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [t["content"] for t in model.get("added_tokens", []) if t.get("special")]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.byte = np.array([vocab[chr(shown[b])] for b in range(256)], np.int64)
        pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair)
        self.pair, self.rank = pair[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.kind = _kinds()
        self.counts: dict[int, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def surviving(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each range of bytes after all merges."""
        size = ends - starts
        out = np.zeros(len(size), np.int64)
        offset = np.cumsum(size) - size
        symbol = self.byte[data[np.repeat(starts - offset, size) + np.arange(int(size.sum()))]]
        of = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(symbol), _NONE, np.int32)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(of)])
            finished = least == _NONE
            if finished.any():
                out[of[first[finished]]] = length[finished]
                stay = np.repeat(~finished, length)
                symbol, of, rank = symbol[stay], of[stay], rank[stay]
                least, length = least[~finished], length[~finished]
                if not len(symbol):
                    break
            low = np.repeat(least, length)
            hit = np.flatnonzero(rank == low)
            # of a run of overlapping equal pairs, every second one merges
            begin = np.r_[True, hit[1:] != hit[:-1] + 1]
            hit = hit[(hit - np.maximum.accumulate(np.where(begin, hit, 0))) % 2 == 0]
            symbol[hit] = self.merged[low[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            symbol, of, rank = symbol[keep], of[keep], rank[keep]
            touched = np.union1d(at, np.maximum(at - 1, 0))
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[of[touched] == of[touched + 1]]
            rank[touched] = self.ranks(symbol[touched], symbol[touched + 1])
        return out

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of the texts, starts and ends of pre-tokens in it, and each one's text."""
        whole = "".join([x + "\n" for x in texts])
        point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        stop = np.cumsum([len(x) + 1 for x in texts]) - 1
        kind = self.kind[point]
        kind[stop] = _END
        cut = np.r_[True, kind[1:] != kind[:-1]]
        cut[stop] = True
        cut[stop[:-1] + 1] = True
        # the last white space before other text stands alone, or joins the text if it is a blank
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
        cut[last] = True
        cut[last[point[last] == 0x20] + 1] = False
        # contractions after an apostrophe that stands alone
        mark = np.flatnonzero((point[:-1] == 0x27) & cut[:-1] & (kind[1:] == _LETTER))
        one, two = point[mark + 1], point[np.minimum(mark + 2, len(point) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        cut[mark[short | long] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[long] + 3] = True
        start = np.flatnonzero(cut)
        start, end = start, np.r_[start[1:], len(point)]
        real = kind[start] != _END
        start, end = start[real], end[real]
        wide = np.zeros(len(point) + 1, np.int64)
        np.cumsum(1 + (point >= 0x80).astype(np.int8) + (point >= 0x800) + (point >= 0x10000), out=wide[1:])
        return np.frombuffer(whole.encode(), np.uint8), wide[start], wide[end], np.searchsorted(stop, start)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                pieces = [p for x in pieces for p in x.split(s)]
            out[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return out
        data, start, end, of = self.pretokens(parts)
        key, at, back = np.unique(range_hash(data, start, end, seed=21), return_index=True, return_inverse=True)
        if len(self.counts) > _KEPT_COUNTS:
            self.counts.clear()
        keys = key.tolist()
        known = np.array([self.counts.get(k, 0) for k in keys], np.int64)
        new = np.flatnonzero(known == 0)
        if len(new):
            known[new] = self.surviving(data, start[at[new]], end[at[new]])
            self.counts.update(zip(key[new].tolist(), known[new].tolist()))
        np.add.at(out, np.array(owner, np.int64), np.bincount(of, known[back], len(parts)).astype(np.int64))
        return out


_LOADED: dict[str, Merges] = {}


def loaded(path: str) -> Merges:
    """Tables of a vocabulary file, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text); no shuffle."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in part.column("text").to_pylist()]
        n = loaded(path).count(texts)
        size = pa.array([len(x.encode()) for x in texts], pa.int64())
        return pa.record_batch([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", limit=2 << 20)
