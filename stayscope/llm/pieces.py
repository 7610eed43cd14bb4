"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At every position
its output links name the pieces that end there, longest first, and each relaxes
the best score of that position; the best path back gives the ids. Characters in
no piece cost more than any piece and fall back to their bytes.

The normaliser supported is the identity with an optional leading mark; others
are refused. No piece has a mark after another character, and none has a
newline, so a path passes the place before each run of marks and both sides of a
newline: texts are cut there and the path of each distinct part is kept.

Defined cases: a null or empty text has no ids and decodes to an empty text; a
mark in the text decodes to a blank, as in the library; ties keep the longer
last piece. Scores are summed in double precision; the
library sums in single precision, where the very low scores of some files hide
all others.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from stayscope.llm.textarrays import map_slices, with_fields

MARK = "▁"
# Piece kinds of the model format, and the penalty of an unknown character
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_PENALTY = 10.0
_KEPT_PARTS = 200_000


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.bytes: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.unknown = 0
        self.find = ahocorasick.Automaton()
        normal = [p.score for p in proto.pieces if p.type == _NORMAL]
        self.lost = min(normal, default=0.0) - _PENALTY
        inner, letters, self.single = False, set(), set()
        for i, p in enumerate(proto.pieces):
            self.shown.append(b"" if p.type == _CONTROL else p.piece.replace(MARK, " ").encode())
            if p.type in (_NORMAL, _USER):
                score = p.score if p.type == _NORMAL else len(p.piece) * max(normal, default=0.0) - 0.1
                self.find.add_word(p.piece, (len(p.piece), i, score))
                inner |= MARK in p.piece.lstrip(MARK)
                letters |= set(p.piece)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
            elif p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.shown[-1] = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                self.unknown = i
                self.shown[-1] = " ⁇ ".encode()
        self.find.make_automaton()
        cut = "".join(c for c in "\n\t" if c not in letters)
        self.parts = re.compile("(?s).+" if inner else f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if cut else ""))
        self.fallback = np.zeros(len(proto.pieces), bool)
        self.fallback[list(self.bytes.values())] = True
        self.known: dict[str, bytes] = {}

    def path(self, part: str) -> bytes:
        """Ids of the best path through ``part``, as 32-bit numbers."""
        n = len(part)
        best, before, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        plain = self.single.issuperset(part)  # then no character can be unknown
        done = 0  # positions up to here are final
        for end, (size, i, score) in self.find.iter(part):
            e = end + 1
            if not plain and end > done:
                self._unknown(part, done, end, best, before)
                done = end
            s = best[e - size] + score
            if s > best[e]:
                best[e], before[e], piece[e] = s, e - size, i
        if not plain:
            self._unknown(part, done, n, best, before)
        out: list[int] = []
        e = n
        while e:
            s = before[e]
            if piece[e] >= 0:
                out.append(piece[e])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[s:e].encode())]
            else:
                out.append(self.unknown)
            e = s
        return array("i", out[::-1]).tobytes()

    def _unknown(self, part: str, done: int, upto: int, best: list, before: list) -> None:
        """Relax the positions after ``done`` by a character that is no piece itself."""
        for e in range(done + 1, upto + 1):
            if part[e - 1] not in self.single and best[e - 1] + self.lost > best[e]:
                best[e], before[e] = best[e - 1] + self.lost, e - 1

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self.known) > _KEPT_PARTS:
            self.known.clear()
        known, out = self.known, []
        for part in self.parts.findall(self.prefix + text.replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self.path(part)
                if len(part) < 100:
                    known[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        shown = self.shown
        whole = b"".join([shown[i] for i in ids])
        if self.prefix and whole[:1] == b" ":
            whole = whole[1:]
        return whole.decode(errors="replace")


_LOADED: dict[str, Model] = {}


def loaded(path: str) -> Model:
    """A model file's automaton, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, and what they decode to (``decoded_sha256``, ``round_trip``), in place of ``text``; no shuffle."""
    kept = [c for c in docs.columns if c != "text"]

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = loaded(path), [x or "" for x in part.column("text").to_pylist()]
        ids = [model.encode(x) for x in texts]
        back = [model.decode(x.tolist()) for x in ids]
        sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
        same = pa.array([x == y for x, y in zip(back, texts)], pa.bool_())
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), sha, same], [*kept, "ids", "decoded_sha256", "round_trip"])

    schema = with_fields(StructType([f for f in docs.schema if f.name != "text"]), ids=ArrayType(IntegerType()), decoded_sha256=StringType(), round_trip=BooleanType())
    return map_slices(docs, rows, schema, limit=1 << 20)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give a null text."""

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, n_fallback, ids_sha256, decoded_sha256, round_trip): ids hashed as 32-bit little-endian numbers."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        model, out = loaded(path), []
        for text in part.column("text").to_pylist():
            ids = model.encode(text or "")
            back = model.decode(ids.tolist())
            out.append((len(ids), int(model.fallback[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        return pa.record_batch([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", "n_pieces", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip"])

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, n_pieces long, n_fallback long, ids_sha256 string, decoded_sha256 string, round_trip boolean", limit=1 << 20)
