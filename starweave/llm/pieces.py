"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is escaped as the library does (a leading mark, marks for spaces) and cut into words: a run of
marks and what follows it. No piece crosses such a cut, so the best segmentation of the text is that
of its words. Words that a task has not met yet are grouped by length and searched together: the
hashes of all substrings of one length probe that length's sorted piece keys, and vectorised maxima
over the last piece's length store backpointers. The segmentation maximises the sum of the piece
scores; ties go to the longer last piece. Characters without a piece become byte pieces.

Piece scores are taken as a unigram model's log probabilities, whatever kind of model the file
names. Nothing is shuffled; the piece table is broadcast (its size is that of the vocabulary file).

Defined results: null and empty texts have no ids and decode to the empty text; decoding gives back
every text exactly; repeated rows and null ids pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.llm.common import documents

MARK = "▁"
_LITERAL = "\udfff"  # stands for a mark that the text itself holds; no valid text holds it
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def piece_table(model_file: str) -> list[tuple[str, float, int]]:
    """(piece, score, byte or -1) by id; pieces that cannot be matched have a score of minus infinity."""
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(m.get_piece_size()):
        byte = int(m.id_to_piece(i)[3:5], 16) if m.is_byte(i) else -1
        usable = not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        out.append((m.id_to_piece(i), m.get_score(i) if usable else -np.inf, byte))
    return out


class Codec:
    LIMIT = 300_000  # words whose ids are kept

    def __init__(self, table: list[tuple[str, float, int]]) -> None:
        self._bytes = {b: i for i, (_, _, b) in enumerate(table) if b >= 0}
        self._out = [bytes([b]) if b >= 0 else p.replace(MARK, " ").encode() for p, _, b in table]
        usable = [(p, s, i) for i, (p, s, _) in enumerate(table) if s > -np.inf and p]
        self._unknown = min((s for _, s, _ in usable), default=0.0) - 10
        # A piece with a mark after another character would cross words: then texts are not cut.
        self._cut = not any(MARK in p.lstrip(MARK) for p, _, _ in usable)
        self._keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p, _, _ in usable}):
            own = [(p, s, i) for p, s, i in usable if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p, _, _ in own], dtype=_U)
            key = self._roll(codes, n)[:, 0]
            by = np.argsort(key)
            self._keys[n] = (key[by], np.array([s for _, s, _ in own])[by], np.array([i for _, _, i in own])[by])
        self._known: dict[str, bytes] = {}

    @staticmethod
    def _roll(codes: np.ndarray, n: int) -> np.ndarray:
        """Hash of every ``n``-character substring of each row."""
        size = codes.shape[1] - n + 1
        with np.errstate(over="ignore"):
            h = np.zeros((len(codes), size), dtype=_U)
            for k in range(n):
                h = h * _P + codes[:, k:k + size] + _U(1)
        return h

    def _viterbi(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of one length, as little-endian 32-bit bytes."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n).astype(_U)
        scores, ids = {}, {}
        for size, (keys, value, piece) in self._keys.items():
            if size <= n:
                h = self._roll(codes, size)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                scores[size] = np.where(hit, value[at], -np.inf)
                ids[size] = np.where(hit, piece[at], -1)
        one = scores.get(1, np.full((m, n), -np.inf))
        scores[1] = np.where(one == -np.inf, self._unknown, one)
        ids.setdefault(1, np.full((m, n), -1))
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), dtype=np.int64)
        sizes = sorted(scores, reverse=True)  # longer pieces first: they win ties
        for e in range(1, n + 1):
            for size in sizes:
                if size <= e:
                    new = best[:, e - size] + scores[size][:, e - size]
                    better = new > best[:, e]
                    best[better, e] = new[better]
                    back[better, e] = size
        for r, word in enumerate(words):
            e, out = n, []
            while e > 0:
                size = int(back[r, e])
                i = int(ids[size][r, e - size])
                if i >= 0:
                    out.append(i)
                else:
                    raw = (MARK if word[e - 1] == _LITERAL else word[e - 1]).encode()
                    out.extend(self._bytes.get(b, 0) for b in reversed(raw))
                e -= size
            yield np.array(out[::-1], dtype="<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as little-endian 32-bit bytes."""
        cut = []
        for t in texts:
            escaped = MARK + t.replace(MARK, _LITERAL).replace(" ", MARK) if t else ""
            cut.append(_WORD.findall(escaped) if self._cut else [escaped] if escaped else [])
        new = {w for words in cut for w in words if w not in self._known}
        ids = dict.fromkeys(())
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for n, words in by_length.items():
            step = max(1, (1 << 18) // n)
            for a in range(0, len(words), step):
                ids.update(zip(words[a:a + step], self._viterbi(words[a:a + step])))
        out = [b"".join([self._known[w] if w in self._known else ids[w] for w in words]) for words in cut]
        if len(self._known) < self.LIMIT:
            self._known.update(ids)
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self._out.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw[1:].decode("utf-8", "replace")  # without the leading mark


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``ids`` (little-endian 32-bit)."""
    table = docs.sparkSession.sparkContext.broadcast(piece_table(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(table.value)
        for b in _chunks(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(codec.encode_all(b.column("text").to_pylist()), pa.binary())],
                                  names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``."""
    table = encoded.sparkSession.sparkContext.broadcast(piece_table(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(table.value)
        for b in _chunks(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array([codec.decode(i or b"") for i in b.column("ids").to_pylist()], pa.string())],
                                  names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, n_byte_pieces, ids_crc32, and whether decoding gives the text back."""
    table = docs.sparkSession.sparkContext.broadcast(piece_table(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(table.value)
        is_byte = np.array([b >= 0 for _, _, b in table.value])
        for b in _chunks(batches):
            texts = b.column("text").to_pylist()
            ids = codec.encode_all(texts)
            yield pa.record_batch([
                b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([int(is_byte[np.frombuffer(i, dtype="<u4")].sum()) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                pa.array([codec.decode(i) == (t or "") for i, t in zip(ids, texts)], pa.bool_()),
            ], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
