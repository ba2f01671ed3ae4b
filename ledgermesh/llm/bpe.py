"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a segment the table holds the one last token of the prefix's
encoding. A token that ends at the position (found by an Aho-Corasick automaton)
is that last token if it stays next to the last token of the prefix before it,
which a memoised test on the pair tells. Ids are recovered backwards from the
last entry. No token holds the word mark behind another character, so a text is
cut before each run of word marks and segments are encoded apart and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgermesh.llm.text import texts_of, tidy

MARK = "▁"

#: Segments that a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 300_000
#: Longer segments are not remembered.
LONGEST_REMEMBERED = 64


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id; types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 5 if sp.is_unused(i) else 6 if sp.is_byte(i) else 1
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class PrefixTable:
    """Encoder and decoder of one model. add_dummy_prefix and byte fallback as the model of BPE type has them; texts are not normalised."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == 2)
        self.bos = next((i for i, x in enumerate(pieces) if x[0] == "<s>"), None)
        self.eos = next((i for i, x in enumerate(pieces) if x[0] == "</s>"), None)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds the word mark behind another character; segments can't be cut there")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, bytes] = {}
        self.back = [p.encode().replace(MARK.encode(), b" ") if kind == 1 else b"" for p, _, kind in pieces]

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' joined text end in just these two tokens."""
        known = self.pair.get((left, right))
        if known is None:
            known = self.pair[left, right] = self._merged(self.pieces[left][0] + self.pieces[right][0]) == [self.pieces[left][0], self.pieces[right][0]]
        return known

    def _merged(self, s: str) -> list[str]:
        """Merge by rank, for the texts of token pairs only (32 characters at most in practice)."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def segment(self, s: str) -> list[int]:
        """Ids of a segment: a run of word marks and what follows up to the next one."""
        n = len(s)
        last = [0] * n  # last token of the prefix that ends here; -1: a character without a piece
        length = [1] * n
        at = -1
        filled = bytearray(n)
        for end, (token, size) in self.automaton.iter(s):
            if end == at:
                continue  # this position has its token
            start = end - size
            if start < 0:
                ok = True
            elif not filled[start]:
                ok = True  # behind a character that no piece holds
            else:
                prev = last[start]
                ok = self.pair.get((prev, token))
                if ok is None:
                    ok = self.apart(prev, token)
            if ok:
                last[end], length[end], filled[end], at = token, size, 1, end
        ids: list[int] = []
        i = n - 1
        while i >= 0:
            if filled[i]:
                ids.append(last[i])
                i -= length[i]
            else:
                raw = s[i].encode()
                ids.extend(self.byte_id[b] for b in reversed(raw)) if self.byte_id else ids.append(self.unknown)
                i -= 1
        ids.reverse()
        return ids

    def __call__(self, s: str) -> bytes:
        out = self.seen.get(s)
        if out is None:
            out = np.array(self.segment(s), dtype="<u4").tobytes()
            if len(s) <= LONGEST_REMEMBERED:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[s] = out
        return out

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, between the begin and end ids if `ends`."""
        head = np.array([self.bos], "<u4").tobytes() if ends and self.bos is not None else b""
        tail = np.array([self.eos], "<u4").tobytes() if ends and self.eos is not None else b""
        if not text:
            return head + tail
        get, new = self.seen.get, self
        body = [get(s) or new(s) for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]
        return head + b"".join(body) + tail

    def decode(self, ids: bytes) -> str:
        """The text of the ids: control ids vanish, byte ids are joined, one leading space of the first piece goes."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        raw = b"".join(map(self.decoded.__getitem__, numbers))
        text = raw.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text

    @property
    def decoded(self) -> list[bytes]:
        if not hasattr(self, "_decoded"):
            self._decoded = [bytes([int(p[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else own for (p, _, kind), own in zip(self.pieces, self.back, strict=True)]
        return self._decoded


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_TABLES: dict[str, PrefixTable] = {}


def table_of(path: str) -> PrefixTable:
    """The worker's own table of the model at the path."""
    if path not in _TABLES:
        _TABLES[path] = PrefixTable(read_model(path))
    return _TABLES[path]


def encode_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the ids (array of int) and the text decoded from them, for each row of docs.

    A null text counts as empty: begin and end ids only. Equal and repeated rows are encoded
    each for itself; other columns are left out. The model file must be readable on each executor
    at the same path, as an installed package is; it isn't copied.
    """
    rows = texts_of(docs, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "ids binary", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = [table.encode(x) for x in part.column("text").to_pylist()]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array([table.decode(x) for x in ids], pa.string())], names=[*part.schema.names[:-1], "ids", "decoded"])

    return rows.mapInArrow(tidy(run), schema)


def digest_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of each row, by the prefix table; the ids too (little-endian unsigned 32-bit integers) if asked for."""
    rows = texts_of(docs, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        sha = hashlib.sha256
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n, first, second, kept = [], [], [], []
                for text in part.column("text"):
                    ids = table.encode(text.as_py())
                    n.append(len(ids) // 4)
                    first.append(sha(ids).hexdigest())
                    second.append(sha(table.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(ids)
                columns = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), *([pa.array(kept, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return rows.mapInArrow(tidy(run), schema)
