"""Licence scan: ordered signature rules behind a keyword prefilter, with priority and containment suppression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgermesh.llm.license_rules import Rule, rules
from ledgermesh.llm.text import PUNCT, slices, texts_of, tidy, words_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Detection:
    label: str
    rule: int
    priority: int
    first_word: int
    last_word: int
    base: bool


class Scanner:
    """Scans normalised word strings. One worker builds it once."""

    def __init__(self) -> None:
        self.rules: list[Rule] = rules()
        anchored: dict[str, list[int]] = {}
        for r in self.rules:  # the set whose shortest piece is longest is seldom met, so it is looked for first
            for k in max(r.keywords, key=lambda s: min(map(len, s))):
                anchored.setdefault(k.decode(), []).append(r.order)
        self.keywords = ahocorasick.Automaton()
        for k in sorted(anchored):
            self.keywords.add_word(k, anchored[k])
        self.keywords.make_automaton()

    def possible(self, low: bytes) -> list[Rule]:
        """The rules whose keywords stand in the lower-cased text, in their order."""
        met = {id(orders): orders for _, orders in self.keywords.iter(low.decode("latin-1"))}
        tried = sorted({k for orders in met.values() for k in orders})
        return [r for r in map(self.rules.__getitem__, tried) if all(any(k in low for k in s) for s in r.keywords)]

    def gate(self, low: bytes) -> bool:
        """Whether any rule may match."""
        return bool(self.possible(low))

    def scan(self, low: bytes) -> list[Detection]:
        """Detections in the lower-cased text that no other one suppresses, in word order."""
        tried = self.possible(low)
        if not tried:
            return []
        joined = b" " + b" ".join(WORD.findall(low)) + b" "
        places = [(r, m.start(), m.end()) for r in tried for m in r.regex.finditer(joined)]
        if not places:
            return []
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        first = np.searchsorted(blanks, [a for _, a, _ in places]) - 1
        last = np.searchsorted(blanks, [b for _, _, b in places]) - 1
        return suppress([Detection(r.label, r.order, r.priority, a, b, r.base) for (r, _, _), a, b in zip(places, first.tolist(), last.tolist(), strict=True)])


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop a detection that lies within a kept one of higher priority, or of equal priority and an earlier rule or longer; base ones stay.

    What lies within a dropped one lies within a kept one too, so a detection is held against the furthest end of all before it that
    begin no later: a tree of maxima over the begins keeps it.
    """
    begins = {w: i + 1 for i, w in enumerate(sorted({d.first_word for d in found}))}
    furthest = [-1] * (len(begins) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.first_word - d.last_word, d.rule, d.first_word)):
        end, i = -1, begins[d.first_word]
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if d.base or end < d.last_word:
            kept.append(d)
        i = begins[d.first_word]
        while i < len(furthest):
            furthest[i] = max(furthest[i], d.last_word)
            i += i & -i
    return sorted(kept, key=lambda d: (d.first_word, d.last_word, d.rule))


_SCANNER: list[Scanner] = []


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licence labels of each text with the places of the base phrases.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections (label, priority, first_word,
    last_word). A null text counts as empty: no words, no labels, score 0. Repeated rows repeat; other columns are left out.
    score: 1 - prod(1 - priority / 110) over the kept detections, so 0 without any.
    """
    rows = texts_of(docs, "doc_id")
    schema = (
        f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " detections array<struct<label:string,priority:int,first_word:long,last_word:long>>"
    )
    one = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scanner = _SCANNER[0]
        for batch in batches:
            for part in slices(batch):
                n_words = words_of(part.column("text"), PUNCT, lower=True).counts()
                n = part.num_rows
                n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
                base_labels, labels, score, all_found = [""] * n, [""] * n, np.zeros(n), [[]] * n
                for i, x in enumerate(part.column("text")):
                    found = scanner.scan(x.as_buffer().to_pybytes().lower())
                    if found:
                        base = [d for d in found if d.base]
                        if base:
                            n_base[i], first[i], last[i] = len(base), min(d.first_word for d in base), max(d.first_word for d in base)
                        base_labels[i] = ",".join(sorted({d.label for d in base}))
                        labels[i] = ",".join(sorted({d.label for d in found}))
                        score[i] = 1 - float(np.prod([1 - d.priority / 110 for d in found]))
                        all_found[i] = [{"label": d.label, "priority": d.priority, "first_word": d.first_word, "last_word": d.last_word} for d in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(all_found, one)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    return rows.mapInArrow(tidy(run), schema)
