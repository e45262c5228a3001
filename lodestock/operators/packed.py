"""Several values packed in one field: split them into one row per value.

The cell is read by a parsing expression grammar, every choice ordered::

    cell      <- blank* ( open list close blank* end / list end )
    list      <- delim* ( item ( delim+ / blank+ &quote ) )* item? delim*
    item      <- quoted / label / bracketed / bare
    quoted    <- quote label quote &stop / quote ( escape / double / !( quote &stop ) any )* quote &stop
    label     <- a label of the vocabulary, longest first, &stop
    bracketed <- group &stop
    bare      <- ( group / !delim any )+
    group     <- open ( group / !close any )* close
    stop      <- blank* ( delim / close end / end ) / blank+ quote

Brackets around the whole cell hold a list; brackets around an item hold one value, whose delimiters
don't split it, like those of a group inside a bare value: ``a; (b, c); d (e, f)`` has the values
``a``, ``b, c`` and ``d (e, f)``. Punctuation inside a label of the vocabulary never splits it.

A quoted value whose closing quote is missing makes ``quoted`` fail; the parser backs up to the
quote, drops it and reads on with the other alternatives, and the cell gets the flag
``unclosed_quote``. A bracket without its partner makes ``group`` fail: at the start or the end of an
item it is dropped, inside it is an ordinary character, and the cell gets ``unclosed_bracket``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters between values, pairs of brackets and quotes.
DELIMITERS = ",;|/+\t\r\n•·，；、｜"
BRACKETS = {"[": "]", "{": "}", "(": ")"}
CLOSING = {c: o for o, c in BRACKETS.items()}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}

#: Default of ``placeholders``: cells that, as a whole and in any letter case, say that there is no value.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nan", "-", "--", "?", "unknown")


def _flag(flags: list[str], name: str) -> None:
    if name not in flags:
        flags.append(name)


def _pairs(text: str) -> dict[int, int]:
    """Where each bracket that has a partner opens, and where it closes."""
    open_at: list[int] = []
    waiting = dict.fromkeys(BRACKETS, 0)
    found: dict[int, int] = {}
    for i, c in enumerate(text):
        if c in BRACKETS:
            open_at.append(i)
            waiting[c] += 1
        elif c in CLOSING and waiting[CLOSING[c]]:
            while True:  # brackets of another kind that were opened since have no partner
                at = open_at.pop()
                waiting[text[at]] -= 1
                if text[at] == CLOSING[c]:
                    break
            found[at] = i
    return found


class PackedGrammar:
    """The grammar for one vocabulary; ``parse`` gives the values and the error flags of a cell."""

    def __init__(self, vocabulary: list[str] | None = None, delimiters: str = DELIMITERS, placeholders: tuple[str, ...] = PLACEHOLDERS):
        d = re.escape(delimiters)
        labels = sorted({x.strip() for x in vocabulary or [] if x and x.strip()}, key=lambda x: (-len(x), x))
        label = "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in labels) or r"(?!)"
        close = re.escape("".join(CLOSING))
        opening = re.escape("".join(QUOTES))
        self.placeholders = {x.lower() for x in placeholders}
        self.delimiters = set(delimiters)
        self.stop = re.compile(rf"\s*(?:[{d}]|[{close}]?\s*\Z)|\s+(?=[{opening}])")
        self.gap = re.compile(rf"[{d}\s]+")
        self.label = re.compile(rf"(?:{label})(?=\s*(?:[{d}]|[{close}]?\s*\Z)|\s+[{opening}])", re.IGNORECASE)
        self.bare = re.compile(rf"[^{d}]+")
        self.bracket = re.compile(rf"[{re.escape(''.join(BRACKETS))}{close}]")
        self.quoted_label = re.compile(rf"(?:{label})", re.IGNORECASE)

    def parse(self, cell: str | None) -> tuple[list[str], list[str]]:
        text = (cell or "").strip()
        if not text or text.lower() in self.placeholders:
            return [], []
        if BRACKETS.get(text[0]) == text[-1]:
            flags: list[str] = []
            values = self._list(text[1:-1], flags, text[-1])
            if values is not None:
                return values, flags
        flags = []
        return self._list(text, flags), flags

    def _list(self, text: str, flags: list[str], around: str = "") -> list[str] | None:
        """The values of a list. None if the closing bracket ``around`` the list stands in it without an opening one."""
        out: list[str] = []
        at, end = 0, len(text)
        pairs = _pairs(text) if self.bracket.search(text) else {}
        while at < end:
            if m := self.gap.match(text, at):
                at = m.end()
                continue
            c = text[at]
            if c in QUOTES and (read := self._quoted(text, at)):
                value, at = read
            elif m := self.label.match(text, at):
                value, at = m[0], m.end()
            elif at in pairs and self.stop.match(text, pairs[at] + 1):
                inner = text[at + 1 : pairs[at]].strip()
                read = self._quoted(inner, 0) if inner[:1] in QUOTES else None
                value, at = read[0] if read and read[1] == len(inner) else inner, pairs[at] + 1
            elif c in QUOTES or (c in BRACKETS or c in CLOSING) and at not in pairs:
                if c == around:
                    return None
                _flag(flags, "unclosed_quote" if c in QUOTES else "unclosed_bracket")
                at += 1
                continue
            elif (read := self._bare(text, at, pairs, flags, around)) is None:
                return None
            else:
                value, at = read
            if value := value.strip():
                out.append(value)
        return out

    def _bare(self, text: str, at: int, pairs: dict[int, int], flags: list[str], around: str) -> tuple[str, int] | None:
        """The bare value that starts here and where it ends; None as in ``_list``."""
        m = self.bare.match(text, at)
        if not self.bracket.search(m[0]):
            return m[0], m.end()
        start, lone = at, set()
        while at < len(text) and text[at] not in self.delimiters:
            if at in pairs:
                at = pairs[at]
            elif text[at] in BRACKETS or text[at] in CLOSING:
                lone.add(at)
            at += 1
        if any(text[i] == around for i in lone):
            return None
        last = at
        while last > start and (last - 1 in lone or text[last - 1].isspace()):
            last -= 1
        if lone:
            _flag(flags, "unclosed_bracket")
        return text[start:last], at

    def _quoted(self, text: str, at: int) -> tuple[str, int] | None:
        """The value of the quoted item that starts here and where it ends, or None."""
        close = QUOTES[text[at]]
        start = at + 1
        if (m := self.quoted_label.match(text, start)) and text[m.end() : m.end() + 1] == close and self.stop.match(text, m.end() + 1):
            return m[0], m.end() + 1
        value: list[str] = []
        i, end = start, len(text)
        while i < end:
            c = text[i]
            if c == "\\" and i + 1 < end:
                if text[i + 1] == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                    value.append(chr(int(text[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                value.append({"n": "\n", "t": "\t", "r": "\r"}.get(text[i + 1], text[i + 1]))
                i += 2
            elif c == close:
                if text[i + 1 : i + 2] == close and i > start and not (self.stop.match(text, i + 1)):
                    value.append(close)
                    i += 2
                elif self.stop.match(text, i + 1):
                    return "".join(value), i + 1
                else:
                    value.append(c)
                    i += 1
            else:
                value.append(c)
                i += 1
        return None


def split_packed(
    df: DataFrame,
    key: str,
    cell: str,
    vocabulary: list[str] | None = None,
    *,
    min_values: int = 1,
    delimiters: str = DELIMITERS,
    placeholders: tuple[str, ...] = PLACEHOLDERS,
) -> DataFrame:
    """One row per value of a packed cell: row_id, pos (from 1), value, n_values, flags.

    Rows keep no other column, so names of further columns can't clash. A null, empty or blank cell, and
    one that is a whole one of ``placeholders`` (in any letter case), gives no row; repeated values and repeated keys come out each time. ``min_values`` keeps
    only cells with that many values. No shuffle: the scan reads key and cell only.
    """
    cells = df.select(F.col(f"`{key}`").alias("row_id"), F.col(f"`{cell}`").cast("string").alias("cell")).where("cell is not null")
    dtype = cells.schema["row_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = PackedGrammar(vocabulary, delimiters, placeholders)
        for batch in batches:
            if not batch.num_rows:
                continue
            # Cells repeat: each different one of the batch is parsed once, rows take its values by index.
            coded = batch.column(1).dictionary_encode()
            parsed = [grammar.parse(c) for c in coded.dictionary.to_pylist()]
            of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([len(v) if len(v) >= min_values else 0 for v, _ in parsed], np.int64)
            start = np.cumsum([0, *[len(v) for v, _ in parsed]])[:-1]
            n = size[of]
            row = np.repeat(np.arange(len(of)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            values = pa.array([x for v, _ in parsed for x in v], pa.string())
            flags = pa.array([f for _, f in parsed], pa.list_(pa.string()))
            for at in range(0, len(row), 50_000):  # a batch of long cells makes many rows
                r, k = row[at : at + 50_000], place[at : at + 50_000]
                c = of[r]
                columns = [batch.column(0).take(pa.array(r)), pa.array(size[c].astype(np.int32)), flags.take(pa.array(c)), pa.array(k + 1), values.take(pa.array(start[c] + k))]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "n_values", "flags", "pos", "value"])

    return cells.mapInArrow(split, f"row_id {dtype}, n_values int, flags array<string>, pos long, value string")
