"""Encoding of a corpus with a public byte-level BPE tokenizer.

Each partition splits its texts into words, and DuckDB encodes the distinct ones: token-position rows
join the merge table, and a recursive query contracts each word's leftmost pair of minimum rank, with
all later occurrences of that pair that don't overlap (no merge can come between them), until no pair
is in the table. An ordered aggregation gives each word's ids, and offsets put the words of a text
together. Recursion stops after ``ROUNDS`` contractions and goes on from the rows then reached, so
that earlier states don't fill memory.

Long words (blobs without spaces) are cut into pieces of ``PIECE`` bytes, which are encoded as words of
their own and put together two by two: the tokens around the seam are encoded anew, over ever more of
them, until the outermost ones stay as they were. An encoding is right exactly if every two neighbours
encode to themselves (a known property of byte-pair encoding), so what lies outside the seam holds.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.llm.duck import run, task_db
from lodestock.sources.shared import shared_root

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed pattern of the tokenizer: how a text falls into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 24
PIECE = 128  # bytes
SEAM = 4  # tokens on either side of a seam, at first
CHUNK = 8_000_000  # characters held at once
KNOWN = 400_000  # words kept from chunk to chunk


def _characters() -> dict[str, int]:
    """The printable character that stands for each byte in the tokenizer's file, and the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    """Ids of words by the merge table of a tokenizer file (.json with merges, or .tiktoken with ranks)."""

    def __init__(self, path: str, shared: str | None = None):
        self.shared = shared
        self.byte_ids, self.merges, self.bytes_of = self._load(path)
        self._db = task_db(shared)
        self.con = self._db.__enter__()
        self.con.register("m", self.merges)
        run(self.con, "create temp table merges as select * from m")
        self.con.unregister("m")

    def close(self) -> None:
        self._db.__exit__(None, None, None)

    @staticmethod
    def _load(path: str) -> tuple[np.ndarray, pa.Table, dict[int, bytes]]:
        byte_ids = np.zeros(256, np.int32)
        rows = []
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            bytes_of = {i: word for word, i in ranks.items()}
            for word, i in ranks.items():
                if len(word) == 1:
                    byte_ids[word[0]] = i
                rows += [(ranks[word[:k]], ranks[word[k:]], i, i) for k in range(1, len(word)) if word[:k] in ranks and word[k:] in ranks]
        else:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocab = model["vocab"]
            characters = _characters()
            bytes_of = {i: bytes(characters[c] for c in word) for word, i in vocab.items() if all(c in characters for c in word)}
            for c, b in characters.items():
                byte_ids[b] = vocab[c]
            for rank, pair in enumerate(model["merges"]):
                a, b = pair.split(" ") if isinstance(pair, str) else pair
                rows.append((vocab[a], vocab[b], rank, vocab[a + b]))
        a, b, rank, new = (np.array(x, np.int32) for x in zip(*rows))
        return byte_ids, pa.table({"a": a, "b": b, "rank": rank, "new": new}), bytes_of

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        data = [w.encode() for w in words]
        long = [k for k, w in enumerate(data) if len(w) > 2 * PIECE]
        if not long:
            return self._encode(data)
        pieces: list[bytes] = []
        shape = []
        for k, w in enumerate(data):
            cut = [w[i : i + PIECE] for i in range(0, len(w), PIECE)] if len(w) > 2 * PIECE else [w]
            shape.append(len(cut))
            pieces += cut
        ids, size = self._encode(pieces)
        parts = np.split(ids, np.cumsum(size)[:-1])
        ends = np.cumsum(shape)
        whole = [parts[e - n] if n == 1 else None for e, n in zip(ends, shape)]
        open_words = {k: parts[ends[k] - shape[k] : ends[k]] for k in long}
        while open_words:  # all seams of a level at once, so there are as many levels as the longest word has doublings
            pairs = [(k, i) for k, held in open_words.items() for i in range(0, len(held) - 1, 2)]
            joined = dict(zip(pairs, self._join([(open_words[k][i], open_words[k][i + 1]) for k, i in pairs])))
            for k, held in list(open_words.items()):
                open_words[k] = [joined[k, i] if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
                if len(open_words[k]) == 1:
                    whole[k] = open_words.pop(k)[0]
        return np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))

    def _join(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The encodings of the texts of two encodings put together."""
        out: list[np.ndarray | None] = [None] * len(sides)
        todo, width = list(range(len(sides))), SEAM
        while todo:
            around = [(sides[i][0][-width:], sides[i][1][:width]) for i in todo]
            ids, size = self._encode([b"".join(self.bytes_of[t] for side in a for t in side.tolist()) for a in around])
            left = []
            for i, (a, b), new in zip(todo, around, np.split(ids, np.cumsum(size)[:-1])):
                x, y = sides[i]
                # The outermost token of each side must stay, unless its side ends there.
                if (len(a) == len(x) or new[0] == a[0] and len(new) > 1) and (len(b) == len(y) or new[-1] == b[-1] and len(new) > 1):
                    out[i] = np.concatenate([x[: len(x) - len(a)], new, y[len(b) :]])
                else:
                    left.append(i)
            todo, width = left, 2 * width
        return out

    def _encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, by the recursive query alone."""
        if not data:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        size = np.fromiter(map(len, data), np.int64, len(data))
        tokens = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        starts = np.cumsum(size) - size
        state = pa.table(
            {"w": np.repeat(np.arange(len(data), dtype=np.int32), size), "pos": (np.arange(len(tokens)) - np.repeat(starts, size)).astype(np.int32), "tok": tokens}
        )
        con = self.con
        con.register("s0", state)
        run(con, "create or replace temp table state as select w, pos, tok from s0")
        run(con, "create or replace temp table done (w integer, pos integer, tok integer)")
        con.unregister("s0")
        while run(con, "select count(*) from state")[0][0]:
            run(con, 
                f"""create or replace temp table steps as
                with recursive s(w, pos, tok, i) as (
                    select w, pos, tok, 0 from state
                    union all
                    select w, pos, case when take then new else tok end, i + 1 from (
                        select *, lag(take, 1, false) over (partition by w order by pos) gone from (
                            select *, hit and (row_number() over (partition by w, hit, run order by pos)) % 2 = 1 take from (
                                select *, sum(case when hit then 0 else 1 end) over (partition by w order by pos) run from (
                                    select *, coalesce(rank = least_rank, false) hit from (
                                        select p.*, m.rank, m.new, min(m.rank) over (partition by p.w) least_rank
                                        from (select *, lead(tok) over (partition by w order by pos) nxt from s where i < {ROUNDS}) p
                                        left join merges m on m.a = p.tok and m.b = p.nxt
                                    ) where least_rank is not null)))
                    ) where not gone)
                select * from s"""
            )
            run(con, "create or replace temp table last as select w, max(i) i from steps group by w")
            run(con, f"insert into done select s.w, s.pos, s.tok from steps s join last l on l.w = s.w and l.i = s.i where l.i < {ROUNDS}")
            run(con, f"create or replace temp table state as select s.w, s.pos, s.tok from steps s join last l on l.w = s.w and l.i = s.i where l.i = {ROUNDS}")
        ids = con.sql("select w, list(tok order by pos) ids from done group by w order by w").to_arrow_table()
        lists = ids.column("ids").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        offsets = lists.offsets.to_numpy()
        return lists.values.to_numpy()[offsets[0] :].astype(np.int32), np.diff(offsets).astype(np.int64)


class TextEncoder:
    """Ids of texts; words once encoded are kept while they are few enough."""

    def __init__(self, path: str, shared: str | None = None):
        self.words = WordEncoder(path, shared)
        self.split = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.index) > KNOWN:
            self._forget()
        index = self.index
        found: list[int] = []
        n_words = np.zeros(len(texts), np.int64)
        fresh: list[str] = []
        for k, text in enumerate(texts):
            if text:
                words = self.split.findall(text)
                n_words[k] = len(words)
                for w in words:
                    i = index.get(w)
                    if i is None:
                        i = index[w] = len(index)
                        fresh.append(w)
                    found.append(i)
        ids, size = self.words.encode(fresh)
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        starts = np.cumsum(self.size) - self.size
        at = np.array(found, np.int64)
        length = self.size[at]
        ends = np.cumsum(length)
        flat = self.ids[np.repeat(starts[at] - (ends - length), length) + np.arange(int(length.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return flat, np.diff(bounds)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to CHUNK characters; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        # Long texts make large batches: rows are taken in pieces.
        lengths = np.array([len(x) if x else 0 for x in batch.column(1).to_pylist()], np.int64) if batch.nbytes > CHUNK else None
        pieces = [batch] if lengths is None else [batch.slice(a, b - a) for a, b in _cuts(lengths)]
        for piece in pieces:
            if held and size + piece.nbytes > CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += int(n)
    yield start, len(lengths)


def _run(path: str, shared: str, counts: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        try:
            for chunk in _chunks(batches):
                if not chunk.num_rows:
                    continue
                encoder = encoder or TextEncoder(path, shared)
                flat, size = encoder.encode(chunk.column(1).to_pylist())
                keys = chunk.column(0).combine_chunks()
                if isinstance(keys, pa.ChunkedArray):
                    keys = pa.concat_arrays(keys.chunks)
                if counts:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(size)], ["key", "n_tokens"])
                    continue
                ends = np.cumsum(size)
                for a in range(0, len(size), 5000):
                    b = min(a + 5000, len(size))
                    lo, hi = int(ends[a] - size[a]), int(ends[b - 1])
                    offsets = np.concatenate([[0], ends[a:b] - lo]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[lo:hi]))], ["key", "ids"])
        finally:
            if encoder:
                encoder.words.close()

    return encode


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids array<int>) of every row: ids of the text without special tokens, whose names are ordinary text.

    Null and empty texts get the empty list; blank texts are encoded as they stand. Keys may repeat or be
    null; each row comes out once. No shuffle. Further columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    dtype = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_run(tokenizer, shared_root(df.sparkSession), False), f"key {dtype}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row, 0 for null and empty texts."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    dtype = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_run(tokenizer, shared_root(df.sparkSession), True), f"key {dtype}, n_tokens long").withColumnRenamed("key", key)
