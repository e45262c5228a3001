import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestock.llm import bpe
from lodestock.llm.bpe import PATTERN, TextEncoder, count_tokens, encode_texts

RANKS = bpe.TOKENIZER.replace(".json", ".tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(bpe.TOKENIZER)


def ids(encoder, texts):
    flat, size = encoder.encode(texts)
    out, at = [], 0
    for n in size:
        out.append([int(x) for x in flat[at : at + n]])
        at += n
    return out


ODD = ["", " ", "  \n\t ", "<|endoftext|> x", "aaaaaaaaaaaaaaaa", "ab" * 900, "日本語テキスト" * 40, "é é́ 𝒳 👩‍👩‍👧", "x" * 3000, "I'll we've 1234567890 ---- !!!\r\n"]


def test_odd_texts(encoder, reference):
    assert ids(encoder, [*ODD, None]) == [reference.encode_ordinary(t) for t in ODD] + [[]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=12))
def test_any_texts(encoder, reference, texts):
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_both_files_agree(encoder, reference):
    assert ids(TextEncoder(RANKS), ODD) == ids(encoder, ODD)


def test_forgetting_words_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    e = TextEncoder(bpe.TOKENIZER)
    for text in ("one two three four", "four five six seven", "one seven"):
        assert ids(e, [text]) == [reference.encode_ordinary(text)]


def test_tables(spark, small, reference):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert got == {k: reference.encode_ordinary(t) if t else [] for k, t in rows.items()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    odd = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, None, 3)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_texts(odd).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert encode_texts(odd.limit(0)).count() == 0


def test_chunks_keep_rows(spark, monkeypatch, reference):
    texts = [f"row {i} " * (i % 7) for i in range(300)]
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CHUNK", 500)
    batch = pa.RecordBatch.from_pydict({"key": list(range(300)), "text": texts})
    out = [r for b in bpe._run(bpe.TOKENIZER, "", False)(iter([batch])) for r in b.to_pylist()]
    assert [r["key"] for r in out] == list(range(300)) and [r["ids"] for r in out] == [reference.encode_ordinary(t) for t in texts]


LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def test_long_words(encoder, reference):
    import random
    import time

    rng = random.Random(3)
    words = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (257, 2_000, 10_000, 40_000)]
    words += [" " * 5_000 + "x", "a" * 9_001, "ab" * 4_000, "=" * 3_000, "日本" * 2_000, "".join(rng.choice("aab") for _ in range(6_000)), "\n" * 2_500]
    began = time.process_time()
    got = ids(encoder, words)
    assert time.process_time() - began < 60
    assert got == [reference.encode_ordinary(w) for w in words]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.é", min_size=200, max_size=900), min_size=1, max_size=4))
def test_seams(reference, texts):
    e = TextEncoder(bpe.TOKENIZER)
    assert ids(e, texts) == [reference.encode_ordinary(t) for t in texts]


def test_seams_with_small_pieces(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 5)
    monkeypatch.setattr(bpe, "SEAM", 1)
    text = "internationalisation unconstitutionally " * 3 + "antidisestablishmentarianism" * 20 + " " * 77 + "!?" * 40
    assert ids(TextEncoder(bpe.TOKENIZER), [text]) == [reference.encode_ordinary(text)]
