import random
from collections import defaultdict

import numpy as np
import pytest

from lodestock.llm.spans import Anchors, SpanIndex, class_links, shared_spans, span_coverage, span_links, span_members, span_pairs, together

N = 30


def brute(rows, n):
    held = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - n + 1):
            held[t[i : i + n]].add(d)
    return {(a, b) for s in held.values() for a in s for b in s if a < b}


def covered(rows, n):
    where = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - n + 1):
            where[t[i : i + n]].add(d)
    out = {}
    for d, t in rows:
        marks = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                marks[i : i + n] = True
        out[d] = int(marks.sum())
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared = [word(k) for k in (29, 30, 31, 45, 200)]
    rows = [(i, word(rng.randint(0, 120)) + rng.choice(shared) + word(rng.randint(0, 120))) for i in range(60)]
    rows += [(100, "a" * 400), (101, "b" * 20 + "a" * 300), (102, "ab" * 100), (103, rows[0][1]), (104, rows[0][1]), (105, None), (106, ""), (107, "é" * 10 + shared[4] + "𝒳" * 40), (108, "𝒳" * 31)]
    return rows


@pytest.mark.parametrize("hot,batches,seed", [(64, 3, 1), (1, 2, 2), (3, 4, 3)])
def test_against_all_windows(spark, hot, batches, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class string")
    index, matches = shared_spans(docs, batches=batches, min_span=N, gram=12, hot=hot)
    got = [(r.doc_a, r.doc_b) for r in span_pairs(index, matches).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, N)
    cover = {r.doc_id: r.shared_chars for r in span_coverage(index, matches, docs).collect()}
    assert cover == covered(rows, N)


def test_anchors_of_long_texts_meet(monkeypatch):
    from lodestock.llm import spans

    monkeypatch.setattr(spans, "SEGMENT", 100)
    rng = random.Random(5)
    text = "".join(rng.choice("abc") for _ in range(1000))
    make = Anchors(10, N)
    at, h, first, last = make.of(text)
    monkeypatch.setattr(spans, "SEGMENT", 1 << 19)
    at2, h2, first2, last2 = Anchors(10, N).of(text)
    assert list(at) == list(at2) and list(h) == list(h2) and list(first) == list(first2) and list(last) == list(last2)
    assert int((last - first + 1).sum()) == 1000 - N + 1
    assert all(((at >= i) & (at + 10 <= i + N)).any() for i in range(1000 - N + 1))


def test_index_keeps_only_tables(spark):
    index = SpanIndex(spark, min_span=N, gram=12)
    a = spark.createDataFrame([(1, "q" * 5 + "abcdefghij" * 4)], "doc_id long, text string")
    b = spark.createDataFrame([(2, "zz" + "abcdefghij" * 4)], "doc_id long, text string")
    assert index.append(a).links().count() == 0
    assert {(r.class_a, r.class_b) for r in index.append(b).links().collect()} == {(1, 2)}
    assert [level for level, _ in index.runs] == [0, 0]
    assert index.append(a.limit(0)).links().count() == 0
    assert [level for level, _ in index.runs] == [1, 0]  # compacted before the next batch came
    with pytest.raises(ValueError):
        SpanIndex(spark, min_span=10, gram=10)


def test_reopened_index_goes_on(spark):
    rows = texts(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = SpanIndex(spark, min_span=N, gram=12, hot=3, buckets=3)
    early = index.append(docs.where("doc_id % 2 = 0"))
    # A session that was lost in the middle of an append: what it wrote isn't listed.
    index._write(spark.createDataFrame([(1, 2, 3, 4, 5, 0)], "g long, class long, pos int, first int, last int, part int"), "run")
    again = SpanIndex.open(spark, index.path)
    assert (again.runs, again.members, again.texts, again.buckets, again.hot) == (index.runs, index.members, index.texts, 3, 3)
    found = again.append(docs.where("doc_id % 2 = 1"))
    third = SpanIndex.open(spark, index.path)
    assert {(r.doc_a, r.doc_b) for r in span_pairs(third, together([early, found])).collect()} == brute(rows, N)
    with pytest.raises(ValueError):
        SpanIndex.open(spark, index.path + "-none")


def test_history_is_not_shuffled(spark):
    index = SpanIndex(spark, min_span=N, gram=12, buckets=4)
    rows = texts(8)
    for i in range(2):
        index.append(spark.createDataFrame(rows[i::3], "doc_id long, text string"))
    new, history = index._table(index.runs[-1][1]), [index._table(n) for _, n in index.runs[:-1]]
    plan = index._shared(new, history)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Exchange hashpartitioning" not in plan


def test_frequent_spans_are_stars(spark):
    """A passage that many hold: links grow with the records, coverage needs no pairs, pairs come out in blocks."""
    from lodestock.llm import spans

    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefghijkl") for _ in range(k))
    passage = word(90)
    rows = [(i, word(40) + passage + word(40)) for i in range(60)] + [(100 + i, rows_text) for i in range(30) for rows_text in [passage + "tail"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    block = spans.BLOCK
    try:
        spans.BLOCK = 7
        index, found = shared_spans(docs, batches=2, min_span=N, gram=12, hot=4)
        pairs = [(r.doc_a, r.doc_b) for r in span_pairs(index, found).collect()]
    finally:
        spans.BLOCK = block
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, N)
    links = span_links(found).collect()
    assert len(links) <= 4 * 61 and all(r.class_a < r.class_b for r in links)
    held = {r.doc_id: r for r in span_members(index, found).collect()}
    assert len(held) == 90 and {held[100 + i]["class"] for i in range(30)} == {held[100]["class"]}
    assert held[105].copies == 30 and all(r.links >= 1 for r in held.values())
    # One connected component: nobody's link was lost.
    seen, todo = set(), [held[0]["class"]]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [r.class_b for r in links if r.class_a == c] + [r.class_a for r in links if r.class_b == c]
    assert seen == {r["class"] for r in held.values()}


def common_stretches(x, y, n):
    """Lengths of the stretches of n characters or more that stand in both, each as long as it can be."""
    out = []
    for shift in range(n - len(x), len(y) - n + 1):
        run = 0
        for i in range(max(0, -shift), min(len(x), len(y) - shift) + 1):
            if i < min(len(x), len(y) - shift) and x[i] == y[i + shift]:
                run += 1
            else:
                out += [run] if run >= n else []
                run = 0
    return out


@pytest.mark.parametrize("hot,batches", [(0, 1), (2, 3), (64, 2)])
def test_all_links_with_all_stretches(spark, hot, batches):
    """Whether an anchor is frequent decides how its links are found, not which come out."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    p, q = word(80), word(70)
    parts = [p, q, p[:45], p[30:], q[10:55], p + q, "-" * 50, "=-" * 24, "abc" * 15, p[:40] + "|" + p[41:], "x" * 70]
    rows = [(i * 37 % 101, "".join(rng.choice(parts) + word(rng.randint(0, 9)) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    rows += [(200, rows[0][1]), (201, "-" * 120), (202, "=-" * 60), (203, "=-" * 40 + "-" * 60), (204, None)]
    index, found = shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, min_span=N, gram=12, hot=hot)
    name = {r.doc_id: r["class"] for r in index.all_members().collect()}
    text = {name[d]: t for d, t in rows if d in name}
    want = {(a, b): s for a in text for b in text if a < b and (s := common_stretches(text[a], text[b], N))}
    links = class_links(index, found).collect()
    assert {(r.class_a, r.class_b): (r.places, r.longest) for r in links} == {k: (len(s), max(s)) for k, s in want.items()} and len(links) == len(want)
    assert {r["class"]: r.links for r in span_members(index, found).collect()} == {c: sum(c in k for k in want) for c in text}


def test_queries_link_all_holders_of_a_passage(spark, tmp_path):
    """70 documents with one passage, more than an anchor is paired for: p8_links and p8_members leave out no pair."""
    from lodestock.llm import queries

    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefghijkl") for _ in range(k))
    passage = word(200)
    spark.createDataFrame([(i, word(30) + "A" + passage + "B" + word(30)) for i in range(70)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    links = queries.p8_links(spark, str(tmp_path)).collect()
    assert {(r.class_a, r.class_b) for r in links} == {(a, b) for a in range(70) for b in range(a + 1, 70)} and len(links) == 70 * 69 // 2
    assert {(r.doc_id, r.links) for r in queries.p8_members(spark, str(tmp_path)).collect()} == {(i, 69) for i in range(70)}
