"""The grammar of packed cells by example, by round trip, and on odd tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestock.operators.packed import PackedGrammar, split_packed

VOCABULARY = ["gaming", "music, live sets", '15" carry', "kids' homework", "photo/video editing", "point of sale; kiosk", "café work"]
G = PackedGrammar(VOCABULARY)

CASES = [
    (None, []), ("", []), ("  ", []), ("[]", []), ("N/A", []), ("none", []), ("gaming", ["gaming"]),
    ("gaming, study", ["gaming", "study"]), ("gaming;;study;", ["gaming", "study"]), (", gaming", ["gaming"]), ("a | b;c, d", ["a", "b", "c", "d"]),
    ("music, live sets, gaming", ["music, live sets", "gaming"]), ("MUSIC, LIVE SETS;x", ["MUSIC, LIVE SETS", "x"]),
    ("photo/video editing / gaming", ["photo/video editing", "gaming"]), ("a + b + kids' homework", ["a", "b", "kids' homework"]),
    ('"music, live sets"; "gaming"', ["music, live sets", "gaming"]), ("'music, live sets','gaming'", ["music, live sets", "gaming"]),
    ('["caf\\u00e9 work", "15\\" carry"]', ["café work", '15" carry']), ('"15"" carry","gaming"', ['15" carry', "gaming"]),
    ('{gaming,"point of sale; kiosk"}', ["gaming", "point of sale; kiosk"]), ("['x', \"kids' homework\"]", ["x", "kids' homework"]),
    ("“gaming” “study”", ["gaming", "study"]), ("a\tb\r\nc", ["a", "b", "c"]), ("a、b，c", ["a", "b", "c"]), ("x, x, x", ["x", "x", "x"]),
    ('15" carry, gaming', ['15" carry', "gaming"]),
    ("a; (b, c); d", ["a", "b, c", "d"]), ("[a, b], c", ["a, b", "c"]), ("(a, b) c, d", ["(a, b) c", "d"]), ("a (b, c), d", ["a (b, c)", "d"]),
    ("[a, b], [c]", ["a, b", "c"]), ("[[a, b], {c}]", ["a, b", "c"]), ('["a]", "b"]', ["a]", "b"]), ('("a, b"); c', ["a, b", "c"]), ("( )", []), ("a, (), b", ["a", "b"]),
]


@pytest.mark.parametrize("cell,want", CASES)
def test_cells(cell, want):
    assert G.parse(cell) == (want, [])


def test_malformed_cells_are_read_and_flagged():
    assert G.parse('"gaming, study') == (["gaming", "study"], ["unclosed_quote"])
    assert G.parse("[gaming, study") == (["gaming", "study"], ["unclosed_bracket"])
    assert G.parse("a, (b, c") == (["a", "b", "c"], ["unclosed_bracket"])
    assert G.parse("a b), c") == (["a b", "c"], ["unclosed_bracket"])
    assert G.parse("a ( b, c") == (["a ( b", "c"], ["unclosed_bracket"])
    assert G.parse("[a, b], c]") == (["a, b", "c"], ["unclosed_bracket"])
    assert G.parse("gaming, study]") == (["gaming", "study"], ["unclosed_bracket"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*VOCABULARY, "thesis", "sim racing", "Taxi"]), min_size=2, max_size=8), st.sampled_from([", ", ";", " | ", "\n", " • ", ",,"]), st.booleans())
def test_round_trip(labels, delimiter, quoted):
    cell = delimiter.join('"' + x.replace('"', '""') + '"' if quoted else x for x in labels)
    assert G.parse(cell)[0] == labels


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'\"[]{}(),;|\\“” \n", max_size=30))
def test_never_fails(cell):
    values, _ = G.parse(cell)
    assert all(v and v == v.strip() for v in values)


def test_placeholders_are_a_parameter():
    assert G.parse("Unknown") == ([], [])
    assert PackedGrammar(placeholders=()).parse("Unknown") == (["Unknown"], [])


def test_many_brackets_take_linear_time():
    assert len(G.parse("(" * 200_000 + "a")[0]) == 1
    assert len(G.parse("([" * 50_000 + "a)" * 50_000)[0]) == 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "a,b", "x"), (1, "a,b", "x"), (2, None, "x"), (3, "one", "x"), (None, "c;d", "x"), (4, "z," * 20_000, "x")], "id long, cell string, value string")
    out = split_packed(df, "id", "cell", VOCABULARY, min_values=2).collect()
    assert sorted((r.row_id or 0, r.pos, r.value) for r in out if r.row_id != 4) == [(0, 1, "c"), (0, 2, "d"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert sum(r.row_id == 4 for r in out) == 20_000
    assert split_packed(df.limit(0), "id", "cell").count() == 0
