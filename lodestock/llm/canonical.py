"""Free-entered values mapped to the entries of a canonical list.

Values are deduplicated, normalised and deduplicated again. Candidates come from an inverted index of
the list: character n-grams of the names' words, and their codes (the last token with a digit and what
stands behind it, such as ``4653H`` or ``S2 Pro``). A candidate's score is the cosine of two blocks: the
codes, which count for ``code_share``, and the words, compared by character n-grams weighted by inverse
frequency over the names. A value is accepted above ``threshold`` and with ``margin`` over the next
entry, and in no other way.

Numbers are no spelling: in the block of codes two numbers are alike or not at all (look-alike letters
read as digits), so the words of a value, however well they fit, never reach the threshold without the
right number.

What stands around a name and says nothing of it (``boxed``, ``8GB``, ``[lot 7f3a2c]``) is learnt from
the values: in values that hold a whole name as it stands, the forms of the other tokens are counted
by the entries they stand beside. A form beside many entries has no weight; all else has.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.sources.shared import keep, small

#: Letters of other scripts that look like Latin ones, and letters read for digits.
LOOKALIKES = str.maketrans("авекмнорстухіјѕ" + "αεικνορτυχ", "abekmhopctyxijs" + "aeiknoptux")
AS_DIGITS = str.maketrans("oilzsbОо", "01125800")
#: Fixed patterns: trade marks, and a token (a number with its decimals and unit is one).
MARKS = re.compile(r"[®™©]|\((?:r|tm|c)\)", re.IGNORECASE)
TOKEN = re.compile(r"\d+\.\d+[a-z]*|[0-9a-z]+")
LETTERS = re.compile(r"[a-z]+")
#: Defaults: least score, least lead over the next entry, share of the codes in a score. Words alone (the root of
#: what the codes leave) stay below the threshold. Words beside a code that are no more alike than unrelated ones count nothing.
THRESHOLD, MARGIN, CODE_SHARE = 0.65, 0.06, 0.58
CHANCE = 0.25
GROUP_ROWS = 2_000  # values that are resolved together, about
BLOCK_ENTRIES = 20_000  # names whose index one group holds, about


def clean(value: str) -> str:
    """The value in lower case with compatible and look-alike characters unified and trade marks removed."""
    # Marks go first: compatibility forms would turn them into letters.
    text = unicodedata.normalize("NFKC", MARKS.sub(" ", value)).lower()
    text = MARKS.sub(" ", unicodedata.normalize("NFKC", text.translate(LOOKALIKES)))
    return re.sub(r"\s+", " ", text).strip()


def squash(text: str) -> str:
    """Letters and digits only, look-alike letters read as digits: two spellings of one value squash alike."""
    return re.sub(r"[^0-9a-z]", "", text).translate(AS_DIGITS)


@lru_cache(100_000)
def grams(word: str) -> tuple[str, ...]:
    """Characters, and pairs at most two apart in either order: one edit or swap leaves most of them."""
    w = f"^{word}$"
    near = [w[i : i + 2] for i in range(len(w) - 1)] + [w[i] + w[i + 2] for i in range(len(w) - 2)]
    return (*word, *(min(p, p[::-1]) for p in near))


def split_name(name: str, remarks: set[str] = frozenset()) -> tuple[list[str], str, str]:
    """(words, number, what stands behind the number) of a cleaned name, squashed. The number is its last token with a digit.

    Words that are remarks have no weight here either, unless there are no others.
    """
    tokens = TOKEN.findall(name)
    tokens = [t for t in tokens if re.search(r"\d", t) or t not in remarks] or tokens
    last = max((i for i, t in enumerate(tokens) if re.search(r"\d", t)), default=None)
    if last is None:
        return [squash(t) for t in tokens], "", ""
    return [squash(t) for t in tokens[:last]], squash(tokens[last]), "".join(squash(t) for t in tokens[last + 1 :])


class Weights:
    """Inverse-frequency weights of the n-grams over the names; their number is bounded by the alphabet."""

    def __init__(self, df: dict[str, int], total: int):
        self.idf = {g: math.sqrt(math.log((1 + total) / (1 + d)) + 1) for g, d in df.items()}
        self.unseen = 1.0  # typing errors make n-grams that no name has

    def vector(self, words: list[str]) -> dict[str, float]:
        return {g: c * self.idf.get(g, self.unseen) for g, c in Counter(g for w in words for g in grams(w)).items()}


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(w * b[g] for g, w in a.items() if g in b)
    return dot and dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def beyond_chance(fit: float) -> float:
    return max(0.0, (fit - CHANCE) / (1 - CHANCE))


def pieces(text: str) -> list[tuple[str, str]]:
    """(what stands before the token, token) of a cleaned value."""
    out, end = [], 0
    for m in TOKEN.finditer(text):
        out.append((text[end : m.start()], m[0]))
        end = m.end()
    return out


def forms(parts: list[tuple[str, str]], i: int) -> tuple[str, str]:
    """The two forms under which the i-th token can be known as a remark.

    Its own: digits read as 9, and a bare number with the token behind it. And, for codes that are never
    the same, its length with what introduces it: the last punctuation before it, else the token before it.
    """
    before, token = parts[i]
    own = re.sub(r"\d", "9", token)
    if not LETTERS.search(token):
        own += parts[i + 1][0] + re.sub(r"\d", "9", parts[i + 1][1]) if i + 1 < len(parts) else ""
    mark = re.search(r"\s?\S+\s?$", before)
    lead = mark[0] if mark else parts[i - 1][1] + before if i else ""
    return own, f"{lead}?{len(token)}" if lead else ""


def strip(text: str, remarks: set[str], leads: bool = True) -> tuple[str, list[str]]:
    """The value without its remarks, and the tokens (squashed) left out for what introduces them; all of it if nothing else is left."""
    parts = pieces(text)
    held, dropped = [], []
    for i, (_, token) in enumerate(parts):
        own, lead = forms(parts, i)
        if own not in remarks:
            if leads and lead in remarks:
                dropped.append(squash(token))
            else:
                held.append(token)
    return (" ".join(held), dropped) if held else (" ".join(t for _, t in parts), [])


class Resolver:
    """Index of entries of one attribute. entries: (canon_id, cleaned name)."""

    def __init__(self, entries: list[tuple[int, str]], weights: Weights | None = None, remarks: set[str] = frozenset(), behinds: set[str] | None = None, threshold: float = THRESHOLD, margin: float = MARGIN, code_share: float = CODE_SHARE):
        self.threshold, self.margin, self.code_share = threshold, margin, code_share
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.names: list[tuple[int, int, str, str]] = []  # entry, its words, number, behind the number
        self.words: list[list[str]] = []
        number_of: dict[tuple[str, ...], int] = {}
        for canon, name in sorted(set(entries)):
            if not squash(name):
                continue
            self.exact[squash(name)].add(canon)
            words, number, behind = split_name(name, remarks)
            k = number_of.setdefault(tuple(words), len(self.words))
            if k == len(self.words):
                self.words.append(words)
            self.names.append((canon, k, number, behind))
        self.weights = weights or Weights(Counter(g for n in self.names for g in set(grams_of(self.words[n[1]]))), len(self.names))
        self.vectors = [self.weights.vector(w) for w in self.words]
        self.parts = [[self.weights.vector([w]) for w in words] for words in self.words]
        self.index: dict[str, list[int]] = defaultdict(list)  # n-gram -> words
        for k, vector in enumerate(self.vectors):
            for g in vector:
                self.index[g].append(k)
        self.by_code: dict[str, list[int]] = defaultdict(list)  # number and what is behind -> names
        self.by_number: dict[str, list[int]] = defaultdict(list)
        self.variants = {number for _, _, number, behind in self.names if behind}
        self.behinds = {behind for _, _, _, behind in self.names if behind} if behinds is None else behinds
        self.of_words: dict[int, list[int]] = defaultdict(list)
        for i, (_, k, number, behind) in enumerate(self.names):
            if number:
                self.by_code[number + behind].append(i)
                self.by_number[number].append(i)
            self.of_words[k].append(i)
        self.sizes = sorted({len(c) for c in self.by_code}, reverse=True)

    def core(self, text: str) -> tuple[int, int, int] | None:
        """(entry, first token, behind its last) of the longest run of tokens that is a whole name of one entry."""
        tokens = [squash(t) for _, t in pieces(text)]
        for size in range(len(tokens), 0, -1):
            for i in range(len(tokens) - size + 1):
                if len(hit := self.exact.get("".join(tokens[i : i + size]), ())) == 1:
                    return next(iter(hit)), i, i + size
        return None

    def _codes(self, raw: list[str]) -> Iterator[tuple[int, float, list[tuple[str, str]]]]:
        """(name, likeness of the code, the other tokens as written and squashed) of names whose number stands in the value."""
        tokens = [squash(t) for t in raw]
        both = list(zip(raw, tokens))
        for i in range(len(tokens)):
            joined = ""
            for j in range(i, min(len(tokens), i + 4)):
                joined += tokens[j]
                following = tokens[j + 1] if j + 1 < len(tokens) else ""
                # The number begins with the token, or inside it, written in one with what stands before it.
                for start in [0, *(len(joined) - size for size in self.sizes if 0 < len(joined) - size < len(tokens[i]))]:
                    code, ahead = joined[start:], raw[i][:start]
                    if code not in self.by_code and code not in self.by_number:
                        continue
                    digits = squash(re.search(r"\d*$", ahead)[0])
                    rest = both[:i] + ([(ahead, squash(ahead))] if ahead else [])
                    for k in self.by_code.get(code, ()):
                        _, w, number, behind = self.names[k]
                        # A variant's word behind the number makes it another model, and so does any word that
                        # is none of the name's if the number has variants.
                        if not behind and (following in self.behinds or number in self.variants and following and not self._known(following, w)):
                            continue
                        if self._apart(digits, w):
                            yield k, 1.0, rest + both[j + 1 :]
                    for k in self.by_number.get(code, ()) if following else ():
                        _, w, _, behind = self.names[k]
                        if behind and self._apart(digits, w) and (like := cosine(self.weights.vector([following]), self.weights.vector([behind]))):
                            yield k, like, rest + both[j + 2 :]

    def _apart(self, digits: str, words: int) -> bool:
        """Whether digits right before a number leave it what it is: only if the name's words end so."""
        return not digits or "".join(self.words[words]).endswith(digits)

    def _known(self, token: str, words: int) -> bool:
        vector = self.weights.vector([token])
        return any(cosine(vector, w) >= self.threshold for w in self.parts[words])

    def scores(self, text: str) -> dict[int, float]:
        """Score by entry of the candidates of a stripped value."""
        raw = TOKEN.findall(text)
        best: dict[int, float] = {}

        def offer(name: int, score: float) -> None:
            canon = self.names[name][0]
            if score > best.get(canon, 0.0):
                best[canon] = score

        seen = set()
        for k, like, rest in self._codes(raw):
            key = (k, like, tuple(rest))
            if key in seen:
                continue
            seen.add(key)
            words = self.words[self.names[k][1]]
            others = [t for r, t in rest if re.search(r"\d", r) and t not in words and not any(t.endswith(w) and w.isdigit() for w in words)]
            like /= math.sqrt(1 + len(others))
            kept = [t for r, t in rest if t not in others]
            fit = beyond_chance(cosine(self.weights.vector(kept), self.vectors[self.names[k][1]]))
            offer(k, self.code_share * like + (1 - self.code_share) * fit if kept else math.sqrt(self.code_share) * like)
        # Names by their words alone: the number is another one, or there is none.
        tokens = [squash(t) for t in raw]
        numbers = [t for r, t in zip(raw, tokens) if re.search(r"\d", r)]
        near = {k for g in {g for t in tokens for g in grams(t) if len(g) == 2} for k in self.index.get(g, ())}
        for k in near:
            words = self.words[k]
            other = [t for t in numbers if t not in words]
            kept = [t for t in tokens if t not in other]
            fit = cosine(self.weights.vector(kept), self.vectors[k])
            for i in self.of_words[k]:
                coded = bool(self.names[i][2])
                if coded or other:
                    offer(i, beyond_chance(fit) * ((1 - self.code_share) if coded and other else math.sqrt(1 - self.code_share)))
                else:
                    offer(i, fit)
        return best

    def top(self, text: str) -> list[tuple[int, float]]:
        """The two best entries with their scores, best first; ties by entry."""
        plain = squash(text)
        best = self.scores(text) if plain else {}
        hit = self.exact.get(plain, ())
        for canon in hit:
            best[canon] = 1.0
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:2]

    def resolve(self, text: str) -> tuple[int, float, float]:
        """(entry or 0, score, margin over the next entry) of a stripped value."""
        return decide(self.top(text), self.threshold, self.margin)


def grams_of(words: list[str]) -> Iterator[str]:
    for w in words:
        yield from grams(w)


def decide(top: list[tuple[int, float]], threshold: float, margin: float) -> tuple[int, float, float]:
    if not top:
        return 0, 0.0, 0.0
    gap = top[0][1] - (top[1][1] if len(top) > 1 else 0.0)
    return (top[0][0] if top[0][1] >= threshold and gap >= margin else 0), top[0][1], gap


LEARNT = "attribute string, cleaned string, size int, canon_id long, found array<struct<own: string, lead: string>>"
TOPS = "attribute string, stripped string, canon_id long, score double"


@F.pandas_udf(T.StringType())
def _clean(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(clean, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("number", T.StringType()), T.StructField("behind", T.StringType())]))
def _code(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_name(n)[1:] for n in names], columns=["number", "behind"])


def entry_names(entries: DataFrame) -> DataFrame:
    """(attribute, canon_id, name, number, behind): labels and aliases, cleaned; nulls and names without a letter or digit are left out."""
    each = entries.select("attribute", F.col("canon_id").cast("long").alias("canon_id"), F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label"))).alias("name"))
    named = each.where("name is not null").select("attribute", "canon_id", _clean("name").alias("name")).where("name rlike '[0-9a-z]'").distinct()
    return named.withColumn("code", _code("name")).select("attribute", "canon_id", "name", "code.*")


def _together(values: DataFrame, names: DataFrame, n_values: int, n_names: int, block_entries: int):
    """Values and names grouped for ``applyInPandas``: every group of values meets every block of names of its attribute.

    Names of one number share a block, so a number's variants are seen together. Neither side of a group
    grows with the data.
    """
    blocks = max(1, -(-n_names // block_entries))
    buckets = max(1, -(-n_values // max(GROUP_ROWS, min(n_names, block_entries))))
    column = values.columns[1]
    each = values.withColumns({"bucket": F.pmod(F.xxhash64(column), F.lit(buckets)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    block = F.pmod(F.xxhash64(F.when(F.col("number") != "", F.col("number")).otherwise(F.col("name"))), F.lit(blocks)).cast("int")
    spread = names.withColumns({"block": block, "bucket": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))})
    keys = ["attribute", "block", "bucket"]
    return each.groupBy(*keys).cogroup(spread.groupBy(*keys))


def _learn(values: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    resolver = Resolver(list(zip(names["canon_id"], names["name"]))) if len(names) else None
    out = []
    for attribute, text in zip(values["attribute"], values["cleaned"]) if resolver else ():
        if hit := resolver.core(text):
            parts = pieces(text)
            around = [forms(parts, i) for i in range(len(parts)) if not hit[1] <= i < hit[2]]
            out.append((attribute, text, hit[2] - hit[1], hit[0], [{"own": own, "lead": lead} for own, lead in around]))
    return pd.DataFrame(out, columns=["attribute", "cleaned", "size", "canon_id", "found"])


def learn_remarks(cleaned: DataFrame, names: DataFrame, n_values: int, n_names: int, *, least: int = 5, share: float = 0.05, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(attribute, form) of tokens that stand beside whole names of at least ``least`` entries and of ``share`` of those met.

    Forms that introduce a token count only where the token's own form is no remark.
    """
    met = _together(cleaned.select("attribute", "cleaned"), names, n_values, n_names, block_entries).applyInPandas(_learn, LEARNT)
    longest = met.groupBy("attribute", "cleaned").agg(F.max(F.struct("size", "canon_id", "found")).alias("x")).select("attribute", "x.canon_id", "x.found")
    longest = keep(longest, "cores")
    need = longest.groupBy("attribute").agg(F.greatest(F.lit(float(least)), F.count_distinct("canon_id") * F.lit(float(share))).alias("need"))
    beside = longest.select("attribute", "canon_id", F.inline("found"))

    def common(column: str, rows: DataFrame) -> DataFrame:
        seen = rows.select("attribute", F.col(column).alias("form"), "canon_id").distinct().groupBy("attribute", "form").agg(F.count(F.lit(1)).alias("entries"))
        return seen.join(need, "attribute").where("entries >= need").select("attribute", "form")

    own = common("own", beside)
    others = beside.where("lead <> ''").join(own.select("attribute", F.col("form").alias("own")), ["attribute", "own"], "left_anti")
    return own.unionByName(common("lead", others))


def _stripper(remarks: dict[str, set[str]], leads: bool):
    @F.pandas_udf(T.StructType([T.StructField("stripped", T.StringType()), T.StructField("dropped", T.ArrayType(T.StringType()))]))
    def run(attributes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([strip(t, remarks.get(a, set()), leads) for a, t in zip(attributes, texts)], columns=["stripped", "dropped"])

    return run


def strip_values(cleaned: DataFrame, names: DataFrame, remarks: dict[str, set[str]]) -> DataFrame:
    """``cleaned`` with ``stripped``. A token that is a number of the list isn't left out for what introduces it."""
    first = keep(cleaned.withColumn("x", _stripper(remarks, True)("attribute", "cleaned")).select(*cleaned.columns, "x.*"), "stripped")
    numbers = names.where("number <> ''").select("attribute", F.col("number").alias("token")).distinct()
    wrong = first.where("size(dropped) > 0").select("attribute", "cleaned", F.explode("dropped").alias("token")).join(numbers, ["attribute", "token"], "left_semi")
    wrong = wrong.select("attribute", "cleaned").distinct()
    again = wrong.withColumn("whole", _stripper(remarks, False)("attribute", "cleaned").getField("stripped"))
    return first.join(again, ["attribute", "cleaned"], "left").select(*cleaned.columns, F.coalesce("whole", "stripped").alias("stripped"))


def _resolve(weights: dict[str, tuple[dict[str, int], int]], remarks: dict[str, set[str]], behinds: dict[str, set[str]], settings: tuple[float, float, float]):
    def run(values: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(values) and len(names):
            attribute = values["attribute"].iloc[0]
            resolver = Resolver(list(zip(names["canon_id"], names["name"])), Weights(*weights[attribute]), remarks.get(attribute, set()), behinds.get(attribute, set()), *settings)
            for text in values["stripped"]:
                out += [(attribute, text, canon, score) for canon, score in resolver.top(text)]
        return pd.DataFrame(out, columns=["attribute", "stripped", "canon_id", "score"])

    return run


def _name_grams(remarks: dict[str, set[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(attributes: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(grams_of(split_name(n, remarks.get(a, set()))[0]))) for a, n in zip(attributes, names)])

    return run


def map_values(
    values: DataFrame,
    entries: DataFrame,
    *,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    code_share: float = CODE_SHARE,
    remark_entries: int = 5,
    remark_share: float = 0.05,
    block_entries: int = BLOCK_ENTRIES,
    max_forms: int = 1_000_000,
) -> DataFrame:
    """(attribute, value, occurrences, canon_id, score, margin) of distinct values; ``canon_id`` is 0 where no entry is meant.

    ``values`` has attribute and value; ``entries`` attribute, canon_id, label and aliases (null or any
    number). Null and blank values give no row; a value that is an entry's label as it stands gets that
    entry (of several, the first). Values of an attribute without entries get 0. Entries without label and
    aliases match nothing. The list may have any size: each task meets ``block_entries`` names at a time.
    Held by every task: the forms that are remarks and the different words behind numbers (at most
    ``max_forms``, beyond which an error says so), and the weights of n-grams, whose number the alphabet bounds.
    """
    distinct = values.select("attribute", "value").where(r"value is not null and not value rlike '(?U)^\\s*$'").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    spelled = keep(distinct.withColumn("cleaned", _clean("value")), "cleaned")
    names = keep(entry_names(entries), "names")
    n_names = names.count()
    if not n_names:
        return spelled.select("attribute", "value", "occurrences", F.lit(0).cast("long").alias("canon_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"))
    cleaned = keep(spelled.select("attribute", "cleaned").distinct(), "spellings")
    found = learn_remarks(cleaned, names, cleaned.count(), n_names, least=remark_entries, share=remark_share, block_entries=block_entries)
    remarks: dict[str, set[str]] = defaultdict(set)
    for r in small(found, max_forms, "forms of remarks"):
        remarks[r.attribute].add(r.form)
    remarks = dict(remarks)
    split = names.withColumn("g", _name_grams(remarks)("attribute", "name"))
    weights: dict[str, tuple[dict[str, int], int]] = {r.attribute: ({}, r.n) for r in small(names.groupBy("attribute").agg(F.count(F.lit(1)).alias("n")), max_forms, "attributes")}
    for r in small(split.select("attribute", F.explode("g").alias("g")).groupBy("attribute", "g").agg(F.count(F.lit(1)).alias("n")), max_forms, "n-grams"):
        weights[r.attribute][0][r.g] = r.n

    behinds: dict[str, set[str]] = defaultdict(set)
    for r in small(names.where("behind <> ''").select("attribute", "behind").distinct(), max_forms, "words behind numbers"):
        behinds[r.attribute].add(r.behind)

    stripped = keep(strip_values(cleaned, names, remarks), "stripped")
    left = stripped.select("attribute", "stripped").distinct()
    left = keep(left, "left")
    tops = _together(left, names, left.count(), n_names, block_entries).applyInPandas(_resolve(weights, remarks, dict(behinds), (threshold, margin, code_share)), TOPS)
    # Best and next entry of all blocks; each block gave its two best.
    ranked = tops.groupBy("attribute", "stripped").agg(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("canon_id")).alias("c"))), asc=False).alias("t"))
    best = F.col("t")[0]
    runner = F.coalesce(F.try_element_at(F.filter("t", lambda x: x["c"] != best["c"]), F.lit(1))["score"], F.lit(0.0))
    ranked = ranked.select("attribute", "stripped", (-best["c"]).alias("top"), best["score"].alias("score"), (best["score"] - runner).alias("margin"))
    resolved = ranked.withColumn("canon_id", F.when((F.col("score") >= threshold) & (F.col("margin") >= margin), F.col("top")).otherwise(F.lit(0)))
    labels = entries.where("label is not null").groupBy("attribute", F.col("label").alias("value")).agg(F.min("canon_id").alias("own"))
    by_value = spelled.join(stripped, ["attribute", "cleaned"]).join(resolved, ["attribute", "stripped"], "left").join(labels, ["attribute", "value"], "left")
    is_label = F.col("own").isNotNull()
    return by_value.select(
        "attribute",
        "value",
        "occurrences",
        F.coalesce("own", "canon_id", F.lit(0)).cast("long").alias("canon_id"),
        F.when(is_label, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(is_label, 1.0).otherwise(F.coalesce("margin", F.lit(0.0))).alias("margin"),
    )


def attach(rows: DataFrame, mapped: DataFrame, total: int, share: float = 0.001) -> DataFrame:
    """``rows`` (attribute, value, ...) with the ``canon_id`` of their value.

    A value of more than ``share`` of all ``total`` rows is spread by a hash of the whole row (the same if a task
    is run again): its rows meet copies of its one mapped row, so no task gets more than about that share. At most 1 / share values are, and they alone are broadcast.
    """
    most = max(1.0, total * share)
    hot = mapped.where(F.col("occurrences") > most).select("attribute", "value", F.ceil(F.col("occurrences") / most).cast("int").alias("splits"))
    salted = rows.join(F.broadcast(hot), ["attribute", "value"], "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("splits", F.lit(1))).cast("int")).drop("splits")
    copies = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("occurrences") / most)).cast("int") - 1)
    spread = mapped.select("attribute", "value", "canon_id", F.explode(copies).alias("salt"))
    return salted.join(spread, ["attribute", "value", "salt"]).drop("salt")
