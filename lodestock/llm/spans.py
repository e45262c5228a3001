"""Long exact spans shared between records, by a log-structured index of window hashes.

Fingerprints. Every run of ``gram`` characters has a rolling hash; of each ``min_span - gram + 1``
consecutive ones the least (of equal ones the last) is an anchor. Two records with a common span of
``min_span`` characters have an anchor in common at the same place of the span, so nothing is missed.

Index. The anchors of a batch are written as an immutable run, bucketed and sorted by hash. A new batch
is merge-joined with the runs before it and with itself, bucket by bucket: neither the history nor the
batch is shuffled for it. Matches are verified on the texts around the anchors, and when a level has
``fan_in`` runs they are compacted into one of the next. Records with the same text share one class, by
the SHA-256 of the text, of which only the first record's text is indexed. Texts are bucketed by class and
never rewritten; a batch reads those of the runs, and if they are few those of the classes, that it meets.
A manifest lists what there is; an index is opened again by its path.

Frequent anchors. An anchor that more than ``hot`` classes hold isn't paired by itself, since all
pairs would be compared. Its ``min_span - gram + 1`` whole windows are hashed instead (SHA-256), and
classes with an equal window are a group. Each member is linked to the group's first class (a star), so
links grow with the records and not with their square; pairs come out only where they are asked for. Then
windows that all their holders have one after another are paired as one run, and repeats of a window at even
distances (a row of dashes) as one, so that all places of both sides meet without being listed one by one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.sources.shared import keep, names_in, new_path, read_text, write_text

#: Fixed odd multipliers of the rolling hash and its finish.
BASE = 0x9E3779B97F4A7C15
FINISH = 0xBF58476D1CE4E5B9
SEGMENT = 1 << 19  # characters hashed at once
POSITION = (1 << 20) - 1
POSTINGS = "g long, class long, pos int, first int, last int"
MATCH = "class_a long, class_b long, start_a int, start_b int, length int"
PLACED = "g long, class long, pos int, first int, last int, fresh boolean, hot boolean, left string, right string"
#: Tables of the index: columns and the column they are bucketed by (none: plain).
TABLES = {"run": (POSTINGS + ", part int", "g"), "classes": ("h binary, class long", "h"), "texts": ("class long, text string", "class"), "members": ("class long, doc_id long", None)}
PICK = 2_000  # classes that are named in a filter on the texts instead of joined with all of a run
BLOCK = 1_024  # members of a group that are paired in one go


class Anchors:
    """Anchors of texts: positions and hashes of selected runs of ``gram`` characters."""

    def __init__(self, gram: int, min_span: int):
        self.gram, self.window = gram, min_span - gram + 1
        n = SEGMENT + min_span + 1
        inverse = pow(BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([one, np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, first, last): anchors, and the first and last start of the windows each is the anchor of.

        Empty for texts shorter than ``min_span``.
        """
        span = self.window + self.gram - 1
        if len(text) < span:
            none = np.empty(0, np.int32)
            return none, np.empty(0, np.int64), none, none
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = []
        # Segments overlap by all that one window covers, so that each window lies in one of them.
        for start in range(0, len(codes) - span + 1, SEGMENT):
            at, h, first, last = self._segment(codes[start : start + SEGMENT + span - 1])
            found.append((at + start, h, first + start, last + start))
        at, h, first, last = (np.concatenate(x) for x in zip(*found))
        at, k = np.unique(at, return_index=True)
        # An anchor of windows in two segments stands twice.
        first, last = np.minimum.reduceat(first, k), np.maximum.reduceat(last, k)
        return at.astype(np.int32), h[k].view(np.int64), first.astype(np.int32), last.astype(np.int32)

    def _segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        g, w, n = self.gram, self.window, len(codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[g:] - sums[:-g]) * self.down[: n - g + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(FINISH)
        h ^= h >> np.uint64(32)
        ranked = (h & ~np.uint64(POSITION)) | (np.uint64(POSITION) - np.arange(len(h), dtype=np.uint64))
        # Minima of windows from minima of blocks, once from the left and once from the right.
        pad = -len(ranked) % w
        blocks = np.concatenate([ranked, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        k = len(ranked) - w + 1
        least = np.minimum(right[:k], left[w - 1 : w - 1 + k])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (np.uint64(POSITION) - (least[first] & np.uint64(POSITION))).astype(np.int64)
        return at, h[at], first, np.concatenate([first[1:], [k]]) - 1


def anchors(texts: DataFrame, gram: int, min_span: int) -> DataFrame:
    """(g, class, pos, first, last) of the texts (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Anchors(gram, min_span)
        for batch in batches:
            keys, parts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = make.of(text)
                if len(part[0]):
                    keys.append(np.full(len(part[0]), key, np.int64))
                    parts.append(part)
            if keys:
                at, h, first, last = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, np.concatenate(keys), at, first, last)], ["g", "class", "pos", "first", "last"])

    return texts.select("class", "text").mapInArrow(run, POSTINGS)


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the common prefix of each pair of strings."""
    out = np.zeros(len(a), np.int32)
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            out[i] = len(x)
            continue
        n = min(len(x), len(y))
        lo, hi = 0, n
        while lo < hi:  # by halves: slices compare at memory speed
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
        out[i] = lo
    return out


def _verify(gram: int, min_span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            behind = _common(b["right_a"].tolist(), b["right_b"].tolist())
            before = _common([x[::-1] for x in b["left_a"]], [x[::-1] for x in b["left_b"]])
            hold = (behind >= gram) & (before + behind >= min_span)
            kept = b[hold]
            yield pd.DataFrame(
                {
                    "class_a": kept["class_a"],
                    "class_b": kept["class_b"],
                    "start_a": (kept["pos_a"] - before[hold]).astype("int32"),
                    "start_b": (kept["pos_b"] - before[hold]).astype("int32"),
                    "length": (before + behind)[hold].astype("int32"),
                }
            )

    return run


def _surroundings(min_span: int, gram: int):
    """Rows (class, text, wanted) to one row per wanted posting with the text around it; each text is read once."""
    reach = min_span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1).to_pylist(), batch.column(2)
            sizes = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            row = np.repeat(np.arange(len(texts)), sizes)
            pos = flat.field("pos").to_numpy()
            for at in range(0, len(row), 20_000):
                r, p, part = row[at : at + 20_000], pos[at : at + 20_000].tolist(), flat.slice(at, 20_000)
                left = [texts[i][max(0, x - reach) : x] for i, x in zip(r.tolist(), p)]
                right = [texts[i][x : x + min_span] for i, x in zip(r.tolist(), p)]
                same = [part.field(n) for n in ("g", "pos", "first", "last", "fresh", "hot")]
                yield pa.RecordBatch.from_arrays(
                    [same[0], batch.column(0).take(pa.array(r)), *same[1:], pa.array(left, pa.string()), pa.array(right, pa.string())], ["g", "class", "pos", "first", "last", "fresh", "hot", "left", "right"]
                )

    return run


@dataclass
class Found:
    """What a batch shares with the index and itself.

    near: verified matches (class_a, class_b, start_a, start_b, length), class_a < class_b; a long span comes as several.
    stars: the same for frequent spans, each member of a group with its first class.
    groups: (w, class, fresh), the members of groups; of groups with the same members only one.
    windows: (w, class, fresh, start), all places of the windows of frequent anchors.
    """

    near: DataFrame
    stars: DataFrame
    groups: DataFrame
    windows: DataFrame

    def links(self) -> DataFrame:
        return self.near.unionByName(self.stars)


class SpanIndex:
    """The index in a folder; ``append`` takes a batch of (doc_id, text) and returns what it found.

    doc_ids are unique. Null texts and texts shorter than ``min_span`` hold no span. Everything the
    index keeps is a table in ``path``, and each append ends with a new manifest there: ``open`` finds the
    state after the last append that ended, whatever became of the session. ``buckets`` should let a bucket of
    the largest run fit a task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, min_span: int = 150, gram: int = 64, hot: int = 64, fan_in: int = 2, buckets: int | None = None):
        if not 0 < gram < min_span:
            raise ValueError("gram must lie between 0 and min_span")
        self.spark, self.path = spark, path or new_path(spark, "spans")
        self.min_span, self.gram, self.hot, self.fan_in = min_span, gram, hot, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, name)
        self.classes: list[tuple[int, str]] = []
        self.members: list[str] = []
        self.texts: list[str] = []
        self.made = self.version = 0
        self.known: dict[str, str] = {}  # table of the session's catalogue by name

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpanIndex:
        """The index that is in the folder, after its last finished append."""
        manifests = [n for n in names_in(spark, path) if n.startswith("manifest-")]
        if not manifests:
            raise ValueError(f"no index in {path}")
        state = json.loads(read_text(spark, f"{path}/{manifests[-1]}"))
        index = cls(spark, path, **{k: state[k] for k in ("min_span", "gram", "hot", "fan_in", "buckets")})
        index.runs, index.classes = ([tuple(x) for x in state[k]] for k in ("runs", "classes"))
        index.members, index.texts, index.made, index.version = state["members"], state["texts"], state["made"], state["version"]
        return index

    def _save(self) -> None:
        self.version += 1
        state = {k: getattr(self, k) for k in ("min_span", "gram", "hot", "fan_in", "buckets", "runs", "classes", "members", "texts", "made", "version")}
        write_text(self.spark, f"{self.path}/manifest-{self.version:08d}.json", json.dumps(state))

    def _write(self, df: DataFrame, what: str) -> str:
        """Write a table; the name holds a part that no unfinished append has used."""
        name = f"{what}-{self.made}-{uuid.uuid4().hex[:8]}"
        self.made += 1
        writer = df.write.option("compression", "zstd")
        key = TABLES[what][1]
        if key is None:
            writer.parquet(f"{self.path}/{name}")
        else:
            self.known[name] = f"lodestock_{uuid.uuid4().hex}"
            sorted_by_bucket = df.repartition(self.buckets, key).write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
            sorted_by_bucket.bucketBy(self.buckets, key).sortBy(key).saveAsTable(self.known[name])
        return name

    def _table(self, name: str) -> DataFrame:
        schema, key = TABLES[name.split("-")[0]]
        if key is None:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        if name not in self.known:
            self.known[name] = f"lodestock_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self.known[name]} ({schema}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(self.known[name])

    def _all(self, names: list[str], what: str) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self._table, names)) if names else self.spark.createDataFrame([], TABLES[what][0])

    def all_members(self) -> DataFrame:
        """(class, doc_id) of all records long enough to hold a span; a class is named by its first doc_id seen."""
        return self._all(self.members, "members")

    def append(self, batch: DataFrame) -> Found:
        """What the batch shares with the index and itself; the index then holds the batch."""
        self.runs, self.classes = self._compact(self.runs, "run"), self._compact(self.classes, "classes")
        long = batch.where(F.length("text") >= self.min_span).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        docs = keep(long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h")), "span-docs")
        first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
        old = [self._table(n).hint("merge").join(first.select("h"), "h", "left_semi").withColumnRenamed("class", "known") for _, n in self.classes]
        old = reduce(DataFrame.unionByName, old) if old else self.spark.createDataFrame([], "h binary, known long")
        named = keep(first.join(old, "h", "left").select("h", F.coalesce("known", "first").alias("class"), F.col("known").isNull().alias("new")), "span-classes")
        self.members.append(self._write(docs.select("h", "doc_id").join(named, "h").select("class", "doc_id"), "members"))
        fresh = named.where("new")
        self.classes.append((0, self._write(fresh.select("h", "class"), "classes")))
        part = len(self.texts)
        self.texts.append(self._write(long.select(F.col("doc_id").alias("class"), "text").join(fresh.select("class"), "class"), "texts"))
        made = anchors(self._table(self.texts[-1]), self.gram, self.min_span)
        run = self._write(made.withColumn("part", F.lit(part)), "run")
        found = self._match(run)
        self.runs.append((0, run))
        self._save()
        return found

    def _compact(self, runs: list[tuple[int, str]], what: str) -> list[tuple[int, str]]:
        """Merge the newest ``fan_in`` runs of a level into a run of the next, as often as there are that many."""
        while runs and [lv for lv, _ in runs].count(runs[-1][0]) >= self.fan_in:
            level = runs[-1][0]
            own = [n for lv, n in runs if lv == level]
            runs = [(lv, n) for lv, n in runs if lv != level] + [(level + 1, self._write(self._all(own, what), what))]
        return runs

    def _shared(self, new: DataFrame, history: list[DataFrame]) -> DataFrame:
        """(g, hot) of the hashes of the batch that several classes hold. All sides are bucketed by g: no exchange."""

        def held(postings: DataFrame, i: int) -> DataFrame:
            return postings.groupBy("g").agg(F.count(F.lit(1)).alias(f"k{i}"), F.min("class").alias(f"lo{i}"), F.max("class").alias(f"hi{i}"))

        every, n = held(new, 0), len(history) + 1
        for i, run in enumerate(history, 1):
            every = every.hint("merge").join(held(run, i), "g", "left")
        k = reduce(Column.__add__, [F.coalesce(f"k{i}", F.lit(0)) for i in range(n)])
        lo, hi = ((f(*[f"{x}{i}" for i in range(n)]) if n > 1 else F.col(f"{x}0")) for f, x in ((F.least, "lo"), (F.greatest, "hi")))
        return every.where(lo < hi).select("g", (k > self.hot).alias("hot"))

    def _match(self, run: str) -> Found:
        new, history = self._table(run), [self._table(n) for _, n in self.runs]
        shared = keep(self._shared(new, history), "span-shared")
        parts = [new.join(shared, "g").withColumn("fresh", F.lit(True)), *[h.join(shared, "g").withColumn("fresh", F.lit(False)) for h in history]]
        wanted = reduce(DataFrame.unionByName, parts).groupBy("part", "class").agg(F.collect_list(F.struct("g", "pos", "first", "last", "fresh", "hot")).alias("wanted"))
        wanted = keep(wanted, "span-wanted")
        around = []
        for part, n in wanted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per run of texts
            own, texts = wanted.where(F.col("part") == part).select("class", "wanted"), self._table(self.texts[part])
            if n <= PICK:
                texts = texts.where(F.col("class").isin([r[0] for r in own.select("class").collect()]))
            around.append(texts.join(own, "class").select("class", "text", "wanted").mapInArrow(_surroundings(self.min_span, self.gram), PLACED))
        placed = keep(reduce(DataFrame.unionByName, around) if around else self.spark.createDataFrame([], PLACED), "span-places")
        a, b = (placed.where("not hot").select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "pos", "left", "right", "fresh")]) for s in "ab")
        pairs = a.join(b, "g").where("class_a < class_b and (fresh_a or fresh_b)")
        near = pairs.select("class_a", "class_b", "pos_a", "pos_b", "left_a", "left_b", "right_a", "right_b").mapInPandas(_verify(self.gram, self.min_span), MATCH)
        return Found(keep(near, "span-matches"), *self._hot(placed.where("hot")))

    def _hot(self, placed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(stars, groups, windows) of anchors that many classes hold: classes with equal whole windows.

        Every window has one anchor, so each is hashed once however often anchors repeat in a text. A
        member comes with the group's first class; the first class, and each further place, with one other.
        """
        begin = F.col("pos") - F.length("left")
        windows = placed.select("class", "fresh", begin.alias("begin"), F.concat("left", "right").alias("whole"), F.explode(F.sequence("first", "last")).alias("start"))
        windows = keep(windows.select(F.unhex(F.sha2(F.expr(f"substring(whole, start - begin + 1, {self.min_span})"), 256)).alias("w"), "class", "fresh", "start"), "span-windows")
        per = windows.groupBy("w", "class").agg(F.max("fresh").alias("fresh"), F.min("start").alias("start"))
        place = F.struct("class", "start")
        groups = per.groupBy("w").agg(
            F.count(F.lit(1)).alias("k"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("fresh").alias("any"),
            F.bit_xor(F.xxhash64("class")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "class")).alias("s2"),
        )
        groups = keep(groups.where("k > 1 and any").drop("any"), "span-groups")
        other = F.when(F.col("class") == F.col("lo.class"), F.col("hi")).otherwise(F.col("lo"))
        ends = windows.join(groups, "w").select(place.alias("own"), other.alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        ends = ends.select(low["class"].alias("class_a"), high["class"].alias("class_b"), low["start"].alias("start_a"), high["start"].alias("start_b")).distinct()
        # Windows one after another on both sides are one span.
        shift = F.col("start_b") - F.col("start_a")
        at = F.col("start_a") - F.row_number().over(Window.partitionBy("class_a", "class_b", shift).orderBy("start_a"))
        stars = ends.withColumns({"shift": shift, "run": at}).groupBy("class_a", "class_b", "shift", "run").agg(
            F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), (F.count(F.lit(1)) + (self.min_span - 1)).cast("int").alias("length")
        )
        # Groups with the same members (the windows of one passage) need one of them only.
        one = groups.groupBy("k", "s1", "s2").agg(F.min("w").alias("w")).select("w")
        return keep(stars.select("class_a", "class_b", "start_a", "start_b", "length"), "span-stars"), keep(per.join(one, "w").select("w", "class", "fresh"), "span-members"), windows


def shared_spans(docs: DataFrame, *, batches: int = 3, min_span: int = 150, gram: int = 64, hot: int = 64) -> tuple[SpanIndex, Found]:
    """(index, all it found) of a corpus (doc_id, text) that comes in batches, as the index would see it day by day."""
    index = SpanIndex(docs.sparkSession, min_span=min_span, gram=gram, hot=hot)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    found = [index.append(docs.where(part == i).select("doc_id", "text")) for i in range(batches)]
    return index, together(found)


def together(found: list[Found]) -> Found:
    """What several appends of one index found."""
    near, stars = (reduce(DataFrame.unionByName, [getattr(f, k) for f in found]) for k in ("near", "stars"))
    # A window may be a group in several appends, each with the members of its time.
    groups, windows = (reduce(DataFrame.unionByName, [getattr(f, k).withColumn("w", F.concat(F.encode(F.lit(f"{i}:"), "utf-8"), "w")) for i, f in enumerate(found)]) for k in ("groups", "windows"))
    return Found(near, stars, groups, windows)


def _pairs_within(members: DataFrame, group: str, item: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, *extra_a, *extra_b), a < b, of each group's items. Groups of over BLOCK items are paired block by block, each two in a task of their own."""
    # At most one group per BLOCK members is large.
    large = members.groupBy(group).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select(group, F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = members.join(F.broadcast(large), group, "left").withColumns({"own": F.pmod(F.xxhash64(item), blocks).cast("int"), "blocks": blocks})
    sides = []
    for s, i, j in (("a", "own", "k"), ("b", "k", "own")):
        spread = placed.withColumn("k", F.explode(F.sequence("own", F.col("blocks") - 1) if s == "a" else F.sequence(F.lit(0), "own")))
        sides.append(spread.select(group, F.col(i).alias("i"), F.col(j).alias("j"), F.col(item).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in extra]))
    both = sides[0].join(sides[1], [group, "i", "j"]).where("i < j or a < b")
    return both.where("a <> b")


def class_pairs(found: Found) -> DataFrame:
    """(class_a, class_b), class_a < class_b: all pairs of classes with a common span."""
    inside = _pairs_within(found.groups, "w", "class", ("fresh",)).where("fresh_a or fresh_b").select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
    return found.near.select("class_a", "class_b").unionByName(inside).distinct()


def span_pairs(index: SpanIndex, found: Found) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of records with a common span, copies included."""
    members = index.all_members()
    # Classes of more than BLOCK records meet their links in parts; there is at most one per BLOCK records.
    large = F.broadcast(members.groupBy("class").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("class", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    held = members.join(large, "class", "left").select("class", "doc_id", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    pairs = class_pairs(found)
    for s in "ab":
        pairs = pairs.withColumnRenamed(f"class_{s}", "class").join(large, "class", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        pairs = pairs.join(held, ["class", "part"]).drop("class", "part").withColumnRenamed("doc_id", f"d{s}")
    pairs = pairs.unionByName(_pairs_within(members, "class", "doc_id").select(F.col("a").alias("da"), F.col("b").alias("db")))
    return pairs.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))


def _frequent(windows: DataFrame, min_span: int) -> DataFrame:
    """(class_a, class_b, start_a, start_b, length), class_a < class_b: what every two classes have in common of windows of frequent anchors, at all places of both."""
    by = Window.partitionBy("w", "class").orderBy("start")
    placed = windows.withColumn("gap", F.col("start") - F.lag("start").over(by))
    groups = placed.groupBy("w").agg(
        F.min(F.struct("class", "start")).alias("lo"), F.max("class").alias("hi"), F.max("fresh").alias("any"),
        F.min(F.when(F.col("gap") <= min_span, F.col("gap"))).alias("step"),
    ).where("any and lo.class < hi").select("w", "lo", "step")
    # Places of a class that follow each other by the group's step: the text from the first to the last repeats itself.
    placed = placed.join(groups, "w").withColumn("row", F.sum(F.when(F.col("gap") == F.col("step"), 0).otherwise(1)).over(by))
    rows = placed.groupBy("w", "class", "row").agg(F.max("fresh").alias("fresh"), F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("times"), F.max("step").alias("step"), F.max("lo").alias("lo"))
    rows = keep(rows, "span-rows")
    # Windows one after another in all their classes are one run, of which the first is paired.
    own = ("class", F.col("start") - F.col("lo.start"), "times")
    same = ["first", "step", "k", "s1", "s2"]
    runs = rows.groupBy("w", F.col("lo.class").alias("first"), F.col("lo.start").alias("at"), "step").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64(*own)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), *own)).alias("s2"))
    runs = runs.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*same).orderBy("at")))
    runs = runs.groupBy(*same, "run").agg(F.min_by("w", "at").alias("w"), F.count(F.lit(1)).cast("int").alias("n")).select("w", "n")
    sides = ("class", "start", "times")
    members = rows.join(runs, "w").select("w", "class", F.struct(*sides).alias("side"), F.coalesce("step", F.lit(0)).alias("step"), "n", "fresh")
    pairs = _pairs_within(members, "w", "class", ("side", "step", "n", "fresh")).where("fresh_a or fresh_b")
    a, b = F.least("side_a", "side_b"), F.greatest("side_a", "side_b")
    # Two rows of places meet at as many distances as both have places, less one.
    pairs = pairs.select(a.alias("a"), b.alias("b"), F.col("step_a").alias("step"), F.col("n_a").alias("n")).withColumn("k", F.explode(F.expr("sequence(1 - a.times, b.times - 1)")))
    pairs = pairs.withColumn("i", F.expr("greatest(0, -k)"))
    length = f"(least(a.times, b.times - k) - i - 1) * step + n + {min_span - 1}"
    return pairs.selectExpr("a.class class_a", "b.class class_b", "a.start + i * step start_a", "b.start + (i + k) * step start_b", f"{length} length")


def class_links(index: SpanIndex, found: Found) -> DataFrame:
    """(class_a, class_b, places, longest), class_a < class_b: all pairs of classes with a common span.

    places: stretches of ``min_span`` characters or more that stand in both and are as long as they can be, each place of
    one with each of the other; longest: characters of the longest.
    """
    matches = found.near.unionByName(_frequent(found.windows, index.min_span)).select("class_a", "class_b", (F.col("start_b") - F.col("start_a")).alias("shift"), "start_a", (F.col("start_a") + F.col("length")).alias("end"))
    stretch = ["class_a", "class_b", "shift"]
    by = Window.partitionBy(*stretch).orderBy("start_a")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    matches = matches.withColumn("new", F.coalesce(F.col("start_a") > before, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = matches.groupBy(*stretch, "k").agg((F.max("end") - F.min("start_a")).alias("length"))
    return whole.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("places"), F.max("length").alias("longest"))


def span_links(found: Found) -> DataFrame:
    """(class_a, class_b, places, longest): matches of classes, linked as stars: members of a frequent span to its first class, not all to each other (``class_links`` has all pairs)."""
    return found.links().groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("places"), F.max("length").alias("longest"))


def span_members(index: SpanIndex, found: Found) -> DataFrame:
    """(doc_id, class, copies, links) of every record long enough to hold a span: its class, the records of it, the classes with a span in common."""
    links = class_pairs(found)
    degree = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    members = index.all_members()
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(size.join(degree, "class", "left"), "class").select("doc_id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


@F.pandas_udf(T.IntegerType())
def _union_length(starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for s, e in zip(starts, ends):
        order = np.argsort(s, kind="stable")
        s, e = np.asarray(s)[order], np.maximum.accumulate(np.asarray(e)[order])
        begun = np.concatenate([[s[0]], np.maximum(s[1:], e[:-1])])
        out.append(int(np.maximum(0, e - begun).sum()))
    return pd.Series(out, dtype="int32")


def span_coverage(index: SpanIndex, found: Found, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every record: how much of it stands elsewhere.

    A record with copies stands elsewhere as a whole. Null and empty texts have 0 characters and a null share.
    No pairs are made for it: in a frequent span, each record's own place is known from its link.
    """
    links = found.links()
    spans = reduce(DataFrame.unionByName, [links.select(F.col(f"class_{s}").alias("class"), F.col(f"start_{s}").alias("s"), (F.col(f"start_{s}") + F.col("length")).alias("e")) for s in "ab"])
    spans = spans.groupBy("class", "s").agg(F.max("e").alias("e"))
    covered = spans.groupBy("class").agg(F.collect_list(F.struct("s", "e")).alias("x")).select("class", _union_length("x.s", "x.e").alias("covered"))
    members = index.all_members()
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    per = members.join(size.join(covered, "class", "left"), "class")
    chars = F.coalesce(F.length("text"), F.lit(0))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), chars.alias("n_chars")).join(per, "doc_id", "left")
    shared = F.when(F.col("size") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return joined.select("doc_id", "n_chars", shared.alias("shared_chars"), (shared / F.nullif(F.col("n_chars"), F.lit(0))).alias("shared_share"))
