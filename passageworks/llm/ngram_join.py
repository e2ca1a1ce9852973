"""Exact Jaccard join of texts on runs of five words, by a token-group matrix.

A text's set holds its distinct runs of five lower-cased words (``A-Z`` only), as
64-bit hashes; a text of fewer words is one run, a text without words has an
empty set and no link. Two texts link if
``100 * common >= percent * (size of the union)``. The result names, for every
row, the least id that can be reached over links, itself included.

1. Texts of equal sets form a class, and only classes are compared.
2. A class can link only if ``percent`` of its runs occur in other classes, so
   all but ``100 - percent`` of any subset must. That is asked first of the runs
   whose hash lies in the lowest ``SAMPLE`` of the range, the same for all texts,
   then of all runs of what remains. Both filters lose no link; they count runs
   and never pair texts.
3. The remaining classes form groups: in each of ``ROUNDS`` rounds, each with its
   own orders of all runs and classes, classes with the same least run are taken
   together, as similar sets mostly have the same one. A class that links to the
   first class among them joins its group, unless both are in one already; so each
   group is connected. The first round merges most, and the others share one pass. First is the class with the smallest share of runs that no
   other class has: edited copies of a text have runs of their own at every edit and
   need not link to each other, but they link to the text. So a family of near
   copies becomes one group, and the matrix does not grow with its square.
4. The matrix holds the union of runs of each group, as rows (run, group), as
   far as a run lies in two groups or more. Of two groups, the classes of the one
   with fewer of them are queries to the other (of as many: of the one with the
   smaller sets), so a large family is asked by the copies that did not join it, and
   its members ask for none of them. Two sets of ``n`` and ``m`` runs need ``percent /
   (100 + percent)`` of ``n + m`` in common. Of a query's runs, sorted by how many
   groups have them, at least one of the first ``size - needed + 1`` must be in a
   group's union (the rare runs, so passages found everywhere name no group). A set
   of which few runs occur elsewhere links to small sets only: sizes and this reach
   of the groups are part of the join, so that unlinked copies of one text do not
   meet each other. For the groups found that have several members, the whole overlap
   with the union is counted, and only those that reach the needed number are opened;
   a single class is opened at once.
5. An opened group is first compared by its first class. Where that links, the
   groups merge. Only queries whose group is still apart from the opened one are
   compared with all its members. Every comparison intersects whole sets.

Copies never make pairs, groups of near copies make one pair per member and
group, and the hot runs are aggregated before each shuffle. Null texts count as
empty. Rows of equal id count each, a null id is larger than any other. Columns
other than id and text are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, store, watched, within
from .components import components

SHINGLE, PERCENT = 5, 80
#: Share of the hash range that the first filter looks at; must exceed ``1 - PERCENT / 100``.
SAMPLE = 0.3
#: Rounds of grouping; they save comparisons later on and decide nothing.
ROUNDS = 4
#: Distinct words whose hashes a task remembers at most before it starts anew.
CACHE_WORDS = 1 << 18
#: Ids that may be broadcast after they were counted (eight bytes each).
BROADCAST_IDS = 1_000_000


class WordHashes(dict):
    """Hash of a word, computed once while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def run_hashes(text: str, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(hashes) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        # a multiply-and-shift per place keeps the order of the words
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def hashed(docs: DataFrame, sample: float | None) -> DataFrame:
    """``(id, cls, n, runs)``: hash and size of each text's set, and its runs below ``sample`` of the range."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        limit = None if sample is None else np.uint64(int(sample * 2**64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                runs, cls = [], []
                for text in piece.column(1).to_pylist():
                    found = run_hashes(text or "", known)
                    cls.append(xxhash.xxh64_intdigest(found.tobytes()))
                    runs.append(found)
                n = np.fromiter(map(len, runs), np.int64, len(runs))
                kept = runs if limit is None else [r[: np.searchsorted(r, limit)] for r in runs]
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
                columns = [piece.column(0), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cls", "n", "runs"])

    return docs.mapInArrow(sets, "id BIGINT, cls BIGINT, n BIGINT, runs ARRAY<BIGINT>")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` stored, and how many rows it has."""
    noted, seen = watched(df)
    return store(noted, name), seen.get["rows"]


def shared_runs(runs: DataFrame) -> DataFrame:
    """``(cls, hits)``: how many rows of each class have a run that another class has too."""
    ends = runs.groupBy("run").agg(F.min("cls").alias("a"), F.max("cls").alias("b"))
    shared = ends.where("a <> b").select("run")
    return runs.join(shared, "run", "left_semi").groupBy("cls").agg(F.count("*").alias("hits"))


def explode_runs(sets: DataFrame, *columns: str) -> DataFrame:
    return sets.select(*columns, F.explode("runs").alias("run"))


def linked(pairs: DataFrame, most: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)``, of which there are ``most`` at most, whose whole sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("runs").alias("runs_b"))
    # sets outside all pairs need not move; a first class stands in many pairs, so it
    # goes last, where a skewed key can be split
    ends = within(pairs.select("b").distinct(), most, BROADCAST_IDS)
    both = left.join(within(pairs.select("a", "b"), most, BROADCAST_IDS), "a").join(right.join(ends, "b", "left_semi"), "b")
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    return both.withColumn("_i", common).where(100 * F.col("_i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("_i"))).select("a", "b")


def candidates(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``(cls, n, runs, own)`` of the classes that may link, by the filters of step 2; ``own`` counts runs of no other class."""
    spare = 100 - percent
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max(F.size("runs")).alias("sampled"))
    hits = shared_runs(explode_runs(rows, "cls"))
    missing = F.col("sampled") * F.col("copies") - F.coalesce("hits", F.lit(0))
    alive = classes.join(hits, "cls", "left").where(100 * missing <= spare * F.col("n") * F.col("copies")).select("cls", "id")
    alive, n_alive = counted(alive, "alive")
    ids = alive.select(F.col("id").alias("_id")).distinct()
    chosen = docs.join(within(ids, n_alive, BROADCAST_IDS), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    whole = hashed(chosen, None).join(within(alive.select("cls"), n_alive, BROADCAST_IDS), "cls", "left_semi").select("cls", "n", "runs")
    whole = store(whole.dropDuplicates(["cls"]), "sets")
    exact = shared_runs(explode_runs(whole, "cls"))
    return store(whole.join(exact, "cls").where(100 * F.col("hits") >= percent * F.col("n")).select("cls", "n", "runs", (F.col("n") - F.col("hits")).alias("own")), "candidates")


def opened(sets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """``(cls, n, other, bound)``, counted: queries, the groups that come after theirs and hold enough of their runs, and how many (null: a single class)."""
    grouped = sets.join(groups, "cls").select("cls", "n", "grp", "runs")
    ends = explode_runs(grouped, "grp").groupBy("run").agg(F.min("grp").alias("a"), F.max("grp").alias("b"))
    runs = explode_runs(grouped, "cls", "n", "grp").join(ends.where("a <> b").select("run"), "run", "left_semi")
    least = F.ceil(F.col("n") * percent / 100)
    enough = runs.groupBy("cls").agg(F.count("*").alias("across"), F.max("n").alias("n")).where(F.col("across") >= least).select("cls", "across")
    # a link needs both its ends among these, so the others leave the matrix as well
    runs = store(runs.join(enough, "cls"), "runs")
    matrix = store(runs.select("run", "grp").distinct(), "matrix")
    # a set of m runs, of which only so many occur in other groups, links to none of more runs than its reach
    reach = F.floor(F.col("across") * (100 + percent) / percent) - F.col("n")
    classes = store(runs.groupBy("cls", "grp").agg(F.max("n").alias("n"), F.max(reach).alias("reach")), "classes")
    sizes = classes.groupBy("grp").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"))
    # of two groups, the classes of the one that comes first by this ask for the other
    sizes = sizes.withColumn("place", F.struct("members", "low", "grp"))
    placed = matrix.join(sizes, "grp")
    spread = placed.groupBy("run").agg(F.count("*").alias("spread"), F.max("members").alias("most")).where("spread > 1")
    ordered = runs.join(spread, "run").groupBy("cls", "n", "grp").agg(F.sort_array(F.collect_list(F.struct("spread", "run", "most"))).alias("runs"))
    ordered = ordered.withColumn("across", F.size("runs")).where(F.col("across") >= least).join(sizes.select("grp", "place"), "grp")
    first = (F.col("across") - least + 1).cast("int")
    asked = ordered.select("cls", "n", "place", "across", F.posexplode(F.slice("runs", F.lit(1), first)).alias("at", "x")).where("x.most >= place.members")
    # the place order makes a single class ask single classes of its size or larger only, for which fewer runs do; the further ones are for groups of several
    far = F.col("at") > F.col("across") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    asked = asked.withColumn("far", far).where("NOT far OR x.most > 1").select("cls", "n", "place", "across", "at", "far", F.col("x.run").alias("run"))
    other = placed.withColumn("far", F.explode(F.when(F.col("members") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    other = other.select("run", "far", F.col("grp").alias("other"), F.col("place").alias("then"), "low", "high", "reach", (F.col("members") == 1).alias("alone"))
    needed = F.greatest(least, F.ceil((F.col("n") + F.col("low")) * percent / (100 + percent)))
    fitting = (F.col("place") < F.col("then")) & (F.col("n") <= F.col("reach")) & (percent * F.col("n") <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * F.col("n")) & (F.col("at") <= F.col("across") - needed)
    found, most = counted(asked.join(other, ["run", "far"]).where(fitting).select("cls", "n", "other", "low", "alone").distinct(), "found")
    # the union of a single class is its set, which is compared as a whole anyway
    several = found.where(~F.col("alone")).drop("alone")
    whole = runs.select("cls", "run").join(within(several, most, BROADCAST_IDS), "cls")
    overlap = whole.join(matrix.select("run", F.col("grp").alias("other")), ["run", "other"]).groupBy("cls", "n", "other", "low").agg(F.count("*").alias("bound"))
    enough = overlap.where(F.col("bound") >= needed).select("cls", "n", "other", "bound")
    return counted(enough.unionByName(found.where("alone").select("cls", "n", "other"), allowMissingColumns=True), "opened")


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups (cls, grp)`` after its groups were merged along ``edges (a, b)`` between them."""
    roots = components(edges)
    joined = groups.join(roots.select(F.col("node").alias("grp"), "root"), "grp", "left")
    return store(joined.select("cls", F.coalesce("root", "grp").alias("grp")), "groups")


def least_run(number: int) -> Column:
    """The least of ``runs`` in the order of a round: by exclusive or with a number."""
    order = number * 0x5851F42D4C957F2D % 2**63
    return F.array_min(F.transform("runs", lambda x: x.bitwiseXOR(F.lit(order))))


def leads(numbers: range) -> Column:
    """One row for each of some rounds, with its number and least run."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("number"), least_run(i).alias("lead")) for i in numbers)))


def grouped_classes(sets: DataFrame, percent: int) -> DataFrame:
    """``(cls, grp)``: the connected groups of the candidate classes, by steps 3 to 5."""
    groups = sets.select("cls", F.col("cls").alias("grp"))
    for numbers in (range(1), range(1, ROUNDS)):
        # of a text and its edited copies, the text has the fewest runs to itself, and it is the one that they all link to
        share = F.floor(100 * F.col("own") / F.col("n"))
        led = sets.select("cls", share.alias("own"), leads(numbers).alias("at")).select("cls", "own", "at.*").join(groups, "cls")
        pivots = led.groupBy("number", "lead").agg(F.min(F.struct("own", F.xxhash64("cls", "number"), "cls", "grp")).alias("first"))
        pairs = led.join(pivots, ["number", "lead"]).where("grp <> first.grp")
        # several rounds may name a pair
        pairs = pairs.select(F.col("cls").alias("a"), F.col("first.cls").alias("b"), "grp", F.col("first.grp").alias("other")).distinct()
        pairs, most = counted(pairs, "pairs")
        if most:
            edges = linked(pairs.select("a", "b"), most, sets, percent).join(pairs, ["a", "b"])
            groups = merged(groups, edges.select(F.col("grp").alias("a"), F.col("other").alias("b")))

    queries, most = opened(sets, groups, percent)
    if not most:
        return groups
    # a group is named by its first class
    first = linked(queries.select(F.col("cls").alias("a"), F.col("other").alias("b")), most, sets, percent)
    edges = first.join(groups.withColumnRenamed("cls", "a"), "a").select(F.col("grp").alias("a"), "b")
    wider = merged(groups, edges)

    now = wider.select("cls", F.col("grp").alias("now"))
    apart = queries.join(now, "cls").join(now.select(F.col("cls").alias("other"), F.col("now").alias("then")), "other").where("now <> then")
    members = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b")).join(groups.select(F.col("cls").alias("b"), F.col("grp").alias("other")), "b")
    sized = (percent * F.col("n") <= 100 * F.col("n_b")) & (percent * F.col("n_b") <= 100 * F.col("n")) & (F.col("b") != F.col("other"))
    # no member has more in common with the query than the union of all
    sized &= percent * (F.col("n") + F.col("n_b")) <= (100 + percent) * F.col("bound")
    rest, most = counted(apart.join(members, "other").where(sized).select(F.col("cls").alias("a"), "b"), "rest")
    if not most:
        return wider
    late = linked(rest, most, sets, percent)
    named = wider.select(F.col("cls").alias("a"), F.col("grp").alias("x")), wider.select(F.col("cls").alias("b"), F.col("grp").alias("y"))
    return merged(wider, late.join(named[0], "a").join(named[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(id, n, component)`` for every row of ``docs``."""
    if not 100 - percent < 100 * SAMPLE:
        raise ValueError("the sampled share of runs must exceed what a linked text may miss")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = store(hashed(texts, SAMPLE), "runs")
    sets = candidates(texts, rows, percent)
    groups = grouped_classes(sets, percent)
    slim = rows.select("id", "cls", "n")
    classes = slim.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"))
    known = classes.join(groups, "cls")
    least = known.groupBy("grp").agg(F.min("id").alias("least"))
    moved = known.join(least, "grp").select("cls", "least")
    named = classes.join(moved, "cls", "left").select("cls", F.coalesce("least", "id").alias("component"))
    # the empty sets are one class without links; their rows do not join
    own = F.when(F.col("n") > 0, F.col("cls"))
    return slim.withColumn("cls", own).join(named, "cls", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def keep_first(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id.

    Ids are keys: of rows that share an id, all go if one of them does, and a row without an id stays.
    """
    gone = joined.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    gone, most = counted(gone, "gone")
    return docs.join(within(gone, most, BROADCAST_IDS), F.col(id_col) == F.col("_gone"), "left_anti")
