"""Hard negatives by rotated one-bit codes with certain bounds.

A vector is rotated (random signs and a fast Hadamard transform, three times) and coded by
the signs of its components: a *code vector* has entries of one size, plus or minus
``1 / sqrt(d)``. What the code leaves of the vector is coded again, ``LEVELS`` times. Stored with the
codes are their *alignments* (the weights with which the code vectors come nearest to the
vector, for one code its inner product with the vector), the length of the coded part and that of
the residual: ``x = x' + r`` with ``x' = sum(a_l * c_l)``.

An anchor's rotated vector is cut into ``PLANES`` bits per component: ``y = y' + s``. The inner
product of a code and a bit plane is a popcount, so popcounts weighted by alignments give
``x' . y'``, the estimated score, and by Cauchy-Schwarz the residuals cannot move the score further
from it than ``|x'||s| + |r||y|``. Every row has such an interval for every anchor; a row whose
interval cannot enter the ranking goes, and the others are scored in whole numbers. No
result depends on the codes, only the work does.

1. *Positives.* Rows and anchors of one label meet (labels share 64 buckets; a bucket is cut into
   slices of bounded size). A task keeps, per anchor, rows whose upper bound reaches the
   ``n_positives``-th best lower bound.
2. *Negatives.* Slices of all rows meet blocks of anchors. A positive's score gives a window of
   allowed scores; rows of another label whose interval touches a window and reaches the
   best certain scores inside it are scored. The floor of a window rises as a task goes on.

Rows that are equal count once; rows of the anchor's own id are not "other rows". Of rows with
equal label and vector only as many of the least ids take part as a ranking can use, so
a vector that a third of all rows share stays small; anchors are never dropped. A null id is
never an anchor and comes last at a tie. Rows with a null label, a null or empty
vector, or a null or non-finite component take no part. Vectors of different widths, or
scores beyond a long, are errors. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .vectors import BLOCK_ROWS, CELLS, SLICE_ROWS, dealt, exact_kind, first_copies, integers, matrix, numbers, parts, repeated, whole, width_of

#: Codes of a row (six leave 7 % of a vector of 64 components) and bits of an anchor's component (six: 2 %).
LEVELS, PLANES = 6, 6
#: Buckets of labels.
BUCKETS = 64
#: Rows that meet a block before its floors are raised, few at first; cells of an interval matrix.
FIRST, STEP, TILE = 32, 512, 65_536
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
CODED = "codes binary, aligned array<double>, part double, residual double"


def padded(width: int) -> int:
    """The least power of two that is no less than ``width`` and fills whole 64-bit words."""
    return max(64, 1 << (width - 1).bit_length())


def rotated(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows turned by one fixed orthogonal map, zero-padded."""
    d = padded(x.shape[1])
    z = np.zeros((len(x), d))
    z[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, d)) * 2.0 - 1
    for flips in signs:
        z *= flips
        half = 1
        while half < d:
            pairs = z.reshape(len(z), -1, 2, half)
            z = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(z), d)
            half *= 2
        z /= np.sqrt(d)
    return z


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of rows as 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def coded(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes ``(rows, levels, words)``, alignments ``(rows, levels)``, lengths of coded part and residual."""
    whole_ = rotated(x)
    n, d = whole_.shape
    signs = np.empty((n, levels, d))
    part = np.zeros_like(whole_)
    for level in range(levels):
        signs[:, level] = np.where(whole_ - part >= 0, 1.0, -1.0) / np.sqrt(d)
        some = signs[:, : level + 1]
        # least squares over the codes so far; the small diagonal is for codes that repeat
        gram = some @ some.transpose(0, 2, 1) + 1e-9 * np.eye(level + 1)
        aligned = np.linalg.solve(gram, some @ whole_[:, :, None])
        part = (aligned.transpose(0, 2, 1) @ some)[:, 0]
    length = lambda m: np.sqrt((m * m).sum(axis=1))
    return _words(signs > 0), aligned[:, :, 0], length(part), length(whole_ - part)


class Coded:
    """Rows of an Arrow table: whole numbers, codes, alignments, lengths."""

    def __init__(self, table: pa.Table, width: int):
        self.d = padded(width)
        self.x = matrix(table.column("x"), width)
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64).reshape(len(self.x), -1, self.d // 64)
        self.aligned = matrix(table.column("aligned"), self.codes.shape[1])
        self.part, self.residual = numbers(table.column("part")), numbers(table.column("residual"))

    def __len__(self) -> int:
        return len(self.x)


class Asked:
    """Anchors of an Arrow table: whole numbers and bit planes of their rotated vectors."""

    def __init__(self, table: pa.Table, width: int, planes: int = PLANES):
        self.x = matrix(table.column("x"), width)
        z = rotated(self.x.astype(np.float64))
        self.least = z.min(axis=1, initial=0)
        self.step = np.maximum((z.max(axis=1, initial=0) - self.least) / ((1 << planes) - 1), 1e-300)
        units = np.clip(np.rint((z - self.least[:, None]) / self.step[:, None]), 0, (1 << planes) - 1).astype(np.int64)
        self.planes = np.stack([_words((units >> j) & 1 == 1) for j in range(planes)], axis=1)
        self.units = units.sum(axis=1)
        self.length = np.sqrt((z * z).sum(axis=1))
        rest = z - self.least[:, None] - self.step[:, None] * units
        self.residual = np.sqrt((rest * rest).sum(axis=1))

    def __len__(self) -> int:
        return len(self.x)


def intervals(rows: Coded, asked: Asked, at: slice, who: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of some rows (first axis) and some anchors."""
    codes, aligned, planes = rows.codes[at], rows.aligned[at], asked.planes[who]
    least, step, units = asked.least[who], asked.step[who], asked.units[who]
    middle = np.zeros((len(codes), len(planes)))
    for i in range(codes.shape[1]):
        # sum of the anchor's units where the code is +1, by popcounts of its planes
        met = np.zeros(middle.shape, np.int64)
        ones = np.zeros(len(codes), np.int64)
        for word in range(codes.shape[2]):
            mine = codes[:, i, word]
            ones += np.bitwise_count(mine)
            for j in range(planes.shape[1]):
                met += np.bitwise_count(mine[:, None] & planes[None, :, j, word]).astype(np.int64) << j
        signed = np.outer(2 * ones - rows.d, least) + (2 * met - units) * step
        middle += aligned[:, i][:, None] * signed
    middle /= np.sqrt(rows.d)
    slack = np.outer(rows.part[at], asked.residual[who]) + np.outer(rows.residual[at], asked.length[who])
    # the last digits of the sums above are not exact
    slack += 1e-9 * (np.outer(rows.part[at] + rows.residual[at], asked.length[who]) + 1)
    return middle - slack, middle + slack


def scores_of(rows: Coded, asked: Asked, at: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Integer scores of pairs."""
    kind = exact_kind(rows.x, asked.x)
    out = np.empty(len(at), np.int64)
    step = max(1, CELLS // max(1, rows.x.shape[1]))
    for s in range(0, len(at), step):
        out[s:s + step] = np.einsum("ij,ij->i", rows.x[at[s:s + step]].astype(kind), asked.x[who[s:s + step]].astype(kind))
    return out


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are there."""
    return numbers(column.fill_null(0)), numbers(column.is_valid())


def _table(columns: dict[str, tuple]) -> pa.Table:
    return pa.table({name: pa.array(values, kind, mask=mask) for name, (values, kind, mask) in columns.items()})


def _firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, there: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each group, by falling score, then id."""
    order = np.lexsort((ids, ~there, -score, group))
    sorted_group = group[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group) < n]


def _positives(rows: DataFrame, anchors: DataFrame, width: int, n: int, counts: dict[int, int], asked: dict[int, int], slice_rows: int, block_rows: int) -> DataFrame:
    """``(_a, positive_id, positive_score)``: the best ``n`` rows of the anchor's label."""
    pieces = lambda sizes, most: F.element_at(F.create_map(*(F.lit(v) for b, c in sorted(sizes.items()) for v in (b, parts(c, most)))), F.col("bucket"))
    within = lambda at_all, column: F.pmod(F.xxhash64(column), at_all).cast("int")
    shared = {b: c for b, c in counts.items() if b in asked}
    if not shared:
        return rows.sparkSession.createDataFrame([], "_a long, positive_id long, positive_score long, _rank int")
    rows = rows.where(F.col("bucket").isin(*shared)).withColumn("slice", within(pieces(shared, slice_rows), "_v"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), pieces(asked, block_rows) - 1))).select("bucket", "slice", "block", "vec_id", "label", "x", "codes", "aligned", "part", "residual")
    anchors = anchors.where(F.col("bucket").isin(*shared)).withColumn("block", within(pieces(asked, block_rows), "_a"))
    anchors = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), pieces(shared, slice_rows) - 1))).select("bucket", "slice", "block", "_a", "anchor_id", "label", "x")

    def mine(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            near, to = Coded(left, width), Asked(right, width)
            ids, there = _ids(left.column("vec_id"))
            mine_, label, theirs = numbers(right.column("anchor_id")), numbers(left.column("label")), numbers(right.column("label"))
            step = max(1, TILE // len(near))
            for start in range(0, len(to), step):
                who = slice(start, start + step)
                low, high = intervals(near, to, slice(None), who)
                other = (label[:, None] != theirs[who]) | (there[:, None] & (ids[:, None] == mine_[who]))
                low[other], high[other] = -np.inf, -np.inf
                floor = np.partition(low, len(low) - n, axis=0)[len(low) - n] if n < len(low) else np.full(low.shape[1], -np.inf)
                at, col = np.nonzero((high >= floor) & ~other)
                found.append((at, start + col))
        at, col = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        score = scores_of(near, to, at, col) if len(at) else np.empty(0, np.int64)
        if len(at):
            best = _firsts(col, score, ids[at], there[at], n)
            at, col, score = at[best], col[best], score[best]
        a = numbers(right.column("_a"))[col] if len(at) else at
        known = there[at] if len(at) else np.empty(0, bool)
        return _table({"_a": (a, pa.int64(), None), "positive_id": (ids[at] if len(at) else at, pa.int64(), ~known), "positive_score": (score, pa.int64(), None)})

    keys = ["bucket", "slice", "block"]
    local = rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(mine, "_a long, positive_id long, positive_score long")
    order = Window.partitionBy("_a").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return local.withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {n}")


def _negatives(rows: DataFrame, anchors: DataFrame, width: int, n: int, window: tuple[int, int], slices: int, blocks: int) -> DataFrame:
    """``(_a, _p, negative_id, negative_score)``: the first ``n`` rows of other labels in each window, per task.

    ``anchors`` has ``scores``, those of its positives in rank order.
    """
    left = rows.withColumn("slice", dealt(slices, "_v")).withColumn("block", repeated(blocks)).select("slice", "block", "vec_id", "label", "x", "codes", "aligned", "part", "residual")
    right = anchors.withColumn("block", dealt(blocks, "_a")).withColumn("slice", repeated(slices)).select("slice", "block", "_a", "label", "scores", "x")
    least, most = window

    def mine(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            near, to = Coded(left, width), Asked(right, width)
            ids, there = _ids(left.column("vec_id"))
            label, theirs = numbers(left.column("label")), numbers(right.column("label"))
            listed = right.column("scores").to_pylist()
            n_windows = max(map(len, listed))
            # windows in whole numbers; a missing one is empty
            floors = np.full((n_windows, len(to)), 1 << 62)
            caps = np.full((n_windows, len(to)), -(1 << 62))
            for i, scores in enumerate(listed):
                for w, s in enumerate(scores):
                    floors[w, i], caps[w, i] = -(-least * s // 100), most * s // 100
            lowest = floors.copy()
            best = [[out[0]] for _ in range(n_windows)]
            anchors_at_once = max(1, TILE // STEP)
            edges = [0]
            while edges[-1] < len(near):
                edges.append(edges[-1] + min(STEP, max(FIRST, edges[-1])))
            for first, end in zip(edges, edges[1:]):
                for start in range(0, len(to), anchors_at_once):
                    who, at_ = slice(start, start + anchors_at_once), slice(first, end)
                    low, high = intervals(near, to, at_, who)
                    touched = np.zeros(low.shape, bool)
                    for w in range(n_windows):
                        touched |= (high >= floors[w, who]) & (low <= caps[w, who])
                    at, col = np.nonzero(touched & (label[at_, None] != theirs[who]))
                    at, col = at + first, col + start
                    score = scores_of(near, to, at, col)
                    for w in range(n_windows):
                        use = (score >= lowest[w, col]) & (score <= caps[w, col])
                        if not use.any():
                            continue
                        best[w].append((at[use], col[use], score[use], there[at[use]]))
                        a, c, s, t = (np.concatenate([b[i] for b in best[w]]) for i in range(4))
                        top = _firsts(c, s, ids[a], t.astype(bool), n)
                        best[w] = [(a[top], c[top], s[top], t[top])]
                        # where n rows are inside the window, a row must reach the last of them
                        c, s = c[top], s[top]
                        last = np.flatnonzero(np.arange(len(c)) - np.searchsorted(c, c) == n - 1)
                        floors[w, c[last]] = np.maximum(floors[w, c[last]], s[last])
            out = [(numbers(right.column("_a"))[c], np.full(len(c), w), a, s) for w in range(n_windows) for a, c, s, _ in best[w]]
        a, w, at, s = (np.concatenate([o[i] for o in out]) for i in range(4))
        known = there[at] if len(at) else np.empty(0, bool)
        return _table({"_a": (a, pa.int64(), None), "_p": (w.astype(np.int32), pa.int32(), None), "negative_id": (ids[at] if len(at) else at, pa.int64(), ~known), "negative_score": (s, pa.int64(), None)})

    keys = ["slice", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(mine, "_a long, _p int, negative_id long, negative_score long")


def with_codes(rows: DataFrame, width: int, levels: int = LEVELS) -> DataFrame:
    """Rows with the codes, alignments and lengths of their vector ``x``."""

    def code(batches):
        for batch in batches:
            codes, aligned, part, residual = coded(matrix(batch.column("x"), width).astype(np.float64), levels)
            extra = pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(aligned), pa.list_(pa.float64())), pa.array(part), pa.array(residual)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "codes", "aligned", "part", "residual"])

    return rows.mapInArrow(code, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {CODED}")


def mine_negatives(
    df: DataFrame, anchors: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", levels: int = LEVELS, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For every row that ``anchors`` marks and each of its first ``n_positives`` other rows of its
    label: the first ``n_negatives`` rows of other labels whose score is within ``window`` percent of the
    positive's. Scores are integer inner products of ``floor(scale * component)``.
    """
    taken = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(vec_col).alias("v"))
    taken = taken.where(whole(F.col("v")) & F.col("label").isNotNull())
    distinct = taken.select("vec_id", "label", "asks", integers(F.col("v"), scale).alias("x")).groupBy("vec_id", "label", "x").agg(F.max("asks").alias("asks"))
    distinct = store(distinct.withColumn("bucket", dealt(BUCKETS, "label")), "negatives-rows")
    n, width = width_of(distinct)
    if not n:
        return df.sparkSession.createDataFrame([], MINED)
    kept = first_copies(distinct.drop("asks"), ["label", "x"], "vec_id", max(n_positives + 1, n_negatives))
    kept = store(with_codes(kept.withColumn("_v", F.monotonically_increasing_id()), width, levels), "negatives-codes")
    asked = distinct.where("asks AND vec_id IS NOT NULL").drop("asks").withColumnRenamed("vec_id", "anchor_id").withColumn("_a", F.monotonically_increasing_id())
    asked = store(asked, "negatives-anchors")
    sizes = lambda rows: {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # noqa: E731  64 numbers at most
    buckets, asking = sizes(kept), sizes(asked)

    positives = store(_positives(kept, asked, width, n_positives, buckets, asking, slice_rows, block_rows), "positives")
    ranked = F.sort_array(F.collect_list(F.struct("_rank", "positive_id", "positive_score")))
    listed = store(positives.groupBy("_a").agg(ranked.alias("positives")), "positive-lists")
    windows = asked.join(listed, "_a").withColumn("scores", F.col("positives.positive_score"))
    local = _negatives(kept, windows, width, n_negatives, window, parts(sum(buckets.values()), slice_rows), parts(sum(asking.values()), block_rows))
    order = Window.partitionBy("_a", "_p").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    best = local.withColumn("rank", F.row_number().over(order)).where(f"rank <= {n_negatives}")
    named = listed.join(asked.select("_a", "anchor_id"), "_a").select("_a", "anchor_id", F.posexplode("positives").alias("_p", "p"))
    return best.join(named, ["_a", "_p"]).select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", "negative_id", F.col("p.positive_score").alias("positive_score"), "negative_score")
