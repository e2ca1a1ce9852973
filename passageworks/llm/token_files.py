"""Token ids in patched frame-of-reference blocks.

Documents are dealt by range of their id, encoded, and written as segments in
ascending order. A segment is one record: the ids of consecutive whole documents
as a binary payload, with the documents' ids and lengths beside it. Its payload::

    magic "PFR1" | n_ids u32 | n_blocks u32 | end of each block u32 | blocks
    block: minimum u32 | width u8 | n_exceptions u8 | packed values
           | exception places u8 | exception values u32

All numbers are little-endian. A block covers 128 ids (the last one fewer). The
block minimum is subtracted; the width is that of the value at ``PERCENTILE``,
and wider values are exceptions, whose packed field stays zero. Ends of blocks
are counted from the first block, so any block can be read alone.

The records sit in Parquet files, because executors reach a shared store only
through Spark's writers. Nothing is dropped: null and empty texts have no ids
besides the end id, a document of any length is one run of a segment, equal ids
follow each other in the order of their texts, null ids come first, columns
other than the id and the text are ignored, an empty table gives no record.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_worker

BLOCK = 128
#: Share of a block's values that must fit into the packed width.
PERCENTILE = 0.9
#: A segment is closed once it holds so many ids; the last document is kept whole.
SEGMENT_IDS = 1 << 18
#: Distinct words whose ids a task remembers at most before it starts anew.
CACHE_WORDS = 1 << 19
#: Marks that often stand behind a word, and the last letter of plain words (those
#: that lower-casing and composing leave one run of letters; all but one up to there).
MARKS, LAST_LETTER = ".,;:!?", "ɏ"

SEGMENTS = "shard INT, segment INT, doc_ids ARRAY<BIGINT>, lengths ARRAY<INT>, payload BINARY"


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs; exact, since 32-bit values have exact doubles."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The payload of a segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = b"PFR1" + np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head
    padded = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).astype(np.uint32).reshape(blocks, BLOCK)
    lowest = padded.min(1)
    rest = padded - lowest[:, None]
    need = widths(rest)
    nth = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(need, nth, axis=1)[:, nth].astype(np.int64)
    out = need > width[:, None]
    n_out = out.sum(1)
    size = 6 + width * (BLOCK // 8) + 5 * n_out
    end = np.cumsum(size)
    start = end - size
    body = np.zeros(int(end[-1]), np.uint8)
    body[start[:, None] + np.arange(4)] = lowest.astype("<u4").view(np.uint8).reshape(blocks, 4)
    body[start + 4] = width
    body[start + 5] = n_out
    kept = np.where(out, 0, rest).astype(np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(kept[which].astype(kind).view(np.uint8).reshape(len(which), BLOCK, kind.itemsize), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
        body[start[which][:, None] + 6 + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(out)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        at = start[row] + 6 + width[row] * (BLOCK // 8)
        body[at + nth] = place
        values = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(at + n_out[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return head + end.astype("<u4").tobytes() + body.tobytes()


def unpack(payload: bytes, block: int | None = None) -> np.ndarray:
    """The ids of a payload, or those of one block, found by the index of block ends."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a payload of token ids")
    n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2, 4))
    if not n:
        return np.zeros(0, np.uint32)
    end = np.frombuffer(payload, "<u4", blocks, 12).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=12 + 4 * blocks)
    start = np.concatenate([[0], end[:-1]])
    chosen = np.arange(blocks) if block is None else np.array([block])
    start = start[chosen]
    lowest = np.ascontiguousarray(body[start[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    width, n_out = body[start + 4].astype(np.int64), body[start + 5].astype(np.int64)
    rest = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        packed = body[start[which][:, None] + 6 + np.arange(w * (BLOCK // 8))]
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        bits = np.zeros((len(which), BLOCK, 8 * kind.itemsize), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
        rest[which] = np.packbits(bits, axis=2, bitorder="little").view(kind)[:, :, 0]
    if n_out.any():
        row = np.repeat(np.arange(len(chosen)), n_out)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        at = start[row] + 6 + width[row] * (BLOCK // 8)
        values = body[(at + n_out[row] + 4 * nth)[:, None] + np.arange(4)]
        rest[row, body[at + nth]] = np.ascontiguousarray(values).view("<u4").reshape(-1)
    ids = (rest + lowest[:, None].astype(np.uint32)).reshape(-1)
    if block is None:
        return ids[:n]
    return ids[: min(BLOCK, n - block * BLOCK)]


class Numbered(dict):
    """Numbers of words in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class WordEncoder:
    """Ids of texts by a tokenizer whose units never cross a blank or line feed.

    Texts are cut there, and the ids of each distinct word are asked for once, plain
    words many at a time. Every text ends with ``end_id``.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        vocabulary = tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place = Numbered({"": 0, "\n": 1})  # no word holds a line feed: the end of a text
        self.flat = np.array([self.end_id], np.uint32)
        self.first, self.count = np.zeros(2, np.int64), np.array([0, 1])

    def learn(self, new: list[str]) -> None:
        # letters are one unit of the tokenizer, and a mark behind them is another
        units = np.fromiter((0 if not w.isascii() and (max(w) > LAST_LETTER or "İ" in w) else 1 if w.isalpha() else 2 if w[-1] in MARKS and w[:-1].isalpha() else 0 for w in new), np.int64, len(new))
        plain, other = np.flatnonzero(units), np.flatnonzero(units == 0)
        ids, counts = self.together([new[i] for i in plain.tolist()], units[plain])
        if ids is None:
            plain, other, ids, counts = other[:0], np.arange(len(new)), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in other.tolist()], add_special_tokens=False)]
        order = np.concatenate([plain, other])
        count = np.concatenate([counts, np.fromiter(map(len, found), np.int64, len(found))])
        first = len(self.flat) + np.cumsum(count) - count
        back = np.argsort(order)
        self.first, self.count = np.concatenate([self.first, first[back]]), np.concatenate([self.count, count[back]])
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(found), np.uint32)])

    def together(self, some: list[str], units: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Ids of words that are encoded with blanks between them, and how many each has.

        Where a word ends is counted by its units, as every unit's last id is one
        that ends a unit. If the units do not add up, nothing is returned.
        """
        texts = [" ".join(some[at : at + 500]) for at in range(0, len(some), 500)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != units.sum() or len(ends) and ends[-1] != len(ids):
            return None, None
        return ids, np.diff(ends[np.cumsum(units) - 1], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHE_WORDS:
            self.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        for found in cut:
            found.append("\n")
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if len(self.place) > len(self.count):
            self.learn(list(islice(self.place, len(self.count), None)))
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(ids, ends[np.cumsum(sizes) - 1][:-1]) if texts else []


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the segments below ``path``.

    The tokenizer file (a few megabytes, whatever the corpus) is read on the
    driver and broadcast, so executors need no copy of it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    shared = spark.sparkContext.broadcast(text)
    name = f"token-files-{xxhash.xxh64_hexdigest(text)}-{end_id}"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = per_worker(name, lambda: WordEncoder(Tokenizer.from_str(shared.value), end_id))
        shard, segment = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def record() -> pa.RecordBatch:
            columns = [[shard], [segment], [ids], [[len(p) for p in parts]], [pack(np.concatenate(parts))]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = ["shard", "segment", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc, found in zip(piece.column(0).to_pylist(), encoder.encode(texts)):
                    ids.append(doc)
                    parts.append(found)
                    held += len(parts[-1])
                    if held >= SEGMENT_IDS:
                        yield record()
                        ids, parts, held, segment = [], [], 0, segment + 1
        if ids:
            yield record()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = chosen.repartitionByRange("id").sortWithinPartitions("id", "text")
    dealt.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: place, number and CRC-32 of its ids (and the ids themselves)."""
    kinds = [("id", pa.int64()), ("shard", pa.int32()), ("segment", pa.int32()), ("nth", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, segment, docs, lengths, payload = (batch.column(i)[row].as_py() for i in range(5))
                ids, end = unpack(payload).astype("<u4"), np.cumsum(lengths)
                runs = [ids[e - n : e] for n, e in zip(lengths, end)]
                columns = [docs, [shard] * len(docs), [segment] * len(docs), range(len(docs)), end - lengths, lengths, [zlib.crc32(r.tobytes()) for r in runs]]
                columns += [[r.astype(np.int32) for r in runs]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

    schema = "id BIGINT, shard INT, segment INT, nth INT, local BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + ", ids ARRAY<INT>" * with_ids
    files = spark.read.schema(SEGMENTS).parquet(path)
    sizes = files.select("shard", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    # one row per shard goes to a single task; the segments of a shard are summed apart
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")
    starts = sizes.select("shard", "segment", inside.alias("inside")).join(before, "shard")
    rows = files.mapInArrow(documents, schema).join(starts, ["shard", "segment"])
    start = (F.col("before") + F.col("inside") + F.col("local")).alias("start")
    return rows.select("id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids, "shard", "segment", "nth")
