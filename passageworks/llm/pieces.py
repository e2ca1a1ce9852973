"""SentencePiece encoding, sampled segmentations, and decoding.

``encode`` gives the model's own segmentation of every whole text, and ``k``
distinct sampled ones. In this model's pieces a blank stands at the front only, so
a text falls into units (blanks and what follows up to the next blank) that no
piece crosses; each distinct unit is looked up in the vocabulary once.

A unit's lattice holds every way to spell it with pieces. A piece of merge rank
``r`` weighs ``(r + 2) ** -ALPHA``, a character outside the vocabulary is spelt by
its bytes, and a segmentation's chance is the product of its weights, normalized
over the lattice. Sums towards the end of the unit give the exact chance of each
next piece.

Distinct segmentations come from Gumbel top-k sampling by best-first search.
A node stands for all segmentations that share a beginning and then avoid some
pieces; its key is the largest perturbed log chance in it. The root's key is a
Gumbel number. Taking the node of the largest key yields the segmentation that
has it, found by drawing a piece at each place; what is left of the node falls
into one child per place (same beginning, another piece there), whose key is a
Gumbel number of the child's chance, truncated at its parent's key. Only the
``k`` best children can ever be taken, so no more are held. The next best key
``t`` after ``k`` samples gives the inclusion score ``1 - exp(-exp(log_prob - t))``.
All random numbers are hashes of seed, row key, sample and place, so results do
not depend on how rows are dealt.

Null texts count as empty; an empty text has one segmentation, without pieces. A
text with fewer than ``k`` segmentations gives all of them, with score 1. Rows
with equal key and text give equal samples. Texts are worked on whole, one row
each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker

MARK = "▁"
K, ALPHA, SEED = 2, 1.0, 1
#: Code points up to this one (but the last, which stands for a blank) have a table of steps.
TABLE_CHARS = 256
#: Distinct units, and arcs of their lattices (25 bytes each), that a worker holds before it forgets those it used least.
CACHE_UNITS, CACHE_ARCS = 1 << 17, 3 << 20
#: Characters of text that are worked on together; a longer text alone.
BATCH_CHARS = 1 << 17

SAMPLE = "STRUCT<ids: BINARY, n_pieces: INT, log_prob: DOUBLE, key: DOUBLE, score: DOUBLE>"
SCHEMA = f"id BIGINT, ids BINARY, n_pieces INT, samples ARRAY<{SAMPLE}>"


class Growing:
    """An array that is extended often; its room doubles, so that each number is moved a few times only."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> np.ndarray:
        """The whole array, with ``values`` at its end."""
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = values
        self.size = end
        return self.room[:end]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + count[i] - 1``, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed; ``x`` is a fresh array and is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(key: int, *parts: int) -> int:
    """The start of a stream of random numbers, from a key and whole numbers."""
    return xxhash.xxh64_intdigest(repr(parts), seed=key)


def uniform(start: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The ``nth`` numbers in (0, 1) of the streams that begin at ``start``."""
    x = mixed(np.atleast_1d(start + np.asarray(nth).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


class Vocabulary:
    """The pieces of a model as a trie over code points, with their weights."""

    def __init__(self, proto: bytes, alpha: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = self.model.get_piece_size()
        self.texts, self.byte_ids, ranks = [], np.zeros(256, np.int64), np.full(size, float(size))
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in range(size):
            piece = self.model.id_to_piece(i)
            plain = not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
            if self.model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.texts.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.texts.append(piece.replace(MARK, " ").encode() if plain else b"")
            if plain:
                score = -self.model.get_score(i)
                ranks[i] = score if score < 1e8 else size
                state = 0
                for c in piece:
                    state = edges.setdefault((state, ord(c)), len(edges) + 1)
                ends[state] = i
        self.log_weight = -alpha * np.log(ranks + 2)
        keys = np.array([s * 0x110000 + c for s, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), np.int64)[order]
        # steps by the most frequent characters are looked up in a table
        self.table = np.full((len(edges) + 1, TABLE_CHARS), -1, np.int32)
        char, frequent = self.keys % 0x110000, self.keys % 0x110000 < TABLE_CHARS - 1
        self.table[self.keys[frequent] // 0x110000, char[frequent]] = self.to[frequent]
        marked = char == ord(MARK)
        self.table[self.keys[marked] // 0x110000, TABLE_CHARS - 1] = self.to[marked]
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.parts = np.array(self.texts, object)

    def columns(self, char: np.ndarray) -> np.ndarray:
        """The column of each character in the table of steps; -1 for those that have none."""
        column = np.where(char == ord(MARK), TABLE_CHARS - 1, char)
        return np.where((column >= TABLE_CHARS) | (char == TABLE_CHARS - 1), -1, column)

    def step(self, state: np.ndarray, column: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state behind each character; -1 if no piece goes on so."""
        found = self.table.ravel().take(state * TABLE_CHARS + column, mode="wrap").astype(np.int64)
        rare = np.flatnonzero(column < 0)
        if len(rare):
            key = state[rare] * 0x110000 + char[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding put in front is taken away."""
        found = b"".join(self.parts[ids].tolist()).decode("utf-8", "replace")
        return found[1:] if found.startswith(" ") else found


class Numbers(dict):
    """Numbers of units; a unit that has none gets the next one, and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Units:
    """The lattices of distinct units, in flat arrays.

    ``node`` is the first node of a unit; a node's arcs lie side by side from
    ``arc_first``, the longest first. An arc has the logarithm of its chance
    given its node, the sum of chances up to it, the node it leads to (-1: end of
    unit) and its ids. ``uses`` counts the batches of texts that a unit occurred in.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.place = Numbers()
        kinds = dict.fromkeys(("node", "arc_first", "arc_count", "to", "ids_first", "ids", "own_first", "own_count", "own", "uses"), np.int32)
        self.grown = {name: Growing(kind) for name, kind in (kinds | {"ids_count": np.int8, "log_chance": np.float64, "upto": np.float32}).items()}
        for name in self.grown:
            self.extend(name, np.zeros(0, np.int64))

    def extend(self, name: str, values: np.ndarray) -> None:
        setattr(self, name, self.grown[name].extend(values))

    def keep(self, kept: np.ndarray) -> None:
        """Forget all units but ``kept`` (ascending numbers), whose arrays move together."""
        names = list(self.place)
        # where the rows of each unit begin, in all four kinds of arrays
        node = np.append(self.node, len(self.arc_first))
        arc = np.append(self.arc_first, len(self.upto))[node]
        ids = np.append(self.ids_first, len(self.ids))[arc]
        own = np.append(self.own_first, len(self.own))
        begin = [b[kept].astype(np.int64) for b in (node, arc, ids, own)]
        count = [b[kept + 1] - at for b, at in zip((node, arc, ids, own), begin)]
        moved = [np.cumsum(n) - n for n in count]
        nodes, arcs, ids, own = map(ranges, begin, count)
        by_node, to_arc, to_ids = (np.repeat(moved[i] - begin[i], count[j]) for i, j in ((1, 0), (0, 1), (2, 1)))
        to = self.to[arcs]
        new = {
            "node": moved[0], "arc_first": self.arc_first[nodes] + by_node, "arc_count": self.arc_count[nodes],
            "to": np.where(to < 0, -1, to + to_arc), "ids_first": self.ids_first[arcs] + to_ids, "ids_count": self.ids_count[arcs],
            "log_chance": self.log_chance[arcs], "upto": self.upto[arcs], "ids": self.ids[ids],
            "own_first": moved[3], "own_count": self.own_count[kept], "own": self.own[own], "uses": self.uses[kept] // 2,
        }
        self.clear()
        self.place.update((names[u], i) for i, u in enumerate(kept.tolist()))
        for name, values in new.items():
            self.extend(name, values)

    def full(self, coming: int) -> bool:
        """Whether ``coming`` more units were too many."""
        return len(self.node) > 0 and (len(self.node) + coming > CACHE_UNITS or len(self.upto) > CACHE_ARCS)

    def numbers(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units, whose uses are counted; makes the lattices of those that are not known yet."""

        def look_up() -> np.ndarray:
            return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

        found, new = look_up(), self.place.new
        if self.full(len(new)):
            for unit in new:
                del self.place[unit]
            self.place.new = []
            self.make_room(len(new))
            found, new = look_up(), self.place.new
        self.place.new = []
        if new:
            self.add(new)
        self.uses[found] += 1
        return found

    def make_room(self, coming: int) -> bool:
        """Forget units that were used least, if ``coming`` more were too many; whether any went."""
        if not self.full(coming):
            return False
        kept = np.argsort(-self.uses, kind="stable")[: CACHE_UNITS // 2]
        kept = np.sort(kept[self.uses[kept] > 1])
        ends = np.append(self.arc_first, len(self.upto))[np.append(self.node, len(self.arc_first))]
        self.keep(kept if (ends[kept + 1] - ends[kept]).sum() <= CACHE_ARCS // 2 else kept[:0])
        return True

    def add(self, new: list[str]) -> None:
        """Lattices and the model's own segmentation of units that are not known yet."""
        v = self.vocabulary
        self.extend("uses", np.zeros(len(new), np.int64))
        self.place.update(zip(new, range(len(self.node), len(self.node) + len(new))))
        own = v.model.encode([u[1:] for u in new], num_threads=1)
        if self.place.get(MARK, -1) >= len(self.node):
            own[self.place[MARK] - len(self.node)] = [v.model.piece_to_id(MARK)]
        count = np.fromiter(map(len, own), np.int64, len(own))
        self.extend("own_first", len(self.own) + np.cumsum(count) - count)
        self.extend("own_count", count)
        self.extend("own", np.fromiter(chain.from_iterable(own), np.int32, int(count.sum())))

        length = np.fromiter(map(len, new), np.int64, len(new))
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        total = len(chars)
        end = np.repeat(np.cumsum(length), length)  # of the unit that a character is in
        at, column = np.arange(total), v.columns(chars)
        state, where = np.zeros(total, np.int64), at.copy()
        arc_count = np.zeros(total, np.int64)
        starts, stops, pieces, ranks = [], [], [], []

        def arcs(begin: np.ndarray, stop: np.ndarray, piece: np.ndarray) -> None:
            starts.append(begin)
            stops.append(stop)
            pieces.append(piece)
            ranks.append(arc_count[begin])
            arc_count[begin] += 1

        while len(at):
            state = v.step(state, column[where], chars[where])
            on = np.flatnonzero(state >= 0)
            at, state, where = at[on], state[on], where[on] + 1
            piece = v.piece[state]
            hit = np.flatnonzero(piece >= 0)
            arcs(at[hit], where[hit], piece[hit])
            on = np.flatnonzero(where < end[at])
            at, state, where = at[on], state[on], where[on]
        # a character that no single piece spells is spelt by its bytes
        single = np.zeros(total, bool)
        if starts:
            single[starts[0]] = True
        spelt = np.flatnonzero(~single)
        raw = [chr(c).encode("utf-8", "replace") for c in chars[spelt]]
        arcs(spelt, spelt + 1, np.full(len(spelt), -1))
        arc_first = np.cumsum(arc_count) - arc_count

        # a place for each arc: those of one node side by side, the longest first
        start, rank = np.concatenate(starts), np.concatenate(ranks)
        place = arc_first[start] + arc_count[start] - 1 - rank
        n_arcs = len(start)
        stop, piece, begin = np.empty(n_arcs, np.int64), np.empty(n_arcs, np.int64), np.repeat(np.arange(total), arc_count)
        stop[place], piece[place] = np.concatenate(stops), np.concatenate(pieces)
        bytewise = np.flatnonzero(piece < 0)
        weight, ids_count = v.log_weight[piece], np.ones(n_arcs, np.int64)
        n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids_count[bytewise] = n_bytes  # both in order of their characters
        weight[bytewise] = n_bytes * v.log_weight[v.byte_ids[0]]
        ids_first = np.cumsum(ids_count) - ids_count
        ids = np.empty(int(ids_count.sum()), np.int64)
        ids[ids_first] = piece
        if len(spelt):
            ids[ranges(ids_first[bytewise], n_bytes)] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]

        # sums towards the end, for all characters that are as far from it together
        last = stop == end[begin]
        behind = np.where(last, total, stop)  # nothing is behind the end, which has the mass 0
        mass = np.zeros(total + 1)
        far = end - np.arange(total)
        order = np.argsort(far.astype(np.uint16) if total and far.max() < 1 << 16 else far, kind="stable")
        count = arc_count[order]
        some = ranges(arc_first[order], count)
        weights, behinds, arc = weight[some], behind[some], np.append(0, np.cumsum(count))
        bounds = np.append(0, np.cumsum(np.bincount(far)[1:])) if total else np.zeros(1, np.int64)
        for lo, hi, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), arc[bounds[:-1]].tolist(), arc[bounds[1:]].tolist()):
            mass[order[lo:hi]] = np.logaddexp.reduceat(weights[a:b] + mass[behinds[a:b]], arc[lo:hi] - a)
        log_chance = np.minimum(weight + mass[behind] - mass[begin], 0.0)
        sums = np.cumsum(np.exp(log_chance))
        before = np.concatenate([[0.0], sums])[arc_first]
        known, held = len(self.arc_first), len(self.upto)
        self.extend("node", known + np.cumsum(length) - length)
        self.extend("arc_first", held + arc_first)
        self.extend("arc_count", arc_count)
        self.extend("log_chance", log_chance)
        self.extend("upto", sums - np.repeat(before, arc_count))
        self.extend("to", np.where(last, -1, known + stop))
        self.extend("ids_first", len(self.ids) + ids_first)
        self.extend("ids_count", ids_count)
        self.extend("ids", ids)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each node, by its chance."""
        arc = self.arc_first[node].astype(np.int64)
        last = arc + self.arc_count[node] - 1
        on = np.flatnonzero((u > self.upto[arc]) & (arc < last))
        while len(on):
            arc[on] += 1
            a = arc[on]
            on = on[(u[on] > self.upto[a]) & (a < last[on])]
        return arc

    def spelt(self, arcs: np.ndarray) -> np.ndarray:
        """The ids of arcs."""
        first, count = self.ids_first[arcs], self.ids_count[arcs]
        return self.ids[first if (count == 1).all() else ranges(first, count)]

    def others(self, arc: int, taken: list[int]) -> np.ndarray:
        """The arcs beside ``arc`` that are none of ``taken``."""
        node = int(np.searchsorted(self.arc_first, np.int32(arc), "right")) - 1
        first = int(self.arc_first[node])
        return np.array([a for a in range(first, first + int(self.arc_count[node])) if a not in taken], np.int64)

    def walk(self, node: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs from each node to the end of its unit, one walk after the other, and how many each has."""
        on = np.flatnonzero(node >= 0)
        now, at, count = node[on], streams[on], np.zeros(len(node), np.int64)
        whose, arcs, step = [], [], 0
        while len(on):
            arc = self.draw(now, uniform(at, np.uint64(step)))
            whose.append(on)
            arcs.append(arc)
            now = self.to[arc].astype(np.int64)
            go = np.flatnonzero(now >= 0)
            on, now, at, step = on[go], now[go], at[go], step + 1
        for w in whose:
            count[w] += 1
        out = np.zeros(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        for i, (w, a) in enumerate(zip(whose, arcs)):
            out[first[w] + i] = a
        return out, count


#: A child's key exceeds the log chance of its beginning by less than this.
SLACK = 38.0


class Search:
    """The best-first search over one text's segmentations."""

    def __init__(self, units: Units, key: int, words: np.ndarray, k: int):
        self.units, self.key, self.words, self.k = units, key, words, k
        self.samples: list[tuple[np.ndarray, float]] = []  # arcs, key
        self.queue: list[tuple[float, int, int, list[int]]] = []  # key, sample, place, arcs to avoid there

    def draws(self, *parts: int) -> np.ndarray:
        return np.array([stream(self.key, *parts)], np.uint64)

    def root_key(self) -> float:
        return float(-np.log(-np.log(uniform(self.draws("root"), 0)[0])))

    def branch(self) -> tuple[float, np.ndarray, int, int, list[int]] | None:
        """Take the best node: its key, the shared arcs, the arc that differs, its unit, the avoided arcs."""
        if not self.queue:
            return None
        top, nth, place, taken = self.queue.pop(0)
        shared = self.samples[nth][0]
        others = self.units.others(int(shared[place]), taken)
        shared = shared[:place]
        sums = np.cumsum(np.exp(self.units.log_chance[others]))
        u = uniform(self.draws("branch", len(self.samples)), 0)[0]
        arc = int(others[min(int(np.searchsorted(sums, u * sums[-1])), len(others) - 1)])
        return top, shared, arc, int(np.count_nonzero(self.units.to[shared] < 0)), taken


def note(units: Units, found: list[tuple[Search, np.ndarray, float, int, list[int]]], k: int) -> None:
    """Note a sample of each search (its arcs, key, place of its first new arc, arcs avoided there), and queue its best children.

    Beginnings only get less likely, so the children are looked at in stretches, those of
    all searches side by side, until no later one can be among the best of its search.
    """
    if not found:
        return
    nth = [len(s.samples) for s, *_ in found]
    flat, tops = np.concatenate([arcs for _, arcs, *_ in found]), np.array([top for _, _, top, *_ in found])
    end = np.cumsum([len(arcs) for _, arcs, *_ in found])
    first = end - [len(arcs) for _, arcs, *_ in found]
    at = first + [start for *_, start, _ in found]
    before = np.array([units.log_chance[arcs[:start]].sum() for _, arcs, _, start, _ in found])
    noise_of = np.concatenate([s.draws("child", n) for (s, *_), n in zip(found, nth)])
    for s, arcs, top, *_ in found:
        s.samples.append((arcs, top))
    size, begin = 64, at.tolist()
    on = np.arange(len(found))
    while True:
        limit = before[on] + SLACK
        reaching = [len(found[i][0].queue) <= k or x > found[i][0].queue[k][0] for i, x in zip(on.tolist(), limit.tolist())]
        on = on[np.array(reaching, bool) & (at[on] < end[on])]
        if not len(on):
            return
        width = min(size, int((end[on] - at[on]).max()))
        where = at[on][:, None] + np.arange(width)
        here = flat[np.minimum(where, len(flat) - 1)]
        log_chance = np.where(where < end[on][:, None], units.log_chance[here], 0.0)
        begun = before[on][:, None] + np.cumsum(log_chance, axis=1)
        rest = -np.expm1(log_chance)  # zero where there is no other arc
        if size == 64:
            for r, i in enumerate(on.tolist()):
                if avoided := found[i][4]:
                    arc = int(here[r, 0])
                    rest[r, 0] = np.exp(units.log_chance[units.others(arc, [*avoided, arc])]).sum()
        none = rest <= 1e-15
        rest[none] = 1.0
        place = begun - log_chance + np.log(rest)
        noise = -np.log(uniform(noise_of[on][:, None], where - first[on][:, None]))
        keys = place - np.log(np.exp(np.minimum(place - tops[on][:, None], 700.0)) + noise)
        keys[none] = -np.inf
        best = np.argpartition(keys, width - k - 1, axis=1)[:, -k - 1 :] if width > k else np.broadcast_to(np.arange(width), keys.shape)
        chosen = (np.take_along_axis(x, best, axis=1).tolist() for x in (keys, where, here))
        for i, *row in zip(on.tolist(), *chosen):
            s, start = found[i][0], begin[i]
            for value, w, arc in zip(*row):
                if value > -np.inf:
                    s.queue.append((value, nth[i], w - int(first[i]), [*(found[i][4] if w == start else []), arc]))
            s.queue = sorted(s.queue, key=lambda x: -x[0])[: k + 1]
        before[on], at[on], size = begun[:, -1], at[on] + width, size * 4


def search_all(units: Units, keys: list[int], texts: list[np.ndarray], k: int) -> list[Search]:
    """Searches of many texts side by side: each round draws the arcs of all of them at once."""
    searches = [Search(units, key, words, k) for key, words in zip(keys, texts)]
    heads: list[tuple | None] = [(s.root_key(), np.zeros(0, np.int64), None, 0, []) for s in searches]
    for nth in range(k):
        # what each text still has to draw: from a node within a unit, then whole units
        nodes, streams = [], []
        for s, head in zip(searches, heads):
            words = s.words[head[3] :] if head else s.words[:0]
            start = units.node[words]
            if head and head[2] is not None:
                start[0] = units.to[head[2]]
            nodes.append(start)
            streams.append(s.draws("walk", nth) + np.arange(len(start), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        arcs, counts = units.walk(np.concatenate(nodes), mixed(np.concatenate(streams)))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(n) for n in nodes])])]
        found = []
        for s, head, lo, hi in zip(searches, heads, ends[:-1], ends[1:]):
            if head:
                top, shared, arc, _, taken = head
                branch = [] if arc is None else [arc]
                found.append((s, np.concatenate([shared, np.array(branch, np.int64), arcs[lo:hi]]), top, len(shared), taken))
        note(units, found, k)
        if nth + 1 < k:
            heads = [s.branch() for s in searches]
    return searches


def cut_units(text: str) -> list[str]:
    """Units of a text; blanks and marks are one to this kind of model."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if MARK + MARK in marked:
        return re.findall(f"{MARK}+[^{MARK}]*", marked)
    return [MARK + w for w in marked[1:].split(MARK)]


def cut_all(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct units of some texts, and the places of each text's units among them."""
    odd = {i: cut_units(t) for i, t in enumerate(texts) if not t or t[0] == " " or "  " in t or MARK in t}
    cut = pc.split_pattern(pa.array([t for i, t in enumerate(texts) if i not in odd], pa.large_string()), " ")
    coded = cut.flatten().dictionary_encode()
    units = [MARK + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    ends = cut.offsets.to_numpy()
    codes = coded.indices.to_numpy()
    plain = iter([codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    if any(odd.values()):
        place = {u: i for i, u in enumerate(units)}
        odd = {i: np.fromiter((place.setdefault(u, len(place)) for u in c), np.int64, len(c)) for i, c in odd.items()}
        units = list(place)
    return units, [np.array(odd[i], np.int64) if i in odd else next(plain) for i in range(len(texts))]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = K, alpha: float = ALPHA, seed: int = SEED, digests: bool = False) -> DataFrame:
    """``(id, ids, n_pieces, samples)`` for every row; ids are little-endian, two bytes each (four from 65,536 pieces on).

    The model file (half a megabyte, whatever the corpus) is read on the driver
    and broadcast, so executors need no copy of it. ``digests`` adds SHA-256 of the text, of
    the text that the row's ids decode to and of those of its samples; decoding in the same
    worker needs no second vocabulary and moves no texts.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = f"pieces-{xxhash.xxh64_hexdigest(model)}-{alpha}"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = per_worker(name, lambda: Units(Vocabulary(shared.value, alpha)))
        vocabulary = units.vocabulary
        kind = np.dtype("<u2" if len(vocabulary.texts) <= 1 << 16 else "<u4")
        sample = pa.struct([("ids", pa.binary()), ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("key", pa.float64()), ("score", pa.float64())])

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            distinct, places = cut_all(texts)
            number = units.numbers(distinct)
            words = [number[at] for at in places]
            seeds = [xxhash.xxh64_intdigest(str(key), seed=seed) for key in keys]
            own, samples = [], []
            for at in words:
                own.append(units.own[ranges(units.own_first[at], units.own_count[at])].astype(kind))
            for search in search_all(units, seeds, words, k):
                nxt = search.queue[0][0] if search.queue else -np.inf
                found = []
                for arcs, top in search.samples:
                    ids = units.spelt(arcs).astype(kind)
                    log_prob = float(units.log_chance[arcs].sum())
                    score = 1.0 if nxt == -np.inf else float(-np.expm1(-np.exp(min(log_prob - nxt, 700.0))))
                    found.append({"ids": ids.tobytes(), "n_pieces": len(ids), "log_prob": log_prob, "key": top, "score": score})
                samples.append(found)
            columns = [pa.array(keys, pa.int64()), pa.array([o.tobytes() for o in own], pa.binary()), pa.array([len(o) for o in own], pa.int32()), pa.array(samples, pa.list_(sample))]
            names = ["id", "ids", "n_pieces", "samples"]
            if digests:
                sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
                read = lambda ids: sha(vocabulary.decode(np.frombuffer(ids, kind).astype(np.int64)))
                columns += [pa.array(map(sha, texts), pa.string()), pa.array([read(o.tobytes()) for o in own], pa.string())]
                columns.append(pa.array([[read(x["ids"]) for x in found] for found in samples], pa.list_(pa.string())))
                names += ["text_sha256", "decoded_sha256", "samples_sha256"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            keys, texts, chars = [], [], 0
            for at in range(0, batch.num_rows, 100):
                piece = batch.slice(at, 100)
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    keys.append(key)
                    texts.append(text or "")
                    chars += len(texts[-1])
                    if chars >= BATCH_CHARS:
                        yield rows(keys, texts)
                        keys, texts, chars = [], [], 0
            if keys:
                yield rows(keys, texts)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(encoded, SCHEMA + (", text_sha256 STRING, decoded_sha256 STRING, samples_sha256 ARRAY<STRING>" if digests else ""))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ids; a null gives null, bytes that are no UTF-8 give U+FFFD."""
    with open(model_path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(shared.value, ALPHA)
        kind = np.dtype("<u2" if len(vocabulary.texts) <= 1 << 16 else "<u4")
        for batch in batches:
            yield batch.map(lambda x: None if x is None else vocabulary.decode(np.frombuffer(x, kind).astype(np.int64)))

    return rows.withColumn(into, decoded(F.col(ids_col)))
