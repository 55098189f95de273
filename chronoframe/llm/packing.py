"""Best-fit packing by a grouping genetic algorithm, run as islands with elite migration.

Documents are cut into pieces of at most CAPACITY tokens (only longer documents are cut).  Full pieces
are sequences of their own.  The rest is dealt by hash into groups of about GROUP pieces, each of them
a packing problem of bounded size.  A group is worked on by ISLANDS populations at a time.  A
chromosome is a list of bins.  Founders are best fit in descending and in random order, and minimum slack
with random first pieces.  Crossover injects well-filled bins of one parent whole into the other, removes the
bins that hold the same pieces, and puts the displaced pieces back: first in exchange for smaller ones, where that
fills a bin better, then by best fit; mutation dissolves the worst-filled bins and some at random.  Parents win
tournaments.  A child that is new and no worse than the worst enters, and the oldest of the worse half leaves, the best
one excepted.  After each round every island sends its elite to the next island of its group.  At the end the group's
best packing counts.  A group that reaches the lower bound (all tokens over the capacity, or the pieces over half of
it) is finished, as no packing is better.

Null and empty texts are pieces of one token (the end id).  Every row is packed, repeated ones too; an
empty table gives no sequences.  All seeds come from the group, island and round, and rows are dealt by their
written table, so a task that is run again gives the same.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import binary_list, slices
from chronoframe.llm.storage import dropped, partitions, small_batches, written
from chronoframe.llm.unit_codes import WordCodes, encoder

CAPACITY = 2048
END_ID = 0
GROUP, ISLANDS, ROUNDS = 5_000, 2, 3
POPULATION, CHILDREN = 12, 60
#: Contestants of a tournament.
TOURNAMENT = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The number of a piece's row, by which repeated rows are dealt apart.
ROW = "row long"
ORDER = ("length", "doc_id", "piece", "ids_crc32", "row")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: its place in its document, the crc32 of its ids, and a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(WordCodes, path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = binary_list(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                ids, n = codes.encode(texts[a:b])
                out: list[list] = [[], [], [], [], []]
                at = 0
                for name, k in zip(names[a:b], n.tolist(), strict=True):
                    x = memoryview(np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4")).cast("B")
                    at += k
                    for j, start in enumerate(range(0, k + 1, capacity)):
                        stop = min(k + 1, start + capacity)
                        for col, v in zip(out, (name, j, start, stop - start, zlib.crc32(x[4 * start : 4 * stop])), strict=True):
                            col.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                out.append(range(row, row + len(out[0])))
                row += len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{PIECES}, {ROW}")


class Packing:
    """Bins of item numbers; ``free`` is the room left in each.  Bins are tuples, which packings share."""

    def __init__(self, bins: list[tuple[int, ...]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.free = [capacity - sum([sizes[i] for i in b]) for b in bins]

    def insert(self, items: list[int], sort: bool = True) -> Packing:
        """Best fit, larger items first or in the given order: each goes where it leaves the least room."""
        room = sorted((f, k) for k, f in enumerate(self.free) if f)
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)) if sort else items:
            size = self.sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                f, k = room.pop(at)
            else:
                f, k = self.capacity, len(self.bins)
                self.bins.append(())
                self.free.append(f)
            self.bins[k] += (i,)
            self.free[k] = f - size
            if f > size:
                insort(room, (f - size, k))
        return self

    def exchange(self, items: list[int]) -> list[int]:
        """Puts displaced items in the place of one or two smaller ones wherever that fills a bin better; gives back what is displaced then."""
        out = sorted((self.sizes[i], i) for i in items)
        for k in sorted(range(len(self.bins)), key=self.free.__getitem__):
            f = self.free[k]
            if not f or not out:
                continue
            b = self.bins[k]
            best = (0, None, ())
            for gone in [(i,) for i in b] + list(combinations(b, 2)):
                size = sum([self.sizes[i] for i in gone])
                limit = size + f
                at = bisect_right(out, (limit, len(self.sizes)))
                if at and out[at - 1][0] - size > best[0]:
                    best = (out[at - 1][0] - size, gone, (at - 1,))
                if best[0] == f:
                    break
                low, high = 0, min(at, len(out)) - 1
                while low < high:  # two displaced ones
                    total = out[low][0] + out[high][0]
                    if total > limit:
                        high -= 1
                    else:
                        if total - size > best[0]:
                            best = (total - size, gone, (low, high))
                        low += 1
                if best[0] == f:
                    break
            gain, gone, came = best
            if gain:
                new = [out[j][1] for j in came]
                for j in reversed(came):
                    out.pop(j)
                for i in gone:
                    insort(out, (self.sizes[i], i))
                self.bins[k] = (*(i for i in b if i not in gone), *new)
                self.free[k] = f - gain
        return [i for _, i in out]

    @cached_property
    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better, then more uneven ones (Falkenauer's measure); asked for when the packing is done."""
        return len(self.bins), -sum([((self.capacity - f) / self.capacity) ** 2 for f in self.free])

    @cached_property
    def where(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out

    def assignment(self) -> np.ndarray:
        return np.array(self.where, "<i4")


def of_assignment(a: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    order = np.argsort(a, kind="stable")
    cut = np.flatnonzero(np.diff(a[order])) + 1
    return Packing([tuple(x.tolist()) for x in np.split(order, cut)] if len(a) else [], sizes, capacity)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return max(-(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))


def crossover(a: Packing, b: Packing, r: np.random.Generator) -> Packing:
    """Injects well-filled bins of ``b`` into ``a``."""
    n = len(b.bins)
    full = np.argsort(np.array(b.free), kind="stable")[: max(1, n // 2)]
    take = r.choice(full, size=max(1, int(n * r.uniform(0.01, 0.1))), replace=False) if n > 8 else full[:1]
    injected = [b.bins[k] for k in take]
    inside = {i for x in injected for i in x}
    hit = {a.where[i] for i in inside}
    displaced = [i for k in sorted(hit) for i in a.bins[k] if i not in inside]
    child = Packing([x for k, x in enumerate(a.bins) if k not in hit] + injected, a.sizes, a.capacity)
    return child.insert(child.exchange(displaced))


def mutated(a: Packing, r: np.random.Generator) -> Packing:
    """Dissolves the emptiest bins and a few others."""
    n = len(a.bins)
    gone = set(np.argsort(-np.array(a.free), kind="stable")[: max(1, n // 100)].tolist()) | set(r.integers(0, n, max(1, n // 100)).tolist())
    child = Packing([x for k, x in enumerate(a.bins) if k not in gone], a.sizes, a.capacity)
    return child.insert(child.exchange([i for k in sorted(gone) for i in a.bins[k]]))


def least_slack(sizes: list[int], capacity: int, r: np.random.Generator | None) -> Packing:
    """Bin by bin: the largest item left (with ``r``, at times another one), then the one, two or three that fill the rest best."""
    of: dict[int, list[int]] = {}
    for i in np.argsort(np.array(sizes), kind="stable").tolist():
        of.setdefault(sizes[i], []).append(i)
    have = np.zeros(capacity + 1, np.int64)
    for size, items in of.items():
        have[size] = len(items)
    #: largest size that is left, up to each size; 0 where there is none
    under = np.maximum.accumulate(np.where(have > 0, np.arange(capacity + 1), 0))
    bins = []

    def take(size: int) -> int:
        have[size] -= 1
        if not have[size]:
            stop = size + int(np.argmax(under[size:] != size)) if under[-1] != size else capacity + 1
            under[size:stop] = under[size - 1]
        return of[size].pop()

    for _ in range(len(sizes)):
        top = int(under[-1])
        if not top:
            break
        if r is not None and r.random() < 0.2:
            top = int(under[r.integers(max(1, top // 2), top + 1)]) or top
        b, room = [take(top)], capacity - top
        while room and under[room]:
            first = int(under[room])
            # pairs: each size with the largest that goes beside it
            half = np.flatnonzero(have[: room // 2 + 1])
            if first < room and len(half):
                beside = under[room - half]
                total = half + np.where((beside == half) & (have[half] < 2), 0, beside)
                k = int(np.argmax(total))
                if total[k] > first:
                    small = int(half[k])
                    b.append(take(small))
                    room -= small
                    continue
            b.append(take(first))
            room -= first
        bins.append(tuple(b))
    return Packing(bins, sizes, capacity)


def first_population(sizes: list[int], capacity: int, r: np.random.Generator) -> list[Packing]:
    """Best fit in descending and in random order, and least slack."""
    every = list(range(len(sizes)))
    out = [Packing([], sizes, capacity).insert(every), least_slack(sizes, capacity, None)]
    while len(out) < POPULATION:
        out.append(Packing([], sizes, capacity).insert(r.permutation(len(sizes)).tolist(), sort=False) if len(out) % 3 == 0 else least_slack(sizes, capacity, r))
    return out


def evolved(population: list[Packing], r: np.random.Generator, children: int = CHILDREN) -> list[Packing]:
    """The population, oldest first, after so many children; a child leaves if it's there already or worse than all."""
    bound = lower_bound(population[0].sizes, population[0].capacity) if population else 0

    def parent() -> int:
        some = r.integers(0, len(population), TOURNAMENT).tolist()
        return min(some, key=lambda k: population[k].fitness)

    for _ in range(children):
        best = min(population, key=lambda p: p.fitness)
        if best.fitness[0] <= bound:
            break
        i, j = parent(), parent()
        child = crossover(population[i], population[j], r) if i != j else mutated(population[i], r)
        if child.fitness > max(p.fitness for p in population) or any(child.fitness == p.fitness for p in population):
            continue
        population = [*population, child]
        if len(population) > POPULATION:
            middle = sorted(p.fitness for p in population)[len(population) // 2]
            population.pop(next(k for k, p in enumerate(population) if p.fitness >= middle and p is not best and p is not child))
    return population


STATE = "grp long, island int, n int, sizes binary, members array<binary>"
_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())]


def rounds(start: DataFrame, capacity: int, n_rounds: int) -> DataFrame:
    """Evolves (grp, island, n, sizes, members); each round ends with the migration of elites."""

    def evolve(k: int):
        def run(table: pa.Table) -> pa.Table:
            group, island = table.column("grp")[0].as_py(), table.column("island")[0].as_py()
            sizes = np.frombuffer(table.column("sizes")[0].as_py(), "<i4").tolist()
            # the longer list is the island's own population, oldest first; the other one is an elite that has come in
            lists = sorted(table.column("members").to_pylist(), key=lambda x: (-len(x), x))
            members = list(dict.fromkeys(x for cell in lists for x in cell))
            r = np.random.default_rng([group, island, k])
            population = [of_assignment(np.frombuffer(x, "<i4"), sizes, capacity) for x in members] or first_population(sizes, capacity, r)
            population = evolved(population, r)
            blobs = [p.assignment().tobytes() for p in population]
            elite = min(population, key=lambda p: p.fitness).assignment().tobytes()
            raw = table.column("sizes")[0].as_py()
            rows = [(group, island, len(sizes), raw, blobs), (group, (island + 1) % ISLANDS, len(sizes), raw, [elite])]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=["grp", "island", "n", "sizes", "members"])

        return run

    # a number of partitions, so that adaptive execution doesn't put all islands, which are few bytes, into one task
    n, state = partitions(start.sparkSession), start
    for k in range(n_rounds):
        last, state = state, written(state.repartition(n, "grp", "island").groupBy("grp", "island").applyInArrow(evolve(k), STATE), f"islands-{k}")
        if k:
            dropped(start.sparkSession, last)
    return state


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which must read the same each time (a written one)."""
    spark = found.sparkSession
    open_ = found.where(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // GROUP))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups)).alias("grp")
    # the packing sees sizes only, in a fixed order

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ORDER])
        sizes = table.column("length").to_numpy().astype("<i4")
        rows = [(table.column("grp")[0].as_py(), k, len(sizes), sizes.tobytes(), []) for k in range(ISLANDS)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=["grp", "island", "n", "sizes", "members"])

    dealt = open_.select(key, *open_.columns).repartition(min(groups, max(1, partitions(spark))), "grp")
    start = dealt.groupBy("grp").applyInArrow(gather, STATE)
    end = rounds(start, capacity, ROUNDS)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best packing of the group, put on its pieces."""
        table = left.sort_by([(c, "ascending") for c in ORDER])
        sizes = table.column("length").to_numpy().astype("<i4")
        best = min((of_assignment(np.frombuffer(x, "<i4"), sizes.tolist(), capacity) for cell in right.column("members").to_pylist() for x in cell), key=lambda p: (p.fitness, p.assignment().tobytes()))
        a = best.assignment()
        by = np.argsort(a, kind="stable")
        stop = np.cumsum(sizes[by].astype(np.int64))
        first = np.concatenate([[True], a[by][1:] != a[by][:-1]])
        begin = stop - sizes[by]
        offset = np.empty(len(a), np.int64)
        offset[by] = begin - np.repeat(begin[first], np.diff(np.append(np.flatnonzero(first), len(a))))
        group = table.column("grp")[0].as_py()
        return table.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array((np.int64(group) << 32) + a)).append_column("offset", pa.array(offset))

    fields = f"{PIECES}, sequence_id long, offset long"
    placed = dealt.groupBy("grp").cogroup(end.groupBy("grp")).applyInArrow(place, fields)
    full = found.where(F.col("length") >= capacity).drop("row")
    # numbers of full pieces are negative; they follow from the row's place in the written table
    full = full.select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Cuts, encodes and packs all documents."""
    small_batches(docs.sparkSession)
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity)
