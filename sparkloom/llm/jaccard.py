"""N-gram Jaccard join: links between documents whose sets of word shingles are similar.

Points and trees. The shingles of a set are hashed into ``GROUPS`` groups; the counts by group are a point. Two sets share
at most the sum over groups of the smaller count, and a set shares with anything below a tree node at most that sum
over the node's upper corner. A search drops nodes, and at last points, that cannot reach the threshold; whatever it
returns, and nothing else, is verified on the whole sets.

The top of the tree. Corners of coarse groups bound nothing for unrelated documents of one length, whose counts are
nearly the same, so the first levels of the tree take the finest groups there are, one for each shingle: a set goes to the
node of each of its leading shingles, which are its first ``n - ceil(s n) + SHARED`` in an order that puts frequent ones last.
Linked sets share ``SHARED`` leading shingles at least, so no link is lost under any order. Nodes with the same
smallest member are one node; below it stands an R-tree over the points of its sets. A node with too many sets that
are not linked yet is split by a second and a third leading shingle, as the pairs that link share these too; what
stays large after that is searched in blocks.

Steps: (1) equal sets become one class. (2) Classes go to their nodes. (3) Each node's tree is searched with one set, the
pivot, which settles copies of one source in one go; nodes with many sets outside their largest component are searched again
with a pivot of these while it pays, so that a large group whose members link with a part of each other takes rounds, not pairs.
(4) The trees of nodes that hold several components still are searched with every set outside the largest one.
(5) Components of all links. Of a component's pairs that their points allow, growing portions are verified until all that are
left are within components.

Defined cases: null and empty texts have the empty set and link with nothing; fewer words than a shingle make one
shingle of the whole; a very long text is one set, held whole by the tasks that verify it; repeated rows fall in one class
and each keep a result row; a null doc_id keeps its row but never names a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_name, table, trimmed, with_text
from .components import components
from .words import NONSPACE, chunks, mix, shingles, utf8, word_hashes

SHINGLE = 5
#: Threshold in hundredths: link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Groups of a point. Larger sets have a finer point too, of four times as many groups for each step that a set reaches, for
#: pairs that their trees return.
GROUPS = 256
STEPS = (1024, 4096, 16384)
#: A shingle that two sets of one window share counts as frequent. Windows hold 32-bit fingerprints of shingles.
OFTEN = 2
WINDOW_SHINGLES = 6_000_000
#: Sets that a task remembers having met; it forgets them all when there are more, which repeats rows alone.
SEEN = 200_000
#: Bound of the frequent shingles that are gathered (12 bytes each), the most frequent ones, and slots of their table (a byte each).
MOST_FREQUENT = 2_000_000
SLOT_BITS = 24
#: Shingles of this rank (the bits of a count) or more go by the way for crowded nodes.
CROWDED = 6
#: How many leading shingles a linked pair must share; as many more shingles lead, so none is lost. Also the levels of nodes.
SHARED = 3
#: Sets of a node that one search task holds; with more sets that ask than this many times as many, a node is split, so
#: that a set is dealt to no more than so many tasks on average. Sets that one verification task compares with another.
BLOCK = 512
SPLIT = 8
VERIFIED_AT_ONCE = 64
#: Rounds of searching with pivots at most. After the first, a node takes part while more sets than this are outside its
#: largest component and while a round leaves no more than a share of them.
ROUNDS = 3
PAIRS_A_SET = 1024
PAYS = 0.8
#: About so many pairs of a component are verified at first, as one link joins it, and so many times as many each time after that.
PORTION = 4
LARGER = 16
#: The texts of nodes that go on are kept for these rounds if they are so small a part of all sets.
KEPT_PART = 8
#: Children of a tree node, rows that a task searches at once, and tree nodes that are compared at once.
LEAF = 16
SEARCHED_ROWS = 20_000
COMPARED = 40_000
#: Wanted sets (16 bytes each) that are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def set_ids(sets: list[np.ndarray]) -> list[int]:
    """64-bit ids of sets, the same for equal sets in any order."""
    n = np.array([len(s) for s in sets], np.uint64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
        end = np.cumsum(n).astype(np.int64)
        return mix(total[end] - total[end - n.astype(np.int64)] + n).view(np.int64).tolist()


def set_id(hashes: np.ndarray) -> int:
    return set_ids([hashes])[0]


def points(hashes: np.ndarray, g: int = GROUPS) -> np.ndarray:
    """Counts by group; a group is a hash's leading bits."""
    return np.bincount((hashes >> np.uint64(64 - (g.bit_length() - 1))).astype(np.int64), minlength=g)


def packed(point: np.ndarray) -> bytes:
    """A point as 8-bit counts, or 32-bit ones where a count needs them; the length tells which."""
    return point.astype("<u1" if point.max() < 256 else "<u4").tobytes()


def unpacked(raw: list[bytes], g: int = GROUPS) -> np.ndarray:
    """Points of g groups as rows."""
    if all(len(x) == g for x in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, g)
    return np.stack([np.frombuffer(x, "<u1" if len(x) == g else "<u4").astype(np.uint32) for x in raw])


def groups(n: int) -> int:
    return GROUPS << 2 * sum(n >= step for step in STEPS)


def most_shared(p: bytes, n_p: int, q: bytes, n_q: int) -> int:
    """What two sets share at most by their finer points, in the finest groups both have (which nest in coarser ones)."""
    g, h = groups(n_p), groups(n_q)
    a, b = (unpacked([x], k)[0].astype(np.int64).reshape(min(g, h), -1).sum(1) for x, k in ((p, g), (q, h)))
    return int(np.minimum(a, b).sum())


def least_shared(threshold: int = THRESHOLD) -> int:
    """What two different sets that link share at least: 100 s >= threshold (s + 1). The smaller of them may be no more than that."""
    return -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 62


def leading(n: int, threshold: int = THRESHOLD) -> int:
    """How many shingles of a set of n, first in the order, must hold ``shared`` of any similar set's."""
    least = -(-threshold * n // 100)
    return n - least + min(SHARED, least)


def _sets(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for i, j in chunks(offsets):
            h, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NONSPACE)
            yield batch, i, shingles(h, first, size)


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """kind 0: doc_id, set id, set size, point, finer point (of larger sets) and text's hash of every row. kind 1: fingerprint of a shingle often seen in a window, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        window: list[np.ndarray] = []
        held = 0

        def often() -> pa.RecordBatch:
            marks = np.concatenate(window)
            window.clear()
            marks.sort()
            head = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
            count = np.diff(np.append(head, len(marks)))
            value, count = marks[head[count >= OFTEN]], count[count >= OFTEN]
            none = pa.nulls(len(value), pa.binary())
            return _rows(np.ones(len(value), np.int32), pa.nulls(len(value), pa.int64()), value.astype(np.int64), count, none, none, pa.nulls(len(value), pa.int64()))

        for batch, i, sets in _sets(batches, size):
            ids = set_ids(sets)
            point = pa.array([packed(points(s)) for s in sets], pa.binary())
            fine = pa.array([packed(points(s, groups(len(s)))) if len(s) >= STEPS[0] else None for s in sets], pa.binary())
            yield _rows(np.zeros(len(sets), np.int32), batch.column(0).slice(i, len(sets)), np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64), point, fine, batch.column(2).slice(i, len(sets)))
            for x, s in zip(ids, sets, strict=True):
                if x not in seen and len(s):
                    seen.add(x)
                    window.append(fingerprints(s))
                    held += len(s)
            if held >= WINDOW_SHINGLES:
                yield often()
                held = 0
                if len(seen) > SEEN:
                    seen.clear()
        if window:
            yield often()

    return with_text(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(trimmed(run), "kind int, doc_id long, id long, n long, point binary, fine binary, mark long")


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _rows(kind, doc, value, n, point, fine, mark) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), doc, pa.array(value, pa.int64()), pa.array(n, pa.int64()), point, fine, mark], names=["kind", "doc_id", "id", "n", "point", "fine", "mark"])


def frequency_ranks(rows: DataFrame, most: int | None = None) -> np.ndarray:
    """A table of ``2**SLOT_BITS`` ranks by a shingle's leading bits: 0, or the bits of the count of a frequent shingle there.

    Whole ranks are gathered from the top down, as far as ``most`` shingles go.
    """
    counts = rows.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = cut(counts.select("id", F.ceil(F.log2(F.col("n") + 1)).cast("int").alias("rank")))
    least, total = 64, 0
    for rank, n in sorted((tuple(r) for r in ranked.groupBy("rank").count().collect()), reverse=True):
        total += n
        if total > (most or MOST_FREQUENT):
            break
        least = rank
    top = ranked.where(F.col("rank") >= least).toArrow()
    ranks = np.zeros(1 << SLOT_BITS, np.uint8)
    np.maximum.at(ranks, top.column("id").to_numpy() >> (32 - SLOT_BITS), top.column("rank").to_numpy().astype(np.uint8))
    return ranks


def in_order(hashes: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k shingles of a sorted set by rank and hash, and their ranks."""
    rank = ranks[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    rare = np.flatnonzero(rank == 0)
    if len(rare) >= k:
        return hashes[rare[:k]], np.zeros(k, np.uint8)
    order = np.argsort(rank, kind="stable")[:k]
    return hashes[order], rank[order]


def meetings(docs: DataFrame, ranks: np.ndarray, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """sig, sid, crowded: the leading shingles of each different set that can link, once for each task that sees it."""
    spread = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, seen, least = spread.value, set(), least_shared(threshold)
        for _, _, sets in _sets(batches, size):
            sig, sid, rank = [], [], []
            for x, s in zip(set_ids(sets), sets, strict=True):
                if len(s) < least or x in seen:
                    continue
                seen.add(x)
                first, r = in_order(s, table_, leading(len(s), threshold))
                sig.append(first)
                sid.append(np.full(len(first), x, np.int64))
                rank.append(r)
            if sid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(sid)), pa.array(np.concatenate(rank) >= CROWDED)], names=["sig", "sid", "crowded"])
            if len(seen) > SEEN:
                seen.clear()

    return with_text(docs).mapInArrow(trimmed(run), "sig long, sid long, crowded boolean")


def fits_broadcast(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def companions(met: DataFrame) -> DataFrame:
    """sig, sid and pivot (the smallest sid) of the nodes of two different sets or more.

    The texts behind ``met`` are read and hashed once. A crowded shingle can hold a large part of all sets: its members are
    dealt by set as well, so never by shingle while the pivots of such nodes, which come from a partial aggregate, fit a
    broadcast. All others are dealt by shingle.
    """
    node = Window.partitionBy("sig", F.when(F.col("crowded"), F.col("sid")))
    dealt = met.select("sig", "sid", "crowded", F.min("sid").over(node).alias("pivot"), F.max("sid").over(node).alias("top"))
    dealt = cut(dealt.where("crowded OR pivot <> top").select("sig", "sid", "crowded", "pivot"))
    crowd = dealt.where("crowded").select("sig", "sid")
    by_sig = crowd.groupBy("sig").agg(F.min("sid").alias("pivot"), F.max("sid").alias("top"))
    pivots = cut(by_sig.where("pivot <> top").select("sig", "pivot"))
    crowd = crowd.join(F.broadcast(pivots) if fits_broadcast(pivots) else pivots, "sig").select("sig", "sid", "pivot").distinct()
    return dealt.where("NOT crowded").select("sig", "sid", "pivot").unionByName(crowd)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """task, hub, sid and hashes of the wanted sets (doc_id, mark, sid, task, hub), from their documents' texts.

    Up to ``BROADCAST_ROWS`` wanted rows are broadcast to the texts; more are joined by shuffle. A task that reads
    a wanted text again emits it once.
    """
    texts = with_text(docs).withColumn("mark", F.xxhash64("text"))
    named = wanted.select(F.col("doc_id").alias("of"), F.col("mark").alias("with"), "sid", "task", "hub")
    joined = texts.join(F.broadcast(named) if fits_broadcast(wanted) else named, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("with"))).select("sid", "text", "task", "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch, i, sets in _sets(batches, size):
            ids, tasks, hubs = (batch.column(c).slice(i, len(sets)).to_pylist() for c in (0, 2, 3))
            own = []
            for x, t, hub, s, found in zip(ids, tasks, hubs, sets, set_ids(sets), strict=True):
                if (x, t) not in seen and found == x:
                    seen.add((x, t))
                    own.append((x, t, hub, np.sort(s.view(np.int64))))
            if len(seen) > SEEN:
                seen.clear()
            off = np.concatenate([[0], np.cumsum([len(s) for *_, s in own])]).astype(np.int32)
            flat = np.concatenate([s for *_, s in own]) if own else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([t for _, t, *_ in own], pa.int64()), pa.array([h for _, _, h, _ in own], pa.bool_()), pa.array([x for x, *_ in own], pa.int64()), lists], names=["task", "hub", "sid", "hashes"])

    return joined.mapInArrow(trimmed(run), "task long, hub boolean, sid long, hashes array<long>")


def reaches(shared, n_a, n_b, threshold: int = THRESHOLD):
    """Whether sets of n_a and n_b with so many shared shingles link (100 * shared >= threshold * union)."""
    return shared * (100 + threshold) >= (n_a + n_b) * threshold


class Forest:
    """R-trees over the points of many nodes at once. Rows of a node stand together; a node's root has the node's number in the top level."""

    def __init__(self, node: np.ndarray, point: np.ndarray, size: np.ndarray, leaf: int = LEAF):
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        self.order = np.arange(len(node))
        for a, b in zip(head.tolist(), np.append(head[1:], len(node)).tolist(), strict=True):
            if b - a > leaf:
                rows = np.arange(a, b)
                self.order[a:b] = self._tiled(point, rows[np.argsort(size[a:b], kind="stable")], leaf)
        self.point, self.size = point[self.order], size[self.order]
        #: corner, smallest and largest size, first child and one past the last, from the leaves up
        self.levels: list[tuple[np.ndarray, ...]] = []
        corner, low, high = self.point, self.size, self.size
        while len(head) and (not self.levels or len(corner) > len(head)):
            run = np.diff(np.append(head, len(corner)))
            count = -(-run // leaf)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(head, count) + leaf * place
            last = np.minimum(first + leaf, np.repeat(head + run, count))
            corner, low, high = np.maximum.reduceat(corner, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.levels.append((corner, low, high, first, last))
            head = np.cumsum(count) - count

    @staticmethod
    def _tiled(point: np.ndarray, rows: np.ndarray, leaf: int) -> np.ndarray:
        """Rows in the order of the leaves: halves along the widest group, again and again."""
        if len(rows) <= leaf:
            return rows
        widest = int(np.argmax(point[rows].max(0) - point[rows].min(0)))
        rows = rows[np.argsort(point[rows, widest], kind="stable")]
        half = -(-len(rows) // (2 * leaf)) * leaf
        if half >= len(rows):
            return rows
        return np.concatenate([Forest._tiled(point, rows[:half], leaf), Forest._tiled(point, rows[half:], leaf)])

    def search(self, node: np.ndarray, point: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries on nodes' trees: (query, row) wherever the minima of their counts allow a link."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(len(self.levels) - 1, np.arange(len(node)), node)] if len(node) else []
        while todo:
            level, q, at = todo.pop()
            if len(q) > COMPARED:
                todo += [(level, q[i : i + COMPARED], at[i : i + COMPARED]) for i in range(0, len(q), COMPARED)]
                continue
            corner, low, high = self.levels[level][:3] if level >= 0 else (self.point, self.size, self.size)
            most = np.minimum(np.minimum(corner[at], point[q]).sum(1, dtype=np.int64), np.minimum(high[at], size[q]))
            # of the sizes below a node, the smallest is the easiest to link with
            ok = reaches(most, size[q], low[at], threshold)
            q, at = q[ok], at[ok]
            if level < 0:
                found.append((q, self.order[at]))
            elif len(q):
                first, last = self.levels[level][3][at], self.levels[level][4][at]
                count = last - first
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                todo.append((level - 1, np.repeat(q, count), np.repeat(first, count) + step))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])


def _whole_tasks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole tasks, of about so many rows, from batches sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows and batch.column(0)[0].as_py() != batch.column(0)[-1].as_py():
            last = int(np.searchsorted(task := batch.column(0).to_numpy(), task[-1], side="left"))
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _searched(threshold: int):
    """Of partitions sorted by task: a task's held sets make a tree, which is searched with the sets that ask; other components' alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tasks(batches, SEARCHED_ROWS):
            task, sid, comp, n = (t.column(c).to_numpy() for c in ("task", "sid", "comp", "n"))
            asks, held = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "held"))
            point = unpacked(t.column("point").to_pylist())
            of = np.flatnonzero(held)
            trees, at = np.unique(task[of], return_index=True)
            forest = Forest(task[of], point[of], n[of])
            query = np.flatnonzero(asks & np.isin(task, trees))
            q, r = forest.search(np.searchsorted(trees, task[query]), point[query], n[query], threshold)
            q, r = query[q], of[r]
            # of two sets that ask each other, the first asks
            keep = (comp[q] != comp[r]) & ((sid[q] < sid[r]) | ~asks[r])
            q, r = q[keep], r[keep]
            large = (n[q] >= STEPS[0]) & (n[r] >= STEPS[0])
            yield pa.RecordBatch.from_arrays([pa.array(sid[q]), pa.array(sid[r]), pa.array(large)], names=["hub", "sid", "large"])

    return run


def searched(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (hub, sid) that the trees of rows (task, asks, held, sid, comp) return, and that their finer points allow if both have one."""
    dealt = rows.join(classes.select("sid", "n", "point"), "sid").select("task", "asks", "held", "sid", "comp", "n", "point")
    pairs = cut(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(trimmed(_searched(threshold)), "hub long, sid long, large boolean").distinct())
    fine = classes.where("fine IS NOT NULL")
    both = pairs.where("large").join(fine.select(F.col("sid").alias("hub"), F.col("n").alias("n_hub"), F.col("fine").alias("hub_fine")), "hub").join(fine.select("sid", "n", "fine"), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [bool(reaches(most_shared(p, a, q, b), a, b, threshold)) for p, a, q, b in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["hub", "sid"]).filter(pa.array(ok, pa.bool_()))

    finer = both.select("hub", "sid", "hub_fine", "n_hub", "fine", "n").mapInArrow(trimmed(run), "hub long, sid long")
    return pairs.where("NOT large").select("hub", "sid").unionByName(finer)


def _links(threshold: int):
    """Of partitions sorted by task, its hub first: the sets that link with the hub. Only the hub is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, name, own = None, 0, np.zeros(0, np.int64)
        for batch in batches:
            hashes = batch.column(3)
            begin = hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy()
            a, b = [], []
            for i, (task, hub, sid) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                s = flat[begin[i] : begin[i + 1]]
                if hub:
                    of, name, own = task, sid, s
                elif task == of:
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    if reaches(int((own[at] == s).sum()), len(own), len(s), threshold):
                        a.append(name)
                        b.append(sid)
            own = own.copy()  # not the whole batch
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) among pairs (hub, sid). A task compares one hub with up to about ``VERIFIED_AT_ONCE`` sets, however many the hub has."""
    pairs = cut(pairs)
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / VERIFIED_AT_ONCE).alias("tasks"))
    task = F.xxhash64("hub", F.pmod(F.xxhash64("sid"), F.col("tasks")))
    # the hub's other sets are dealt over its tasks
    tasked = cut(pairs.join(F.broadcast(many) if fits_broadcast(many) else many, "hub").select("hub", "sid", task.alias("task")))
    need = tasked.select("task", "sid", F.lit(False).alias("hub")).unionByName(tasked.select("task", F.col("hub").alias("sid"), F.lit(True).alias("hub")).distinct())
    wanted = cut(need.join(classes.select("sid", "doc_id", "mark"), "sid").select("doc_id", "mark", "sid", "task", "hub"))
    rows = whole_sets(docs, wanted, size).repartition("task").sortWithinPartitions("task", F.desc("hub"))
    return rows.mapInArrow(trimmed(_links(threshold)), "a long, b long")


def open_nodes(nodes: DataFrame, label: DataFrame | None, salt: int) -> tuple[DataFrame, DataFrame]:
    """Of the nodes (key, sid) that hold several components: key, sid, comp; and key, main (the largest component), total, probes (sets outside of it) and a pivot among these."""
    named = nodes.select("key", "sid", F.col("sid").alias("comp"))
    if label is not None:
        named = cut(nodes.join(label.select(F.col("vertex").alias("sid"), "component"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp")))
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64(F.lit(salt), "sid").alias("r"), "sid"))["sid"].alias("one"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("top.comp").alias("main"), "total", (F.col("total") - F.col("top.n")).alias("probes"))
    pivots = parts.join(keys.select("key", "main"), "key").where("comp <> main").groupBy("key").agg(F.max(F.struct("n", F.xxhash64(F.lit(salt), "comp").alias("r"), "comp", "one")).alias("p")).select("key", F.col("p.one").alias("pivot"), F.col("p.comp").alias("pivot_comp"))
    return named, cut(keys.join(pivots, "key"))


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def pivot_rows(named: DataFrame, keys: DataFrame) -> DataFrame:
    """Search rows: each open node's pivot asks its tree, in tasks of ``BLOCK`` sets."""
    blocks = F.ceil(F.col("total") / BLOCK)
    task = lambda i: F.xxhash64("key", i).alias("task")
    held = named.join(keys, "key").where("comp <> pivot_comp").select(task(F.pmod(F.xxhash64("sid"), blocks)), F.lit(False).alias("asks"), F.lit(True).alias("held"), "sid", "comp")
    asks = keys.select("key", "pivot", "pivot_comp", F.explode(_upto(blocks)).alias("i")).select(task(F.col("i")), F.lit(True).alias("asks"), F.lit(False).alias("held"), F.col("pivot").alias("sid"), F.col("pivot_comp").alias("comp"))
    return held.unionByName(asks)


def _block_rows(named: DataFrame, keys: DataFrame) -> DataFrame:
    """Search rows: all sets outside a node's largest component ask its tree, which is held in tasks of ``BLOCK`` sets."""
    blocks = F.ceil(F.col("total") / BLOCK)
    rows = named.join(keys.select("key", "main", "total"), "key").withColumns({"asks": F.col("comp") != F.col("main"), "own": F.pmod(F.xxhash64("sid"), blocks), "blocks": blocks})
    spread = F.when(F.col("asks"), _upto(F.col("blocks"))).otherwise(F.array("own"))
    return rows.select("key", "sid", "comp", "asks", "own", F.explode(spread).alias("i")).select(F.xxhash64("key", "i").alias("task"), "asks", (F.col("own") == F.col("i")).alias("held"), "sid", "comp")


def probe_rows(members: DataFrame, nodes: DataFrame, label: DataFrame | None, threshold: int, opened: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Search rows of all open nodes (``opened`` are these, if they are known). Those with more than ``SPLIT * BLOCK`` sets that ask are split by one, two and three leading shingles."""
    levels, rows = min(SHARED, least_shared(threshold)), None
    deep = nodes.select("key", "sid", F.array().cast("array<long>").alias("path"))
    shingles_ = members.select("sid", "sig").distinct()
    for level in range(levels + 1):
        named, keys = opened if opened and not level else open_nodes(deep.select("key", "sid").distinct(), label, 0)
        crowded = F.col("probes") > SPLIT * BLOCK if level < levels else F.lit(False)
        found = _block_rows(named, keys.where(~crowded))
        rows = found if rows is None else rows.unionByName(found)
        hot = cut(keys.where(crowded).select("key"))
        if hot.isEmpty():
            break
        below = deep.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "key").select("sid", "path").distinct()
        path = F.array_sort(F.concat("path", F.array("sig")))
        deep = below.join(shingles_, "sid").where(~F.array_contains("path", F.col("sig"))).select("sid", path.alias("path")).distinct()
        # shingles of one set alone go at once
        several = deep.groupBy("path").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("path")
        deep = cut(deep.join(several, "path").select(F.xxhash64("path").alias("key"), "sid", "path"))
    return rows


def class_links(docs: DataFrame, members: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame | None:
    """vertex and component of the classes that link, from searches of the nodes' trees; None if there are no nodes."""
    nodes = cut(members.select(F.col("pivot").alias("key"), "sid").distinct())
    links = label = None

    def joined(rows: DataFrame, texts: DataFrame, whole: bool) -> None:
        """Links of the pairs found in rows; unless ``whole``, of the first portion alone, as the last search finds the others again."""
        nonlocal links, label
        left, portion = searched(rows, classes, threshold), PORTION
        while left is not None and (whole or portion == PORTION):
            known = label is not None
            pairs, left = portioned(left, label, portion)
            if known and pairs.isEmpty():
                break
            new = cut(verified(pairs, texts, classes, size, threshold))
            if links is None or not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                label = cut(components(links))
            portion *= LARGER

    now, texts, opened = nodes, docs, open_nodes(nodes, None, 0)
    if opened[1].isEmpty():
        return label
    keys = opened[1]
    for salt in range(1, ROUNDS + 1):
        joined(pivot_rows(opened[0], keys), texts, False)
        were = keys.select("key", F.col("probes").alias("were"))
        opened = open_nodes(now, label, salt)
        paid = (F.col("probes") <= F.col("were") * PAYS) if salt > 1 else F.lit(True)
        keys = cut(opened[1].join(were, "key").where((F.col("probes") > PAIRS_A_SET) & paid).drop("were"))
        if keys.isEmpty():
            break
        now = cut(now.join(keys.select("key"), "key"))
        if salt == 1:
            texts = texts_of(docs, now, classes)
    if now is not nodes:
        opened = open_nodes(nodes, label, ROUNDS + 1)
    joined(probe_rows(members, nodes, label, threshold, opened), docs, True)
    return label


def portioned(pairs: DataFrame, label: DataFrame | None, portion: int) -> tuple[DataFrame, DataFrame | None]:
    """Of the pairs (hub, sid) between different components about ``portion`` for each component, and the others; all and None if the others are no more."""
    if label is None:
        return pairs, None
    for side in ("hub", "sid"):
        pairs = pairs.join(label.select(F.col("vertex").alias(side), F.col("component").alias(f"of_{side}")), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    pairs = cut(pairs.where("of_hub <> of_sid").select("hub", "sid", "of_hub", "of_sid"))
    many = pairs.select(F.col("of_hub").alias("of")).unionByName(pairs.select(F.col("of_sid").alias("of"))).groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    many = cut(many.where(F.col("n") > portion))
    if many.isEmpty():
        return pairs.select("hub", "sid"), None
    counted = pairs
    for side in ("hub", "sid"):
        own = many.select(F.col("of").alias(f"of_{side}"), F.col("n").alias(f"n_{side}"))
        counted = counted.join(own, f"of_{side}", "left").withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(portion)))
    # another draw for each portion, as those that were not drawn before have other places among so many
    chosen = F.pmod(F.xxhash64(F.lit(portion), "hub", "sid"), F.least("n_hub", "n_sid")) < portion
    drawn = cut(counted.select("hub", "sid", chosen.alias("now")))
    if 2 * drawn.where("now").count() >= drawn.count():
        return drawn.select("hub", "sid"), None
    return drawn.where("now").select("hub", "sid"), drawn.where("NOT now").select("hub", "sid")


def texts_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and text of one document for each set of the nodes, or all documents where these sets are not few."""
    sets = nodes.select("sid").distinct()
    wanted = cut(sets.join(classes.select("sid", "doc_id", "mark"), "sid").select(F.col("doc_id").alias("of"), F.col("mark").alias("with")))
    if wanted.count() * KEPT_PART > classes.count():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("with"))
    return cut(with_text(docs).join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, same, "left_semi"))


def marked_components(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, mark (the text's hash), n_shingles, set_id, component and component_id of every row.

    The component is a set's id, so that it is there without any doc_id; it is null for the empty set.
    """
    rows = cut(shingle_sets(docs, size))
    own = rows.where("kind = 0").select("doc_id", F.col("id").alias("sid"), F.col("n").alias("n_shingles"), "mark")
    members = cut(companions(meetings(docs, frequency_ranks(rows), size, threshold)))
    # a row without doc_id stands for a set only where no other does
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("one")
    classes = rows.where("kind = 0 AND n > 0").groupBy(F.col("id").alias("sid")).agg(one, *[F.first(c).alias(c) for c in ("n", "point", "fine")])
    classes = cut(classes.select("sid", "one.doc_id", "one.mark", "n", "point", "fine"))
    label = class_links(docs, members, classes, size, threshold)
    named = classes.select("sid", "doc_id", F.col("sid").alias("component"))
    if label is not None:
        named = classes.select("sid", "doc_id").join(label.withColumnRenamed("vertex", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("component", "sid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(smallest, "component").select("sid", "component", "component_id")
    found = own.where("n_shingles > 0").join(by_set, "sid", "left").select("doc_id", "mark", "n_shingles", F.col("sid").alias("set_id"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = own.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("sid").alias("set_id"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, set_id and component_id of every row."""
    return marked_components(docs, size, threshold).select("doc_id", "n_shingles", "set_id", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, all columns as they are: the one with the smallest doc_id, set id and text's hash.

    Rows without a doc_id come last in a component, and stay if they are alone in it. Rows of the empty set link with
    nothing and all stay, but for repeats of a doc_id and text.
    """
    rows = marked_components(docs, size, threshold).groupBy("component", "set_id", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_id", "mark", "n")).alias("r")
    chosen = rows.where("component IS NOT NULL").groupBy("component").agg(first).select("r.doc_id", "r.mark", "r.n")
    chosen = chosen.unionByName(rows.where("component IS NULL").select("doc_id", "mark", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("n")).alias("n")))
    names = [free_name(docs.columns, f"kept_{c}") for c in ("id", "mark", "n")]
    keep = cut(chosen.toDF(*names))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(names[1]))
    single = docs.join(keep.where(F.col(names[2]) == 1), same, "left_semi").select(docs.columns)
    again = docs.join(keep.where(F.col(names[2]) > 1), same).groupBy(*names[:2]).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("r"))
    return single.unionByName(again.select("r.*").select(docs.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(texts: list[tuple[int, str | None]], size: int = SHINGLE, threshold: int = THRESHOLD) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component) by comparing all pairs (for tests)."""
    import re

    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}
