"""Boosted trees over histograms, one tree for each class and round, all classes in the same pass.

Features are cut into bins once, by quantiles. A round takes the gradients of the softmax loss; each level
of its trees needs one sum, the histogram of gradients and weights by (class, node, feature, bin), and
splits every node by the best gain. Of two children only the lighter is summed, the other is the rest of
their parent. Bins and scores are left with the blocks every ``KEEP`` rounds; a block walks the trees that
came later, so a lost executor costs that and nothing else.

The trees of a round don't depend on each other. When candidates of one block are too few for all cores, a round
is one job: a task grows some classes of some candidates, and is told all trees of the rounds before.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.blocks import Block, Sums, fit_all, posteriors, to_blocks
from assay.session import write_and_read


KEEP = 20
CHUNK = 16384    # rows that walk a tree at once, so that they stay in a core's cache
FEW = 1 << 16    # cells that are counted in one call, not feature by feature
RUN = 16         # bins of a run: sums up to a bin are sums in its run and of the runs before
UP_TO = np.triu(np.ones((RUN, RUN)))
SHARED = 1 << 17  # numbers of a candidate from which a round costs more than a job's start
#: blocks that this Python worker met in the fit it is at, by (fit, candidate). What it forgot it works out anew from all trees
MET: dict[tuple[str, int], Block] = {}


@dataclass(frozen=True)
class Settings:
    rounds: int = 1200
    depth: int = 6
    rate: float = 0.02
    l2: float = 2.0
    l1: float = 1.0
    min_child: float = 2.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 255
    seed: int = 42


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers in [0, 1) of each row and round, the same wherever the row lies."""
    x = ids.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & (2 ** 64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of the bin of each value; a value equal to an edge lies below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Trees:
    """The trees of one round: node i has the children 2i + 1 (bin <= cut) and 2i + 2."""

    def __init__(self, classes: int, depth: int):
        self.feature = np.full((classes, 2 ** (depth + 1) - 1), -1, dtype=np.int16)
        self.cut = np.zeros(self.feature.shape, dtype=np.uint8)
        self.value = np.zeros(self.feature.shape, dtype=np.float64)

    def _leaf(self, c: int, node: int, columns: np.ndarray):
        """Leaf of each column of ``columns`` (feature, row) below a node: a number, or one for each. All comparisons of a tree over
        bytes that lie together cost less than each row's own way through it."""
        f = self.feature[c, node]
        kind = np.uint8 if self.feature.shape[1] <= 256 else np.int32
        if f < 0:
            return kind(node)
        right = np.negative((columns[f] > self.cut[c, node]).astype(kind))  # all bits or none
        a, b = self._leaf(c, 2 * node + 1, columns), self._leaf(c, 2 * node + 2, columns)
        right &= a ^ b
        right ^= a
        return right

    def add_to(self, score: np.ndarray, columns: np.ndarray) -> None:
        """Adds the trees' values to ``score`` (class, row) for ``columns`` (feature, row)."""
        for lo in range(0, columns.shape[1], CHUNK):
            part = columns[:, lo:lo + CHUNK]
            for c in range(len(self.feature)):
                score[c, lo:lo + CHUNK] += self.value[c].take(self._leaf(c, 0, part))


class _Rows:
    """What a block knows between sums: bins, scores by the trees seen and, for a round, gradients of live rows and the rows of each node."""

    def __init__(self, block: Block, edges: list[np.ndarray], k: int, bins: int):
        if block.state:
            self.bins, self.score, self.seen = pickle.loads(block.state)
        else:
            self.bins, self.score, self.seen = np.ascontiguousarray(binned(block.x, edges).T), np.zeros((k, len(block.y))), 0
        self.turn, self.live, self.gh, self.places = -1, None, {}, {}
        self.growing, self.rows, self.room = None, {}, np.empty(0)

    def memory(self, shape: tuple[int, ...]) -> np.ndarray:
        """What an earlier histogram had; the next one fills all of it."""
        size = int(np.prod(shape))
        if len(self.room) < size:
            self.room = np.empty(size + size // 4)
        return self.room[:size].reshape(shape)

    def catch_up(self, block: Block, trees: list[Trees], s: Settings, k: int) -> None:
        for t in trees[self.seen:]:
            t.add_to(self.score, self.bins)
        self.seen = len(trees)
        if self.turn != len(trees):
            w = block.w * (_uniform(block.id, s.seed, len(trees)) < s.rows)
            self.live = np.flatnonzero(w > 0)
            self.w, self.y = w.take(self.live), block.y.take(self.live)
            self.e = self.score.take(self.live, axis=1)
            self.e -= self.e.max(axis=0)
            np.exp(self.e, out=self.e)
            self.total = self.e.sum(axis=0)
            self.turn, self.gh, self.places = len(trees), {}, {}

    def gradients(self, c: int) -> np.ndarray:
        """Gradient and, as the imaginary part, weight of each live row, so that both are summed in one go."""
        if c not in self.gh:
            p = self.e[c] / self.total
            out = np.empty(len(p), dtype=complex)
            out.real = (p - (self.y == c)) * self.w
            out.imag = np.maximum(2 * p * (1 - p), 1e-16) * self.w
            self.gh[c] = out
        return self.gh[c]

    def column(self, f: int) -> np.ndarray:
        """Bins of the live rows."""
        if f not in self.places:
            self.places[f] = self.bins[f].take(self.live).astype(np.uint16)
        return self.places[f]

    def of(self, new: Trees, c: int, node: int) -> np.ndarray:
        """Places of the live rows of a node of the growing trees."""
        if self.growing is not new:
            self.growing, self.rows = new, {}
        if (c, node) not in self.rows:
            if node == 0:
                self.rows[c, 0] = np.arange(len(self.live))
            else:
                parent = (node - 1) // 2
                rows = self.of(new, c, parent)
                right = self.column(new.feature[c, parent]).take(rows) > new.cut[c, parent]
                self.rows[c, 2 * parent + 2] = rows.take(np.flatnonzero(right))
                self.rows[c, 2 * parent + 1] = rows.take(np.flatnonzero(~right))
        return self.rows[c, node]


class _Room:
    """Memory for the search of a node's best cut, taken once for all nodes: at these sizes new memory costs more than the sums."""

    def __init__(self, width: int, bins: int):
        self.gain, self.other, self.rest, self.spare = (np.empty((width, bins)) for _ in range(4))
        self.found = np.empty((width, bins), dtype=np.float32)
        self.fits, self.too = (np.empty((width, bins), dtype=bool) for _ in range(2))


def running(hist: np.ndarray) -> np.ndarray:
    """Sums up to each bin of a histogram (kind, feature, bin)."""
    x = np.matmul(hist.reshape(-1, RUN), UP_TO).reshape(*hist.shape[:2], -1, RUN)
    x[:, :, 1:] += np.cumsum(x[:, :, :-1, -1], axis=2)[..., None]
    return x.reshape(hist.shape)


def _threshold(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


class Boosting:
    """The learner, see ``blocks``: needs the quantile edges of each candidate."""

    def __init__(self, edges: dict[int, list[np.ndarray]], k: int, settings: Settings):
        self.edges, self.k, self.s = edges, k, settings

    def bins(self, candidate: int) -> int:
        return -(-(max((len(e) for e in self.edges[candidate]), default=0) + 1) // RUN) * RUN

    def _leaf(self, g: float, h: float) -> float:
        return -self.s.rate * _threshold(g, self.s.l1) / (h + self.s.l2)

    def _gain(self, g: np.ndarray, weight: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """The gain of sums of gradients, in ``out``, which may be ``g``; ``weight`` has the penalty."""
        np.clip(g, -self.s.l1, self.s.l1, out=spare)
        np.subtract(g, spare, out=out)
        out *= out
        out /= weight
        return out

    def _best(self, left: np.ndarray, room: _Room):
        """The best cut of a node by its running sums (kind, feature, bin): (feature, bin, sums on the left, sums on the right) or None.
        Sums are (gradients, weights); features are numbered as in the histogram."""
        s, total = self.s, left[:, 0, -1].copy()
        gain, other, rest, spare, found = room.gain, room.other, room.rest, room.spare, room.found
        penalty = max(s.l2, 1e-16)
        np.add(left[1], penalty, out=rest)
        self._gain(left[0], rest, gain, spare)
        np.greater_equal(left[1], s.min_child, out=room.fits)
        np.subtract(total[1], left[1], out=rest)
        np.greater_equal(rest, s.min_child, out=room.too)
        room.fits &= room.too
        rest += penalty
        np.subtract(total[0], left[0], out=other)
        gain += self._gain(other, rest, other, spare)
        gain -= _threshold(total[0], s.l1) ** 2 / (total[1] + penalty)
        # in single precision, so that sums in another order choose alike
        np.copyto(found, gain, casting="same_kind")
        found *= room.fits.astype(np.float32)  # no gain, no cut
        j, at = divmod(int(found.argmax()), found.shape[1])
        if not (room.fits[j, at] and gain[j, at] > 1e-9):
            return None
        here = left[:, j, at].copy()
        return j, at, here, total - here

    @staticmethod
    def _children(split: list[tuple], got: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(class, node, running sums) of what goes on, each made when it is its turn and still in a core's cache."""
        for i, (c, node, other, parent, own, rest) in enumerate(split):
            here = running(got[:, i])
            if rest:
                parent -= here
            if own:
                yield c, node, here
            if rest:
                yield c, other, parent

    def grow(self, sums: Sums, candidate: int, trees: list[Trees], classes: Iterable[int], room: _Room) -> Trees:
        """The next trees of some classes."""
        s, k, edges, bins = self.s, self.k, self.edges[candidate], self.bins(candidate)
        rng = np.random.default_rng([s.seed, len(trees)])
        drawn = drawn_of(s, len(edges))
        allowed = [np.flatnonzero(np.argsort(rng.random(len(edges))) < drawn) for _ in range(k)]
        new = Trees(k, s.depth)
        asked = [(c, 0) for c in classes]
        split: list[tuple] = []  # (class, asked child, its sibling, running sums of their parent, which of the two go on)
        for level in range(s.depth):
            got = sums(_Histogram(trees, new, asked, allowed, edges, bins, s, k)).swapaxes(2, 3)
            if level == 0:
                for i, (c, _) in enumerate(asked):
                    new.value[c, 0] = self._leaf(*got[:, i, 0].sum(axis=1))
                active = ((c, 0, running(got[:, i])) for i, (c, _) in enumerate(asked))
            else:
                active = self._children(split, got)
            split = []
            for c, node, left in active:
                cut = self._best(left, room)
                if cut is None:
                    continue
                new.feature[c, node], new.cut[c, node] = allowed[c][cut[0]], cut[1]
                pair = []
                for side, (cg, ch) in enumerate(cut[2:]):
                    child = 2 * node + 1 + side
                    new.value[c, child] = self._leaf(cg, ch)
                    pair.append((ch, child, ch >= 2 * s.min_child))  # or no split can follow
                (_, light, own), (_, heavy, rest) = sorted(pair)
                if own or rest:
                    split.append((c, light, heavy, left, own, rest))
            asked = [x[:2] for x in split]
            if not asked:
                break
        return new

    def room(self, candidate: int) -> _Room:
        return _Room(drawn_of(self.s, len(self.edges[candidate])), self.bins(candidate))

    def model(self, candidate: int, trees: list[Trees]) -> bytes:
        model = self.edges[candidate], *(np.stack([getattr(t, of) for t in trees]) for of in ("feature", "cut")), np.stack([t.value for t in trees]).astype(np.float32)
        return zlib.compress(pickle.dumps(model), 1)

    def __call__(self, sums: Sums, candidate: int) -> bytes:
        trees: list[Trees] = []
        room = self.room(candidate)
        for turn in range(self.s.rounds):
            trees.append(self.grow(sums, candidate, trees, range(self.k), room))
            if (turn + 1) % KEEP == 0:
                sums.keep(_Scores(trees, self.edges[candidate], self.bins(candidate), self.s, self.k))
        return self.model(candidate, trees)


def drawn_of(s: Settings, width: int) -> int:
    """Features that a tree may use."""
    return max(1, round(s.columns * width))


class _Pass:
    """Something that is asked of each block, with the trees so far."""

    def __init__(self, trees, edges, bins, settings, k):
        self.trees, self.edges, self.bins, self.s, self.k = trees, edges, bins, settings, k

    def rows(self, block: Block) -> _Rows:
        if block.memo is None:
            block.memo = _Rows(block, self.edges, self.k, self.bins)
        block.memo.catch_up(block, self.trees, self.s, self.k)
        return block.memo


class _Scores(_Pass):
    def __call__(self, block: Block) -> bytes:
        rows = self.rows(block)
        return pickle.dumps((rows.bins, rows.score, rows.seen))


class _Histogram(_Pass):
    """(gradients, weights) by (asked node, bin, feature drawn for the node's class). It holds until the block is asked again."""

    def __init__(self, trees, new, asked, allowed, edges, bins, settings, k):
        super().__init__(trees, edges, bins, settings, k)
        self.new, self.asked, self.allowed = new, asked, allowed

    def __call__(self, block: Block) -> np.ndarray:
        rows, bins, width = self.rows(block), self.bins, len(self.allowed[0])
        out = rows.memory((2, len(self.asked), width, bins))
        lo = 0
        while lo < len(self.asked):
            c = self.asked[lo][0]
            nodes = [node for of, node in self.asked[lo:] if of == c]
            each = [rows.of(self.new, c, node) for node in nodes]
            own = np.concatenate(each)
            at = np.repeat(np.arange(len(nodes)), [len(x) for x in each])
            v = rows.gradients(c).take(own)
            if len(own) * width <= FEW:
                cell = np.stack([rows.column(f).take(own) for f in self.allowed[c]]).astype(np.int64)
                cell += np.arange(width)[:, None] * bins
                cell += at * (width * bins)
                for kind, x in enumerate((v.real, v.imag)):
                    out[kind, lo:lo + len(nodes)] = np.bincount(cell.ravel(), np.tile(x, width), len(nodes) * width * bins).reshape(-1, width, bins)
            else:
                first = (at * bins).astype(np.uint16 if len(nodes) * bins <= 1 << 16 else np.int64)
                whole = len(own) == len(rows.live) and len(nodes) == 1
                for j, f in enumerate(self.allowed[c]):
                    cell = rows.column(f)
                    if not whole:
                        cell = cell.take(own) + first
                    total = np.zeros(len(nodes) * bins, dtype=complex)
                    np.add.at(total, cell.astype(np.int64), v)
                    total = total.reshape(-1, bins)
                    out[0, lo:lo + len(nodes), j], out[1, lo:lo + len(nodes), j] = total.real, total.imag
            lo += len(nodes)
        return out.swapaxes(2, 3)


def edges_of(rows: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """Cuts of each candidate's features: at most ``bins`` distinct quantiles, the largest value left out."""
    q = [i / bins for i in range(1, bins)]
    got = (rows.select("candidate", F.posexplode(F.col("features").cast("array<double>")).alias("j", "x")).groupBy("candidate", "j")
           .agg(F.array_distinct(F.percentile_approx("x", q, 100 * bins)).alias("e"), F.max("x").alias("top"))
           .select("candidate", "j", F.filter("e", lambda v: v < F.col("top")).alias("e")).collect())
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in got:
        out.setdefault(r["candidate"], {})[r["j"]] = np.sort(np.array(r["e"], dtype=float))
    return {c: [e[j] for j in range(len(e))] for c, e in out.items()}


def predict(model: bytes, x: np.ndarray) -> np.ndarray:
    edges, feature, cut, value = pickle.loads(zlib.decompress(model))
    columns = np.ascontiguousarray(binned(x, edges).T)
    score = np.zeros((feature.shape[1], len(x)))
    for f, c, v in zip(feature, cut, value):
        t = Trees.__new__(Trees)
        t.feature, t.cut, t.value = f, c, v
        t.add_to(score, columns)
    return softmax(score.T)


def dealt(sizes: dict[int, int], k: int, tasks: int) -> list[tuple[int, int, list[int]]]:
    """(task, candidate, classes): equal shares of the work, so that a task has few candidates."""
    whole, before, out = sum(sizes.values()) * k, 0, {}
    for candidate, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        for c in range(k):
            out.setdefault((min(tasks - 1, int((before + size / 2) * tasks / whole)), candidate), []).append(c)
            before += size
    return [(task, candidate, classes) for (task, candidate), classes in out.items()]


def met(fit: str, candidate: int, row: list[bytes], k: int) -> Block:
    """A block of (bins, y, w, id), with what this worker knows of it. Jobs take functions of modules by name, so ``MET`` stays."""
    for key in [key for key in MET if key[0] != fit]:
        del MET[key]
    if (fit, candidate) not in MET:
        y, i = (np.frombuffer(row[at], dtype=np.int64) for at in (1, 3))
        bins = np.frombuffer(row[0], dtype=np.uint8).reshape(-1, len(y))
        block = Block(bins, y, np.frombuffer(row[2]), i, pickle.dumps((bins, np.zeros((k, len(y))), 0)))
        block.memo = _Rows(block, [], k, 0)
        MET[fit, candidate] = block
    return MET[fit, candidate]


def grow_together(blocks: DataFrame, sizes: dict[int, int], learner: Boosting, tasks: int) -> dict[int, bytes]:
    """Model of each candidate of ``sizes``, which have one block each, as many numbers as the sizes say."""
    spark, s, k, fit = blocks.sparkSession, learner.s, learner.k, uuid.uuid4().hex

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins = np.ascontiguousarray(binned(Block.of(row).x, learner.edges[row["candidate"]]).T)
                yield pa.RecordBatch.from_pylist([row | {"x": bins.tobytes()}], batch.schema)

    share = spark.createDataFrame(dealt(sizes, k, tasks), "task int, candidate int, classes array<int>")
    small = write_and_read(blocks.mapInArrow(cut, blocks.schema), "blocks-binned")
    rows = small.join(F.broadcast(share), "candidate").repartitionById(tasks, F.col("task")).select("candidate", "classes", "x", "y", "w", "id").rdd
    rows = rows.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    shared = spark.sparkContext.broadcast(learner)
    told, recent = [], []  # trees by candidate of each round: KEEP rounds in a broadcast, and those since

    def turn(part: Iterable[tuple]) -> Iterator[tuple]:
        now = len(told) * KEEP + len(recent)
        for c, classes, *row in part:
            block, grower = met(fit, c, row, k), shared.value
            trees = [None] * block.memo.seen
            for t in range(len(trees), now):
                trees.append((told[t // KEEP].value[t % KEEP] if t // KEEP < len(told) else recent[t - len(told) * KEEP])[c])
            new = grower.grow(Sums(block), c, trees, classes, grower.room(c))
            yield c, classes, new.feature[classes], new.cut[classes], new.value[classes]

    models: dict[int, list[Trees]] = {c: [] for c in sizes}
    for _ in range(s.rounds):
        new = {c: Trees(k, s.depth) for c in sizes}
        for c, classes, feature, cuts, value in rows.mapPartitions(turn).collect():
            new[c].feature[classes], new[c].cut[classes], new[c].value[classes] = feature, cuts, value
        recent.append(new)
        for c in sizes:
            models[c].append(new[c])
        if len(recent) == KEEP:
            told.append(spark.sparkContext.broadcast(recent))
            recent = []
    rows.unpersist()
    for kept in told:
        kept.destroy()
    return {c: learner.model(c, trees) for c, trees in models.items()}


def fit(blocks: DataFrame, learner: Boosting) -> dict[int, bytes]:
    """Model of each candidate."""
    parts = blocks.groupBy("candidate").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("x") / 8).cast("long").alias("size")).collect()
    sizes = {r["candidate"]: r["size"] for r in parts if r["parts"] == 1}
    tasks = min(blocks.sparkSession.sparkContext.defaultParallelism, len(sizes) * learner.k)
    # whole fits in as many tasks, unless most tasks would wait for the largest
    if not sizes or max(sizes.values()) < SHARED or max(sizes.values()) * tasks < 2 * sum(sizes.values()):
        return fit_all(blocks, learner)
    models = grow_together(blocks.where(F.col("candidate").isin(*sizes)), sizes, learner, tasks)
    if len(sizes) < len(parts):
        models |= fit_all(blocks.where(~F.col("candidate").isin(*sizes)), learner)
    return models


def boosted_posteriors(train: DataFrame, evalu: DataFrame, k: int, settings: Settings = Settings(), cells: int | None = None,
                       blocks: DataFrame | None = None) -> DataFrame:
    """(candidate, path, y, p) of rows to score; ``train`` is (candidate, path, y, features, weight), ``blocks`` the same in blocks, if they
    are there. All candidates are fitted together."""
    if blocks is None:
        blocks = to_blocks(train, cells) if cells else to_blocks(train)
    return posteriors(evalu, fit(blocks, Boosting(edges_of(train, settings.bins), k, settings)), predict)
