"""Ranked lexical search with a K2-treap over the grid of terms and documents.

The grid of a shard has a row for each term and a column for each document, in the order of their ids; a
cell holds the impact of the term in the document. A quadtree halves rows and columns at once. Empty cells
are left out and a cell with one posting isn't cut further, so nodes are four child bits (children follow
in breadth-first order, found by counting bits), the largest impact inside, and for single postings their
row and column. An item descends along the rows of all its terms together: a range of documents has the
bound sum of weight * largest impact, the best ranges are opened first, and ranges whose bound can't enter
the item's best k are dropped.

Shards are built and searched where the documents lie; documents aren't shuffled and no index is stored.
One pass counts documents, words and the documents of each item term, the next builds the shards with the
rows that the items ask for. Items come in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.words import ALNUM, U64, Words, slices
from assay.session import write_and_read

#: words of the items of one block, or one item; and items
ITEM_WORDS, ITEMS = 100_000, 1024
#: postings and documents of one shard
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 15
#: ranges that an item opens at once
OPEN = 256
POP = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


class Terms:
    """Distinct terms of a block of items, found in texts by hash and compared by bytes."""

    def __init__(self, names: list[bytes]):
        w = Words(names, ALNUM)
        assert len(w.start) == len(names)
        h = w.hashes()
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]
        self.start, self.size = w.start[self.order], (w.end - w.start)[self.order]
        self.buf = w.buf
        self.names = len(names)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, term) of all words of ``w`` that are terms."""
        h = w.hashes()
        none = np.zeros(0, dtype=np.int64)
        if not len(h) or not self.names:
            return none, none
        words, terms = [], []
        at = np.searchsorted(self.hash, h)
        for step in range(int(np.unique(self.hash, return_counts=True)[1].max())):  # 1, unless two terms share a hash
            i = np.minimum(at + step, len(self.hash) - 1)
            hit = np.flatnonzero((self.hash[i] == h) & (self.size[i] == w.end - w.start) & (at + step < len(self.hash)))
            i = i[hit]
            size = self.size[i]
            ramp = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            unlike = w.buf[np.repeat(w.start[hit], size) + ramp] != self.buf[np.repeat(self.start[i], size) + ramp]
            same = np.ones(len(hit), dtype=bool)
            if unlike.any():
                same[np.repeat(np.arange(len(hit)), size)[unlike]] = False
            words.append(hit[same])
            terms.append(self.order[i[same]])
        return np.concatenate(words), np.concatenate(terms)


def postings(texts: list[bytes | None], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text), and (text, term, occurrences) of the postings."""
    w = Words(texts, ALNUM, lower=True)
    at, term = terms.occurrences(w)
    doc = np.searchsorted(w.first, at, side="right") - 1
    pair, n = np.unique(doc * max(1, terms.names) + term, return_counts=True)
    return np.diff(w.first), pair // max(1, terms.names), pair % max(1, terms.names), n


def _spread_bits(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U64(shift))) & U64(mask)
    return x


class Treap:
    """Compressed quadtree over postings (row, column, impact) with the largest impact of each cell.

    Rows are renumbered by falling number of postings, so that frequent terms share cells.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, rows: int, columns: int):
        count = np.bincount(row, minlength=rows)
        self.row_of = np.empty(rows, dtype=np.int64)
        self.row_of[np.argsort(-count, kind="stable")] = np.arange(rows)
        self.present = count > 0
        self.depth = max(1, (max(rows, columns, 2) - 1).bit_length())
        row = self.row_of[row]
        code = (_spread_bits(row) << U64(1)) | _spread_bits(column)
        order = np.argsort(code, kind="stable")
        code, row, column, impact = code[order], row[order], column[order], impact[order]
        bits, most, leaf_row, leaf_column = [], [], [], []
        lo, hi = np.array([0]), np.array([len(code)])
        inside, new = np.arange(len(code)), np.array([0])  # postings of this level's nodes, and where each node begins
        for level in range(self.depth + 1):
            most.append(np.maximum.reduceat(impact[inside], new))
            single = hi - lo == 1
            leaf_row.append(row[lo[single]])
            leaf_column.append(column[lo[single]])
            node = np.zeros(len(lo), dtype=np.uint8)
            parents = np.flatnonzero(~single)
            if len(parents):
                inside = np.arange((hi - lo)[parents].sum())
                size = (hi - lo)[parents]
                inside += np.repeat(lo[parents] - (np.cumsum(size) - size), size)
                parent = np.repeat(parents, size)
                part = code[inside] >> U64(2 * (self.depth - 1 - level))
                new = np.flatnonzero((np.diff(parent, prepend=-1) != 0) | (np.diff(part, prepend=~part[:1]) != 0))
                np.bitwise_or.at(node, parent[new], (1 << (part[new] & U64(3)).astype(np.uint8)).astype(np.uint8))
                lo, hi = inside[new], inside[np.append(new[1:], len(inside)) - 1] + 1
            bits.append(node)
            if not len(parents):
                break
        # the last node is the empty cell
        self.bits = np.append(np.concatenate(bits), np.uint8(0))
        self.most = np.append(np.concatenate(most), 0)
        children = POP[self.bits]
        self.first = 1 + np.cumsum(children) - children
        self.leaf = np.cumsum(self.bits == 0) - 1
        self.leaf_row = np.append(np.concatenate(leaf_row), -1)
        self.leaf_column = np.append(np.concatenate(leaf_column), -1)
        self.empty = len(self.bits) - 1

    def children(self, node: np.ndarray, level: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the left and right half of the documents, along the given rows; all (ranges, rows)."""
        shift = (self.depth - 1 - level)[:, None]
        bits, quarter = self.bits[node].astype(np.int64), ((rows[None, :] >> shift) & 1) << 1
        single = bits == 0
        mine = single & (self.leaf_row[self.leaf[node]] == rows[None, :])
        side = (self.leaf_column[self.leaf[node]] >> shift) & 1
        first = self.first[node]
        out = []
        for half in (0, 1):
            q = quarter | half
            inner = np.where((bits >> q) & 1 == 1, first + POP[bits & ((1 << q) - 1)], self.empty)
            got = np.where(single, np.where(mine & (side == half), node, self.empty), inner)
            # a single posting of another row bounds nothing
            alien = (self.bits[got] == 0) & (self.leaf_row[self.leaf[got]] != rows[None, :])
            out.append(np.where(alien, self.empty, got))
        return out[0], out[1]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the ``k`` columns of highest score of at least ``least``, ties to the smaller column."""
        here = self.present[terms]
        rows, weights = self.row_of[terms[here]], weights[here]
        found: list[tuple[int, int]] = []  # heap of (score, -column)
        if not len(rows):
            return found
        node = np.where((self.bits[0] == 0) & (self.leaf_row[0] != rows), self.empty, 0)[None, :]
        bound, level, start = self.most[node] @ weights, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(bound):
            edge = (found[0][0], -found[0][1]) if len(found) == k else (least, self.empty)
            ok = (bound > edge[0]) | ((bound == edge[0]) & (start <= edge[1]))
            bound, level, start, node = bound[ok], level[ok], start[ok], node[ok]
            if not len(bound):
                break
            if len(bound) > OPEN:
                part = np.argpartition(-bound, OPEN)
                take, rest = part[:OPEN], part[OPEN:]
            else:
                take, rest = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            left, right = self.children(node[take], level[take], rows)
            half = np.int64(1) << (self.depth - 1 - level[take])
            new = np.concatenate([left, right])
            at, deep = np.concatenate([start[take], start[take] + half]), np.concatenate([level[take], level[take]]) + 1
            value = self.most[new] @ weights
            done = deep == self.depth
            for s, c in sorted(zip(value[done].tolist(), at[done].tolist()), key=lambda x: (-x[0], x[1])):
                if s < least:
                    break
                if len(found) < k:
                    heapq.heappush(found, (s, -c))
                elif (s, -c) > found[0]:
                    heapq.heapreplace(found, (s, -c))
                else:
                    break
            go = ~done & (value >= max(least, 1))
            bound, level = np.concatenate([bound[rest], value[go]]), np.concatenate([level[rest], deep[go]])
            start, node = np.concatenate([start[rest], at[go]]), np.concatenate([node[rest], new[go]])
        return [(s, -c) for s, c in sorted(found, key=lambda x: (-x[0], -x[1]))]


class Items:
    """A block of items: their distinct terms and, for each item, terms with repeats."""

    def __init__(self, texts: list[bytes | None]):
        w = Words(texts, ALNUM, lower=True)
        number: dict[bytes, int] = {}
        self.lists = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            own: dict[int, int] = {}
            for i in range(a, b):
                t = number.setdefault(w.word(i), len(number))
                own[t] = own.get(t, 0) + 1
            self.lists.append((np.array(list(own), dtype=np.int64), np.array(list(own.values()), dtype=np.int64)))
        self.names = list(number)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, words = [], 0
    for row in items.toLocalIterator():
        n = len(row[1] or b"") // 2 + 1
        if block and (words + n > ITEM_WORDS or len(block) >= ITEMS):
            yield block
            block, words = [], 0
        block.append(tuple(row))
        words += n
    if block:
        yield block


def _statistics(docs: DataFrame, names: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(documents with words, words, documents of each term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(names)
        some, words, df = 0, 0, np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(0)).fill_null(0).to_pylist()):
                size, _, term, _ = postings(batch.column(0)[lo:hi].to_pylist(), terms)
                some, words = some + int((size > 0).sum()), words + int(size.sum())
                df += np.bincount(term, minlength=len(names))
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *has.tolist()], pa.int64()), pa.array([some, words, *df[has].tolist()], pa.int64())], ["term", "n"])

    df = np.zeros(len(names) + 2, dtype=np.int64)
    for term, n in docs.select("_t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # one row for each item term
        df[term] = n
    return int(df[-2]), int(df[-1]), df[:-2]


def impacts(tf: np.ndarray, words: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Saturated term frequency in millionths, for documents of the given lengths."""
    m = 100 - 25 + (25 * words.astype(np.int64) * n_docs) // max(1, n_words)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 12 * m)


def _ranked(docs: DataFrame, block: list[tuple], k: int, id_type: T.DataType, item_type: T.DataType) -> DataFrame:
    items = Items([text for _, text in block])
    names, lists = items.names, items.lists
    n_docs, n_words, df = _statistics(docs, names)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        terms = Terms(names)
        best: list[list[tuple]] = [[] for _ in lists]
        ids, parts, held = [], [], 0

        def search() -> None:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
            column = np.empty(len(ids), dtype=np.int64)
            column[order] = np.arange(len(ids))
            doc, term, impact = (np.concatenate(x) for x in zip(*parts))
            if not len(doc):
                return
            treap = Treap(term, column[doc], impact, len(names), len(ids))
            for i, (own, times) in enumerate(lists):
                # scores that tie with another shard's go by id, so they are kept
                edge = max(1, -best[i][-1][0]) if len(best[i]) == k else 1
                new = [(-s, ids[order[c]] is None, ids[order[c]]) for s, c in treap.best(own, weight[own] * times, k, edge)]
                best[i] = sorted(best[i] + new, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]

        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                size, doc, term, tf = postings(batch.column(1)[lo:hi].to_pylist(), terms)
                parts.append((doc + len(ids), term, impacts(tf, size[doc], n_docs, n_words)))
                ids += batch.column(0)[lo:hi].to_pylist()
                held += len(doc)
                if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    search()
                    ids, parts, held = [], [], 0
        if parts:
            search()
        rows = [{"item": i, "doc_id": d, "score": -s} for i, b in enumerate(best) for s, _, d in b]
        yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    found = docs.select("doc_id", "_t").mapInArrow(run, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    number = docs.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType(
        [T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
    return top.join(number, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each row of ``items``.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's score sums weight * impact over the
    item's terms, repeats included; weights and impacts are whole numbers, see ``impacts``. Equal scores go by id,
    rows without an id last; rows that repeat an id are ranked each for itself, and so are rows of items. Null and
    empty texts have no terms and are neither counted nor found. Empty tables give empty tables; other columns are not read.
    """
    q = lambda c: F.col(f"`{c}`")
    given = docs.select(q(doc_id).alias("doc_id"), q(text).cast("string").cast("binary").alias("_t"))
    asked = items.select(q(item_id).alias("item_id"), q(item_text).cast("string").cast("binary").alias("_t"))
    id_type, item_type = given.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    out = None
    for block in _item_blocks(asked):
        found = _ranked(given, block, k, id_type, item_type)
        if out is None:
            out = found
        else:  # one block's tables at a time
            out = write_and_read(out, "search-block").union(write_and_read(found, "search-block"))
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                                  T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    return out


ORACLE = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nw FROM len),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
weight AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY term, nd),
scored AS (
  SELECT q.item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nw))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN weight USING (term) JOIN len ON len.doc_id = p.doc_id, total GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
