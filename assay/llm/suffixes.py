"""Removal of repeated byte strings by deep-shallow suffix sorting.

Suffixes are compared over ``WINDOW`` bytes. Only suffixes that may repeat are sorted (see
``repeats``): multikey quicksort on eight-byte characters brings them in order down to a shallow
depth, and a blind trie orders each group that still agrees there. Equal neighbours are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import repeats
from assay.llm.words import BYTES, BYTES2, U64, mix, slices

WINDOW, GRAM = 200, 64
#: bytes ordered by quicksort; segments below SMALL are ordered by one sort of these bytes
SHALLOW, SMALL = 32, 2048
#: a longer text is cut into parts that overlap by a window less one byte
PART = 1 << 20


def pieces(texts: list[bytes], width: int = WINDOW, gram: int = GRAM, part: int = PART) -> tuple[np.ndarray, ...]:
    """Text number, minimiser, piece hash, first window and number of windows of all pieces."""
    parts, owner, offset = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), part):
            parts.append(t[at:at + part + width - 1])
            owner.append(i)
            offset.append(at)
    owner, offset = np.array(owner, dtype=np.int64), np.array(offset, dtype=np.int64)
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for lo, hi in slices(list(map(len, parts)), part):
        which, m, p, at, n = _pieces(parts[lo:hi], width, gram)
        out.append((owner[lo:hi][which], m, p, at + offset[lo:hi][which], n))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(parts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    data = b" ".join(parts) + b" "
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    buf = np.frombuffer(data, dtype=np.uint8)
    grams = mix(BYTES.windows(BYTES.prefix(BYTES.values[buf]), gram))
    lows = np.minimum(begin, max(0, len(data) - width + 1))
    at, n, place = repeats.pieces_of(grams, width - gram + 1, lows, np.maximum(lows, begin + size - width + 1))
    whole = BYTES2.prefix(BYTES2.values[buf])
    p = mix(BYTES2.runs(whole, at, at + n + width - 1) + n.astype(U64))
    which = np.searchsorted(begin, at, "right") - 1
    return which, grams[place], p, at - begin[which], n


def pack(text: bytes, wanted: list[tuple[int, int]], width: int = WINDOW) -> list[bytes]:
    return [text[at:at + n + width - 1] for at, n in wanted]


class BlindTrie:
    """Strings of one length, in order; nodes know only where their strings part.

    An inner node is [depth, {byte: child}], a leaf is (string, list of numbers).
    """

    def __init__(self, string: bytes, number: int):
        self.root: list | tuple = (string, [number])

    def add(self, s: bytes, number: int) -> None:
        node = self.root
        while type(node) is list:
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(number)
            return
        differs = int.from_bytes(other, "big") ^ int.from_bytes(s, "big")
        depth = len(s) - (differs.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = (s, [number])
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        new = [depth, {other[depth]: node, s[depth]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def groups(self) -> Iterator[list[int]]:
        """Numbers of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def suffix_order(data: bytes, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Groups of equal suffixes (as numbers into ``starts``), in suffix order over ``width`` bytes."""
    raw = np.frombuffer(data + b"\0" * (width + 8), dtype=np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)

    def character(who: np.ndarray, depth: int) -> np.ndarray:
        c = np.ascontiguousarray(eight[starts[who] + depth]).view(">u8").ravel().astype(U64)
        short = width - depth
        return c & ~((U64(1) << U64(8 * (8 - short))) - U64(1)) if short < 8 else c

    shallow = min(SHALLOW, width)
    stack = [(np.arange(len(starts)), 0)]
    while stack:
        who, depth = stack.pop()
        if len(who) == 1:
            yield who
        elif depth >= shallow:
            yield from _deep(data, starts, who, min(depth, width), width)
        elif len(who) <= SMALL:
            keys = [character(who, d) for d in range(depth, shallow, 8)]
            order = np.lexsort(keys[::-1])
            who = who[order]
            new = np.zeros(len(who), dtype=bool)
            new[0] = True
            for k in keys:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
            cut = [*np.flatnonzero(new).tolist(), len(who)]
            for a, b in zip(cut, cut[1:]):
                yield from ([who[a:b]] if b - a == 1 else _deep(data, starts, who[a:b], min(shallow, width), width))
        else:
            key = character(who, depth)
            some = np.sort(key[::len(key) // 255])
            pivot = some[len(some) // 2]
            stack += [(w, d) for w, d in ((who[key > pivot], depth), (who[key == pivot], depth + 8), (who[key < pivot], depth)) if len(w)]


def _deep(data: bytes, starts: np.ndarray, who: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    numbers, at = who.tolist(), starts[who].tolist()
    trie = BlindTrie(data[at[0] + depth:at[0] + width], numbers[0])
    for i, a in zip(numbers[1:], at[1:]):
        trie.add(data[a + depth:a + width], i)
    for group in trie.groups():
        yield np.array(group)


def sorter(strings: list[bytes], n: list[int], v: list[int], width: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """For each packed string: runs of windows with the number of their occurrences."""
    data = b"".join(strings)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in strings])])[:-1]
    count = np.array(n)
    owner = np.repeat(np.arange(len(strings)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    starts = np.arange(first[-1]) - first[owner] + begin[owner]
    each = np.array(v, dtype=np.int64)[owner]
    total = each.copy()
    for group in suffix_order(data, starts, width):
        if len(group) > 1:
            total[group] = each[group].sum()
    return [repeats.value_runs(total[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def digests(string: bytes, n: int, width: int = WINDOW) -> np.ndarray:
    buf = np.frombuffer(string, dtype=np.uint8)
    return np.stack([mix(h.windows(h.prefix(h.values[buf]), width)) for h in (BYTES, BYTES2)])[:, :n]


def remove_repeats(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id",
                   max_variants: int = repeats.MAX_VARIANTS) -> DataFrame:
    """Every row of ``docs``: ``doc_id``, ``n_bytes``, ``removed`` (maximal byte spans), ``kept`` (bytes).

    A byte goes if a string of ``width`` bytes that covers it also starts elsewhere, in the same or
    another document. Null counts as empty; shorter texts lose nothing. Rows that repeat an id and
    text are copies of each other; so are equal texts without ids. Empty tables give empty tables;
    other columns are not read.
    """
    docs = repeats.keyed(docs, text, doc_id)
    every = repeats.all_pieces(docs, lambda t: pieces(t, width, gram), slices)
    spans = repeats.repeated_windows(
        docs, every, by_document=False, max_variants=max_variants, pack=lambda t, w: pack(t, w, width),
        sorter=lambda s, n, v: sorter(s, n, v, width), digests=lambda s, n: digests(s, n, width))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<struct<from: long, to: long>>, kept binary"
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in repeats.small(batches, 1):
            removed, kept = [], []
            for t, s in zip(batch.column(1), batch.column(2)):
                t, s = t.as_py(), repeats.joined([(x["from"], x["to"]) for x in s.as_py() or []], width)
                ends = [0, *[x for ab in s for x in ab], len(t)]
                removed.append([{"from": a, "to": b} for a, b in s])
                kept.append(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return docs.join(spans, ["d", "th"], "left").select("doc_id", "_t", "spans").mapInArrow(run, schema)


def digest_columns(result: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return result.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                         F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS hx FROM documents),
w AS (SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 400)) AS h
      FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 199)) AS s FROM d WHERE len(hx) >= 400)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w JOIN again USING (h)),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM numbered GROUP BY doc_id, g),
gone AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN hx ELSE array_to_string(list_transform(range(1, len(a) + 2),
    lambda i: substr(hx, CASE WHEN i = 1 THEN 1 ELSE 2 * z[i - 1] + 1 END, CASE WHEN i > len(a) THEN len(hx) ELSE 2 * a[i] - CASE WHEN i = 1 THEN 0 ELSE 2 * z[i - 1] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
