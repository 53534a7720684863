"""Byte-level BPE encoding and decoding.

Bytes map to Latin-1 characters, so that one Aho-Corasick automaton finds every vocabulary entry in
a piece of text. Encoding walks from the longest match at each place and goes back where two
neighbouring tokens can't stand side by side; a pair can when merging the bytes of both gives just
these two, and that answer is memoised. A place that fails once is not tried again, so a piece
costs time in proportion to its length. The tokens are those of merging by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.words import slices

#: entries of a worker's memo of pieces, and the longest piece kept in it
MEMO, MEMO_BYTES = 1 << 18, 64
#: bytes of a rank file that is sent to the executors
MAX_FILE = 64 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()

    def merge(self, piece: bytes) -> list[int]:
        """Merge by rank, the definition; only for the bytes of one or two tokens."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Does merging the token's bytes give the token?"""
        if token not in self.whole:
            self.whole[token] = self.merge(self.tokens[token]) == [token]
        return self.whole[token]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MEMO * 4:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        match: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # shortest first
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            match[end - size + 1].append((size, token))
        tokens: list[int] = []
        tried: list[int] = []  # for each token: how many of the matches at its place are left
        open_ = bytearray(b"\1") * (n + 1)
        at, left = 0, len(match[0])
        while at < n:
            found = False
            while left:
                left -= 1
                size, token = match[at][left]
                if open_[at + size] and self.reachable(token) and (not tokens or self.compatible(tokens[-1], token)):
                    found = True
                    break
            if found:
                tokens.append(token)
                tried.append(left)
                at += size
                left = len(match[at]) if at < n else 0
            else:
                if not tokens:
                    raise ValueError("the ranks lack a byte")
                open_[at] = 0
                at -= len(self.tokens[tokens.pop()])
                left = tried.pop()
        return tokens

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Memo(dict):
    """Piece of text -> its ids as little-endian 32-bit numbers."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        out = np.array(self.encoder.encode_piece(raw), dtype="<u4").tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


_ready: dict[tuple[int, int], tuple[Encoder, Memo]] = {}


def encoder_of(raw: bytes) -> tuple[Encoder, Memo]:
    """One encoder a worker; building it takes about a second."""
    key = (len(raw), hash(raw))
    if key not in _ready:
        encoder = Encoder(read_ranks(raw))
        _ready[key] = encoder, Memo(encoder)
    return _ready[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids and decoded bytes of each text.

    Returns the columns ``keep`` and ``ids`` (little-endian unsigned 32-bit numbers in a binary),
    ``decoded`` (binary). Null and empty texts have no ids. Special tokens are ordinary text.
    Rows are independent: repeated rows, ties and null ids pass through, an empty table gives an
    empty table, other columns are not read. The rank file is read by the driver and sent along.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError(f"the rank file has over {MAX_FILE} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = encoder_of(sent.value)
        find = regex.compile(pattern).findall
        for batch in batches:
            kept, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                ids = [b"".join(map(memo.__getitem__, find(t))) if t else b"" for t in texts[lo:hi].to_pylist()]
                decoded = [encoder.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [kept[lo:hi], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["_k", "ids", "decoded"])

    rest = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_k"), F.col(text).cast("string").alias("_t"))
    schema = T.StructType([rest.schema["_k"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return rest.mapInArrow(run, schema).select("_k.*", "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """The ids and bytes as counts and SHA-256, for comparison with another encoder."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
