"""Byte-level BPE encoding and decoding over a public rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves a whole pre-token that is a token; any
other pre-token is merged with a heap of adjacent pairs over a doubly linked list of its bytes. A bounded memo in
each worker keeps the ids of pre-tokens it has met, since the same words come again and again.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.arrow import Collector, map_arrow, small_slices

_MEMO_ENTRIES = 500_000
_MASK = (1 << 64) - 1
_ID_BITS = 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _slot(h: int, displacement: int, n: int) -> int:
    mixed = ((h ^ (displacement * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
    return (mixed >> 29) % n


class PerfectHash:
    """Every key in a slot of its own, as many slots as keys: hash, then displace by bucket.

    Buckets of several keys try displacements until all their keys fall into free slots, largest buckets
    first; a bucket of one key names the slot it gets (as a negative number).
    """

    def __init__(self, table: dict[bytes, int]):
        n = max(1, len(table))
        self._n, self._m = n, max(1, n // 3)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self._m)]
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self._m].append((h, key))
        self._displacement = [0] * self._m
        self._keys: list[bytes | None] = [None] * n
        self._values = [0] * n
        free = [True] * n
        order = sorted(range(self._m), key=lambda b: -len(buckets[b]))
        singles = [b for b in order if len(buckets[b]) == 1]
        for b in order:
            bucket = buckets[b]
            if len(bucket) < 2:
                break
            d = 1
            while True:
                slots = [_slot(h, d, n) for h, _ in bucket]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self._displacement[b] = d
            for s, (_, key) in zip(slots, bucket):
                free[s], self._keys[s], self._values[s] = False, key, table[key]
        left = (s for s in range(n) if free[s])
        for b, s in zip(singles, left):
            key = buckets[b][0][1]
            self._displacement[b], self._keys[s], self._values[s] = -s - 1, key, table[key]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self._displacement[h % self._m]
        slot = -d - 1 if d < 0 else _slot(h, d, self._n)
        return self._values[slot] if self._keys[slot] == key else None


def late_letters() -> list[tuple[int, int]]:
    """Ranges of code points that the ``regex`` module counts as letters or numbers and the library's own
    engine, of an older Unicode, does not. A rank per byte and a pattern of one class make it list its members."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    pattern = r"[\p{L}\p{N}]"
    lister = tiktoken.Encoding(
        "classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}
    )
    theirs = set(bytes(lister.encode_ordinary(every)).decode())
    return _ranges(ord(c) for c in regex.findall(pattern, every) if c not in theirs)


def _ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    ranges: list[tuple[int, int]] = []
    for point in points:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1] = (ranges[-1][0], point)
        else:
            ranges.append((point, point))
    return ranges


#: Classes of the ``regex`` module as the standard one has them, but for a few code points.
_STANDARD = {r"[^\s\p{L}\p{N}]": r"(?:[^\w\s]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}


def standard_pattern(pattern: str) -> tuple[str, list[tuple[int, int]]] | None:
    """``pattern`` for the standard, faster module, and the code points whose classes differ there; None if it cannot be said."""
    said = pattern
    for ours, standard in _STANDARD.items():
        said = said.replace(ours, standard)
    if r"\p" in said:
        return None
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd: set[str] = set()
    for ours, standard in [*_STANDARD.items(), (r"\s", r"\s")]:
        odd |= set(regex.findall(ours, every)) ^ set(re.findall(standard, every))
    return said, _ranges(sorted(map(ord, odd)))


class Codec:
    """Encodes single pre-tokens and decodes ids. Built once on the driver and sent to the tasks: its size is the
    vocabulary's."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks, self._pattern = ranks, pattern
        self._whole = PerfectHash(ranks)
        self._late = late_letters()
        self._standard = standard_pattern(pattern)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("_ranks", "_pattern", "_whole", "_late", "_standard")}

    @cached_property
    def _bytes(self) -> list[int]:
        return [self._ranks[bytes([b])] for b in range(256)]

    @cached_property
    def _pairs(self) -> dict[int, int]:
        """(left id, right id) -> id of the token they spell."""
        ranks, pairs = self._ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _ID_BITS | right] = rank
        return pairs

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens end to end, and where each begins and how long it is, by id."""
        size = np.zeros(max(self._ranks.values()) + 1, np.int64)
        first, parts, end = np.zeros_like(size), [], 0
        for token, rank in self._ranks.items():
            first[rank], size[rank] = end, len(token)
            parts.append(token)
            end += len(token)
        return np.frombuffer(b"".join(parts), np.uint8), first, size

    @cached_property
    def _find(self) -> Callable[[str], list[str]]:
        return regex.compile(self._pattern).findall

    @cached_property
    def _has_late(self) -> Callable[[str], object]:
        return _any_of(self._late)

    @cached_property
    def _quick(self) -> tuple[Callable[[str], object], Callable[[str], list[str]]] | None:
        """Whether a text holds a code point that the standard module may take otherwise, and its matches if not."""
        if self._standard is None:
            return None
        pattern, odd = self._standard
        return _any_of([*odd, *self._late]), re.compile(pattern).findall

    def _split(self, text: str) -> list[str]:
        """Matches of the pattern, which cover the text. Late letters are matched as the symbols the library takes
        them for."""
        if self._quick and not self._quick[0](text):
            return self._quick[1](text)
        if text.isascii() or not self._has_late(text):
            return self._find(text)
        stand_in = {point: "\uffff" for a, b in self._late for point in range(a, b + 1)}
        ends = [m.span() for m in regex.finditer(self._pattern, text.translate(stand_in))]
        return [text[a:b] for a, b in ends]

    @cached_property
    def _memo(self) -> _Memo:
        return _Memo(self)

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self._whole.get(raw)
        return [whole] if whole is not None else self._merged(raw)

    def _merged(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost on a tie: the heap orders (rank, place) in one number."""
        pair_of, n = self._pairs.get, len(raw)
        table = self._bytes
        ids = [table[b] for b in raw]
        heap = []
        for i in range(n - 1):
            rank = pair_of(ids[i] << _ID_BITS | ids[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or pair_of(ids[i] << _ID_BITS | ids[j]) != rank:
                continue  # one of the two is gone or has grown since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pair_of(rank << _ID_BITS | ids[k])
                if right is not None:
                    heapq.heappush(heap, right << 32 | i)
            h = before[i]
            if h >= 0:
                left = pair_of(ids[h] << _ID_BITS | rank)
                if left is not None:
                    heapq.heappush(heap, left << 32 | h)
        return [t for t in ids if t >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        memo = self._memo
        out = b"".join(map(memo.__getitem__, self._split(text)))
        if len(memo) > _MEMO_ENTRIES:
            memo.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        data, first, size = self._table
        at = np.frombuffer(ids, "<u4")
        sizes = size[at]
        ends = np.cumsum(sizes)
        # each byte's place in the table: its token's beginning and how far it is into the token
        return data[np.repeat(first[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _any_of(ranges: list[tuple[int, int]]) -> Callable[[str], object]:
    members = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[{members}]" if members else "(?!)").search


class _Memo(dict):
    """Pre-token -> its ids as bytes, filled when asked."""

    def __init__(self, codec: Codec):
        super().__init__()
        self._codec = codec

    def __missing__(self, pre_token: str) -> bytes:
        ids = np.array(self._codec.piece(pre_token.encode()), "<u4").tobytes()
        self[pre_token] = ids
        return ids


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row's whole text.

    A null or empty text has no ids. Columns besides doc_id and text are ignored; repeated rows and null
    ids are encoded row by row; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, out = shared.value.encode, Collector(schema)
        for part in small_slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                ids = to_ids(text) if text else b""
                if out.add((doc_id, ids), len(ids) + 16):
                    yield out.take()
        yield out.take()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """Adds ``decoded`` (binary) to the rows of `encode`. Null ids decode to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes, out = shared.value.decode, Collector(schema)
        for part in small_slices(batches):
            for doc_id, ids in zip(part["doc_id"].to_pylist(), part["ids"].to_pylist()):
                decoded = to_bytes(ids or b"")
                if out.add((doc_id, ids, decoded), len(ids or b"") + len(decoded) + 16):
                    yield out.take()
        yield out.take()

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")
