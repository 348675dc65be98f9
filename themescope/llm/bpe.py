"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (one slot a token, no empty slot):
a pre-token that is a token as a whole costs one probe and one comparison. Tier two merges
the bytes of a miss: bytes form a linked list and a heap holds the neighbouring pairs by
rank and place, so n bytes cost O(n log n) whatever their length.

The table is built once, from a rank file of known size, and broadcast (50,256 tokens: about
2 MB). A worker remembers what it found for at most ``MEMO`` different pre-tokens and then
starts anew, so memory does not grow with the data. Each text is handled on its own: no
shuffle, and a lost executor repeats only its own splits.

Defined results: null and empty texts have no ids (digests of the empty string); repeated
rows are encoded again; null ids are kept; text that looks like a special token is ordinary;
bytes that are not UTF-8 are replaced before encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from themescope.llm.common import field, per_text

#: Different pre-tokens (of at most MEMO_BYTES bytes) whose ids a worker remembers.
MEMO = 600_000
MEMO_BYTES = 64
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 token and rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, lines))]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks in {path} are not 0 to {len(pairs) - 1}")
    return [token for _, token in pairs]


def _place(h: int, seed: int, n: int) -> int:
    h = ((h ^ (seed * 0x9E3779B97F4A7C15 & _MASK)) * 0xFF51AFD7ED558CCD) & _MASK
    return ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & _MASK) % n


class PerfectHash:
    """Gives each of n known keys its own number below n; any other key gets some number.

    Keys fall into buckets; large buckets first, each gets the first seed that sends its
    keys to free slots. Buckets of one key store the slot itself.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        self.seeds = [0] * self.buckets
        groups: dict[int, list[tuple[int, int]]] = {}
        for number, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, number))
        self.slots = [-1] * self.n
        alone = []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                alone.append((bucket, members[0][1]))
                continue
            seed = 0
            while True:
                seed += 1
                places = [_place(h, seed, self.n) for h, _ in members]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
            self.seeds[bucket] = seed
            for p, (_, number) in zip(places, members, strict=True):
                self.slots[p] = number
        free = (p for p in range(self.n) if self.slots[p] < 0)
        for (bucket, number), p in zip(alone, free, strict=False):
            self.seeds[bucket] = -1 - p
            self.slots[p] = number

    def find(self, key: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        return self.slots[-1 - seed if seed < 0 else _place(h, seed, self.n)]


class Encoder:
    """Two-tier encoder over a list of tokens by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.whole = PerfectHash(tokens)
        self.ranks: dict[bytes, int] = {}
        self.memo: dict[str, str] = {}

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "whole": self.whole, "ranks": {}, "memo": {}}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token: merge the pair of least rank, leftmost first."""
        if not self.ranks:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
        n, rank = len(piece), self.ranks.get
        bits = n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # of the part that starts here; 0 where no part starts any more
        before = list(range(-1, n - 1))
        # a pair is one number: its rank, then its start, then its end
        heap = [
            (r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            stop, i = pair & low, pair >> bits & low
            middle = end[i]
            if not middle or middle >= stop or end[middle] != stop:
                continue  # a part has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                last = end[stop]
                if (r := rank(piece[i:last])) is not None:
                    heappush(heap, (r << bits | i) << bits | last)
            b = before[i]
            if b >= 0 and (r := rank(piece[b:stop])) is not None:
                heappush(heap, (r << bits | b) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, piece: bytes) -> list[int]:
        number = self.whole.find(piece)
        return [number] if self.tokens[number] == piece else self.merged(piece)

    def joined(self, text: str) -> str:
        """Ids of a text, in decimal, joined by commas."""
        parts = _pattern(self.pattern)(text)
        memo = self.memo
        try:
            return ",".join([memo[p] for p in parts])
        except KeyError:
            pass
        out = []
        for p in parts:
            ids = memo.get(p)
            if ids is None:
                raw = p.encode()
                ids = ",".join(map(str, self.piece(raw)))
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = ids
            out.append(ids)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.joined(text).split(","))) if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _pattern(pattern: str):
    import regex

    return regex.compile(pattern).findall


def load(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


#: This worker's encoder by a digest of its vocabulary, so that tasks after the first keep the memo.
_HERE: dict = {}


def _shared(spark, encoder: Encoder):
    kept = spark.sparkContext.broadcast(encoder)
    name = hashlib.sha256(b"\0".join(encoder.tokens) + encoder.pattern.encode()).hexdigest()

    def here() -> Encoder:
        if name not in _HERE:
            _HERE.clear()
            _HERE[name] = kept.value
        return _HERE[name]

    return here


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int); a null text has none."""
    here = _shared(docs.sparkSession, load(path, pattern))

    def start():
        encoder = here()
        return lambda texts: [[encoder.encode(x.decode("utf-8", "replace")) for x in texts]]

    return per_text(docs, docs.columns, [field("ids", "ints")], start)


def digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, then decode the ids."""
    here = _shared(docs.sparkSession, load(path, pattern))

    def start():
        encoder = here()
        tokens = {str(i): t for i, t in enumerate(encoder.tokens)}

        def work(texts):
            counts, ids_sha, text_sha = [], [], []
            for x in texts:
                joined = encoder.joined(x.decode("utf-8", "replace"))
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
            return counts, ids_sha, text_sha

        return work

    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]
    return per_text(docs.select(*keep, "text"), list(keep), fields, start)
