"""Byte-level BPE encoding and decoding by corpus-level merge replay.

An inverted index leads from each merge (the pair of neighbouring tokens whose union has that rank) to the positions,
in any word of a block, where it can be applied. The merges are replayed in rank order; each one touches only the
neighbours of the positions that it changes and files the new pairs under their own ranks. A word is replayed once for
a block of texts, whatever the number of its occurrences. No shuffle; each worker holds the ranks and a bounded cache.

Null text: as the empty text, no ids. Empty text: no ids. Texts of any length: pieces are taken in bounded portions.
Repeated rows: each is encoded on its own. Other columns do not matter; null ids stay null. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexspark.llm.common import blocks, spread, starts

#: Words kept with their ids between the blocks of a task, at least until the next block.
CACHE_WORDS = 400_000
#: Characters of texts whose words are replayed together: a worker's memory grows with it.
BLOCK_CHARS = 2 << 20
#: Characters from which a text is taken in portions of so many pieces.
PORTION = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class MergeReplay:
    """Encoder of words by ranks; every single byte must have a rank."""

    #: Merges with fewer waiting positions go position by position.
    FEW = 12

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.found = np.append(found[:, 0], np.int64(2**62)), np.append(found[:, 1], -1)

    def unions(self, left, right) -> np.ndarray:
        """Ranks of the unions of neighbouring tokens, -1 where it is none."""
        key = (np.asarray(left, np.int64) << 32) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.found[at], -1)

    def union(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = self.keys.searchsorted(key)
        return int(self.found[at]) if self.keys[at] == key else -1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and where each word's ids start (and the last ends)."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        n = int(ends[-1]) if words else 0
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        token = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int64), np.arange(-1, n, dtype=np.int64)
        last = ends[ends > np.concatenate(([0], ends[:-1]))] - 1
        after[last] = n
        before[(last + 1)[last + 1 < n]] = n  # position n, of no token, stands for "none"
        before[0] = n
        rank_at = self.unions(token[:n], token[after[:n]])
        at = np.nonzero(rank_at >= 0)[0]
        at = at[np.argsort(rank_at[at], kind="stable")]
        group, begin = np.unique(rank_at[at], return_index=True)
        index: dict[int, list] = dict(zip(group.tolist(), ([x] for x in np.split(at, begin[1:])), strict=True)) if len(at) else {}
        heap = list(index)

        def file(ranks: np.ndarray, places: np.ndarray) -> None:
            for r, p in zip(ranks.tolist(), places.tolist(), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        while heap:
            rank = heapq.heappop(heap)
            waiting = index.pop(rank, None)
            if not waiting:
                continue
            if isinstance(waiting[0], np.ndarray):
                places = np.concatenate((waiting[0], np.array(waiting[1:], np.int64))) if len(waiting) > 1 else waiting[0]
            else:
                places = np.array(waiting, np.int64)
            if len(places) > 1:
                places.sort()
                places = places[np.concatenate(([True], places[1:] != places[:-1]))]
            near = len(places) > 1 and bool((after[places[:-1]] == places[1:]).any())  # as in aaaa: the left one goes first
            if len(places) >= self.FEW and not near:
                right = after[places]
                # a token that is gone, or none, is -1: it has no union
                ok = self.unions(token[places], token[right]) == rank
                places, right = places[ok], right[ok]
                then, prior = after[right], before[places]
                beside = token[then], token[prior]
                up, down = self.unions(rank, beside[0]), self.unions(beside[1], rank)
                if not (((up >= 0) & (up < rank)) | ((down >= 0) & (down < rank))).any():
                    token[places] = rank
                    token[right] = -1
                    after[places] = then
                    before[then] = places
                    if (token[then] != beside[0]).any() or (token[prior] != beside[1]).any():
                        up, down = self.unions(rank, token[then]), self.unions(token[prior], rank)
                    file(up[up >= 0], places[up >= 0])
                    file(down[down >= 0], prior[down >= 0])
                    continue
            queue = places.tolist()
            for i, p in enumerate(queue):
                left, q = int(token[p]), int(after[p])
                if left < 0 or q >= n or self.union(left, int(token[q])) != rank:
                    continue
                token[p] = rank
                token[q] = -1
                q = after[p] = int(after[q])
                lower = False
                if q < n:
                    before[q] = p
                    found = self.union(rank, int(token[q]))
                    if found >= 0:
                        file(np.array([found]), np.array([p]))
                        lower = found < rank
                q = int(before[p])
                if q < n:
                    found = self.union(int(token[q]), rank)
                    if found >= 0:
                        file(np.array([found]), np.array([q]))
                        lower = lower or found < rank
                if lower:  # an earlier merge has become possible and goes first, as it would in a word on its own
                    rest = np.array(queue[i + 1 :], np.int64)
                    file(np.full(len(rest), rank), rest)
                    break
        live = token[:n] >= 0
        return token[:n][live], np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], ends))]


LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
BEYOND = re.compile("[^\x00-\u024f]")


def latin(pattern: str) -> re.Pattern | None:
    """The same pattern for texts below U+0250, where its classes are short; None if it has others."""
    sets = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES}
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for i, x in enumerate(parts):
        for name, own in sets.items():
            x = x.replace(name, own if i % 2 else f"[{own}]")
        parts[i] = x if i % 2 else x.replace(r"\S", f"[^{SPACES}]")
    out = "".join(parts)
    return None if "\\" in out else re.compile(out)


class Codec:
    """Whole texts to ids and back; pattern splits a text into the pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.replay = MergeReplay(ranks)
        self.pattern, self.latin = regex.compile(pattern), latin(pattern)
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def finder(self, text: str):
        return self.latin if self.latin and not BEYOND.search(text) else self.pattern

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Replay the merges for the words that have got a number since."""
        done = len(self.begin) - 1
        words = [p.encode() for p in islice(self.number, done, None)]
        whole = [self.ranks.get(w, -1) for w in words]
        ids, begin = self.replay.encode([b"" if r >= 0 else w for w, r in zip(words, whole, strict=True)])
        whole = np.array(whole, np.int64)
        size = np.where(whole >= 0, 1, np.diff(begin))
        to = starts(size)
        new = np.empty(int(to[-1]), np.int32)
        new[to[:-1][whole >= 0]] = whole[whole >= 0]
        new[spread(to[:-1], np.diff(begin))] = ids
        self.begin = np.concatenate((self.begin, to[1:] + self.begin[-1]))
        self.ids = np.concatenate((self.ids, new))

    def packed(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.begin[numbers], self.begin[numbers + 1] - self.begin[numbers])].astype("<u4")

    def encode_texts(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """For each text, portions of its ids."""
        if len(self.number) > CACHE_WORDS:
            self.number = defaultdict(count().__next__)
            self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        found = [self.numbers(self.finder(x).findall(x)) if len(x) <= PORTION else None for x in texts]
        self.learn()
        for x, numbers in zip(texts, found, strict=True):
            yield self.long(x) if numbers is None else iter((self.packed(numbers),))

    def long(self, text: str) -> Iterator[np.ndarray]:
        pieces = (m.group() for m in self.finder(text).finditer(text))
        while portion := list(islice(pieces, PORTION)):
            numbers = self.numbers(portion)
            self.learn()
            yield self.packed(numbers)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *next(self.encode_texts([text]))])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.bytes_of.__getitem__, ids.tolist()))


@lru_cache(1)
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process, with the words it has learnt, not for each task."""
    return Codec(read_ranks(ranks_path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the token ids of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in blocks(texts, BLOCK_CHARS):
                rows = []
                for portions in codec.encode_texts(texts[a:b]):
                    own, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    for portion in portions:
                        own.update(portion.tobytes())
                        back.update(codec.decode(portion))
                        n += len(portion)
                        if ids:
                            kept.append(portion.tobytes())
                    rows.append((n, own.hexdigest(), back.hexdigest(), b"".join(kept)))
                out = [batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    flat = np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.int32)
                    cuts = np.concatenate(([0], np.cumsum([r[0] for r in rows]))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the bytes that its token ids stand for; null ids are none. An id outside the vocabulary is an error."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                own = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                if len(own) and own.min() < 0:
                    raise ValueError("a token id below zero")
                texts.append(codec.decode(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], [id_col, "bytes"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")
