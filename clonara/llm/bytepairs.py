"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token is a match of the splitting pattern. One that is a whole token is found by a minimal perfect hash over the
vocabulary (hash, then displace: a bucket's displacement sends its tokens to places of their own, as many places as
tokens) and confirmed on its bytes. Every other pre-token is merged: a heap holds the neighbouring pairs that are
tokens, least rank first and then leftmost, over a linked list of byte positions.

A space that stands before another character than white space always starts a match, as no match goes on over it. Texts
are therefore cut at spaces, and what stands between two cuts is matched, encoded and decoded once and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import mixed

#: Matches and pieces of text that a task remembers, about; matches longer than LONG characters and pieces of more than
#: three matches are forgotten after their group of texts.
REMEMBERED = 1_000_000
LONG = 64
#: What the patterns of rank files call white space.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")

_TRIES = np.arange(64, dtype=np.uint64)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Places 0 to n - 1 of n different keys; a key that is not among them gets some place, too."""

    def __init__(self, keys: list[bytes], shift: np.ndarray | None = None):
        self.n = max(len(keys), 1)
        self.buckets = max(self.n // 2, 1)
        #: Displacement of a bucket; below zero, the place of a bucket's single key, as -1 - place.
        self.shift = self._settled(keys) if shift is None else shift

    def _settled(self, keys: list[bytes]) -> np.ndarray:
        n, hashes = self.n, self._hashes(keys)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("two keys are equal, or their hashes are")
        settled = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []
        members.sort(key=len, reverse=True)
        taken = np.zeros(n, bool)
        free = None
        for m in members:
            if len(m) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                settled[bucket[m[0]]] = -1 - next(free)
                continue
            first = np.uint64(0)
            while True:
                tried = first + _TRIES
                places = self._displaced(hashes[m][:, None], tried[None, :])
                good = ~taken[places].any(0)
                if good.any():
                    ordered = np.sort(places, axis=0)
                    good &= (ordered[1:] != ordered[:-1]).all(0)
                if good.any():
                    k = int(np.argmax(good))
                    taken[places[:, k]] = True
                    settled[bucket[m[0]]] = int(tried[k])
                    break
                first += np.uint64(len(_TRIES))
                if first > 1 << 24:
                    raise ValueError("no displacement found")
        return settled

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def _displaced(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return ((mixed(h ^ (shift * _STRIDE)) >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        h = self._hashes(keys)
        shift = self.shift[self._bucket(h)]
        return np.where(shift < 0, -1 - shift, self._displaced(h, np.maximum(shift, 0).astype(np.uint64)))


class ByteCodec:
    """Encoder and decoder over the ranks of a file; ids are ranks.

    ``shift`` takes the displacements of another codec of that file, so that only one process looks for them.
    """

    def __init__(self, rank_file: str, pattern: str, shift: np.ndarray | None = None):
        import regex

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.alone = [self.ranks[bytes([b])] for b in range(256)].__getitem__
        #: Rank of the union of two tokens, and of two bytes.
        self.unions = {a << 32 | b: r for t, r in self.ranks.items() for k in range(1, len(t))
                       if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None}.get
        self.pairs = {tuple(token): rank for token, rank in self.ranks.items() if len(token) == 2}.get
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if len(self.tokens) < len(self.ranks):
            raise ValueError("two tokens have one rank")
        self.hash = PerfectHash(list(self.ranks), shift)
        self.placed: list[bytes] = [b""] * len(self.ranks)
        for place, token in zip(self.hash.places(list(self.ranks)).tolist(), self.ranks):
            self.placed[place] = token
        self.matches = regex.compile(pattern).findall

    def whole(self, keys: list[bytes]) -> list[bool]:
        """Whether each key is a token, by the perfect hash and its bytes."""
        return list(map(bytes.__eq__, map(self.placed.__getitem__, self.hash.places(keys).tolist()), keys))

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is no token, by a heap over linked bytes."""
        union, n = self.unions, len(data)
        shift = n.bit_length()
        low = (1 << shift) - 1
        ids = list(map(self.alone, data))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: Rank of the union of the symbols at a place and after it, none where it is no token.
        joined = list(map(self.pairs, zip(data, data[1:])))
        joined.append(None)
        heap = [r << shift | i for i, r in enumerate(joined) if r is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, best = top & low, top >> shift
            if joined[i] != best:
                continue
            ids[i] = best
            gone = after[i]
            joined[gone] = ids[gone] = None
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
                joined[i] = r = union(best << 32 | ids[right])
                if r is not None:
                    heappush(heap, r << shift | i)
            else:
                joined[i] = None
            left = before[i]
            if left >= 0:
                joined[left] = r = union(ids[left] << 32 | best)
                if r is not None:
                    heappush(heap, r << shift | left)
        return [i for i in ids if i is not None]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every pre-token: by the perfect hash where it is a token, merged where not."""
        keys = [w.encode("utf-8") for w in words]
        return [[self.ranks[k]] if is_token else self.merge(k) for k, is_token in zip(keys, self.whole(keys))]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_words(self.matches(text or ""))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Known(dict):
    """What the last groups of texts held; what was not asked for since the memory was last full is forgotten."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def age(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.before = dict(self)
            self.clear()

    def missing(self, keys: set[str]) -> set[str]:
        new = keys.difference(self)
        back = new.intersection(self.before)
        self.update((k, self.before[k]) for k in back)
        return new - back


class _Remembered:
    """Ids as text and decoded bytes: of pieces after a space, and of matches that begin without one."""

    def __init__(self, of: ByteCodec):
        self.of = of
        self.spaced, self.plain = _Known(), _Known()

    def _learn(self, words: set[str]) -> None:
        """Take up matches that are not known yet."""
        new = [*(" " + w for w in self.spaced.missing({w[1:] for w in words if w[0] == " "})), *self.plain.missing({w for w in words if w[0] != " "})]
        for w, ids in zip(new, self.of.encode_words(new)):
            known, key = (self.spaced, w[1:]) if w[0] == " " else (self.plain, w)
            known[key] = (str(ids)[1:-1].replace(" ", ""), self.of.decode_bytes(ids))

    def _matches(self, pieces: list[str]) -> list[list[str]]:
        """Matches of every piece after a space; all pieces are read at once, as a match with a space starts one."""
        split: list[list[str]] = []
        for word in self.of.matches(" " + " ".join(pieces)) if pieces else []:
            if word[0] == " ":
                split.append([word])
            else:
                split[-1].append(word)
        return split

    def _parts(self, words: list[str]) -> list[tuple[str, bytes]]:
        return [self.spaced[w[1:]] if w[0] == " " else self.plain[w] for w in words]

    def encoded(self, texts: list[str]) -> list[tuple[str, bytes]]:
        self.spaced.age()
        self.plain.age()
        cut = [t.split(" ") for t in texts]
        pieces = set(chain.from_iterable(cut))
        odd = {p for p in pieces if not p or p[0] in WHITE}
        first = []
        for c in cut:
            if odd and not odd.isdisjoint(c):  # the space before such a piece may belong to the match before it
                c[:] = _rejoined(c, odd)
                pieces.update(c)
            first.append(c[0])
            del c[0]
        new = self.spaced.missing(pieces - odd)
        whole = [p for p in new if " " in p or p[-1] in WHITE]
        new = [*new.difference(whole), *whole]
        split = self._matches(new[:len(new) - len(whole)])
        split.extend(self.of.matches(" " + p) for p in whole)
        start = list(map(self.of.matches, first))
        words = set(chain.from_iterable(chain(split, start)))
        self._learn(words)
        for p, match in zip(new, split):
            if len(match) > 1:
                self.spaced[p] = _joined(self._parts(match))
        spaced = self.spaced.__getitem__
        out = [_joined([*self._parts(match), *map(spaced, rest)]) for match, rest in zip(start, cut)]
        for p, match in zip(new, split):
            if len(match) > 3 or len(p) > LONG:
                self.spaced.pop(p, None)
        for w in [w for w in words if len(w) > LONG]:
            self.spaced.pop(w[1:], None)
            self.plain.pop(w, None)
        return out


def _joined(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


def _rejoined(cut: list[str], odd: set[str]) -> list[str]:
    """Pieces, those that start with white space or are empty put to the piece before."""
    out = [[cut[0]]]
    for p in cut[1:]:
        if p in odd:
            out[-1].append(p)
        else:
            out.append([p])
    return [" ".join(parts) for parts in out]


_memories: dict[tuple[str, str], _Remembered] = {}


def remembered(rank_file: str, pattern: str, shift: np.ndarray | None = None) -> _Remembered:
    key = (rank_file, pattern)
    if key not in _memories:
        _memories[key] = _Remembered(ByteCodec(rank_file, pattern, shift))
    return _memories[key]


def _groups(texts: list[str], chars: int = 2_000_000):
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= chars:
            yield group
            group, n = [], 0
    if group:
        yield group


def tokenize(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array, unless ``keep_ids`` is false), n_tokens, ids_sha256, decoded_sha256 of the decoded bytes.

    Every match of ``pattern`` is encoded on its own by the ranks of ``rank_file``, without special tokens; their names in
    a text are ordinary text. A null or empty text has no ids and decodes to no bytes. Repeated rows give repeated results;
    a null doc_id stays null. Other columns are not read. The file must be readable on every executor.
    """

    shift = remembered(rank_file, pattern).of.hash.shift

    def run(batches):
        memory = remembered(rank_file, pattern, shift)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids, shas, decoded, counts = [], [], [], []
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                for text, back in memory.encoded(group):
                    counts.append(text.count(",") + 1 if text else 0)
                    shas.append(sha(text.encode()))
                    decoded.append(sha(back))
                    if keep_ids:
                        ids.append(np.array(text.split(","), np.int32) if text else np.empty(0, np.int32))
            columns = [batch.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                       pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")
