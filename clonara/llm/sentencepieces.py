"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text is one dummy space and the text, with spaces written as U+2581. Every character is a symbol; an agenda holds the
neighbouring pairs whose union is a piece, best score first and then leftmost, and joins them until none is left.
Characters outside the vocabulary become their bytes. No piece has a space mark after another character or a character
that stands in no longer piece, so words between such places are encoded on their own and remembered. Every Arrow
batch's new words are checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Encoded words that a task remembers; longer ones than LONG characters are not remembered.
REMEMBERED = 500_000
LONG = 64
#: Characters up to which a word's agenda is a plain list or a row of an array.
SHORT = 40
_NEVER = 2**31 - 1


class MergeCodec:
    """Encoder and decoder over the pieces and scores of a model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[piece] = i
        self.costs = {p: -sp.get_score(i) for p, i in self.pieces.items()}
        self.values = {i: b for b, i in self.bytes.items()}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("the vocabulary must have all bytes, and space marks only at the start of pieces")
        alone = "\n" if not any("\n" in p for p in self.pieces) else ""
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        self.names = {i: p for p, i in self.pieces.items()}
        self._tables()

    def _tables(self) -> None:
        """Arrays for agendas of many words: pieces of one character, and for pairs of pieces the place of their union by cost."""
        by_cost = sorted((p for p in self.pieces if len(p) > 1 and p.strip(MARK)), key=self.costs.__getitem__)
        # one piece per cost, so a place names a piece; runs of marks may share one, words with doubled marks go alone
        self.plain = len({self.costs[p] for p in by_cost}) == len(by_cost)
        place = {p: k for k, p in enumerate(by_cost)}
        self.by_cost = np.array([self.pieces[p] for p in by_cost], np.int32)
        self.letters = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        pairs = [(a << 32 | b, place[p]) for p in by_cost for k in range(1, len(p))
                 if (a := self.pieces.get(p[:k])) is not None and (b := self.pieces.get(p[k:])) is not None]
        pairs.sort()
        self.pairs = np.array([k for k, _ in pairs] + [2**63 - 1], np.int64)
        self.unions = np.array([v for _, v in pairs] + [_NEVER], np.int32)

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place by cost of the union of two pieces, _NEVER where it is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.unions[at], _NEVER)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of every word; short words of known characters go through their agendas together, one pair of each at a time."""
        out: list[list[int] | None] = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            at = [k for k in at if MARK + MARK not in words[k]]
            if n > SHORT or not self.plain or not at:
                continue
            points = np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le"), np.uint32).reshape(-1, n)
            ids = self.letters[points]
            known = (ids >= 0).all(1)
            at = np.array(at)[known]
            for k, word in zip(at.tolist(), self._agendas(ids[known])):
                out[k] = word
        return [self.merge(words[k]) if ids is None else ids for k, ids in enumerate(out)]

    def _agendas(self, ids: np.ndarray) -> list[list[int]]:
        """Words of equal length, a row each: the cheapest pair of every row is joined until a row has none."""
        out: list[list[int]] = [[]] * len(ids)
        rows = np.arange(len(ids))
        agenda = self._places(ids[:, :-1], ids[:, 1:])
        while len(rows):
            m, n = ids.shape
            if n == 1:
                going = np.zeros(m, bool)
            else:
                best = agenda.argmin(1)
                least = agenda[np.arange(m), best]
                going = least < _NEVER
            for k, word in zip(rows[~going].tolist(), ids[~going].tolist()):
                out[k] = word
            if not going.any():
                break
            if not going.all():
                rows, ids, agenda, best, least = rows[going], ids[going], agenda[going], best[going], least[going]
            every = np.arange(len(rows))
            ids[every, best] = self.by_cost[least]
            keep = np.ones(ids.shape, bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(len(rows), n - 1)
            keep = np.ones(agenda.shape, bool)
            keep[every, best] = False
            agenda = agenda[keep].reshape(len(rows), n - 2)
            if n > 2:
                for side, some in ((best - 1, best > 0), (best, best < n - 2)):
                    r, c = every[some], side[some]
                    agenda[r, c] = self._places(ids[r, c], ids[r, c + 1])
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of a word by the agenda: a list by position for short words, a heap for long ones."""
        ids: list[int] = []
        for s in self._short(list(word)) if len(word) <= SHORT else self._long(word):
            k = self.pieces.get(s)
            if k is None:
                ids.extend(self.bytes[b] for b in s.encode("utf-8"))
            else:
                ids.append(k)
        return ids

    def _short(self, symbols: list[str]) -> list[str]:
        cost, never = self.costs.get, float("inf")
        agenda = [cost(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda and (least := min(agenda)) < never:
            i = agenda.index(least)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], never)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], never)
        return symbols

    def _long(self, word: str) -> list[str]:
        cost, n = self.costs.get, len(word)
        symbols: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, word[i:i + 2], i + 1) for i in range(n - 1) if (c := cost(word[i:i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair, j = heapq.heappop(agenda)
            if symbols[i] is None or after[i] != j or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = right = after[j]
            if right < n:
                before[right] = i
                more = pair + symbols[right]
                if (c := cost(more)) is not None:
                    heapq.heappush(agenda, (c, i, more, right))
            if (left := before[i]) >= 0:
                more = symbols[left] + pair
                if (c := cost(more)) is not None:
                    heapq.heappush(agenda, (c, left, more, i))
        return [s for s in symbols if s is not None]

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.split(text or "") for i in self.merge(w)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, one leading space dropped; bytes that are no UTF-8 become U+FFFD each."""
        out: list[str] = []
        run = bytearray()

        def flush():
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        first = True
        for i in ids:
            if (b := self.values.get(i)) is not None:
                run.append(b)
                first = False
                continue
            flush()
            piece = self.names.get(i)
            if piece is not None:
                if first and piece.startswith(MARK):
                    piece = piece[1:]
                out.append(piece.replace(MARK, " "))
                first = False
        flush()
        return "".join(out)

    def check(self, words: list[str], ids: list[list[int]]) -> None:
        """Compare words with the library, which puts a space mark of its own before each text.

        A word that starts with marks is given to it with one mark less; another follows a line break, whose ids the
        library gives first.
        """
        asked = [w[1:].replace(MARK, " ") if w.startswith(MARK) else "\n" + w for w in words]
        skip = self.library.encode("\n")
        for word, own, text, theirs in zip(words, ids, asked, self.library.encode(asked, num_threads=1)):
            want = theirs if word.startswith(MARK) else theirs[len(skip):]
            if text == "":
                continue  # a lone mark: the library gives no ids for an empty text
            if own != want:
                raise ValueError(f"{word!r}: agenda {own}, library {want}")


def _utf8(data: bytes) -> str:
    """Decoded text where every byte that starts no character counts as one U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, MergeCodec] = {}


def codec(model_file: str) -> MergeCodec:
    if model_file not in _codecs:
        _codecs[model_file] = MergeCodec(model_file)
    return _codecs[model_file]


class _Remembered:
    """Ids of words as text, and decoded words; the words that are new to a batch are encoded and checked together."""

    def __init__(self, of: MergeCodec):
        self.of, self.texts, self.decoded = of, {}, {}
        self.numbers = [str(i) for i in range(of.library.get_piece_size())].__getitem__

    def learn(self, words: set[str]) -> list[str]:
        """Encode the unknown words; returns those to forget after the batch."""
        new = words.difference(self.texts)
        if len(self.texts) + len(new) > REMEMBERED:
            self.texts.clear()
            self.decoded.clear()
            new = words
        new = list(new)
        ids = self.of.merge_all(new)
        self.of.check(new, ids)
        self.texts.update(zip(new, [",".join(map(self.numbers, i)) for i in ids]))
        # decode() takes a mark off the first piece, which is only meant for the first word of a text
        self.decoded.update(zip(new, [(" " if w[0] == MARK else "") + t for w, t in zip(new, self.of.library.decode(ids, num_threads=1))]))
        return [w for w in new if len(w) > LONG]

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self.texts[w], self.decoded[w]


_memories: dict[str, _Remembered] = {}


def encoded(model_file: str, texts: list[str]) -> list[tuple[str, str]]:
    """(ids joined by commas, decoded text) of every text.

    Every character outside the vocabulary has all its bytes within one word, so decoded words can be joined.
    """
    of = codec(model_file)
    memory = _memories.setdefault(model_file, _Remembered(of))
    split = [of.split(t) for t in texts]
    long = memory.learn(set(chain.from_iterable(split)))
    ids, decoded = memory.texts.__getitem__, memory.decoded.__getitem__
    out = [(",".join(map(ids, ws)), "".join(map(decoded, ws))[1:]) for ws in split]
    memory.forget(long)
    return out


def numbers(text: str) -> np.ndarray:
    return np.array(text.split(","), np.int32) if text else np.empty(0, np.int32)


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


def tokenize(docs: DataFrame, model_file: str, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array, unless ``keep_ids`` is false), n_tokens, ids_sha256, decoded_sha256.

    No begin or end ids are added. A null or empty text has no ids, and decodes to the empty text. Ids are those of the
    sentencepiece library; a word that differs from it fails the task. Repeated rows give repeated results; a null
    doc_id stays null. Other columns are not read. ``model_file`` must be readable on every executor.
    """

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            ids, shas, decoded, counts = [], [], [], []
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                for text, back in encoded(model_file, group):
                    counts.append(text.count(",") + 1 if text else 0)
                    shas.append(sha(text))
                    decoded.append(sha(back))
                    if keep_ids:
                        ids.append(numbers(text))
            columns = [batch.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")
