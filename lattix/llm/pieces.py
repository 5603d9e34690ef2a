"""SentencePiece encoding and decoding by a batched Viterbi recursion in numpy.

A text gets a dummy blank, blanks become U+2581, and it falls into chunks (a run of blanks with the word after it)
that no piece crosses.  Distinct chunks of equal length advance together: at every position, all piece lengths are
probed at once by substring hashes in the sorted piece keys, each candidate is given its value, and the maximum is
stored with its back pointer.

* For a unigram model a candidate's value is the best value before it plus the piece's score.
* For a BPE model the best path is the one that the merges take.  A sequence of pieces is what BPE makes of its text
  exactly if every two neighbours are what BPE makes of their text, so the recursion keeps, for every prefix, its last
  piece; a candidate is valid if its pair with the last piece before it is, and exactly one candidate is.  Pairs are
  merged once per worker and remembered.

A character without a piece becomes its UTF-8 bytes' pieces, or the unknown piece where the model has none.

Defined results: a null text is encoded like an empty one, to no tokens; decoding gives the text back but for U+2581 and
NUL (as the format has it); repeated rows are repeated; other columns pass through; an empty table gives no rows.
The model file is read on the driver and its pieces are broadcast, at most ``MAX_PIECES``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattix.llm.common import release_memory

MAX_PIECES = 1 << 20
BLANK = "▁"
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_FEW = np.uint64((1 << 20) - 1)
#: Texts are encoded in lots of about so many characters.
BATCH_CHARS = 2_500_000
NORMAL, UNKNOWN, CONTROL, BYTE, UNUSED = range(5)
# The numbers of kinds of pieces in a model file (those of user-defined pieces, 4, are not supported).
_KINDS = {1: NORMAL, 2: UNKNOWN, 3: CONTROL, 5: UNUSED, 6: BYTE}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the wire format: integers, or bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return out

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: None, 5: 4}[key & 7]
        size = varint() if size is None else size
        yield key >> 3, message[at : at + size]
        at += size


def _finished(h: np.ndarray, length) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) + np.uint64(_PRIME) * np.asarray(length, np.uint64)


@dataclass
class Pieces:
    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool  # a BPE model
    cache: dict[str, bytes] = field(default_factory=dict)  # ids of chunks as the bytes of int32
    older: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)

    def __getstate__(self):
        return {"texts": self.texts, "scores": self.scores, "kinds": self.kinds, "merges": self.merges}

    def __setstate__(self, state):
        self.__init__(**state)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a model file and its kind; settings that this encoder doesn't follow are an error."""
        with open(path, "rb") as f:
            found = list(_fields(f.read()))
        trainer = dict(_fields(next((v for n, v in found if n == 2), b"")))
        normaliser = dict(_fields(next((v for n, v in found if n == 3), b"")))
        kind = trainer.get(3, 1)
        unsupported = {
            "a model that is neither unigram nor BPE": kind not in (1, 2),
            "normalisation": bool(normaliser.get(2)),
            "no dummy prefix": not normaliser.get(3, 1),
            "removal of extra blanks": bool(normaliser.get(4, 1)),
            "unescaped blanks": not normaliser.get(5, 1),
            "blanks as suffixes": bool(trainer.get(24, 0)),
        }
        texts, scores, kinds = [], [], []
        for piece in (dict(_fields(v)) for n, v in found if n == 1):
            texts.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            kinds.append(_KINDS.get(piece.get(3, 1)))
        unsupported["user-defined pieces"] = None in kinds
        unsupported[f"more than {MAX_PIECES} pieces"] = len(texts) > MAX_PIECES
        unsupported["pieces with a blank behind a character"] = any(BLANK in t.lstrip(BLANK) for t, k in zip(texts, kinds, strict=True) if k == NORMAL)
        if what := [k for k, v in unsupported.items() if v]:
            raise ValueError(f"{path}: not supported: {', '.join(what)}")
        return cls(texts, np.array(scores), np.array(kinds), kind == 2)

    def __post_init__(self):
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == NORMAL}
        self.rank = {t: self.scores[i] for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        keys = np.array([self._key(t) for t in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        self.maybe = np.zeros(int(_FEW) + 1, bool)
        self.maybe[self.keys & _FEW] = True
        self.bytes_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.known, self.known_valid = np.array([-1]), np.array([True])
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.raw = [
            bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(BLANK, " ").encode("utf-8", "surrogatepass")
            for t, k in zip(self.texts, self.kinds, strict=True)
        ]

    @staticmethod
    def _key(text: str) -> np.uint64:
        h = 0
        for c in text:
            h = (h * _PRIME + ord(c) + 1) & _MASK
        return _finished(np.array([h], np.uint64), len(text))[0]

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the neighbours with the best joint piece are merged, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _valid(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces is what BPE makes of its text; -1 stands for nothing or an unknown character."""
        n = len(self.texts) + 1
        distinct, back = np.unique((before + 1) * n + piece + 1, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        out = self.known_valid[at]
        for k in np.flatnonzero(self.known[at] != distinct).tolist():
            key = int(distinct[k])
            valid = self.pairs.get(key)
            if valid is None:
                a, b = key // n - 1, key % n - 1
                parts = [self.texts[b]] if a < 0 else [self.texts[a], self.texts[b]]
                valid = self.pairs[key] = b < 0 or self.merged("".join(parts)) == parts
            out[k] = valid
        if len(self.pairs) > 10_000:
            self._remember()
        return out[back]

    def _remember(self) -> None:
        """Move the pairs met of late into the sorted arrays; start anew when there are very many."""
        if len(self.known) > 1_500_000:
            self.known, self.known_valid = self.known[:1], self.known_valid[:1]
        keys = np.concatenate([self.known, np.fromiter(self.pairs, np.int64, len(self.pairs))])
        valid = np.concatenate([self.known_valid, np.fromiter(self.pairs.values(), bool, len(self.pairs))])
        order = np.argsort(keys, kind="stable")
        self.known, self.known_valid = keys[order], valid[order]
        self.pairs.clear()

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """The pieces of words of one length."""
        n, w = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, n).astype(np.uint64)
        h = np.zeros((n + 1, w), np.uint64)
        for i in range(n):
            h[i + 1] = h[i] * np.uint64(_PRIME) + codes[:, i] + np.uint64(1)
        best = np.full((n + 1, w), -np.inf)
        best[0] = 0
        last = np.full((n + 1, w), -1, np.int64)
        length = np.zeros((n + 1, w), np.int32)
        powers = [pow(_PRIME, k, 1 << 64) for k in range(self.longest + 1)]
        for i in range(1, n + 1):
            m = min(i, self.longest)
            keys = np.stack([_finished(h[i] - h[i - k] * np.uint64(powers[k]), k) for k in range(1, m + 1)])
            piece = np.full(keys.shape, -1, np.int64)
            may = np.nonzero(self.maybe[keys & _FEW])  # most substrings are no pieces
            some = keys[may]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            piece[may] = np.where(self.keys[at] == some, self.key_ids[at], -1)
            there = piece >= 0
            there[0] = True  # a character alone is always possible
            value = np.full(piece.shape, -np.inf)
            k, j = np.nonzero(there)
            from_ = i - 1 - k
            if self.merges:
                ok = self._valid(last[from_, j], piece[k, j]) & (best[from_, j] == 0)
                value[k[ok], j[ok]] = 0
            else:
                lone = float(self.scores.min()) - 10
                value[k, j] = best[from_, j] + np.where(piece[k, j] >= 0, self.scores[piece[k, j]], lone)
            top = value[::-1].argmax(0)  # the longest of equals
            top = m - 1 - top
            cols = np.arange(w)
            best[i], last[i], length[i] = value[top, cols], piece[top, cols], top + 1
        # all words step back together
        at, steps, cols = np.full(w, n), [], np.arange(w)
        while at.any():
            steps.append(np.where(at > 0, last[at, cols], -2))
            at = at - length[at, cols]
        back = np.stack(steps[::-1], 1)
        there = back != -2
        out = np.split(back[there].astype(np.int32), np.cumsum(there.sum(1))[:-1])
        for j in np.flatnonzero((back == -1).any(1)):  # words with characters that have no piece
            ids, i = [], n
            while i:
                p, k = last[i, j], length[i, j]
                ids.extend([int(p)] if p >= 0 else self._spelled(words[j][i - k : i])[::-1])
                i -= k
            out[j] = np.array(ids[::-1], np.int32)
        return out

    def _spelled(self, char: str) -> list[int]:
        if not self.bytes_ids:
            return [self.unknown]
        return [self.bytes_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        every: list[str] = []
        counts = []
        for t in texts:
            before = len(every)
            if t:
                every += _CHUNK.findall(BLANK + t.replace(" ", BLANK))
            counts.append(len(every) - before)
        if not every:
            return [np.empty(0, np.int32) for _ in texts]
        seen = {c: i for i, c in enumerate(dict.fromkeys(every))}
        if len(self.cache) > 120_000:  # chunks that come again move to the newer half
            self.older, self.cache = self.cache, {}
        new: dict[int, list[str]] = {}
        for c in seen:
            if c not in self.cache:
                if c in self.older:
                    self.cache[c] = self.older[c]
                else:
                    new.setdefault(len(c), []).append(c)
        for n, words in new.items():
            step = max(1, 400_000 // n)
            for a in range(0, len(words), step):
                self.cache.update(zip(words[a : a + step], map(bytes, self.viterbi(words[a : a + step])), strict=True))
        pool = [self.cache[c] for c in seen]
        lens = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts, ids = np.cumsum(lens) - lens, np.frombuffer(b"".join(pool), np.int32)
        index = np.fromiter(map(seen.__getitem__, every), np.int64, len(every))
        n = lens[index]
        ends = np.cumsum(n)
        tokens = ids[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts[index], n)]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(tokens, stops[:-1])

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("utf-8", "replace")
        return text.removeprefix(" ")


def encode_documents(docs: DataFrame, model_path: str, *, keep: list[str]) -> DataFrame:
    """The kept columns and n_tokens, ids and round_trip (whether the ids decode to the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)), docs["text"].alias("text"))

    def encoded(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces, texts = shared.value, b.column(len(names))
        start, size, held = 0, 0, []
        for i, t in enumerate(texts):
            held.append(t.as_py())
            size += len(held[-1] or "")
            if size >= BATCH_CHARS or i + 1 == b.num_rows:
                ids = pieces.encode(held)
                same = [pieces.decode(x) == (t or "") for x, t in zip(ids, held, strict=True)]
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                kept = [b.column(k).slice(start, len(held)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lens), lists, pa.array(same)], [*names, "n_tokens", "ids", "round_trip"])
                start, size, held = i + 1, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small batches are put together: the more new chunks of a length there are, the more advance together
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(w.nbytes for w in waiting) >= BATCH_CHARS:
                yield from encoded(pa.concat_batches(waiting))
                waiting = []
        if waiting:
            yield from encoded(pa.concat_batches(waiting))
        release_memory()

    fields = rows.select(*names).schema.add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    out = rows.mapInArrow(run, fields)
    return out.toDF(*keep, "n_tokens", "ids", "round_trip")
