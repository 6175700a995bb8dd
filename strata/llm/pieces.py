"""SentencePiece encoding and decoding with a score-ordered agenda of adjacent pairs.

A merge-type vocabulary is applied by always merging the adjacent pair whose joined piece has
the highest score (the leftmost of equal scores) until no adjacent pair forms a piece. Symbols
that end up outside the vocabulary fall back to their UTF-8 bytes.

Two forms of the same agenda exist: ``agenda_ids`` keeps a heap (any length, O(n log n)) and
``block_ids`` advances the agendas of many short chunks in lockstep with numpy. A text is cut
into chunks at places no piece spans (before a run of word marks, and around characters that
occur in no longer piece); this is derived from the vocabulary when it is loaded, and where it
does not hold the whole text is one chunk. Each worker keeps a bounded table of chunks it has
seen; every chunk that enters the table is compared with the sentencepiece library, batch by
batch, and one whole text a batch as well. A difference raises.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Chunks longer than this use the heap; shorter ones advance in lockstep.
LOCKSTEP = 24


class Vocabulary:
    """Pieces, scores and the table of mergeable pairs of a merge-type model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.unk = sp.unk_id()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.symbols = dict(plain)  # piece -> symbol; characters without a piece get numbers past the vocabulary
        for c in sorted(set(chain.from_iterable(plain)) - plain.keys()):
            self.symbols[c] = n + len(self.symbols)
        self.size = n
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[sp.get_score(i)], i)
        self.pairs = pairs
        self._hash(pairs)
        self.symbol_of = -np.arange(0x110000, dtype=np.int32) - 1
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        long = [p for p in plain if len(p) > 1]
        inside = set(chain.from_iterable(long))
        self.splits = not any(MARK in p.lstrip(MARK) for p in long)
        self.newline_alone = "\n" not in inside
        self.names = names

    def _hash(self, pairs: dict[int, tuple[int, int]]) -> None:
        bits = max(16, (len(pairs) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        size = (1 << bits) + 64
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.made = np.full(size, -1, np.int32)
        at = self._slot(np.fromiter(pairs, np.int64, len(pairs)))
        self.probes = 1
        for (key, (rank, made)), h in zip(pairs.items(), at.tolist()):
            k = 0
            while self.keys[h + k] != -1:
                k += 1
            self.keys[h + k], self.rank[h + k], self.made[h + k] = key, rank, made
            self.probes = max(self.probes, k + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; the last slot (rank NONE) for pairs that form no piece."""
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        out = np.full(key.shape, len(self.keys) - 1)
        seen = self.keys[at]
        hit = seen == key
        out[hit] = at[hit]
        todo = np.nonzero(~hit & (seen != -1))
        for step in range(1, self.probes):
            if not len(todo[0]):
                break
            seen, want = self.keys[at[todo] + step], key[todo]
            hit = seen == want
            found = tuple(x[hit] for x in todo)
            out[found] = at[found] + step
            todo = tuple(x[~hit & (seen != -1)] for x in todo)
        return out

    def emit(self, symbols: list[int], chunk: str) -> list[int]:
        """Symbols -> ids. Symbols without a piece (negative, or past the vocabulary) become bytes."""
        if min(symbols, default=0) >= 0 and max(symbols, default=0) < self.size:
            return symbols
        out: list[int] = []
        back = None
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
                continue
            if s >= self.size:
                back = back or {v: k for k, v in self.symbols.items()}
                c = back[s]
            else:
                c = chr(-s - 1)
            out.extend([self.bytes[b] for b in c.encode()] if self.fallback else [self.unk])
        return out

    def start(self, chunk: str) -> list[int]:
        get = self.symbols.get
        return [get(c, -ord(c) - 1) for c in chunk]


NONE = np.iinfo(np.int32).max


def agenda_ids(v: Vocabulary, chunk: str) -> list[int]:
    """Ids of one chunk by a heap of (score rank, position) over adjacent pairs."""
    sym = v.start(chunk)
    n = len(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = v.pairs
    heap = []

    def push(i: int, j: int) -> None:
        if sym[i] >= 0 and sym[j] >= 0 and (hit := pairs.get(sym[i] << 20 | sym[j])):
            heapq.heappush(heap, (hit[0], i, j, sym[i], sym[j], hit[1]))

    for i in range(n - 1):
        push(i, i + 1)
    alive = [True] * n
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and sym[i] == a and sym[j] == b):
            continue
        sym[i], alive[j] = made, False
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            push(i, k)
        if prv[i] >= 0:
            push(prv[i], i)
    return v.emit([s for s, live in zip(sym, alive) if live], chunk)


def block_ids(v: Vocabulary, chunks: list[str]) -> list[list[int]]:
    """Ids of many chunks: each round merges every chunk's best pair, so agendas advance in lockstep.

    Positions form linked lists with a sentinel at both ends; a merge touches the pair, its two
    neighbours and nothing else.
    """
    out: list = [None] * len(chunks)
    by_len: dict[int, list[int]] = {}
    for k, c in enumerate(chunks):
        if 1 < len(c) <= LOCKSTEP:
            by_len.setdefault(len(c), []).append(k)
        else:
            out[k] = agenda_ids(v, c)
    for width, at in by_len.items():
        points = np.frombuffer("".join([chunks[k] for k in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(at)
        s = np.full((n, width + 2), -1, np.int32)
        s[:, 1:-1] = v.symbol_of[points].reshape(n, width)
        nxt = np.tile(np.arange(1, width + 3, dtype=np.int32), (n, 1))
        prv = np.tile(np.arange(-1, width + 1, dtype=np.int32), (n, 1))
        live = np.zeros((n, width + 2), bool)
        live[:, 1:-1] = True
        rank = np.full((n, width + 2), NONE, np.int32)
        rank[:, 1:width] = v.rank[v.find(s[:, 1:width], s[:, 2 : width + 1])]
        row = np.arange(n)
        while True:
            i = rank[row].argmin(1)
            go = rank[row, i] < NONE
            row, i = row[go], i[go]
            if not len(row):
                break
            j = nxt[row, i]
            made = v.made[v.find(s[row, i], s[row, j])]
            k, p = nxt[row, j], prv[row, i]
            s[row, i] = made
            live[row, j] = False
            rank[row, j] = NONE
            nxt[row, i] = k
            prv[row, k] = i
            rank[row, i] = v.rank[v.find(made, s[row, k])]
            rank[row, p] = v.rank[v.find(s[row, p], made)]
        ends = np.cumsum(live.sum(1)).tolist()
        flat = s[live]
        odd = (((s < 0) | (s >= v.size)) & live).any(1).tolist()
        flat, lo = flat.tolist(), 0
        for x, hi, strange in zip(at, ends, odd):
            g = flat[lo:hi]
            out[x] = v.emit(g, chunks[x]) if strange else g
            lo = hi
    return out


class Encoder:
    """Whole texts -> ids, with a bounded table of chunks; new chunks are checked against the library."""

    def __init__(self, model_file: str, keep: int = 600_000):
        self.v = Vocabulary(model_file)
        self.keep = keep
        self.ids: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(self.v.library.get_piece_size())]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that are new, compare them with the library, and keep them."""
        if len(self.ids) + len(chunks) > self.keep:
            self.ids.clear()
        got = block_ids(self.v, chunks)
        sp = self.v.library
        # the library puts one mark before a text: a leading mark is left out, a lone one and a chunk without one go beside a newline
        plain = ["\n" if c == MARK else c[1:] if c[0] == MARK else "\n" + c for c in chunks]
        if self.v.newline_alone:
            for c, g, w in zip(chunks, got, sp.encode(plain, num_threads=1)):
                if g != (w[:1] if c == MARK else w if c[0] == MARK else w[2:]):
                    raise AssertionError(f"chunk {c!r}: {g} differs from the library's {w}")
        self.ids.update(zip(chunks, map(tuple, got)))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text. Empty text: none. Splits only where no piece can span."""
        if not text:
            return []
        alone = "\n" in text and self.v.newline_alone
        if not self.v.splits:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or text[0] == " " or MARK in text:  # a run of marks belongs to one chunk with what follows
            marked = MARK + text.replace(" ", MARK)
            return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if alone else f"{MARK}+[^{MARK}]*", marked)
        apart = MARK + text.replace(" ", " " + MARK)
        return list(filter(None, apart.replace("\n", " \n ").split(" "))) if alone else apart.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Per text: ids with the end id, and the decimal ids joined by a space."""
        many = [self.chunks(t) for t in texts]
        new = set().union(*many) - self.ids.keys() if many else set()
        if len(self.ids) + len(new) > self.keep:
            new = set().union(*many)
        if new:
            self._learn(list(new))
        ids, end, decimal = self.ids.__getitem__, self.v.eos, self.decimal.__getitem__
        out = []
        for c in many:
            got = list(chain.from_iterable(map(ids, c)))
            got.append(end)
            out.append((got, " ".join(map(decimal, got))))
        return out


def encode_documents(docs: DataFrame, model_file: str, keep: int = 600_000, batch_chars: int = 2_000_000) -> DataFrame:
    """``docs(doc_id, text)`` -> ``SCHEMA``, one row a row; other columns are ignored.

    Null text counts as empty, which encodes to the end id alone and decodes to the empty text.
    Null ids stay null, repeated rows stay repeated, an empty table gives an empty table.
    ``keep`` bounds the chunks a worker remembers, ``batch_chars`` the characters it encodes at once
    (one longer text is still encoded whole; a chunk without a space, however long, goes through the heap).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()  # millions of small tuples and no cycles; workers are reused, so it is put back
        try:
            yield from encoded(batches)
        finally:
            if was:
                gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model_file, keep)
        sp = enc.v.library
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            n, a, b = [], [], []
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= batch_chars):
                    chars += len(texts[hi])
                    hi += 1
                got = enc.encode(texts[lo:hi])
                if lo == 0 and got[0][0] != sp.encode(texts[0], add_eos=True):
                    raise AssertionError("a whole text differs from the library")
                back = sp.decode([g for g, _ in got], num_threads=1)
                n += [len(g) for g, _ in got]
                a += [hashlib.sha256(s.encode()).hexdigest() for _, s in got]
                b += [hashlib.sha256(t.encode()).hexdigest() for t in back]
                lo = hi
            yield pa.RecordBatch.from_arrays([names.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
