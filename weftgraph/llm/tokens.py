"""Encoding text with a public byte-level BPE tokenizer.

Pre-tokenisation works on codepoint-class arrays. Each class is a function from scanner states to
scanner states; functions compose associatively, so one batch of texts is cut into blocks whose
composed functions are formed side by side, chained, and replayed with known start states. No
regular expression runs. The slices between boundaries feed a cache of merged pairs.

Null and empty texts give the empty list. Special-token strings inside a text are ordinary text.
Slices are cut without loss, so ids decode back to the exact text; their offsets are not returned.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftgraph.runtime import load, ship, spread

#: Default place of the rank file; every function takes another as a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points scanned at once.
SCAN_CHARS = 1 << 21
#: Slices kept in a worker's cache before it starts afresh.
CACHE_SLICES = 400_000

# Input classes.
L, N, O, Q1, Q2, JOIN, LAST, INNER, END = range(9)
# Scanner states: nothing open, one open space, letters, numbers, others, white space, letters of a contraction still to come.
_S0, _SP, _SL, _SN, _SO, _SW, _C1, _C2, _CE = range(9)
#: White_Space code points of the Unicode standard.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag for every (class, state)."""
    nxt = np.zeros((9, 9), np.uint8)
    cut = np.ones((9, 9), bool)
    for s in range(9):
        nxt[L, s], cut[L, s] = {_C2: (_C1, False), _C1: (_CE, False), _SL: (_SL, False), _SP: (_SL, False)}.get(s, (_SL, True))
        nxt[N, s], cut[N, s] = _SN, s not in (_SN, _SP)
        nxt[O, s], cut[O, s] = _SO, s not in (_SO, _SP)
        for q, start in ((Q1, _C1), (Q2, _C2)):
            nxt[q, s], cut[q, s] = (_SO, False) if s in (_SO, _SP) else (start, True)
        nxt[JOIN, s] = _SP
        nxt[LAST, s] = _S0
        nxt[INNER, s], cut[INNER, s] = _SW, s != _SW
        nxt[END, s] = _S0
    return nxt, cut


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that runs of classes can compose to: the table of compositions, each function's values, and each class's function."""
    elements = {tuple(range(9)): 0}
    order = [tuple(range(9))]
    generators = [tuple(int(x) for x in row) for row in nxt]
    k = 0
    while k < len(order):
        for g in generators:
            f = tuple(g[x] for x in order[k])
            if f not in elements:
                elements[f] = len(order)
                order.append(f)
        k += 1
    values = np.array(order, np.uint8)
    index = elements
    table = np.array([[index[tuple(b[x] for x in a)] for b in order] for a in order], np.uint16)
    return table, values, np.array([index[g] for g in generators], np.uint16)


_NEXT, _CUT = _transitions()
_TABLE, _VALUES, _GENERATOR = _monoid(_NEXT)
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Letters, numbers, white space (as INNER) or others, for every code point."""
    global _CLASS
    if _CLASS is None:
        kinds = np.full(sys.maxunicode + 1, O, np.uint8)
        by = {"L": L, "N": N}
        category = unicodedata.category
        for cp in range(sys.maxunicode + 1):
            k = by.get(category(chr(cp))[0])
            if k is not None:
                kinds[cp] = k
        kinds[WHITE] = INNER
        _CLASS = kinds
    return _CLASS


#: Composition with one class's function, and one state's step, as flat tables over ``function * 9 + class`` and ``state * 9 + class``; entries are multiplied by 9 already.
_COMPOSE = (_TABLE[:, _GENERATOR] * 9).astype(np.uint16).reshape(-1)
_STEP = (_NEXT.T.astype(np.uint16) * 9).reshape(-1)
_CUTS = _CUT.T.reshape(-1).copy()
_CUTS[END::9] = True


def scan(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """State before each position, times 9, by an associative scan over blocks of ``width`` positions."""
    n = len(classes)
    rows = -(-n // width)
    padded = np.full(rows * width, END, np.uint16)
    padded[:n] = classes
    by_step = np.ascontiguousarray(padded.reshape(rows, width).T)
    functions = np.zeros(rows, np.uint16)
    for step in by_step:
        functions = _COMPOSE.take(functions + step)
    values = _VALUES.tolist()
    state, starts = 0, []
    for f in (functions // 9).tolist():
        starts.append(state * 9)
        state = values[f][state]
    before = np.empty((width, rows), np.uint16)
    current = np.array(starts, np.uint16)
    for j, step in enumerate(by_step):
        before[j] = current
        current = _STEP.take(current + step)
    return before.T.reshape(-1)[:n]


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Starts of all slices in ``text``, in which several texts stand one after another, each followed by one spare code point at ``ends``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _classes().take(points)
    c[ends] = END
    white = np.flatnonzero(c == INNER)
    following = c.take(white + 1)
    last = white[(following != INNER) & (following != END)]
    c[last] = np.where(points.take(last) == 32, JOIN, LAST)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        pad = np.append(points, [0, 0])
        a, b = pad[quotes + 1], pad[quotes + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        c[quotes[two]] = Q2
        c[quotes[one]] = Q1
    return np.flatnonzero(_CUTS.take(scan(c) + c))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Cache(dict):
    """Numbers of slices, in order of first sight; the ids of slice k stand at ``flat[bounds[k]:bounds[k + 1]]``."""

    def __init__(self, merge):
        self.merge = merge
        self.flat, self.bounds = array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.flat.extend(self.merge(piece.encode("utf-8", "replace")))
        self.bounds.append(len(self.flat))
        return k


class Encoder:
    """Merges of one rank file, with a cache of slices."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.cache = _Cache(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or j >= n or parts[j] is None or right[i] != j or ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = left[i]
            if h >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, i))
        return [ranks[p] for p in parts if p is not None]

    def slices(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The joined text, the starts of its slices, and the index of each text's end among them."""
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = boundaries(joined, ends)
        return joined, starts, np.searchsorted(starts, ends)

    def encode(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of ids of each."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        begin = 0
        while begin < len(texts):
            stop, chars = begin, 0
            while stop < len(texts) and (stop == begin or chars + len(texts[stop]) < SCAN_CHARS):
                chars += len(texts[stop])
                stop += 1
            joined, starts, at_end = self.slices(texts[begin:stop])
            if len(self.cache) > CACHE_SLICES:
                self.cache = _Cache(self.merge)
            places = starts.tolist()
            pieces = [joined[a:b] for a, b in pairwise(places)]
            pieces.append("\n")
            number = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
            bounds = np.array(self.cache.bounds, np.int64)
            lengths = bounds[number + 1] - bounds[number]
            lengths[at_end] = 0
            upto = np.cumsum(lengths)
            sizes.append(np.diff(upto[at_end], prepend=0))
            if not counts_only:
                shift = bounds[number] - (upto - lengths)
                parts.append(np.array(self.cache.flat, np.int32)[np.repeat(shift, lengths) + np.arange(upto[-1])])
            begin = stop
        return np.concatenate(parts), np.concatenate(sizes)

    def decode(self, ids) -> str:
        if not hasattr(self, "words"):
            self.words = {v: k for k, v in self.ranks.items()}
        return b"".join(self.words[int(i)] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder for each Python worker and broadcast rank file."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode_column(df: DataFrame, key: str, text: str, out: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """``key`` and the list of token ids of ``text``.

    Null and empty texts give the empty list; other columns of ``df`` are not carried. One pass over
    the scan without a shuffle; the rank file (under 1 MB, fixed) is broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, sizes = encoder.encode(texts)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def count_column(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", ranks_path: str = RANKS) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; 0 for null and empty texts."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            _, sizes = encoder.encode(texts, counts_only=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(sizes)], names=[*keep, out])

    return spread(df.select(*keep, text)).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_column(load(spark, sf_dir, "documents"), "doc_id", "text")
