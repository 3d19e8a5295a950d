"""Encoding a corpus with a public byte-level BPE vocabulary, without a regex.

The pre-tokeniser of the vocabulary splits a text into contractions, words,
numbers, other signs (each with one blank before it) and runs of white space.
Here that is a finite automaton: code points become symbol classes by table
look-up, each symbol is a transition function over eight states, and since
composing such functions is associative, a blocked prefix scan over the
(finite) set of composed functions gives the state before every character of a
whole batch at once.  Slices between the boundaries go through a cache to
pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Symbol classes.  A contraction sign is an apostrophe before s, t, m, d (one
# more letter) or re, ve, ll (two more).  The last white space before other
# text is apart from white space before white space or the end.
LETTER, NUMBER, SIGN, CONTRACT1, CONTRACT2, BLANK_LAST, SPACE_LAST, SPACE_MORE = range(8)
N_CLASSES = 8
FIRST = 8  # added to the class of a text's first character: the state is reset there
IDENTITY = 16

# States after a character.
DONE, IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_SPACE, AFTER_BLANK, NEED1, NEED2 = range(8)
N_STATES = 8

_RUN = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SIGN: IN_SIGNS}


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at the character."""
    if symbol == LETTER and state in (NEED1, NEED2):
        return (DONE if state == NEED1 else NEED1), False
    if symbol in _RUN:
        run = _RUN[symbol]
        return run, state not in (run, AFTER_BLANK)
    if symbol in (CONTRACT1, CONTRACT2):
        if state in (IN_SIGNS, AFTER_BLANK):
            return IN_SIGNS, False
        return (NEED1 if symbol == CONTRACT1 else NEED2), True
    if symbol == BLANK_LAST:
        return AFTER_BLANK, True
    if symbol == SPACE_LAST:
        return DONE, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generator numbers, the composition table, the functions, and the output table.

    The functions reachable by composition are few; they are numbered, so a
    composition is one look-up.
    """
    gens = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(N_CLASSES)]
    gens += [(g[DONE],) * N_STATES for g in gens]
    gens.append(tuple(range(N_STATES)))
    number = {f: i for i, f in enumerate(dict.fromkeys(gens))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    fs = np.array(list(number), dtype=np.uint8)
    comp = np.array([[number[tuple(int(g[x]) for x in f)] for g in fs] for f in fs], dtype=np.uint8)
    begins = np.zeros((N_STATES, 2 * FIRST), dtype=bool)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            begins[s, c] = _step(s, c)[1]
    begins[:, FIRST:] = True
    return np.array([number[g] for g in gens], dtype=np.uint8), comp.ravel(), fs.ravel(), begins.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space (Unicode's own set) or other sign."""
    table = np.full(0x110000, SIGN, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE_MORE
    return table


def states_before(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """The state before each position, by a blocked associative scan from DONE."""
    gen, comp, apply, _ = _automaton()
    k = int(np.sqrt(len(comp)))
    n = len(functions)
    n_blocks = -(-n // block)
    padded = np.full(n_blocks * block, gen[IDENTITY], dtype=np.uint8)
    padded[:n] = functions
    grid = padded.reshape(n_blocks, block).T.copy()
    for j in range(1, block):
        grid[j] = comp[grid[j - 1].astype(np.uint16) * k + grid[j]]
    if n_blocks == 1:
        enter = np.array([DONE], dtype=np.uint8)
    elif n_blocks <= block:
        enter = np.empty(n_blocks, dtype=np.uint8)
        state = DONE
        for b, f in enumerate(grid[-1].tolist()):
            enter[b] = state
            state = apply[f * N_STATES + state]
    else:
        enter = states_before(grid[-1], block)
    before = np.empty((block, n_blocks), dtype=np.uint8)
    before[0] = enter
    before[1:] = apply[grid[:-1].astype(np.uint16) * N_STATES + enter]
    return before.T.ravel()[:n]


def slice_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where slices begin in the code points of several non-empty texts laid end to end."""
    n = len(points)
    sym = _classes()[points]
    is_space = sym == SPACE_MORE
    last = np.zeros(n, dtype=bool)
    last[text_starts[1:] - 1] = True
    last[n - 1] = True
    # the last white space before other text of the same text
    before_other = is_space & ~last
    before_other[:-1] &= ~is_space[1:]
    at = np.flatnonzero(before_other)
    sym[at] = np.where(points[at] == 0x20, BLANK_LAST, SPACE_LAST)
    # contractions
    at = np.flatnonzero((points == 0x27) & ~last)
    if len(at):
        one = points[at + 1]
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        room = ~last[at + 1]
        two = points[np.minimum(at + 2, n - 1)]
        long = room & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        sym[at[short]] = CONTRACT1
        sym[at[long]] = CONTRACT2
    sym[text_starts] += FIRST
    gen, _, _, begins = _automaton()
    state = states_before(gen[sym])
    return np.flatnonzero(begins[state.astype(np.uint8) * (2 * FIRST) + sym])


class PairMerger(dict):
    """slice -> ids; a missing slice is merged and, if short, kept up to ``max_kept`` slices."""

    def __init__(self, ranks: dict[bytes, int], max_kept: int = 400_000):
        super().__init__()
        self.ranks = ranks
        self.max_kept = max_kept

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        known = self.ranks.get(data)
        ids = (known,) if known is not None else self.merge(data)
        if len(piece) <= 40:
            if len(self) >= self.max_kept:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merge the pair of the lowest rank, leftmost first, until none is left: n log n by a heap."""
        n = len(data)
        ranks = self.ranks
        ends = list(range(1, n + 1))  # of the part that begins at i; 0: the part is gone
        left = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (r := ranks.get(data[i : ends[j]])) is not None:
                heap.append((r, i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = ends[i]
            if j < n and (r := ranks.get(data[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, j, ends[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if ends[i] != j or ends[j] != k:
                continue
            ends[i], ends[j] = k, 0
            if k < n:
                left[k] = i
                push(i)
            if left[i] >= 0:
                push(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


_MERGERS: dict[int, PairMerger] = {}


def _merger(content: bytes) -> PairMerger:
    """One merger, with its cache, for each worker process and vocabulary."""
    key = hash(content)
    if key not in _MERGERS:
        _MERGERS[key] = PairMerger(read_ranks(content))
    return _MERGERS[key]


def encode_texts(texts: list[str], merger: PairMerger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, ids per text, ids per slice, slice starts (characters from the first text's start)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if not sizes.sum():
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.int32), np.zeros(len(texts), dtype=np.int64), none, none
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = slice_starts(points, offsets[:-1][sizes > 0])
    bounds = starts.tolist()
    pieces = map(joined.__getitem__, map(slice, bounds, chain(bounds[1:], (len(joined),))))
    found = list(map(merger.__getitem__, pieces))
    per_slice = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(per_slice.sum()))
    ends = np.concatenate([[0], np.cumsum(per_slice)])
    at = np.searchsorted(starts, offsets)
    return ids, np.diff(ends[at]), per_slice, starts


def _spans(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch where the characters so far reach ``most``."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _over_batches(df: DataFrame, text: str, path: str, field: str, make, kind: str) -> DataFrame:
    spark: SparkSession = df.sparkSession
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # fixed: the file of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(vocabulary.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for a, b in _spans(texts, 1_000_000):
                part = batch.slice(a, b - a)
                columns = [c for i, c in enumerate(part.columns) if i != at]
                new = make(merger, [t or "" for t in texts[a:b]])
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, new], names=[*names, field])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(run, f"{kept}, `{field}` {kind}" if kept else f"`{field}` {kind}")


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its token ids (array of int), without special tokens.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text; a text of any length is encoded whole; repeated
    rows stay; other columns are passed through (a column named as ``out`` is
    replaced); an empty table gives an empty table.  A narrow step: no shuffle.
    """

    def ids_of(merger: PairMerger, texts: list[str]) -> pa.Array:
        ids, per_text, _, _ = encode_texts(texts, merger)
        offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))

    keep = df.drop(out) if out != text else df
    return _over_batches(keep, text, path, out, ids_of, "array<int>")


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens (0 for null and empty)."""

    def sizes_of(merger: PairMerger, texts: list[str]) -> pa.Array:
        return pa.array(encode_texts(texts, merger)[1])

    return _over_batches(df.drop(out) if out != text else df, text, path, out, sizes_of, "bigint")


def decode_slices(ids: list[int], vocabulary: bytes) -> bytes:
    """The bytes of a list of ids."""
    back = _back(vocabulary)
    return b"".join(back[i] for i in ids)


@lru_cache(2)
def _back(vocabulary: bytes) -> dict[int, bytes]:
    return {i: b for b, i in read_ranks(vocabulary).items()}


def encode_with_offsets(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """As ``encode``, with ``slices``: array<struct<start,n_ids>>, the character at which each slice begins and its number of ids."""

    def slices_of(merger: PairMerger, texts: list[str]) -> pa.Array:
        rows = []
        for t in texts:
            ids, _, per_slice, starts = encode_texts([t], merger)
            rows.append({"ids": ids.tolist(), "starts": starts.tolist(), "sizes": per_slice.tolist()})
        return pa.array(rows, type=pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))

    return _over_batches(df.drop("encoded"), text, path, "encoded", slices_of, "struct<ids:array<int>,starts:array<bigint>,sizes:array<bigint>>")


def round_trip(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by ``same``: decoding the ids gives the text's bytes again."""
    with open(path, "rb") as f:
        content = f.read()
    ids = df.sparkSession.sparkContext.broadcast(content)

    def same_of(merger: PairMerger, texts: list[str]) -> pa.Array:
        ids_, per_text, _, _ = encode_texts(texts, merger)
        cut = np.concatenate([[0], np.cumsum(per_text)])
        back = [decode_slices(ids_[a:b].tolist(), ids.value) for a, b in zip(cut[:-1], cut[1:])]
        return pa.array([t.encode("utf-8", "surrogatepass") == b for t, b in zip(texts, back)])

    return _over_batches(df.drop("same"), text, path, "same", same_of, "boolean")
