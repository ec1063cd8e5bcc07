"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Method: pre-tokenisation without regular expressions.  The texts of a batch become one array of code points;
a table gives each its class; the splitting rules are a small automaton whose transition functions, one per
class, form a finite set closed under composition.  A scan composes them in log2 steps (it stops once every
prefix function is constant, that is after about log2 of the longest undecided run), so all states, and from
them all boundaries, come from array look-ups.  The slices between boundaries go through pair merging by
rank, each distinct slice once (a cache per worker).  Offsets of every token in bytes are kept on demand, so
ids can be decoded and located.

The vocabulary file is a parameter: it is read once by the driver and broadcast (50,256 entries, fixed).

Defined results: a null and an empty text both give an empty list; marker strings are ordinary text; texts
of any length are encoded whole; lone surrogates are encoded as U+FFFD; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# classes of code points; the letters after an apostrophe that end a contraction have their own
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, ONE, PAIR, END = range(9)
# states: what the last code point belongs to
S_START, S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_APOSTROPHE, S_FIRST, S_DONE = range(9)


def _step(state: int, symbol: int) -> int:
    if symbol == END:
        return S_START
    if symbol == OTHER:
        return S_OTHER
    if symbol == NUMBER:
        return S_NUMBER
    if symbol == SPACE:
        return S_SPACE
    if symbol == WHITE:
        return S_WHITE
    if symbol == APOSTROPHE:  # it may start a contraction unless it continues other signs or follows a blank
        return S_OTHER if state in (S_OTHER, S_APOSTROPHE, S_SPACE) else S_APOSTROPHE
    if state == S_FIRST:  # the second letter of a two-letter contraction
        return S_DONE
    if state == S_APOSTROPHE and symbol in (ONE, PAIR):
        return S_DONE if symbol == ONE else S_FIRST
    return S_LETTER


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbol -> function number, composition of function numbers, and each function as a table."""
    functions = [tuple(_step(s, x) for s in range(9)) for x in range(9)]
    known = list(dict.fromkeys(functions))
    i = 0
    while i < len(known):  # the closure under composition
        for f in list(known):
            for g, h in ((known[i], f), (f, known[i])):
                both = tuple(h[g[s]] for s in range(9))
                if both not in known:
                    known.append(both)
        i += 1
    number = {f: n for n, f in enumerate(known)}
    compose = np.array([[number[tuple(h[g[s]] for s in range(9))] for h in known] for g in known], np.uint8)
    return np.array([number[f] for f in functions], np.uint8), compose, np.array(known, np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110001, OTHER, np.uint8)
    for o in range(0x110000):
        kind = unicodedata.category(chr(o))[0]
        if kind == "L":
            out[o] = LETTER
        elif kind == "N":
            out[o] = NUMBER
    # fixed values: the White_Space property
    for o in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[o] = WHITE
    out[0x20], out[0x27], out[0x110000] = SPACE, APOSTROPHE, END
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens start in an array of code points in which 0x110000 ends each text (it is a token too)."""
    symbol = _classes()[points]
    following = np.append(points[1:], 0x110000)
    is_one = np.isin(points, np.frombuffer(b"stmd", np.uint8))
    is_pair = (((points == ord("r")) | (points == ord("v"))) & (following == ord("e"))) | (
        (points == ord("l")) & (following == ord("l"))
    )
    symbol[is_one] = ONE
    symbol[is_pair] = PAIR
    functions, compose, tables = _automaton()
    constant = (tables == tables[:, :1]).all(axis=1)
    scan = functions[symbol]
    reach, open_ = 1, np.flatnonzero(~constant[scan])
    while len(open_):
        ahead = open_ - reach
        inside = ahead >= 0
        open_ = open_[inside]
        if not len(open_):
            break
        scan[open_] = compose[scan[ahead[inside]], scan[open_]]  # read before written: one parallel step
        open_ = open_[~constant[scan[open_]]]
        reach *= 2
    state = tables[scan, S_START]
    before = np.concatenate(([S_START], state[:-1])).astype(np.uint8)
    white = (state == S_SPACE) | (state == S_WHITE)
    was_white = (before == S_SPACE) | (before == S_WHITE)
    next_white = np.append(white[1:], False)
    next_end = np.append(points[1:] == 0x110000, True)
    start = np.ones(len(points), bool)
    same = (state == before) & ((state == S_LETTER) | (state == S_NUMBER) | (state == S_OTHER))
    start[same] = False
    start[(before == S_APOSTROPHE) & ((state == S_OTHER) | (state == S_FIRST) | (state == S_DONE))] = False
    start[(before == S_FIRST) & (state == S_DONE)] = False
    # one blank goes with the word, number or signs after it; of more white space the last stays apart
    start[(before == S_SPACE) & ~white & (state != S_START)] = False
    last = ~next_white & ~next_end
    start[white & was_white & ~last] = False
    start[points == 0x110000] = True
    return np.flatnonzero(start)


@functools.lru_cache(4)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in map(bytes.split, raw.splitlines()) if t}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging by rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As merge, by a heap over a linked list: long runs of signs or letters stay near linear."""
    import heapq

    n = len(parts)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or parts[i] is not a or parts[j] is not b:
            continue
        parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for k in (prv[i], i):
            if k >= 0 and nxt[k] < n and (r := ranks.get(parts[k] + parts[nxt[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[nxt[k]]))
    return [ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]


_cache: dict[str, list[int]] = {}
_CACHE_SLICES = 1 << 19  # the cache starts anew beyond it; results do not depend on it


def encode(texts: list[str | None], ranks: dict[bytes, int]) -> Iterator[list[int]]:
    """The ids of each text."""
    kept = [t or "" for t in texts]
    joined = "".join(kept)
    if not joined.isascii():
        joined = joined.encode("utf-8", "replace" if any(0xD800 <= ord(c) < 0xE000 for c in set(joined)) else "strict").decode()
    lengths = np.fromiter(map(len, kept), np.int64, len(kept))
    flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    points = np.insert(flat, ends, 0x110000)
    starts = boundaries(points)
    is_end = points[starts] == 0x110000
    text_of = np.cumsum(is_end) - is_end  # how many end marks lie before: their places are not in joined
    at = (starts - text_of)
    stops = np.flatnonzero(is_end)
    bounds = at.tolist()
    if len(_cache) > _CACHE_SLICES:
        _cache.clear()
    get, k = _cache.get, 0
    for stop in stops.tolist():
        ids: list[int] = []
        for i in range(k, stop):
            piece = joined[bounds[i] : bounds[i + 1]]
            got = get(piece)
            if got is None:
                got = merge(piece.encode(), ranks)
                if len(piece) <= 64:
                    _cache[piece] = got
            ids += got
        k = stop + 1
        yield ids


def decoder(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {n: t for t, n in ranks.items()}


BATCH_CHARS = 1 << 20  # texts are scanned together up to this many code points; a longer one by itself


def encode_table(documents: DataFrame, vocabulary: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids) and with_offsets also ends: where each token ends in the bytes of the text."""
    with open(vocabulary, "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(raw.value)
        size = {n: len(t) for t, n in ranks.items()} if with_offsets else {}
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, total = begin, 0
                while end < len(texts) and (end == begin or total + len(texts[end] or "") <= BATCH_CHARS):
                    total += len(texts[end] or "")
                    end += 1
                ids = list(encode(texts[begin:end], ranks))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter((n for x in ids for n in x), np.int32, int(offsets[-1]))
                columns = [doc_ids.slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if with_offsets:
                    ends = [np.cumsum([size[n] for n in x]).tolist() for x in ids]
                    columns.append(pa.array(ends, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "ends"][: len(columns)])
                begin = end

    schema = "doc_id long, ids array<int>" + (", ends array<bigint>" if with_offsets else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_table(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the texts that ids stand for."""
    with open(vocabulary, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(_ranks(raw.value))
        for b in batches:
            texts = [b"".join(map(back.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
