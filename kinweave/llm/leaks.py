"""Evaluation texts leaking into training text (problem 9).

Method: the words of a shard of documents become one sequence of numbers, over which an FM-index is built:
suffix array, Burrows-Wheeler transform, a wavelet tree for ranks and every SAMPLE-th suffix position.  All
phrases of PHRASE words of the evaluation items are sought at once by backward search; occurrences are located
by walking to the next sampled position.  Hits of a document and an item on one diagonal merge into runs, runs
into aligned spans that may hold changed, missing or added words (each costs PENALTY), and the spans of a pair
are counted together.  As a word costs three, an aligned span of LEAST points holds a run of PHRASE words, so
the phrases lose none.  Shorter pieces count too where they continue each other: runs in the order of the item
are chained, whatever lies between them in the text, at the cost of one word for each word of the item left
out, so a passage broken into many pieces is found and scattered common wording is not.

Scale: shards are cut from the partitions of the corpus, so the corpus is read once and never shuffled; only
the items (a fixed set, checked against MAX_ITEM_WORDS) are sent to all tasks.  Words that no item has are one
symbol, and runs of them one place, which keeps the index small.

Defined results: null, empty and blank texts contain nothing; case, punctuation, accents, markup, width and
look-alikes make no difference; repeated documents are each reported; an item of fewer than MIN_WORDS words
cannot leak; an item_id with several texts is judged by each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.visual import consistent

PHRASE = 4
PENALTY = 3
LEAST = 8
MIN_WORDS = 20
SHARD = 1 << 18  # symbols in a shard
SAMPLE = 8
MAX_ITEM_WORDS = 20_000_000

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});|\]\([^()\s]+\)")
_WORD = re.compile(r"[^\W_]+")


def _fold(word: str) -> str:
    word = word.casefold()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    if not text.isascii():
        text = consistent.__wrapped__(text)  # line breaks become spaces too
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text)


class WaveletTree:
    """Ranks and symbols of a sequence, one bit of the symbols a level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(sequence) - self.ones[-1][-1]))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbols >> (self.bits - 1 - k)) & 1
            one_low, one_high = ones[low], ones[high]
            low = np.where(bit == 1, zeros + one_low, low - one_low)
            high = np.where(bit == 1, zeros + one_high, high - one_high)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        low, here, symbol = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            before, one_low = ones[here], ones[low]
            bit = ones[here + 1] - before
            symbol = symbol * 2 + bit
            here = np.where(bit == 1, zeros + before, here - before)
            low = np.where(bit == 1, zeros + one_low, low - one_low)
        return symbol, here - low


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is the least and occurs nowhere else."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], np.diff(sequence[order]) != 0)))
    step = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        step *= 2
    return order


class FMIndex:
    def __init__(self, sequence: np.ndarray, alphabet: int):
        order = suffix_array(sequence)
        self.size = len(sequence)
        self.tree = WaveletTree(sequence[order - 1].astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=alphabet))))[:-1]
        marked = order % SAMPLE == 0
        self.marked = np.concatenate(([0], np.cumsum(marked)))
        self.is_marked = marked
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each row of phrases."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        at, steps = suffixes.copy(), np.zeros(len(suffixes), np.int64)
        open_ = np.flatnonzero(~self.is_marked[at])
        while len(open_):
            symbol, rank = self.tree.symbol_and_rank(at[open_])
            at[open_] = self.first[symbol] + rank
            steps[open_] += 1
            open_ = open_[~self.is_marked[at[open_]]]
        return self.samples[self.marked[at]] + steps


@dataclass
class Items:
    """The evaluation items as numbered words: 0 ends a shard, 1 a document, 2 is any word of no item."""

    code: dict[str, int]
    ids: list[int]
    texts: list[np.ndarray]
    phrases: np.ndarray  # the distinct phrases
    owner: np.ndarray  # for each place of a phrase its item and position, grouped by phrase
    place: np.ndarray
    start: np.ndarray

    @classmethod
    def compile(cls, rows: list[tuple[int, str]]) -> Items:
        code: dict[str, int] = {}
        ids, texts = [], []
        for item_id, text in rows:
            sequence = [code.setdefault(_fold(w), len(code) + 3) for w in words(text or "")]
            if len(sequence) >= MIN_WORDS:
                ids.append(item_id)
                texts.append(np.array(sequence, np.int64))
        grams, owner, place = [np.zeros((0, PHRASE), np.int64)], [], []
        for k, t in enumerate(texts):
            view = np.lib.stride_tricks.sliding_window_view(t, PHRASE)
            grams.append(view)
            owner += [k] * len(view)
            place += range(len(view))
        phrases, which = np.unique(np.concatenate(grams), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(phrases)))))
        return cls(code, ids, texts, phrases, np.array(owner, np.int64)[order], np.array(place, np.int64)[order], start)


def chained(runs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """The points and runs of the best chain of (place in text, place in item, words): both places go on, words that
    overlap count once, each word of the item left out costs one."""
    best: list[tuple[int, int]] = []  # points of the best chain that ends here, the run before
    for j, (p, q, n) in enumerate(runs):
        points, before = n, -1
        for i in range(j):
            p0, q0, n0 = runs[i]
            skipped = q - (q0 + n0)
            again = max(0, -skipped, p0 + n0 - p)
            if q > q0 and p > p0 and again < n:
                got = best[i][0] + n - again - max(0, skipped)
                if got > points:
                    points, before = got, i
        best.append((points, before))
    at = max(range(len(runs)), key=lambda k: best[k][0])
    total, out = best[at][0], []
    while at >= 0:
        out.append(runs[at])
        at = best[at][1]
    return total, out[::-1]


def align(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """The best local alignments of LEAST points or more, apart from each other: (words, from, to) in text."""
    same = item[:, None] == text[None, :]
    out = []
    while True:
        n, m = same.shape
        score, count, begin = (np.zeros((n + 1, m + 1), np.int32) for _ in range(3))
        begin[:] = np.arange(m + 1)
        for i in range(1, n + 1):
            hit = same[i - 1]
            diagonal = score[i - 1, :-1] + np.where(hit, 1, -PENALTY)
            above = score[i - 1, 1:] - PENALTY
            use = diagonal >= above
            best = np.where(use, diagonal, above)
            num = np.where(use, count[i - 1, :-1] + hit, count[i - 1, 1:])
            beg = np.where(use, begin[i - 1, :-1], begin[i - 1, 1:])
            for gap in (1, 2, 3):  # words added in the text
                left = best[:-gap] - PENALTY * gap
                better = np.flatnonzero(left > best[gap:])
                if len(better):
                    best[better + gap], num[better + gap], beg[better + gap] = left[better], num[better], beg[better]
            dead = best <= 0
            best[dead], num[dead] = 0, 0
            beg[dead] = np.arange(1, m + 1)[dead]
            score[i, 1:], count[i, 1:], begin[i, 1:] = best, num, beg
        k = int(score.argmax())
        i, j = divmod(k, m + 1)
        if score[i, j] < LEAST:
            return out
        matched, start = int(count[i, j]), int(begin[i, j])
        out.append((matched, start, j))
        same = same.copy() if len(out) == 1 else same
        same[:, start:j] = False  # words of the text count once
        # words of the item count once too: those that this span used
        used = np.zeros(n, bool)
        used[max(0, i - (j - start) - 3) : i] = True
        same[used] = False
        if min(same.any(axis=0).sum(), same.any(axis=1).sum()) < LEAST:  # no further span can have the points
            return out


def leaks_in_shard(items: Items, doc_ids: list[int], sequences: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, matched words, first word, end word) of each span of the pairs that share MIN_WORDS or more."""
    parts, places, docs = [], [], []
    for d, s in enumerate(sequences):
        # a run of words of no item takes one place
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 2) | (s[:-1] != 2)
        at = np.flatnonzero(keep)
        parts += [s[at], [1]]
        places += [at, [-1]]
        docs += [np.full(len(at) + 1, d)]
    text = np.concatenate([*parts, [0]]).astype(np.int64)
    place = np.concatenate([*places, [-1]]).astype(np.int64)
    doc = np.concatenate([*docs, [-1]]).astype(np.int64)
    index = FMIndex(text, len(items.code) + 3)
    low, high = index.search(items.phrases)
    hits = high - low
    phrase = np.repeat(np.arange(len(hits)), hits)
    if not len(phrase):
        return
    offset = np.arange(len(phrase)) - np.repeat(np.cumsum(hits) - hits, hits)
    where = index.locate(low[phrase] + offset)
    # every place of the phrase in the items
    many = (items.start[1:] - items.start[:-1])[phrase]
    hit = np.repeat(np.arange(len(phrase)), many)
    slot = np.repeat(items.start[phrase], many) + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
    item, item_at = items.owner[slot], items.place[slot]
    text_at = where[hit]
    # runs: neighbours on one diagonal
    order = np.lexsort((text_at, text_at - item_at, item, doc[text_at]))
    d, it, ta, ia = doc[text_at][order], item[order], text_at[order], item_at[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (ta[1:] - ia[1:] != ta[:-1] - ia[:-1]) | (ta[1:] != ta[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(order))) + PHRASE - 1
    rd, ri, rt, ra = d[first], it[first], ta[first], ia[first]
    pair = np.flatnonzero(np.concatenate(([True], (rd[1:] != rd[:-1]) | (ri[1:] != ri[:-1]))))
    total = np.add.reduceat(length, pair)
    ends = np.append(pair[1:], len(rd))
    for k in np.flatnonzero(total >= LEAST).tolist():
        a, b = int(pair[k]), int(ends[k])
        document = sequences[rd[a]]
        runs = sorted(zip(place[rt[a:b]].tolist(), ra[a:b].tolist(), length[a:b].tolist(), strict=True))
        # spans: runs in order that changed words may join, with the points they can reach at most
        spans: list[list[int]] = []
        for p, q, n in runs:
            best = None
            for s in spans:
                gap, shift = p - s[1], (p - q) - s[3]
                if -n < gap <= 24 and abs(shift) <= 6 and (best is None or s[2] > best[2]):
                    best = s
            if best is None:
                spans.append([p, p + n, n, p - q, n])
            else:
                best[1], best[3] = max(best[1], p + n), p - q
                best[2] = max(best[2] + n - PENALTY, n)
                best[4] = max(best[4], best[2])
        good = [s for s in spans if s[4] >= LEAST]
        found: list[tuple[int, int, int]] = []  # (words, from, to)
        if sum(s[1] - s[0] for s in good) >= MIN_WORDS:  # an alignment does not reach beyond its span
            found = aligned_spans(items.texts[ri[a]], document, sorted(good), int(ra[a:b].min()), int((ra[a:b] + length[a:b]).max()))
        if sum(n for n, _, _ in found) < MIN_WORDS and sum(n for _, _, n in runs) >= MIN_WORDS:
            points, pieces = chained(runs)
            found = [(n, p, p + n) for p, _, n in pieces] if points >= MIN_WORDS else []
        if sum(n for n, _, _ in found) >= MIN_WORDS:
            for n, start, stop in found:
                yield doc_ids[rd[a]], items.ids[ri[a]], n, start, stop


def aligned_spans(item: np.ndarray, document: np.ndarray, spans: list[list[int]], first: int, last: int) -> list[tuple[int, int, int]]:
    """(words, from, to) of the alignments of an item around spans of a document; the runs of the spans touch the
    words first to last of the item."""
    margin = 12
    windows: list[list[int]] = []
    for s in spans:  # joined where they overlap
        lo, hi = max(0, s[0] - margin), min(len(document), s[1] + margin)
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = max(hi, windows[-1][1])
        else:
            windows.append([lo, hi])
    places = np.concatenate([np.append(np.arange(lo, hi), -1) for lo, hi in windows])
    window = np.where(places >= 0, document[places], 0)
    part = item[max(0, first - margin) : last + margin]
    return [(n, int(places[start]), int(places[stop - 1]) + 1) for n, start, stop in align(part, window)]


def leaked_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, first_word, end_word): the aligned spans of the pairs that share MIN_WORDS
    words or more in all."""
    rows = eval_items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 6 * MAX_ITEM_WORDS:
        raise ValueError("the evaluation items are larger than what is sent to every task")
    items = Items.compile(sorted((r.item_id, r.text) for r in rows.collect()))
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        memo: dict[str, int] = {}

        def flush(ids: list[int], sequences: list[np.ndarray]) -> pd.DataFrame:
            found = list(leaks_in_shard(items, ids, sequences)) if ids else []
            return pd.DataFrame(found, columns=["doc_id", "item_id", "n_words", "first_word", "end_word"], dtype="int64")

        ids: list[int] = []
        sequences: list[np.ndarray] = []
        total = 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                codes = []
                for w in words(text):
                    c = memo.get(w)
                    if c is None:
                        c = items.code.get(_fold(w), 2)
                        if len(memo) > 1 << 18:
                            memo.clear()
                        memo[w] = c
                    codes.append(c)
                if len(codes) < PHRASE:
                    continue
                if total and total + len(codes) > SHARD:
                    yield flush(ids, sequences)
                    ids, sequences, total = [], [], 0
                ids.append(doc_id)
                sequences.append(np.array(codes, np.int64))
                total += len(codes)
        yield flush(ids, sequences)

    return (
        documents.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInPandas(run, "doc_id long, item_id long, n_words long, first_word long, end_word long")
    )


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak."""
    return leaked_spans(documents, eval_items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word): what to remove of each document, spans of all items merged."""
    from pyspark.sql import Window

    spans = leaked_spans(documents, eval_items).select("doc_id", "first_word", "end_word").distinct()
    order = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(before.isNull() | (F.col("first_word") > before), 1).otherwise(0))
    return (
        opened.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
        .drop("span")
    )
