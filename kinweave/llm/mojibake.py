"""Garbled text from wrong character encoding (problem 2).

Method: character trigrams with interpolated smoothing are counted over the corpus and scored per word.  For
every distinct word with characters beyond ASCII each candidate chain (encode in the encoding it was read
with, decode in the one it was written in; UTF-8 twice over; UTF-8 with bytes lost) proposes an original; the
likeliest is accepted if it beats the word as it stands by a margin.  Training is in two rounds: words that
the first round restores are left out of the counts of the second, so the model is of clean text.  The margin
is validated on all clean words, each judged without its own occurrences: the words must stay, all their forms
garbled by every chain must come back.

Scale: lines meet their record within blocks of line numbers of a file, so a file of any share of the rows is
spread; the carry between blocks is one row a block.  Words are judged once each, wherever they occur.  The
trigram table has at most MAX_TRIGRAMS entries: only where the corpus has more, its rarest characters count as
one, in training and in scoring alike.

Defined results: null values are empty text; CONC adds to the value, CONT adds a line break and it; of
reloaded lines the latest ingested_at counts (ties: the greater tag and value); CONC/CONT lines before any
record of a file belong to none; words with U+FFFD or C1 control characters are garbled whether or not they
can be restored; texts of any length are read whole; an empty table gives no row.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.workspace import Workspace

BLOCK = 4096  # line numbers in a block
MAX_TRIGRAMS = 2_000_000  # what the driver collects and every task holds
POOLED = "\uffff"  # stands for the rarest characters
ROUGH = 2.0  # the first round's margin: it only keeps words out of the counts
MARGINS = tuple(1.5 + 0.25 * k for k in range(35))  # what the validation chooses from
CONTINUATIONS = ("CONC", "CONT")

# fixed values: the encodings that genealogy files were written or read in
ENCODINGS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp850", "cp852", "cp437", "mac-roman", "mac-latin2", "cp1251", "koi8-r", "cp866", "iso8859-15", "iso8859-5")


def records(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, text) of the records with a character beyond ASCII."""
    tag = F.coalesce("tag", F.lit(""))
    rows = lines.where("file_id is not null and line_no is not null").select(
        "file_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.floor(F.col("line_no") / BLOCK).alias("block"),
        tag.alias("tag"),
        F.coalesce("value", F.lit("")).alias("value"),
        "ingested_at",
        (~tag.isin(*CONTINUATIONS)).alias("is_head"),
    )
    by_block = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy("file_id", "block")
        .agg(F.max(F.when(F.col("is_head"), F.col("line_no"))).alias("last_head"))
        .select("file_id", "block", F.last("last_head", ignorenulls=True).over(by_block).alias("carried"))
    )
    order = Window.partitionBy("file_id", "block").orderBy(
        "line_no", F.desc("ingested_at"), F.desc("tag"), F.desc("value")
    )
    placed = (
        rows.withColumn("repeat", F.lag("line_no").over(order) == F.col("line_no"))
        .withColumn(
            "head",
            F.last(F.when(F.col("is_head"), F.col("line_no")), ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .where("repeat is null or not repeat")
    )
    parts = (
        placed.groupBy("file_id", "block", "head")
        .agg(
            F.collect_list(F.struct("line_no", "tag", "value")).alias("lines"),
            F.max(F.col("value").rlike(r"[^\x00-\x7f]")).alias("odd"),
        )
        # parts at the edge of a block may go with an odd part of the next
        .withColumn("open", F.col("head").isNull() | (F.col("head") == F.max("head").over(Window.partitionBy("file_id", "block"))))
        .where("odd or open")
        .join(carry, ["file_id", "block"])
        .select("file_id", F.coalesce("head", "carried").alias("line_no"), "lines", "odd")
        .where("line_no is not null")
    )
    whole = (
        parts.groupBy("file_id", "line_no")
        .agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"), F.max("odd").alias("odd"))
        .where("odd")
    )
    joined = F.aggregate(
        "lines",
        F.lit(""),
        lambda acc, x: F.concat(acc, F.when(x["tag"] == "CONT", "\n").otherwise(""), x["value"]),
    )
    return whole.select("file_id", "line_no", joined.alias("text"))


# ---- candidate chains


def _encode(text: str, encoding: str) -> bytes | None:
    """As the lenient decoders do, bytes without a meaning stand for the C1 control of that number."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _decode(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if encoding == "utf-8" or not encoding.startswith("cp125"):
            return None
        return "".join(_decode_byte(b, encoding) for b in raw)


@functools.lru_cache(1 << 13)
def _decode_byte(b: int, encoding: str) -> str:
    try:
        return bytes((b,)).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def _c1(text: str) -> bool:
    return any("\x7f" <= c < "\xa0" or c == "�" for c in text)


def _lossy(raw: bytes, model: Model) -> str | None:
    """UTF-8 of which continuation bytes were lost: the likeliest letter for each lone lead byte."""
    out, i, lost = "", 0, 0
    while i < len(raw):
        b = raw[i]
        if b < 0x80:
            out += chr(b)
            i += 1
        elif 0xC2 <= b < 0xE0:
            if i + 1 < len(raw) and 0x80 <= raw[i + 1] < 0xC0:
                out += chr((b & 31) << 6 | raw[i + 1] & 63)
                i += 2
            else:
                after = chr(raw[i + 1]) if i + 1 < len(raw) and raw[i + 1] < 0x80 else None
                options = [chr((b & 31) << 6 | x) for x in range(64)]
                out += max((c for c in options if c.isalpha()), key=lambda c: model.local(out, c, after), default="�")
                lost += 1
                i += 1
        else:
            return None
    return out if lost and "�" not in out else None


def candidates(word: str, model: Model | None = None) -> set[str]:
    """The originals that the chains propose for a word."""
    found: set[str] = set()
    raws = {e: r for e in ENCODINGS if (r := _encode(word, e)) is not None}
    for read, raw in raws.items():
        got = _decode(raw, "utf-8")
        if got is not None and got != word:
            found.add(got)
            for again in ("cp1252", "latin-1", "cp1250"):
                twice = _encode(got, again)
                if twice is not None and (more := _decode(twice, "utf-8")) is not None and more != got:
                    found.add(more)
        elif got is None and model and read in ("cp1252", "latin-1", "cp1250", "mac-roman", "cp850", "cp1251"):
            lossy = _lossy(raw, model)
            if lossy:
                found.add(lossy)
        for written in ENCODINGS:
            if written != read:
                other = _decode(raw, written)
                if other is not None and other != word:
                    found.add(other)
    return {c for c in found if not _c1(c)}


def garbled_by(word: str) -> dict[str, tuple[str, str]]:
    """Every garbled form of a word, for validation, with a chain (written, read) that makes it."""
    out: dict[str, tuple[str, str]] = {}
    for written in ("utf-8", *ENCODINGS):
        raw = _encode(word, written)
        if raw is None:
            continue
        for read in ENCODINGS:
            if read != written and (got := _decode(raw, read)) is not None and got != word and not _c1(got):
                out.setdefault(got, (written, read))
    return out


def garble(word: str) -> set[str]:
    """Every garbled form of a word."""
    return set(garbled_by(word))


class Model:
    """Interpolated character trigrams."""

    def __init__(self, trigrams: dict[str, float], alphabet: frozenset[str] | None = None):
        """alphabet: the characters that are told apart; None for all."""
        self.alphabet = alphabet
        self.three: dict[str, float] = dict(trigrams)
        self.two: Counter = Counter()
        self.before: Counter = Counter()
        self.one: Counter = Counter()
        self.first: Counter = Counter()
        for g, n in trigrams.items():
            self.before[g[:2]] += n
            self.two[g[1:]] += n
            self.first[g[1]] += n
            self.one[g[2]] += n
        self.total = sum(self.one.values()) or 1.0
        self.known = frozenset(self.one) | {"^"}
        self._memo: dict[str, float] = {}

    def step(self, g: str) -> float:
        """Log probability of the third character after the first two."""
        got = self._memo.get(g)
        if got is None:
            p1 = (self.one.get(g[2], 0.0) + 0.01) / (self.total + 20.0)
            p2 = (self.two.get(g[1:], 0.0) + 2.0 * p1) / (self.first.get(g[1], 0.0) + 2.0)
            p3 = (self.three.get(g, 0.0) + 1.0 * p2) / (self.before.get(g[:2], 0.0) + 1.0)
            got = self._memo[g] = math.log(p3)
            if len(self._memo) > 1 << 20:
                self._memo.clear()
        return got

    def _padded(self, word: str) -> str:
        return f"^^{word}$" if self.alphabet is None else "^^" + "".join(c if c in self.alphabet else POOLED for c in word) + "$"

    def score(self, word: str) -> float:
        padded = self._padded(word)
        return sum(self.step(padded[i : i + 3]) for i in range(len(padded) - 2))

    def score_without(self, word: str, n: float) -> float:
        """The score by a model that has not seen the word's own n occurrences."""
        padded = self._padded(word)
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
        own3 = Counter(grams)
        own_before, own2 = Counter(g[:2] for g in grams), Counter(g[1:] for g in grams)
        own_first, own1 = Counter(g[1] for g in grams), Counter(g[2] for g in grams)
        rest = lambda had, own: max(0.0, had - n * own)
        total, out = rest(self.total, len(grams)), 0.0
        for g in grams:
            p1 = (rest(self.one.get(g[2], 0.0), own1[g[2]]) + 0.01) / (total + 20.0)
            p2 = (rest(self.two.get(g[1:], 0.0), own2[g[1:]]) + 2.0 * p1) / (
                rest(self.first.get(g[1], 0.0), own_first[g[1]]) + 2.0
            )
            p3 = (rest(self.three.get(g, 0.0), own3[g]) + p2) / (rest(self.before.get(g[:2], 0.0), own_before[g[:2]]) + 1.0)
            out += math.log(p3)
        return out

    def local(self, done: str, c: str, after: str | None) -> float:
        padded = self._padded(f"{done}{c}{after or ''}")[:-1]
        return sum(self.step(padded[i : i + 3]) for i in range(len(done), len(padded) - 2))

    def rarest(self, word: str) -> float:
        padded = self._padded(word)
        return min(self.three.get(padded[i : i + 3], 0.0) for i in range(len(padded) - 2))

    def best(self, word: str, n: float = 0.0) -> tuple[str | None, float]:
        """The likeliest original and its gain in log likelihood over the word, n of which were counted.

        The word's own occurrences do not speak for it against an original that is attested more often in
        every part; against others only a few are left out, as a frequent word speaks for itself."""
        alone = self.score_without(word, n)
        base = self.score_without(word, min(n, 3.0)) if n > 3 else alone
        best, gain = None, 0.0
        for c in sorted(candidates(word, self)):
            g = self.score(c)
            if g - alone > gain:
                g -= alone if n <= 3 or self.rarest(c) > 2 * n else base
                if g > gain:
                    best, gain = c, g
        return best, gain


def trained(ws: Workspace, words: DataFrame, most: int = MAX_TRIGRAMS) -> Model:
    """The model of the padded trigrams of (word, n)."""
    padded = F.concat(F.lit("^^"), "word", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    counted, seen = ws.cut_counted(words.select(F.explode(grams).alias("g"), "n").groupBy("g").agg(F.sum("n").cast("double").alias("n")))
    if seen["n"] <= most:
        return Model({r.g: r.n for r in counted.collect()})
    # tell apart as many characters, most frequent first, as the bound permits; their number is one of Unicode's at most
    letters = counted.select(F.substring("g", 3, 1).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()
    kept = len(letters)
    while True:
        kept //= 2
        alphabet = frozenset("".join(r.c for r in letters[:kept])) | {"^", "$"}
        known = F.lit("".join(sorted(alphabet)))
        one = [F.when(F.instr(known, F.substring("g", i, 1)) > 0, F.substring("g", i, 1)).otherwise(POOLED) for i in (1, 2, 3)]
        squeezed, seen = ws.cut_counted(counted.groupBy(F.concat(*one).alias("g")).agg(F.sum("n").alias("n")))
        if seen["n"] <= most or not kept:
            return Model({r.g: r.n for r in squeezed.collect()}, alphabet)


def _judge(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = [model.best(w, n) for w, n in zip(b["word"], b["n"], strict=True)]
            yield pd.DataFrame({"word": b["word"], "original": [x for x, _ in best], "gain": [g for _, g in best]})

    return run


def _below(gain: float) -> int:
    """The number of margins that a gain is beyond."""
    return sum(gain > m for m in MARGINS)


def _tally(model: Model):
    """Of (word, n): (garbled, below, weight), the occurrences of clean words and of garbled forms by the
    number of margins that their gain is beyond."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for word, n in zip(b["word"], b["n"], strict=True):
                seen[False, _below(model.best(word, n)[1])] += n
                whole = model.score(word)
                for form, (written, read) in garbled_by(word).items():
                    # the word itself is a candidate of most forms; beyond the last margin no other matters
                    raw = _encode(form, read)
                    if raw is not None and whole - model.score(form) > MARGINS[-1] and _decode(raw, written) == word:
                        seen[True, len(MARGINS)] += n
                    else:
                        seen[True, _below(model.best(form)[1])] += n
            rows = [(g, k, n) for (g, k), n in seen.items()]
            yield pd.DataFrame(rows, columns=["garbled", "below", "weight"])

    return run


def validated_margin(clean: DataFrame, model: Model) -> float:
    """The margin with the fewest errors over all clean words beyond ASCII, ``clean`` (word, n): the words, each
    judged without its own occurrences, are to stay, all their garbled forms to go.  Clean words weigh as often
    as they occur, garbled forms a hundredth of that."""
    tally = clean.mapInPandas(_tally(model), "garbled boolean, below int, weight long")
    totals = tally.groupBy("garbled", "below").agg(F.sum("weight").alias("weight")).collect()
    if not totals:
        return 3.0
    wrong = [sum(r.weight * (1 if r.garbled else 100) for r in totals if r.garbled == (r.below <= i)) for i in range(len(MARGINS))]
    return min(zip(wrong, MARGINS, strict=True))[1]


def judged_words(ws: Workspace, words: DataFrame) -> DataFrame:
    """(word, original, garbled) for the words beyond ASCII; ``words`` is (word, n), written."""
    # a few bytes a word, much work: partitions by number, not by size
    tasks = 3 * words.sparkSession.sparkContext.defaultParallelism
    odd = words.where(F.col("word").rlike(r"[^\x00-\x7f]")).repartition(tasks, "word")
    first = trained(ws, words)
    rough = ws.cut(odd.select("word", "n").mapInPandas(_judge(first), "word string, original string, gain double"))
    broken = F.col("word").rlike("[\\x7f-\\x9f�]")
    dirty = rough.where(broken | (F.col("gain") > ROUGH)).select("word")
    clean = ws.cut(words.join(dirty, "word", "left_anti").where(~broken))
    model = trained(ws, clean)
    held = clean.where(F.col("word").rlike(r"[^\x00-\x7f]")).repartition(tasks, "word")
    margin = validated_margin(held, model)
    counted = odd.join(clean.select("word", F.col("n").alias("m")), "word", "left")
    counted = counted.select("word", F.coalesce("m", F.lit(0)).alias("n"))  # words left out were not counted
    judged = counted.repartition(tasks, "word").mapInPandas(_judge(model), "word string, original string, gain double")
    accepted = F.col("gain") > margin
    return ws.cut(
        judged.select("word", F.when(accepted, F.col("original")).alias("original"), (accepted | broken).alias("garbled"))
    )


def garbled_records(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, text, restored) of each garbled record; restored has the words put right that can
    be, others as they are."""
    ws = Workspace(lines.sparkSession, "mojibake")
    found = ws.cut(records(lines))
    split = lambda c: F.split(c, "(?=[ \n/,])|(?<=[ \n/,])")
    placed = found.select("file_id", "line_no", F.explode(F.array_distinct(split(F.col("text")))).alias("word")).where(
        F.col("word").rlike(r"[^\x00-\x7f]")
    )
    plain = lines.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"[^\x00-\x7f]")).select(
        F.explode(split(F.col("value"))).alias("word")
    )
    odd = found.select(F.explode(split(F.col("text"))).alias("word"))
    words = ws.cut(plain.unionByName(odd).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    judged = judged_words(ws, words).where("garbled")
    hits = placed.join(judged, "word").groupBy("file_id", "line_no").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("word", "original")))).alias("fixes")
    )
    fixed = F.array_join(F.transform(split(F.col("text")), lambda w: F.coalesce(F.try_element_at("fixes", w), w)), "")
    return found.join(hits, ["file_id", "line_no"]).select("file_id", "line_no", "text", fixed.alias("restored"))
