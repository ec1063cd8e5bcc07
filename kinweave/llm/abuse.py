"""Abusive, hateful or sexual content (problem 10).

Method: gradient-boosted trees over dense features of a text: densities of lexicon classes (insults, swearing,
dehumanising words, groups of people, threats, explicit sexual words), how close they stand to the second
person, capitals, punctuation and how many words are disguised; the densities are of the whole text and of its
worst window, as one sentence among many can offend.  Disguises (digits and signs for letters, masked and
stretched letters, letters set apart) are undone before the look-up and counted.  The listed words are common
ones of seven languages.  Two more lexicons are learned from the judged texts alone: words that occur in
offending texts significantly more often, and the weights of all words and pairs near a hit, which tell offence from
sober use of the same words.  Both are learned without the fold that they are used on while the trees are
fitted.  Out-of-fold scores are calibrated by isotonic regression; a text is marked at one half.

The trees are fitted on at most MAX_LABELLED judged texts (chosen by a hash of the id); the votes of a text's
readers are averaged and weigh by their number, so readers who err are outvoted where they can be.  Every text
of the corpus is scored whole.

Defined results: null, empty and blank texts score 0 and are never marked; without any judged text, or with
only one kind of verdict, the score is the calibrated share of that verdict, none without any; a text without
a listed or learned word has no feature at all; repeated texts score alike.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.visual import consistent
from kinweave.plans.workspace import Workspace

MAX_LABELLED = 20_000
WINDOW = 12
FOLDS = 5
SIGNIFICANT = 3.5  # standard errors of the log odds from which a word counts as learned
RATHER = 4  # times as many offending texts as others that a learned word occurs in at least
SEEN = 4  # judged texts that a learned word occurs in at least

# fixed values: common words of the classes in English, French, German, Polish, Spanish, Italian and Russian
# (in Latin letters); * stands for any ending
INSULT = """scumbag* imbecile* dickhead* asshole* arsehole* moron* cretin* bastard* whore* slut* bitch* cunt* idiot* coward*
shit bullshit crap trash wanker* twat* prick* retard* loser* faggot* dumbass jerk pig swine fool dimwit halfwit scoundrel nigger* spastic tramp creep
putain* salope* connard* connasse* encule* ordure* conne merde salaud* batard* pute* cochon imbecile cretin abruti* debile*
arschloch* schlampe* wichser* hurensohn* drecksau* miststuck* scheiss* fotze* missgeburt* depp* trottel schwein* hure* vollidiot* dummkopf
kurw* skurwysyn* debil* dziwk* gnoj* smieci* idiot* szmat* suko suka chuj* cwel* kretyn* glupi* dupek frajer* swini*
puta* cabron* pendejo* gilipollas imbecil* idiota* maricon* zorra* mierda estupid* hijoputa
stronz* cazzo troia puttan* coglion* bastard* merda vaffanculo cretin* scem*
suka* blyad* mudak* idiot* pidor* tvar* debil* svoloch*"""
SWEARING = """fuck* goddamn* damn* bloody filthy disgusting pathetic worthless brainless ugly stupid lying motherfuck* bollocks piss* crappy
foutre nique* baise* gueule dumme* fick* verpiss* verdammt* verfickt* dreckig* fresse halt maul
pierdol* spierdalaj* jeba* wypierdalaj* zamknij morde ryj zasran*
jod* chinga* carajo follar fanculo porca fottut* ebat* zaeb* poshel nahuy"""
DEHUMAN = """vermin lice rat rats scum parasite* cockroach* animals subhuman* savages apes monkeys filth* garbage plague disease degenerat* inferior
vermine cafard* parasit* ungeziefer schmarotzer* untermensch* abschaum ratten robactw* pasozyt* bydl* szczur* alimanas ratas escoria parassit* feccia tarakan* skot*"""
GROUP = """immigrant* migrant* foreigner* refugee* women woman jew jews muslim* gypsies gypsy blacks whites arabs asians gays lesbians christians cripples africans mexicans kurds turks poles germans
etrangers juifs arabes noirs musulmans gens femmes refugie* migrants ausland* juden fremde* frauen fluchtling* zigeuner obcy zydzi ludzie cyganie uchodzc* kobiet*
inmigrantes judios moros mujeres extranjeros ebrei zingari donne stranieri"""
THREAT = """kill* smash stab* strangle* shoot* beat burn* hang* choke* rot throat steriliz* sterilis* exterminat* deport* gas* drown* kick* rape* die dead skull teeth bones rope hell
creve* crever tuer casser bruler pendre egorger verrecke* aufhangen umbringen vergasen abstechen gejagt totschlag* zdech* zabi* zdychaj powiesi* wygoni*
matar* muere muerete matare ammazz* crepa* ubyu sdohni"""
SEXUAL = """porn* nude* xxx cam webcam horny uncensored hardcore sex sexy naked strip* lick* suck* cock* moan* orgasm* masturbat* anal thrust* nipple*
fucked pussy tits dick blowjob* cum cums cumshot milf boobs escort* hookup* erotic* 
nackt* ficken titten sexkontakt* geil* nue nues seins bite chatte nago cyck* cipa ruchan* sperm* polla* cono desnud* tetas nuda nude figa golye siski"""
SECOND = """you your yours yourself youre u jestes bist tu te toi ton tes ta vous votre vos du dich dein* dir euch ihr ty ci cie ciebie twoj twoja twoje twoim wasz tus usted ustedes voi tuo tua tebya tvoy"""
CLASSES = {"insult": INSULT, "swearing": SWEARING, "dehuman": DEHUMAN, "group": GROUP, "threat": THREAT, "sexual": SEXUAL, "second": SECOND, "learned": ""}
NAMES = list(CLASSES)
HARSH = [NAMES.index(c) for c in ("insult", "swearing", "dehuman", "threat", "sexual", "learned")]
HARSH_BITS = sum(1 << k for k in HARSH)
LEARNED = 1 << NAMES.index("learned")

_LEET = str.maketrans("0134578@$!|€£", "oieastbasiiel")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([ ._\-])[^\W_])(?:\1[^\W_])+(?:[^\W_]*)")
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{}<>,;:?…]+")
_END = re.compile(r"[^\W\d_]{3}[.!?][.!?1]*$")
_STRETCHED = re.compile(r"([a-z])\1\1+")
_TAIL = re.compile(r"[.!?][.!?1]*$")


def _fold(word: str) -> str:
    word = word.casefold().replace("ł", "l").replace("ß", "ss").replace("œ", "oe")
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _key(word: str) -> str:
    """Letters that stand in for each other alike, stretched letters once."""
    return re.sub(r"(.)\1+", r"\1", word.replace("v", "u").replace("l", "i"))


@functools.cache
def _lexicon() -> tuple[dict[str, int], dict[str, list[tuple[str, int]]], dict[str, list[tuple[str, int]]], dict[int, dict[str, int]]]:
    """Keys of whole words -> classes as bits; beginnings, and keys of beginnings, with their bits by their first two
    letters; all of them as spelled by length, for masked words."""
    whole: dict[str, int] = {}
    begin: dict[str, int] = {}
    by_length: dict[int, dict[str, int]] = {}
    for k, text in enumerate(CLASSES.values()):
        for w in text.split():
            w = _fold(w)
            if w.endswith("*"):
                w = w[:-1]
                begin[w] = begin.get(w, 0) | 1 << k
            else:
                whole[_key(w)] = whole.get(_key(w), 0) | 1 << k
            spelled = by_length.setdefault(len(w), {})
            spelled[w] = spelled.get(w, 0) | 1 << k
    beginnings: dict[str, list[tuple[str, int]]] = {}
    keyed: dict[str, list[tuple[str, int]]] = {}
    for w, bits in begin.items():
        beginnings.setdefault(w[:2], []).append((w, bits))
        keyed.setdefault(_key(w)[:2], []).append((_key(w), bits))
    return whole, beginnings, keyed, by_length


@functools.lru_cache(1 << 17)
def _look_up(token: str) -> tuple[int, int, int, str]:
    """(class bits, disguised, shouted, the word as it is meant) of a token as it stands in the text."""
    token = _TAIL.sub("", token)
    core = token.strip(".!'’-–—_/\\*") if "*" not in token.strip("*.!'’") else token.strip(".!'’-–—_/\\")
    if not core:
        return 0, 0, 0, ""
    low = _fold(core)
    letters = low.isalpha()
    if not letters and not any(c.isalpha() for c in low):
        return 0, 0, 0, ""
    shouted = int(len(core) > 3 and core.isupper())
    whole, beginnings, keyed, by_length = _lexicon()
    odd = not letters and any(c.isdigit() or c in "@$!|€£*" for c in low)
    stretched = bool(_STRETCHED.search(low))
    if letters and not stretched:
        bits = whole.get(_key(low), 0)
        # keys merge letters: an undisguised word must be spelled as listed
        listed = by_length.get(len(low), {})
        if bits and low not in listed:
            swapped = low.replace("v", "u")
            if swapped in listed:  # v for u
                return bits, 1, shouted, swapped
            bits = 0
        for b, more in beginnings.get(low[:2], ()):
            if low.startswith(b) and len(low) <= len(b) + 5:
                bits |= more
        return bits, 0, shouted, low
    if "*" in low:
        plain = low.translate(_LEET)
        fits = lambda w: [x == y for x, y in zip(plain, w) if x != "*"]
        bits, meant = 0, plain.replace("*", "")
        for w, more in by_length.get(len(plain), {}).items():
            if all(fits(w)):
                bits, meant = bits | more, w
        for listed in beginnings.values():
            for b, more in listed:  # the beginning of a word of which two letters are shown at least
                if len(b) <= len(plain) <= len(b) + 5 and all(shown := fits(b)) and len(shown) > 1:
                    bits, meant = bits | more, b + plain[len(b) :]
        return bits, 1, shouted, meant
    spelled = "".join(c for c in (low.translate(_LEET) if odd else low) if c.isalpha())
    key = _key(spelled)
    bits = whole.get(key, 0)
    for b, more in keyed.get(key[:2], ()):
        if key.startswith(b) and len(key) <= len(b) + 5:
            bits |= more
    return bits, int(odd or stretched), shouted, _STRETCHED.sub(r"\1", spelled)


def _joined(m: re.Match) -> str:
    return m[0].replace(m[1], "")


FEATURES = [
    *(f"top_{n}" for n in NAMES), *(f"density_{n}" for n in NAMES), "top_harsh", "top_classes", "insult_second", "swearing_second",
    "threat_second", "dehuman_group", "sexual_many", "top_shouted", "top_marks", "top_disguised", "density_disguised", "context",
]
# a text does not become less offensive by more of a feature
DIRECTION = np.ones(len(FEATURES))


class Lexicon:
    """What the judged texts teach: words of offending texts, and the weight of every word near a hit."""

    def __init__(self, words: frozenset[str] = frozenset(), weights: dict[str, float] | None = None):
        self.words, self.weights = words, weights or {}


def tokens_of(text: str) -> tuple[list[str], int]:
    """The tokens of a text, letters set apart joined, and how many words were set apart."""
    if not text.isascii():
        text = consistent.__wrapped__(text.replace("\n", " "))
    apart = 0
    if _APART.search(text):
        text, apart = _APART.subn(_joined, text)
    return _TOKEN.findall(text), apart


def analysed(text: str | None, words: frozenset[str]) -> tuple[np.ndarray, list[list[str]]] | None:
    """The dense features of a text, but for the last, and the words and pairs of neighbours of each window
    around a hit, within its sentence; None where no listed or learned word occurs.  Windows that overlap are one."""
    if not text or not text.strip():
        return None
    tokens, apart = tokens_of(text)
    seen = [_look_up(t) for t in tokens]
    bits = [b | LEARNED if w in words else b for b, _, _, w in seen]
    hits = [i for i, b in enumerate(bits) if b & HARSH_BITS]
    if not hits:
        return None
    n, k = len(tokens), len(NAMES)
    bits = np.array(bits, np.int64)
    marks = [t.count("!") for t in tokens]
    columns = np.empty((n, k + 4))
    columns[:, :k] = (bits[:, None] >> np.arange(k)) & 1
    columns[:, k] = [x[1] for x in seen]
    columns[:, k + 1] = [x[2] for x in seen]
    columns[:, k + 2] = marks
    columns[:, k + 3] = bits & HARSH_BITS > 0
    sums = np.concatenate((np.zeros((1, k + 4)), np.cumsum(columns, axis=0)))
    width = min(WINDOW, n)
    win = sums[width:] - sums[:-width]
    win = win[win[:, k + 3] > 0]  # some word of the window is a hit
    cls, disguised, shouted, mark, harsh = win[:, :k], win[:, k], win[:, k + 1], win[:, k + 2], win[:, k + 3]
    col = {name: cls[:, i] for i, name in enumerate(NAMES)}
    near = np.minimum(col["second"], 2)
    x = np.array([
        *cls.max(axis=0), *(sums[-1, :k] * 100.0 / n), harsh.max(), (cls[:, HARSH] > 0).sum(axis=1).max(),
        (col["insult"] * near).max(), (col["swearing"] * near).max(), (col["threat"] * near).max(),
        (np.minimum(col["dehuman"] + col["threat"], 4) * np.minimum(col["group"], 1) * np.minimum(col["dehuman"] + col["learned"], 1)).max(),
        np.maximum(col["sexual"] - 1, 0).max(), shouted.max(), mark.max(), disguised.max() + apart, (sums[-1, k] + apart) * 100.0 / n, 0.0,
    ])
    windows: list[list[int]] = []
    for i in hits:
        lo, hi = i, i + 1
        while lo and lo > i - WINDOW and not _END.search(tokens[lo - 1]):
            lo -= 1
        while hi < n and hi <= i + WINDOW and not _END.search(tokens[hi - 1]):
            hi += 1
        if windows and lo < windows[-1][1]:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    near_hits = []
    for lo, hi in windows:
        ws = [w for _, _, _, w in seen[lo:hi] if w]
        near_hits.append(sorted({*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}))
    return x, near_hits


def context(windows: list[list[str]], weights: dict[str, float]) -> float:
    """The weight of the most offensive window."""
    return max((sum(weights.get(w, 0.0) for w in ws) for ws in windows), default=0.0)


def features(text: str | None, lexicon: Lexicon) -> np.ndarray | None:
    got = analysed(text, lexicon.words)
    if got is None:
        return None
    got[0][-1] = context(got[1], lexicon.weights)
    return got[0]


def word_weights(judged: list[tuple[list[list[str]], float, float]], rounds: int = 8, strength: float = 4.0) -> dict[str, float]:
    """Shrunken log odds of the words near hits, (windows, verdict, weight) each.  Of an offending text only the
    window that speaks most for it counts, found in turns with the weights until none changes; of others every
    window does."""
    against, sure = Counter(), Counter()
    open_: list[tuple[list[list[str]], float]] = []  # offending texts with a choice of windows
    for windows, y, w in judged:
        for ws in windows:
            for x in ws if y < 1 else ():
                against[x] += (1 - y) * w
        if y > 0 and len(windows) == 1:
            for x in windows[0]:
                sure[x] += y * w
        elif y > 0 and windows:
            open_.append((windows, y * w))
    weights: dict[str, float] = {}
    chosen = None
    for _ in range(rounds):
        worst = [max(range(len(ws)), key=lambda k: sum(weights.get(x, 0.0) for x in ws[k])) for ws, _ in open_]
        if worst == chosen:
            break
        chosen, for_ = worst, sure.copy()
        for k, (windows, weight) in zip(worst, open_, strict=True):
            for x in windows[k]:
                for_[x] += weight
        total_for, total = sum(for_.values()) or 1.0, sum(against.values()) or 1.0
        share = total_for / (total_for + total)
        weights = {
            x: min(2.5, max(-2.5, math.log((for_[x] + strength * share) / (against[x] + strength * (1 - share)) * (1 - share) / share)))
            for x in for_.keys() | against.keys()
            if for_[x] + against[x] > 1.5
        }
    return weights


# ---- trees


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, split on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 3.0, l2: float = 2.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.l2, self.bins = rounds, depth, rate, least, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip((y * w).sum() / max(w.sum(), 1e-9), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, (p - y) * w, p * (1 - p) * w, w, np.arange(len(y)), 0)
            self.trees.append(tree)
            score += self.rate * self._tree(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.append((None, -gs / (hs + self.l2)))
        if depth == self.depth or w[rows].sum() < 2 * self.least:
            return at
        best = (1e-3, None, None)
        for j in range(b.shape[1]):
            size = len(self.edges[j]) + 1
            gl = np.cumsum(np.bincount(b[rows, j], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(b[rows, j], h[rows], size))[:-1]
            wl = np.cumsum(np.bincount(b[rows, j], w[rows], size))[:-1]
            if not len(gl):
                continue
            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
            gain[(wl < self.least) | (w[rows].sum() - wl < self.least)] = 0
            rising = -(gs - gl) / (hs - hl + self.l2) >= -gl / (hl + self.l2)
            gain[rising != (DIRECTION[j] > 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return at
        left = b[rows, best[1]] <= best[2]
        tree[at] = (best[1], best[2], self._grow(tree, b, g, h, w, rows[left], depth + 1), self._grow(tree, b, g, h, w, rows[~left], depth + 1))
        return at

    def _tree(self, tree: list, b: np.ndarray, at: int = 0, rows: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        if out is None:
            out, rows = np.zeros(len(b)), np.arange(len(b))
        node = tree[at]
        if node[0] is None:
            out[rows] = node[1]
        else:
            left = b[rows, node[0]] <= node[1]
            self._tree(tree, b, node[2], rows[left], out)
            self._tree(tree, b, node[3], rows[~left], out)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + self.rate * sum(self._tree(t, b) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the steps of the non-decreasing fit, for interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, v, k in zip(score[order], y[order], w[order], strict=True):
        blocks.append([v, k, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[3] = b[3]
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.array([b[0] for b in blocks for _ in range(2)])


class Scorer:
    """The learned lexicon and the fitted trees with their calibration."""

    def __init__(self, judged: list[tuple[np.ndarray | None, list[list[str]], float, float, int]], held: list[tuple[np.ndarray | None, list[list[str]]]], words: frozenset[str]):
        """judged: features, windows, verdict, weight and fold of each text with all learned words; held: features
        and windows of each by the words learned without its fold."""
        y, w, fold = (np.array([r[i] for r in judged], float) for i in (2, 3, 4))
        self.constant = None if len(y) and 0 < (y * w).sum() < w.sum() else float((y * w).sum() / w.sum()) if len(y) else 0.0
        self.lexicon = Lexicon(words)
        if self.constant is not None:
            return
        x = np.zeros((len(y), len(FEATURES)))
        for k in range(FOLDS):
            weights = word_weights([(held[i][1], y[i], w[i]) for i in np.flatnonzero(fold != k)])
            for i in np.flatnonzero(fold == k):
                if held[i][0] is not None:
                    x[i] = held[i][0]
                    x[i, -1] = context(held[i][1], weights)
        self.lexicon = Lexicon(words, word_weights([(r[1], r[2], r[3]) for r in judged]))
        # texts without a hit are all alike: one row a fold stands for them
        hit = x.any(axis=1)
        alike = [(fold == k) & ~hit for k in range(FOLDS) if ((fold == k) & ~hit).any()]
        x = np.concatenate((x[hit], np.zeros((len(alike), len(FEATURES)))))
        y = np.concatenate((y[hit], [np.average(y[m], weights=w[m]) for m in alike]))
        w, fold = np.concatenate((w[hit], [w[m].sum() for m in alike])), np.concatenate((fold[hit], [fold[m][0] for m in alike]))
        out = np.zeros(len(y))
        for k in range(FOLDS):
            train = fold != k
            out[~train] = Boosted().fit(x[train], y[train], w[train]).score(x[~train])
        self.xs, self.ys = isotonic(out, y, w)
        self.held_out = np.interp(out, self.xs, self.ys)
        self.model = Boosted().fit(x, y, w)
        self.nothing = float(np.interp(self.model.score(np.zeros((1, len(FEATURES)))), self.xs, self.ys)[0])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        blank = np.array([not t or not t.strip() for t in texts], bool)
        if self.constant is not None:
            return np.where(blank, 0.0, self.constant)
        out = np.where(blank, 0.0, self.nothing)
        rows = [(i, x) for i, t in enumerate(texts) if (x := features(t, self.lexicon)) is not None]
        if rows:
            out[[i for i, _ in rows]] = np.interp(self.model.score(np.array([x for _, x in rows])), self.xs, self.ys)
        return out


def learned_words(judged: DataFrame) -> list[frozenset[str]]:
    """The words of offending texts, learned without each fold in turn, and last from all: those whose log odds
    are SIGNIFICANT standard errors above none.  judged: (text, y, w, fold)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (word, fold, y * w, (1 - y) * w)
                for text, y, w, fold in zip(b["text"], b["y"], b["w"], b["fold"], strict=True)
                for word in {_look_up(t)[3] for t in tokens_of(text)[0]}
                if len(word) > 2
            ]
            yield pd.DataFrame(rows, columns=["word", "fold", "yes", "no"])

    each = judged.select("text", "y", "w", "fold").mapInPandas(run, "word string, fold int, yes double, no double")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("yes", "no")]
    # words of offending texts above all: a small part of the vocabulary of at most MAX_LABELLED texts
    rows = each.groupBy("word").agg(*sums, F.sum("yes").alias("y"), F.sum("no").alias("n")).where(f"y + n >= {SEEN} and y > {RATHER} * n").collect()
    total = judged.groupBy("fold").agg(F.sum(F.col("y") * F.col("w")).alias("yes"), F.sum((1 - F.col("y")) * F.col("w")).alias("no")).collect()
    in_fold = {r.fold: (r.yes, r.no) for r in total}
    out = []
    for k in [*range(FOLDS), None]:
        all_yes, all_no = (sum(v[i] for f, v in in_fold.items() if f != k) for i in (0, 1))
        found = set()
        for r in rows:
            yes, no = r.y - (r[f"yes{k}"] if k is not None else 0.0), r.n - (r[f"no{k}"] if k is not None else 0.0)
            if yes + no >= SEEN and all_yes and all_no:
                odds = np.log((yes + 0.5) / (all_yes - yes + 0.5)) - np.log((no + 0.5) / (all_no - no + 0.5))
                if odds > SIGNIFICANT * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)):
                    found.add(r.word)
        out.append(frozenset(found))
    return out


def judged_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y, w, fold): texts with the share of their readers who were offended and their number;
    copies of a text share a fold."""
    votes = (
        labels.where("doc_id is not null and is_abusive is not null")
        .select("doc_id", "reviewer", "is_abusive")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg(F.col("is_abusive").cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    texts = documents.where("text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(votes), "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def fit(documents: DataFrame, labels: DataFrame) -> Scorer:
    judged = Workspace(documents.sparkSession, "abuse").cut(judged_texts(documents, labels))
    words = learned_words(judged)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, y, w, fold in b[["doc_id", "text", "y", "w", "fold"]].itertuples(index=False, name=None):
                for held, ws in ((False, words[-1]), (True, words[fold])):
                    got = analysed(text, ws)
                    rows.append((doc_id, held, y, w, fold, None if got is None else got[0].tolist(), [] if got is None else got[1]))
            yield pd.DataFrame(rows, columns=["doc_id", "held", "y", "w", "fold", "x", "windows"])

    schema = "doc_id long, held boolean, y double, w double, fold int, x array<double>, windows array<array<string>>"
    rows = sorted(judged.mapInPandas(run, schema).collect(), key=lambda r: (r.doc_id, r.held))
    read = lambda r: (None if r.x is None else np.array(r.x), [list(ws) for ws in r.windows])
    return Scorer([(*read(r), r.y, r.w, r.fold) for r in rows if not r.held], [read(r) for r in rows if r.held], words[-1])


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, is_abusive) of every document."""
    scorer = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = scorer.value(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": p, "is_abusive": p >= 0.5})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, is_abusive boolean")


def offending(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, labels).where("is_abusive").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score)."""
    return scored(documents, labels).groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.count_if("is_abusive").alias("n_abusive"),
        F.avg(F.col("is_abusive").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
