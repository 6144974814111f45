"""Text decoded with the wrong character encoding: detection and repair.

A multinomial naive Bayes classifier over hashed byte bigrams is trained on synthetically garbled records and predicts
the exact encoding chain of each non-ASCII run of a line (runs of one line share their evidence), or that it is sound.
The predicted chain is inverted and the inversion is kept only if it decodes strictly; if it doesn't, the next chain is
taken, down to the class of sound text, which ends the search.  Inverted text is put to the classifier again.

Records.  ``records`` are sound runs with their neighbours, drawn from the corpus (a bounded sample, see
``encoding_pages.trained``); characters that a small corpus lacks are drawn from the inventory below.  Each is garbled by
every chain.  The classes' priors are estimated by expectation maximisation over runs of the corpus as they stand.

Defined results: null text gives (no case, null); empty or ASCII-only text is unchanged and no case; repeated rows are
judged one by one; a run that holds U+FFFD is a case that can't be inverted (it is refilled where its context in the
rest of the corpus names one character, else left as it is).
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Characters of ordinary technical prose beyond ASCII, in contexts in which they are written.
INVENTORY = (
    "’s “ ” ‘ ’ – — … • · ° °C ± × ÷ ² ³ µ μ µs €5 £ ¥ § © ® ™ ≤ 5 ≥ 5 ≠ ≈ − ∞ √ ∑ → Γ Δ Ω α β γ δ θ λ π σ φ ω cm²/(V·s) ½ ¼ "
    "café naïve résumé façade über Zoë Ångholm Señal crème protégé Môlen Brünn Süd garçon fête œuvre cœur Straße Größe für "
    "prüfen schöne Änderung Öl Übung niño mañana acción ¿qué ¡no! corazón São João não ação maçã Łódź żółty čeština řeka "
    "šest žena ő ű ğ ı ş İstanbul требование задача система проверка отчёт работа и не на ключ ﬁ ﬂ « » ‹ › „ ‚ † ‡ ‰ ¬ ¡ ¿ ª º"
).split(" ")

#: Single-byte encodings that UTF-8 text may have been read with; a chain is a sequence of such readings.
CHAINS: tuple[tuple[str, ...], ...] = (
    ("cp1252",), ("latin-1",), ("cp1250",), ("cp1251",), ("cp437",), ("cp850",), ("mac-roman",), ("cp866",), ("koi8-r",),
    ("iso8859-15",), ("cp1254",), ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp437", "cp437"),
)
#: Classes beside the chains: sound text, text with U+FFFD, Windows readings that dropped bytes their code page leaves undefined.
CLEAN, LOSSY, DROPPED = len(CHAINS), len(CHAINS) + 1, len(CHAINS) + 2
CLASSES = len(CHAINS) + 3
#: Share of each class before any run was seen, as a number of runs: sound text is usual, so are the two western readings.
PRIOR_RUNS = tuple(200.0 if c in (("cp1252",), ("latin-1",)) else 2.0 for c in CHAINS) + (2000.0, 20.0, 20.0)
#: Invisible marks and spaces that stand beside sound characters.
MARKS = "\u00a0\u2007\u202f\u200b\u200c\u200d\u2060\ufeff\u00ad"
BUCKETS = 1 << 13
ENTITY = re.compile(r"&(#\w+|\w+);")
RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(None)
def table(codec: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a codec and their bytes; undefined bytes read as the control of the same number."""
    chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def garble(text: str, chain: tuple[str, ...]) -> str:
    for codec in chain:
        chars = table(codec)[0]
        text = "".join(chars[b] for b in text.encode("utf-8"))
    return text


def invert(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before the chain, or None unless every step decodes strictly."""
    for codec in reversed(chain):
        codes = table(codec)[1]
        try:
            text = bytes([codes[c] for c in text]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def features(run: str) -> np.ndarray:
    """Hashed bigrams of the run's UTF-8 bytes, with one neighbour of each side where it is given."""
    b = np.frombuffer(run.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(0, dtype=np.int64)
    pair = b[:-1] * 256 + b[1:]
    pair = pair[(b[:-1] >= 128) | (b[1:] >= 128)]
    return (pair * 0x9E3779B1 >> 7) % BUCKETS


def sound(run: str) -> bool:
    """Whether no part of a run can be inverted by any chain, so that it can teach what sound text is."""
    return "\ufffd" not in run and refill(run) is None and not any(invert(run[i:j], c) is not None for c in CHAINS for i in range(len(run)) for j in range(i + 2, min(len(run), i + PIECE) + 1))


@dataclass
class Garble:
    """The trained classifier.

    ``records`` are sound runs in their context, ``seen`` runs as they stand, for the priors; ``copies`` bounds the
    synthetic records of a class and inventory word.
    """

    copies: int = 12
    seed: int = 7
    records: tuple[str, ...] = ()
    seen: tuple[str, ...] = ()
    logp: np.ndarray = field(init=False, repr=False)
    prior: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        rng = random.Random(self.seed)
        counts = np.full((CLASSES, BUCKETS), 0.02)
        texts = [rng.choice(" e\n“") + word + rng.choice(" s.,\n") for word in INVENTORY for _ in range(self.copies)]
        for text in [*texts, *self.records]:
            for k, chain in enumerate(CHAINS):
                np.add.at(counts[k], features(garble(text, chain)), 1)
            np.add.at(counts[CLEAN], features(text), 1)
            np.add.at(counts[LOSSY], features(RUN.sub("\ufffd", text)), 1)
            if (lost := garble(text, ("cp1252",)).translate(NO_UNDEFINED)) != garble(text, ("cp1252",)):
                np.add.at(counts[DROPPED], features(lost), 1)
        for text in texts:
            mark = rng.choice(MARKS)
            np.add.at(counts[CLEAN], features(mark + text.strip() + mark), 0.2)
        self.logp = np.log(counts / counts.sum(1, keepdims=True))
        self._cache: dict[str, np.ndarray] = {}
        self.prior = np.log(np.array(PRIOR_RUNS) / sum(PRIOR_RUNS))
        for _ in range(3 if self.seen else 0):
            n = np.array(PRIOR_RUNS)
            for run in self.seen:
                s = self.logp[:, features(run)].sum(1) + self.prior
                p = np.exp(s - s.max())
                n += p / p.sum()
            self.prior = np.log(n / n.sum())

    def scores(self, run: str) -> np.ndarray:
        """Log likelihood and prior of each class."""
        got = self._cache.get(run)
        if got is None:
            if len(self._cache) > 50_000:
                self._cache.clear()
            got = self._cache[run] = self.logp[:, features(run)].sum(1) + self.prior
        return got


#: The most characters that one character becomes: four bytes, of which each becomes three when read twice.
PIECE = 12
#: Characters whose last byte may have been dropped, likeliest first; and bytes that some decoders drop because their code page leaves them undefined.
CLOSERS = "”‑‐"
UNDEFINED = b"\x81\x8d\x8f\x90\x9d"
NO_UNDEFINED = dict.fromkeys(UNDEFINED)


def refill(run: str, codec: str = "cp1252") -> str | None:
    """The text of a run that lost one undefined byte of a three-byte character, if only one byte fits."""
    codes = table(codec)[1]
    try:
        raw = bytes([codes[c] for c in run])
    except KeyError:
        return None
    if not (len(raw) >= 2 and raw[-2] in (0xE2, 0xE1, 0xE3) and 0x80 <= raw[-1] < 0xC0):
        return None
    fits = []
    for extra in UNDEFINED:
        try:
            text = (raw + bytes([extra])).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text[-1] in CLOSERS:
            fits.append(text)
    return min(fits, key=lambda x: CLOSERS.index(x[-1])) if fits else None


@dataclass
class Repair:
    model: Garble = field(default_factory=Garble)
    _judged: dict[tuple[str, ...], tuple[list[str], bool]] = field(default_factory=dict)

    def line(self, line: str) -> tuple[str, bool]:
        """The repaired line and whether anything in it was garbled, also where the garble was escaped as entities."""
        if "&" in line and ENTITY.search(line):
            plain = html.unescape(line)
            if plain != line and (got := self._line(plain))[1]:
                return got
        return self._line(line)

    def _line(self, line: str) -> tuple[str, bool]:
        runs = list(RUN.finditer(line))
        if not runs:
            return line, False
        key = tuple([line[max(0, m.start() - 1) : m.end() + 1] for m in runs])
        judged = self._judged.get(key)
        if judged is None:
            if len(self._judged) > 100_000:
                self._judged.clear()
            total = sum((self.model.scores(x) for x in key), np.zeros(CLASSES))
            each = [self._run(m.group(), ctx, total) for m, ctx in zip(runs, key, strict=True)]
            judged = self._judged[key] = ([x for x, _ in each], any(b for _, b in each))
        fixed, bad = judged
        if not bad:
            return line, False
        out, last = [], 0
        for m, x in zip(runs, fixed, strict=True):
            out += [line[last : m.start()], x]
            last = m.end()
        return "".join([*out, line[last:]]), True

    def _run(self, run: str, ctx: str, total: np.ndarray, depth: int = 2) -> tuple[str, bool]:
        """The run inverted by the likeliest class that can be, and whether one likelier than sound text could."""
        if "\ufffd" in run:
            return run, True
        own = self.model.scores(ctx)
        for k in np.argsort(-(own + 0.25 * (total - own)), kind="stable"):
            if k == CLEAN:
                break
            got = None if k == LOSSY else refill(run) if k == DROPPED else self._inverted(run, CHAINS[k])
            if got is not None:
                return (self._again(got, depth - 1) if depth else got), True
        return run, False

    def _inverted(self, run: str, chain: tuple[str, ...]) -> str | None:
        """The run before a chain; if sound characters stand among garbled ones, they stay."""
        got = invert(run, chain)
        if got is not None:
            return got if plausible(got) else None
        out, i, hit = [], 0, False
        while i < len(run):
            piece = next((g for j in range(min(len(run), i + PIECE), i + 1, -1) if (g := invert(run[i:j], chain)) is not None and plausible(g)), None)
            if piece is None:
                out.append(run[i])
                i += 1
                continue
            j = next(j for j in range(min(len(run), i + PIECE), i + 1, -1) if invert(run[i:j], chain) == piece)
            out.append(piece)
            i, hit = j, True
        return "".join(out) if hit else None

    def _again(self, text: str, depth: int) -> str:
        """A reading that was itself garbled is put to the classifier again."""

        def one(m: re.Match) -> str:
            ctx = text[max(0, m.start() - 1) : m.end() + 1]
            return self._run(m.group(), ctx, self.model.scores(ctx), depth)[0]

        return RUN.sub(one, text)

    def text(self, text: str | None) -> tuple[str | None, bool]:
        if not text or (text.isascii() and not ENTITY.search(text)):
            return text, False
        fixed = [self.line(x) for x in text.split("\n")]
        return "\n".join(x for x, _ in fixed), any(b for _, b in fixed)


def plausible(text: str) -> bool:
    """Whether an inversion gave characters of prose: Latin, Greek, Cyrillic, punctuation, symbols, CJK or emoji."""
    return all(
        0xA0 <= (o := ord(c)) < 0x180 or o in (0x192, 0x2C6, 0x2DC, 0xFEFF, 0xFE0F) or 0x218 <= o < 0x21C or 0x370 <= o < 0x530 or 0x1E00 <= o < 0x2300
        or 0x2460 <= o < 0x2800 or 0x3000 <= o < 0xD7A4 or 0xFB00 <= o < 0xFB07 or 0xFF01 <= o < 0xFFE7 or o >= 0x1F000 or o < 0x80
        for c in text
    )
