"""Averaged perceptrons: a multiclass one over sparse features, and a character editor that proposes words."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable

#: What a scan turns characters into, as (written, read).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("o", "0"), ("n", "ri"), ("u", "ii"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("d", "cl"), ("i", "!"), ("s", "5"), ("s", "$"),
    ("g", "9"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("l", "!"), ("m", "rn"), ("w", "vv"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("vv", "w"),
    ("in", "m"), ("ni", "m"), ("nn", "rm"), ("b", "6"), ("b", "8"), ("z", "2"), ("q", "9"), ("o", "c"), ("c", "e"), ("y", "v"),
)


class Perceptron:
    """Multiclass averaged perceptron; features are strings, classes any hashable."""

    def __init__(self) -> None:
        self.weights: dict[object, dict[str, float]] = {}

    def fit(self, examples: list[tuple[list[str], object, tuple]], epochs: int = 4, seed: int = 3, strict: bool = False) -> Perceptron:
        """examples: features, right class, classes allowed; if strict, the right class must be ahead, a tie is a mistake."""
        now: dict = defaultdict(lambda: defaultdict(float))
        total: dict = defaultdict(lambda: defaultdict(float))
        stamp: dict = defaultdict(lambda: defaultdict(int))
        order, step = list(range(len(examples))), 0
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, right, allowed = examples[k]
                step += 1
                best = max(allowed, key=lambda c: (sum(now[c][f] for f in features), strict and c != right, str(c)))
                if best != right:
                    for c, sign in ((right, 1.0), (best, -1.0)):
                        for f in features:
                            total[c][f] += now[c][f] * (step - stamp[c][f])
                            stamp[c][f] = step
                            now[c][f] += sign
        self.weights = {c: {f: (total[c][f] + w * (step - stamp[c][f])) / max(step, 1) for f, w in fs.items()} for c, fs in now.items()}
        return self

    def score(self, features: Iterable[str], c: object) -> float:
        w = self.weights.get(c)
        return sum(w.get(f, 0.0) for f in features) if w else 0.0


def _features(word: str, i: int) -> list[str]:
    at = lambda k: word[k] if 0 <= k < len(word) else "^" if k < 0 else "$"
    c = at(i)
    return [c, f"-1{at(i - 1)}{c}", f"+1{c}{at(i + 1)}", f"3{at(i - 1)}{c}{at(i + 1)}", f"-2{at(i - 2)}{at(i - 1)}{c}", f"+2{c}{at(i + 1)}{at(i + 2)}", f"5{at(i - 2)}{at(i - 1)}{c}{at(i + 1)}{at(i + 2)}"]


#: A line break inside a word, as the editor reads it.
BREAK = "\n"


class Editor:
    """For each character read: keep it, delete it, replace it, insert beside it or, at a line break, join the lines with or
    without a hyphen, as learned from broken and noised words; compounds show where a hyphen stays."""

    #: Noised words that training takes at most, dealt over the words; broken forms of each word.
    EXAMPLES, BROKEN = 12_000, 2

    def __init__(self, words: list[str], compounds: list[str] = (), seed: int = 11) -> None:
        rng = random.Random(seed)
        noised = min(15, max(2, self.EXAMPLES // max(1, len(words))))
        self.outputs: dict[str, set[str]] = defaultdict(set)
        examples: list[tuple[str, list[str]]] = []
        for word in words:
            examples.append((word, list(word)))
            for _ in range(noised):
                examples.append(self._noise(word, rng))
        apart = random.Random(seed + 1)
        for word in words:
            for k in range(self.BROKEN if len(word) > 1 else 0):
                read, out = self._noise(word, apart) if k else (word, list(word))
                at = apart.randrange(1, max(2, len(read)))
                examples.append((read[:at] + BREAK + read[at:], [*out[:at], "", *out[at:]]))
        for word in compounds:
            for at in (i for i, c in enumerate(word) if c == "-"):
                examples.append((word[:at] + BREAK + word[at + 1 :], list(word)))
        for read, out in examples:
            for c, o in zip(read, out, strict=True):
                self.outputs[c].add(o)
        allowed = {c: tuple(sorted(o | {c})) for c, o in self.outputs.items()} | {BREAK: ("", "-")}
        rows = [(_features(read, i), o, allowed[read[i]]) for read, out in examples for i, o in enumerate(out) if len(allowed[read[i]]) > 1]
        self.model = Perceptron().fit(rows, epochs=3, seed=seed)
        self.allowed = allowed

    @staticmethod
    def _noise(word: str, rng: random.Random) -> tuple[str, list[str]]:
        """A noised word and, for each of its characters, what was written there."""
        places = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
        read, out, i = "", [], 0
        chosen = {}
        for p in rng.sample(places, min(len(places), rng.choice((1, 1, 1, 2)))):
            chosen.setdefault(p[0], p)
        while i < len(word):
            if i in chosen:
                _, a, b = chosen[i]
                read += b
                out += [a] + [""] * (len(b) - 1)
                i += len(a)
            else:
                read += word[i]
                out.append(word[i])
                i += 1
        return read, out

    def propose(self, token: str, beam: int = 24) -> list[tuple[str, int, int]]:
        """(word, first edit, last edit) of the best rated edited forms, the token itself left out.

        Edits are counted without the join of lines, their places without the break.
        """
        past = token.find(BREAK) if BREAK in token else len(token)
        states: list[tuple[float, str, int, int, int]] = [(0.0, "", -1, -1, 0)]
        for i, c in enumerate(token):
            f = _features(token, i)
            options = [(self.model.score(f, o), o) for o in self.allowed.get(c, (c,))]
            top = max(s for s, _ in options)
            new = []
            for s, text, first, last, n in states:
                for w, o in options:
                    if o == c or c == BREAK:
                        new.append((s + w - top, text + o, first, last, n))
                    elif n < 5:
                        at = i - (i > past)
                        new.append((s + w - top - 0.5, text + o, at if first < 0 else first, at, n + 1))
            new.sort(key=lambda x: -x[0])
            states = new[:beam]
        seen, out = {token}, []
        for _, text, first, last, _ in states:
            if text not in seen:
                seen.add(text)
                out.append((text, first, last))
        return out


def noises(word: str, token: str, most: int) -> bool:
    """Whether at most so many known confusions turn the word into the token."""
    states = {(0, 0): 0}
    for _ in range(len(word) + 1):
        new: dict[tuple[int, int], int] = {}
        for (i, j), k in states.items():
            if i == len(word):
                if j == len(token):
                    return True
                continue
            steps = [(1, 1, 0)] if word[i] == token[j : j + 1] else []
            steps += [(len(a), len(b), 1) for a, b in CONFUSIONS if k < most and word.startswith(a, i) and token.startswith(b, j)]
            for di, dj, dk in steps:
                at = (i + di, j + dj)
                new[at] = min(new.get(at, most + 1), k + dk)
        states = new
        if not states:
            return False
    return (len(word), len(token)) in states
