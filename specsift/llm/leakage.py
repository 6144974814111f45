"""Evaluation passages inside training texts, found through an FM-index of each training shard.

Texts and items are reduced to words without regard to case, punctuation, markup, layout, invisible marks and
look-alike letters.  A shard is the word sequence of some thousand texts.  Its suffix order gives the Burrows-Wheeler
transform, whose ranks a wavelet matrix answers; every window of ``RUN`` item words is searched backwards, all windows
at once; occurrences are located by walking to sampled suffix positions; and overlapping windows are merged into spans.
Words that no item holds are one symbol, and stretches of item words shorter than ``RUN`` can't hold a passage and are
folded into it, so an index is small though every word of every text is read.

The items are a stated evaluation set.  Their bytes are counted before they are sent to the tasks; sets of more than
``ITEM_BYTES`` are dealt over several passes, each of which sends its share.

Defined results: null and empty texts or items match nothing; items of fewer than ``RUN`` words match nothing; repeated
documents are reported each; a passage that several items share is reported for each; a text of any length is searched
whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specsift.llm.lookalikes import INVISIBLE, LATIN_OF

RUN = 10
#: Bytes of item texts that a pass sends to the tasks; windows and numbers take some 40 times as many there.
ITEM_BYTES = 4_000_000
SHARD_WORDS = 1_000_000
SAMPLE = 8
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
ENTITY = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+\d?);")
BROKEN = re.compile(r"(?<=[^\W\d_])[-¬\u2010\u2011]\s*\n[ \t>|*#]*(?=[^\W\d_])")
DROP = {ord(c): None for c in INVISIBLE}
FOLD = DROP | {ord(a): b for a, b in LATIN_OF.items()}


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(DROP)).translate(FOLD)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        import html

        text = ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "-\n" in text or "¬" in text or "- \n" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.lower())


class WaveletMatrix:
    """Ranks of any symbol in a sequence of small integers, for many positions at once."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.bits, self.zeros = [], []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.int32)
            ones = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append((level, ones))
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before position at[k]."""
        low, high = np.zeros_like(at), at.copy()
        for (level, ones), zeros in zip(self.bits, self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out, pos = np.zeros_like(at), at.copy()
        for (level, ones), zeros in zip(self.bits, self.zeros, strict=True):
            one = ones[pos + 1] > ones[pos]
            out |= one.astype(at.dtype) << level
            pos = np.where(one, zeros + ones[pos], pos - ones[pos])
        return out


class FmIndex:
    """Backward search over a word sequence that ends in the only 0; suffixes are sorted by prefix doubling."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        n = len(seq)
        rank, width = seq.astype(np.int64), 1
        suffix = np.argsort(rank, kind="stable")
        while width < n:
            second = np.full(n, -1, dtype=np.int64)
            second[: n - width] = rank[width:]
            suffix = np.lexsort((second, rank))
            a, b = rank[suffix], second[suffix]
            new = np.zeros(n, dtype=np.int64)
            new[suffix[1:]] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            rank, width = new, width * 2
            if new[suffix[-1]] == n - 1:
                break
        self.n = n
        self.less = np.zeros(top + 2, dtype=np.int64)
        self.less[1:] = np.cumsum(np.bincount(seq, minlength=top + 1))
        last = seq[suffix - 1]  # the word before each suffix, cyclically
        self.ranks = WaveletMatrix(last.astype(np.int64), top)
        marked = suffix % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = suffix[marked]
        self.is_marked = marked

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase, a row of word numbers."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.less[c] + self.ranks.rank(c, low[alive])
            high[alive] = self.less[c] + self.ranks.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        dead = np.ones(len(phrases), dtype=bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking backwards to sampled suffixes."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.is_marked[rows])
        while len(todo):
            c = self.ranks.get(rows[todo])
            rows[todo] = self.less[c] + self.ranks.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.is_marked[rows[todo]]]
        return self.samples[self.marked[rows]] + steps


class Items:
    """The windows of all items as word numbers: 0 ends a shard, 1 separates texts, 2 is any word that no item holds."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.number: dict[str, int] = {}
        of: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 3) for x in words(text)]
            for i in range(len(w) - RUN + 1):
                owners = of[tuple(w[i : i + RUN])]
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.top = len(self.number) + 2
        self.windows = np.array(list(of), dtype=np.int64).reshape(-1, RUN)
        self.owners = list(of.values())


def compact(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that may belong to a passage and their positions; each stretch of others becomes one 2."""
    known = numbers > 2
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= RUN
    out, at = [], []
    for a, b in zip(starts[long], ends[long], strict=True):
        out += [np.full(1, 2, dtype=np.int64), numbers[a:b]]
        at += [np.array([a - 1]), np.arange(a, b)]
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(shard: list[tuple[int, np.ndarray, np.ndarray]], items: Items) -> list[tuple[int, int, int, int]]:
    """(doc_id, item_id, first word, last word) of the merged spans in a shard of (doc_id, numbers, positions)."""
    if not shard or not len(items.windows):
        return []
    seq = np.concatenate([*(x for _, s, _ in shard for x in (np.ones(1, np.int64), s)), np.zeros(1, np.int64)])
    begin = np.cumsum([0] + [len(s) + 1 for _, s, _ in shard])
    index = FmIndex(seq, items.top)
    low, high = index.search(items.windows)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return []
    sizes = high[hit] - low[hit]
    rows = np.repeat(low[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    which, pos = np.repeat(hit, sizes), index.locate(rows)
    doc = np.searchsorted(begin, pos, side="right") - 1
    starts = defaultdict(list)
    for w, p, d in zip(which.tolist(), pos.tolist(), doc.tolist(), strict=True):
        at = int(shard[d][2][p - begin[d] - 1])
        for item in items.owners[w]:
            starts[d, item].append(at)
    out = []
    for (d, item), found in starts.items():
        found.sort()
        first = last = found[0]
        for p in [*found[1:], None]:
            if p is None or p > last + RUN:
                out.append((shard[d][0], item, first, last + RUN - 1))
                first = p
            last = p
    return out


def spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): each passage of an item in a document, words counted from 0."""
    told = eval_items.where("item_text is not null").select("item_id", "item_text")
    parts = max(1, -(-(told.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) // ITEM_BYTES))
    passes = [_pass(documents, told.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == p)) for p in range(parts)]
    return reduce(DataFrame.unionByName, passes)


def _pass(documents: DataFrame, told: DataFrame) -> DataFrame:
    """The spans of a share of the items that may be sent to the tasks."""
    items = Items(sorted((r[0], r[1]) for r in told.collect()))
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        get = items.number.get
        shard: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        columns = ["doc_id", "item_id", "first_word", "last_word"]
        for batch in batches:
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                said = words(text)
                seq, at = compact(np.fromiter(map(get, said, repeat(2)), np.int64, len(said)))
                if len(seq):
                    shard.append((d, seq, at))
                    held += len(seq) + 1
                if held >= SHARD_WORDS:
                    yield pd.DataFrame(search(shard, items), columns=columns)
                    shard, held = [], 0
        yield pd.DataFrame(search(shard, items), columns=columns)

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint, first_word int, last_word int")


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage of an item."""
    return spans(documents, eval_items).select("doc_id", "item_id").distinct()
