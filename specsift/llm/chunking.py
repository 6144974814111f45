"""Oversized chunks cut at natural boundaries by dynamic programming.

A token is a run of characters that aren't white space.  The cuts of a text minimise the sum of boundary penalties
(paragraph, line, sentence, clause, plain word) and of the squared imbalance of the pieces, subject to at most
``limit`` tokens in each piece, of which the first ``overlap`` repeat the end of the text before.

Defined results: null, empty and blank texts come out as they are, with token_count 0; texts within the limit come out
as one piece; a text without any boundary is cut between words; one token is never cut, whatever its length; repeated
rows give repeated pieces; extra columns pass through with the first piece's row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 256, 32
TOKEN = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: Penalty of a cut after a token, by what follows or ends it.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 0.0, 0.5, 1.0, 4.0, 10.0
BALANCE = 3.0


def count(text: str | None) -> int:
    return len(text.split()) if text else 0


def penalties(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The penalty of a cut before each token; 0 before the first."""
    cost = np.full(len(spans) + 1, WORD)
    cost[0] = cost[-1] = 0
    for i in range(1, len(spans)):
        gap, token = text[spans[i - 1][1] : spans[i][0]], text[spans[i - 1][0] : spans[i - 1][1]]
        if gap.count("\n") > 1 or "\u2029" in gap:
            cost[i] = PARAGRAPH
        elif SENTENCE_END.search(token):
            cost[i] = LINE if "\n" in gap else SENTENCE
        elif "\n" in gap or "\r" in gap or "\u2028" in gap:
            cost[i] = LINE
        elif token[-1] in ",;:–—":
            cost[i] = CLAUSE
    return cost


def cuts(cost: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Starts of the pieces' own tokens, then the number of tokens: the cheapest cuts."""
    n, step = len(cost) - 1, limit - overlap
    if n <= limit:
        return [0, n]
    pieces = 1 + -(-(n - limit) // step)
    target = n / pieces
    size = BALANCE * ((np.arange(limit + 1) - target) / target) ** 2 + 0.25
    longest_first = size[1 : step + 1][::-1]
    best = np.full(n + 1, np.inf)
    back = np.zeros(n + 1, dtype=np.int64)
    best[0] = 0.0
    for end in range(1, n + 1):
        low, least, at = max(1, end - step), np.inf, 0
        if low < end:
            total = best[low:end] + longest_first[step - (end - low) :]
            k = int(total.argmin())
            least, at = total[k], low + k
        if end <= limit and size[end] <= least:  # the first piece repeats nothing and may take the whole limit
            least, at = size[end], 0
        best[end], back[end] = least + cost[end], at
    out = [n]
    while out[-1]:
        out.append(int(back[out[-1]]))
    return out[::-1]


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str | None, int, bool]]:
    """(piece, tokens, whether it repeats the end of the piece before) of a text."""
    if count(text) <= limit:
        return [(text, count(text), False)]
    spans = [m.span() for m in TOKEN.finditer(text)]
    at = cuts(penalties(text, spans), limit, overlap)
    out = []
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        first = a if k == 0 else max(0, a - overlap)
        out.append((text[spans[first][0] : spans[b - 1][1]], b - first, k > 0))
    return out


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every chunk's pieces: chunk_id, piece_no from 0, text, token_count, overlap_with_prev, oversized."""
    schema = "chunk_id string, piece_no int, text string, token_count int, overlap_with_prev boolean, oversized boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c, t in zip(batch["chunk_id"], batch["text"], strict=True):
                parts = split(t, limit, overlap)
                rows += [(c, k, *p, len(parts) > 1) for k, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "text", "token_count", "overlap_with_prev", "oversized"])

    return chunks.select("chunk_id", "text").mapInPandas(run, schema)


def found(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id of the chunks that the operator cuts."""
    return pieces(chunks, limit, overlap).where(F.col("oversized") & (F.col("piece_no") == 0)).select("chunk_id").distinct()
