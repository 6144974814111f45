"""Token ids of whole texts by a public byte-level BPE vocabulary, with defined ids for empty and null texts.

Texts are split by the vocabulary's pattern and each piece is encoded by its byte-pair merges.  Long pieces without a
split (a run of thousands of letters) are encoded by tree concatenation: the halves are encoded in parallel, and the
tokens around a join are encoded again in a growing window until the window's outer tokens agree with both sides and
every two neighbours at the seams are by themselves encoded as these two.  Byte-pair encoding is determined by its
neighbouring pairs, so the result is exact, in time that grows with the length, not its square.

Defined results: null and empty texts give an empty list; strings that spell a special token are ordinary text;
repeated rows are encoded alike; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Parameter: the folder of the vocabulary files.
FOLDER = os.environ.get("SPECSIFT_TOKENIZERS", "/opt/tokenizers")
#: Texts up to this many characters hold no piece worth a tree and are encoded at once.
LONG_TEXT = 8192
#: Bytes of a leaf; longer pieces are halved.
LEAF = 2048


class Bpe:
    def __init__(self, folder: str, name: str) -> None:
        import regex
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = _pattern(folder)
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in self.ranks.items()}

    def piece(self, raw: bytes) -> list[int]:
        return self.encoding._encode_single_piece(raw)

    def encode(self, text: str | None, pool: ThreadPoolExecutor | None = None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG_TEXT:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        start = end = 0
        for m in self.split.finditer(text):
            if m.end() - m.start() > LEAF // 4:
                out += self.encoding.encode_ordinary(text[start : m.start()])
                out += self.tree(m.group().encode("utf-8"), pool)
                start = m.end()
            elif m.end() - start > LONG_TEXT:
                out += self.encoding.encode_ordinary(text[start : m.end()])
                start = m.end()
            end = m.end()
        return out + self.encoding.encode_ordinary(text[start : max(start, end)])

    def tree(self, raw: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """The ids of one long piece from the ids of its leaves, joined pairwise."""
        leaves = [raw[i : i + LEAF] for i in range(0, len(raw), LEAF)]
        parts = list(pool.map(self.piece, leaves)) if pool and len(leaves) > 1 else [self.piece(x) for x in leaves]
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 8
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.piece(b"".join(self.bytes_of[i] for i in [*left[a:], *right[:b]]))
            before = a == 0 or (middle[0] == left[a] and self.pair(left[a - 1], middle[0]))
            after = b == len(right) or (middle[-1] == right[b - 1] and self.pair(middle[-1], right[b]))
            if before and after:
                return [*left[:a], *middle, *right[b:]]
            if a == 0 and b == len(right):
                return middle
            width *= 2

    def pair(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


def _pattern(folder: str) -> str:
    """The split pattern that the folder's module names."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(2)
def load(folder: str, name: str) -> Bpe:
    return Bpe(folder, name)


def ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, threads: int = 2) -> DataFrame:
    """(doc_id, ids) of documents(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(folder, name)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t, pool) for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, ids array<int>")
