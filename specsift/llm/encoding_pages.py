"""Pages whose text was decoded with a wrong encoding, found and restored by the trained chain classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specsift.llm.encoding import RUN, Garble, Repair, sound

#: Texts without any of these can't be garbled, so Python never sees them.
LOST = "\ufffd"
NOT_ASCII = re.compile("[^\\x00-\\x7f]")
SUSPECT = "[^\\x00-\\x7f]|&#?\\w+;"


#: Bounds of what the classifier learns from: distinct runs of the corpus, each of at most so many characters.
RECORDS, RECORD_LENGTH = 4_000, 40
CONTEXT_RUN = "[\\x00-\\x7f]?[^\\x00-\\x7f]+[\\x00-\\x7f]?"


@lru_cache(1)
def repair() -> Repair:
    """The classifier of the inventory alone, for keys that other operators compare."""
    return Repair()


def trained(pages: DataFrame, text: str = "raw_text") -> Broadcast:
    """The classifier, trained on garbled records of a corpus and sent to the tasks.

    The records are at most ``RECORDS`` distinct non-ASCII runs with their neighbours, in the order of a hash of the run;
    those that are sound by themselves are garbled by every chain, and all of them give the classes' priors.
    """
    runs = pages.where(F.octet_length(text) > F.length(text)).select(F.explode(F.regexp_extract_all(text, F.lit(CONTEXT_RUN), 0)).alias("run"))
    some = runs.where(F.length("run") <= RECORD_LENGTH).distinct().orderBy(F.xxhash64("run"), "run").limit(RECORDS).collect()
    seen = tuple(r.run for r in some)
    return pages.sparkSession.sparkContext.broadcast(Repair(model=Garble(records=tuple(x for x in seen if sound(RUN.search(x).group())), seen=seen)))


def _rows(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    a = raw.select(F.lit("raw_pages").alias("tbl"), "page_id", F.col("raw_text").alias("text"))
    return a.unionByName(cleaned.select(F.lit("cleaned_pages").alias("tbl"), "page_id", F.col("cleaned_text").alias("text")))


def _found(batches: Iterator[pd.DataFrame], model: Broadcast) -> Iterator[pd.DataFrame]:
    r = model.value
    for batch in batches:
        hit = [r.text(t)[1] for t in batch["text"]]
        yield batch.loc[hit, ["tbl", "page_id"]]


#: A lost character is refilled if this share of the sound characters in its context are one.
SURE = 0.9
SIDE = 3


def context(text: str, i: int) -> str:
    """What stands beside a character: three on each side, lower case, digits alike."""
    return "".join("0" if c.isdigit() else c for c in f"{text[max(0, i - SIDE) : i]}\x00{text[i + 1 : i + 1 + SIDE]}".lower())


def _contexts(batches: Iterator[pd.DataFrame], model: Broadcast) -> Iterator[pd.DataFrame]:
    r = model.value
    for batch in batches:
        rows = []
        for t in batch["text"]:
            fixed = r.text(t)[0]
            rows += [(context(fixed, m.start()), m.group()) for m in NOT_ASCII.finditer(fixed)]
        yield pd.DataFrame(rows, columns=["context", "c"])


def _restored(batches: Iterator[pd.DataFrame], model: Broadcast) -> Iterator[pd.DataFrame]:
    r = model.value
    for batch in batches:
        out = []
        for t, fill in zip(batch["text"], batch["fill"], strict=True):
            fixed, garbled = r.text(t)
            if fixed and LOST in fixed and fill is not None and len(fill):
                of = {x["context"]: x["c"] for x in fill}
                fixed = "".join(of.get(context(fixed, i), c) if c == LOST else c for i, c in enumerate(fixed))
            out.append((fixed, garbled))
        yield pd.DataFrame({"tbl": batch["tbl"], "page_id": batch["page_id"], "text": [x for x, _ in out], "garbled": [g for _, g in out]})


def found(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(tbl, page_id) of the pages that hold a garbled sequence, restorable or not."""
    return _rows(raw, cleaned).where(F.col("text").rlike(SUSPECT)).mapInPandas(partial(_found, model=trained(raw)), "tbl string, page_id bigint")


def lost(batches: Iterator[pd.DataFrame], model: Broadcast) -> Iterator[pd.DataFrame]:
    r = model.value
    for batch in batches:
        rows = []
        for tbl, k, t in zip(batch["tbl"], batch["page_id"], batch["text"], strict=True):
            fixed = r.text(t)[0]
            rows += [(tbl, k, c) for c in sorted({context(fixed, i) for i, c in enumerate(fixed) if c == LOST})]
        yield pd.DataFrame(rows, columns=["tbl", "page_id", "context"])


def restored(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(tbl, page_id, text, garbled) of every page; sound pages pass through.

    Characters that decoding lost are refilled by their context: the contexts of lost characters meet those of sound
    ones in a join, and a context that nearly always holds one character gives it back.
    """
    rows, model = _rows(raw, cleaned), trained(raw)
    gaps = rows.where(F.contains("text", F.lit(LOST))).mapInPandas(partial(lost, model=model), "tbl string, page_id bigint, context string")
    sound = rows.where(F.octet_length("text") > F.length("text")).mapInPandas(partial(_contexts, model=model), "context string, c string").where(F.col("c") != LOST)
    wanted = sound.join(gaps.select("context").distinct(), "context", "left_semi").groupBy("context", "c").agg(F.count(F.lit(1)).alias("n"))
    best = wanted.groupBy("context").agg(F.max_by("c", F.struct("n", "c")).alias("c"), F.max("n").alias("n"), F.sum("n").alias("of")).where(F.col("n") >= SURE * F.col("of"))
    fills = gaps.join(best.select("context", "c"), "context").groupBy(F.col("tbl").alias("f_tbl"), F.col("page_id").alias("f_page")).agg(F.collect_list(F.struct("context", "c")).alias("fill"))
    x = rows.join(fills, (F.col("tbl") == F.col("f_tbl")) & (F.col("page_id") == F.col("f_page")), "left").select("tbl", "page_id", "text", "fill")
    return x.mapInPandas(partial(_restored, model=model), "tbl string, page_id bigint, text string, garbled boolean")
