"""Free-entered values mapped to a canonical list: token-level repair, then soft TF-IDF over complete entries.

Every distinct value is reduced to tokens (labels, articles, remarks in brackets and after a dash are set aside).  Each
distinct token is joined to the words of the reference list by edit distance: both sides emit their forms with up to
three letters deleted, equal forms meet in an equi-join, and the true distance (neighbours may be swapped) decides.
Corrected tokens then rank the entries' names by soft TF-IDF.  A name is meant if all its words are met and no other
word of weight is left; a value written without its spaces is compared as one word; codes must match letter for letter.

Values are few against rows, so rows are reduced to distinct values before any of this and joined back at the end.

Defined results: null and blank values and values equal to an entry's name are no cases; values that mean no entry get
actor_id 0; of equally good entries the smallest actor_id is taken; repeated rows are reported for each row and
position; an empty catalogue maps nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specsift.llm.lookalikes import folded, plain

#: Words that hold no part of a role.
EMPTY_WORDS = {"a", "an", "the", "role", "actor", "user", "as", "of", "our", "any", "each"}
#: Words up to this length must match letter for letter, longer ones within one edit, long ones within two, from 12 letters on three.
EXACT_UP_TO, ONE_UP_TO = 3, 5
MIN_SCORE = 0.75


def key(value: str) -> str:
    """Case, width, look-alikes, accents and quotes set aside."""
    text = folded(plain(value)[0])
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.casefold()


def tokens(value: str) -> list[str]:
    text = key(value)
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text) if re.sub(r"\([^)]*\)|\[[^\]]*\]", "", text).strip() else text
    text = re.sub(r"^\W*(role|actor|user|persona|stakeholder)\s*[:=-]", " ", text)
    text = re.sub(r"\s+[-–—/|]\s+.*$", "", text)
    found = re.findall(r"[^\W_]+\.?", text)
    return [t for t in found if t.strip(".") not in EMPTY_WORDS] or found


def deletions(word: str, longest: int | None = None) -> set[str]:
    """The word and its forms with up to as many letters deleted as it may differ by.

    A word that is longer than the longest one it may be compared with by more letters than that differs from all.
    """
    forms = {word}
    for _ in range(tolerance(word) if longest is None or len(word) <= longest + tolerance(word) else 0):
        forms |= {w[:i] + w[i + 1 :] for w in forms for i in range(len(w))}
    return forms


def tolerance(word: str) -> int:
    return 0 if len(word) <= EXACT_UP_TO else 1 if len(word) <= ONE_UP_TO else 2 if len(word) < 12 else 3


def distance(a: str, b: str) -> int:
    """Edits between two words; two neighbours swapped are one edit, also where letters between them came or went."""
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last_column = 0
        for j, y in enumerate(b, 1):
            row, column = last_row.get(y, 0), last_column
            if x == y:
                last_column = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][column] + (i - row - 1) + 1 + (j - column - 1))
        last_row[x] = i
    return d[-1][-1]


def similar(token: str, word: str) -> float:
    """1 for equal words, less by edits, for abbreviations and plurals; 0 beyond the tolerance."""
    bare = token.rstrip(".")
    if bare == word:
        return 1.0
    if token.endswith(".") and len(bare) >= 3 and word.startswith(bare):
        return 0.9
    if bare in (word + "s", word + "es") or (word.endswith("y") and bare == word[:-1] + "ies"):
        return 0.97
    d = distance(bare, word)
    return 1 - d / max(len(bare), len(word)) if d <= min(tolerance(bare), tolerance(word)) else 0.0


FORMS = "value string, n int, pos int, token string, whole boolean, form string"
NAMES = "actor_id bigint, variant string, code boolean, n int, word string, whole boolean, form string"


def dealt(df: DataFrame) -> DataFrame:
    """Few rows that cost much each, dealt over all cores: their bytes alone would put them into one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Bits of the filter of the names' forms: a fixed size, whatever the reference list.
SLOTS = 1 << 22


def filter_of(names: DataFrame) -> np.ndarray:
    """Which slots the names' forms fall into; a form in no such slot meets no name."""
    taken = names.select((F.crc32(F.col("met").cast("binary")) % SLOTS).alias("slot")).distinct()
    bits = np.zeros(SLOTS, dtype=bool)
    bits[[r.slot for r in taken.collect()]] = True
    return np.packbits(bits)


def value_forms(values: DataFrame, longest: int, taken: np.ndarray) -> DataFrame:
    """(value, n, pos, token, whole, form) of each token of each distinct value, and of the value written as one word.

    Forms that the filter knows to meet no name aren't emitted; the join decides on the others.
    """
    shared = values.sparkSession.sparkContext.broadcast(taken)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(shared.value).tobytes()
        met = lambda forms: sorted(f for f in forms if bits[crc32(f.encode()) % SLOTS])
        for batch in batches:
            rows = []
            for v in batch["value"]:
                t = tokens(v)
                for i, x in enumerate(t):
                    bare = x.rstrip(".")
                    forms = set(deletions(bare, longest)) | ({bare + "."} if x.endswith(".") else set()) | ({bare[:-1]} if bare.endswith("s") else set()) | ({bare[:-2]} if bare.endswith("es") else set())
                    rows += [(v, len(t), i, x, False, f) for f in met(forms)]
                one = "".join(x.rstrip(".") for x in t)
                rows += [(v, len(t), -1, one, True, f) for f in met(deletions(one, longest))]
            yield pd.DataFrame(rows, columns=["value", "n", "pos", "token", "whole", "form"])

    return dealt(values).mapInPandas(run, FORMS)


def name_forms(catalog: DataFrame) -> DataFrame:
    """The same of every name, short form and alternative name of the reference list; prefixes for abbreviations."""
    named = catalog.select("actor_id", F.array_distinct(F.filter(F.concat(F.array("actor_name", "short_form"), F.coalesce("alt_names", F.array().cast("array<string>"))), lambda x: F.length(F.trim(x)) > 0)).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for actor, names in zip(batch["actor_id"], batch["names"], strict=True):
                for name in names:
                    code = name.isupper() and " " not in name
                    words = re.findall(r"[^\W_]+", key(name))
                    for w in words:
                        forms = {w} if code else set(deletions(w)) | {w[:i] + "." for i in range(3, len(w))}
                        rows += [(actor, name, code, len(words), w, False, f) for f in sorted(forms)]
                    if not code:
                        one = "".join(words)
                        rows += [(actor, name, code, len(words), one, True, f) for f in sorted(deletions(one))]
            yield pd.DataFrame(rows, columns=["actor_id", "variant", "code", "n", "word", "whole", "form"])

    return named.mapInPandas(run, NAMES)


def mapped(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """(value, meant) of the distinct values that mean an entry."""
    names = name_forms(catalog).select("actor_id", "variant", "code", F.col("n").alias("words"), "word", F.col("whole").alias("as_one"), F.col("form").alias("met"))
    longest = names.agg(F.max(F.length("word"))).first()[0] or 0
    meet = value_forms(values, longest, filter_of(names)).join(names, (F.col("form") == F.col("met")) & (F.col("whole") == F.col("as_one")))
    pairs = meet.select("value", "n", "pos", "token", "whole", "actor_id", "variant", "words", "word", "code").distinct()
    pairs = dealt(pairs)
    near = F.pandas_udf(lambda a, b: pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    scored = pairs.withColumn("sim", near("token", "word")).where("sim > 0")
    # the weight of a word falls with the number of names that hold it
    spread = name_forms(catalog).where("not whole").select("variant", "word").distinct()
    total = F.lit(1.0) + spread.groupBy().agg(F.countDistinct("variant")).first()[0]
    idf = spread.groupBy("word").agg(F.log(total / F.count(F.lit(1))).alias("idf")).select(F.col("word").alias("w"), "idf")
    best = scored.where("not whole").withColumn("k", F.row_number().over(Window.partitionBy("value", "variant", "word").orderBy(F.desc("sim"), "pos"))).where("k = 1")
    soft = best.join(idf, F.col("word") == F.col("w")).groupBy("value", "actor_id", "variant").agg(
        F.first("n").alias("n"), F.first("words").alias("words"), F.count(F.lit(1)).alias("met_words"), F.countDistinct("pos").alias("met_tokens"), (F.sum(F.col("sim") * F.col("idf")) / F.sum("idf")).alias("score")
    )
    by_words = soft.where((F.col("met_words") == F.col("words")) & (F.col("met_tokens") == F.col("n"))).select("value", "actor_id", "score")
    by_whole = scored.where("whole").select("value", "actor_id", (F.col("sim") - 0.001).alias("score"))
    every = by_words.unionByName(by_whole).where(F.col("score") >= MIN_SCORE)
    return every.groupBy("value").agg(F.max_by("actor_id", F.struct("score", -F.col("actor_id"))).alias("meant"))


def entered(stories: DataFrame, models: DataFrame) -> DataFrame:
    """(tbl, row_id, item_pos, value) of every entered value that isn't null or blank."""
    a = stories.select(F.lit("user_stories").alias("tbl"), F.col("story_uid").alias("row_id"), F.lit(0).alias("item_pos"), F.col("role").alias("value"))
    b = models.select(F.lit("requirements_models").alias("tbl"), F.col("model_id").alias("row_id"), F.posexplode("actors").alias("p", "value")).select("tbl", "row_id", (F.col("p") + 1).alias("item_pos"), "value")
    return a.unionByName(b).where(F.col("value").rlike("[^\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]"))


def found(stories: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tbl, row_id, item_pos, actor_id): the entry that each value not spelt like one means, 0 if none."""
    rows = entered(stories, models)
    names = catalog.select(F.col("actor_name").alias("value")).distinct()
    cases = rows.join(names, "value", "left_anti")
    known = mapped(cases.select("value").distinct(), catalog).withColumnRenamed("value", "v")
    return cases.join(known, F.col("value") == F.col("v"), "left").select("tbl", "row_id", "item_pos", F.coalesce("meant", F.lit(0).cast("bigint")).alias("actor_id"))


def unmatched(stories: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(value, rows): the values that mean no entry, with how often each was entered."""
    rows = entered(stories, models)
    cases = rows.join(catalog.select(F.col("actor_name").alias("value")).distinct(), "value", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    known = mapped(cases.select("value"), catalog).select(F.col("value").alias("v"))
    return cases.join(known, F.col("value") == F.col("v"), "left_anti").select("value", "rows")
