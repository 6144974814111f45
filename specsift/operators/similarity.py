"""Similarity operators: sequence ratio, cosine, nearest neighbours, and conflicts by likeness."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType

from specsift.functions import requirements as R
from specsift.functions.text import col
from specsift.operators.issues import classes, opposed, representatives, stories_of
from specsift.runtime import cut

#: Conditions of at least this ratio meet; the key of rules without a condition.
ALIKE, GLOBAL = 0.85, "global"
#: Objects more alike than this are of one domain.
SAME_OBJECT = 0.78
#: Actions under so many characters don't say what they are about.
SHORT_ACTION = 15


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Matching blocks of two texts, lower case, against their length; not symmetric."""
    return _ratio(col(a), col(b))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _nearest_of(ids: np.ndarray, q: np.ndarray, own: np.ndarray, m: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of a batch for each query, ties by the smaller id.

    Copies are one vector with its k + 1 smallest ids.  Matrix products only choose vectors, with a margin for rounding;
    similarities are summed in the order of dimensions, so that equal rows are equal in every batch.
    """
    order = np.argsort(own, kind="stable")
    own, m = own[order], m[order]
    keys = np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel()
    _, first, group, sizes = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    members, starts = np.argsort(group, kind="stable"), np.cumsum(sizes) - sizes
    u = m[first]
    s = q @ u.T
    top = min(k + 1, len(u))
    margin = 4 * m.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(u, axis=1).max()
    at, vec = np.nonzero(s >= (np.partition(s, len(u) - top, axis=1)[:, len(u) - top] - 2 * margin)[:, None])
    exact = np.zeros(len(at))
    for d in range(m.shape[1]):
        exact += q[at, d] * u[vec, d]
    n = np.minimum(sizes[vec], k + 1)
    rows = members[np.repeat(starts[vec], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    at, exact = np.repeat(at, n), np.repeat(exact, n)
    other = own[rows] != ids[at]
    at, rows, exact = at[other], rows[other], exact[other]
    order = np.lexsort((own[rows], -exact, at))
    at, rows, exact = at[order], rows[order], exact[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return pd.DataFrame({"query_id": ids[at[kept]], "vec_id": own[rows[kept]], "similarity": exact[kept]})


def nearest(vectors: DataFrame, k: int = 15, every: int = 20, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest rows, by inner product, of each row whose id ``every`` divides.

    The stated queries are sent in blocks of bounded size; each block meets all rows in one pass of matrix products that
    keeps k rows of each batch, and the kept rows are merged.  Ties go to the smaller id, however many rows are tied.
    Rows without an id or a vector are near to none.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null and embedding is not null")
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    n = queries.count()
    parts = max(1, -(-n // block))
    out = None
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches:
                yield _nearest_of(ids, q, batch["vec_id"].to_numpy(), np.stack(batch["embedding"].to_numpy()).astype(np.float64), k)

        part = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id bigint, vec_id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.where(F.col("similarity") > float("-inf")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centres(vectors: DataFrame, cells: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres of cells, by spherical k-means over at most ``sample`` rows in the order of a hash of their ids."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].sum(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


def indexed_nearest(vectors: DataFrame, k: int = 15, every: int = 20, cells: int = 16, probes: int = 12, sample: int = 20_000, salts: int = 8, rounds: int = 8, seed: int = 5) -> DataFrame:
    """The same by an inverted file: every row is filed under its nearest centre, a query meets ``probes`` cells.

    Centres are fitted on a bounded sample; all rows are indexed.  Rows of a cell are dealt over salts and a cell's
    queries are copied to them, so a cell that holds a third of all rows is spread; k rows of each salt are kept before
    the merge.  More cells for more rows keep a query's work bounded; recall depends on the share of cells probed and
    is measured in the tests.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres(vectors, cells, sample, rounds, seed))

    def near(n: int) -> object:
        def run(e: pd.Series) -> pd.Series:
            m = np.stack(e.to_numpy()).astype(np.float64)
            return pd.Series(list(np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

        return F.pandas_udf(run, ArrayType(IntegerType()))

    rows = vectors.select("vec_id", "embedding", F.get(near(1)("embedding"), 0).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(near(probes)("embedding")).alias("q_cell"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q_salt"))
    met = rows.join(asked, (F.col("cell") == F.col("q_cell")) & (F.col("salt") == F.col("q_salt")) & (F.col("vec_id") != F.col("query_id")))
    scored = met.select("query_id", "vec_id", "cell", "salt", dot("embedding", "q").alias("similarity"))
    order = (F.desc("similarity"), "vec_id")
    kept = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "cell", "salt").orderBy(*order))).where(F.col("r") <= k)
    return kept.select("query_id", "vec_id", "similarity").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def candidate_pairs(vectors: DataFrame, k: int = 15) -> DataFrame:
    """Unordered pairs of each query and its nearest rows."""
    n = nearest(vectors, k)
    return n.select(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).distinct()


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the ratio in either direction is at least ALIKE; cheap bounds of it are asked first."""

    def one(x: str, y: str) -> bool:
        m = SequenceMatcher(None, x, y)
        return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and (m.ratio() >= ALIKE or SequenceMatcher(None, y, x).ratio() >= ALIKE)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


def said(action: Column | str, raw: Column | str) -> Column:
    """What names a rule's object: its action or, where that is short, the raw text."""
    return F.coalesce(F.when(F.length(col(action)) < SHORT_ACTION, col(raw)), col(action), F.lit(""))


def domain_gate(pairs: DataFrame) -> DataFrame:
    """Pairs of rules(story_a, raw_a, action_a, story_b, raw_b, action_b) with whether they are of one domain.

    One module is one domain; rules of other modules need alike objects, read from the raw text where the action is short.
    """
    module = lambda x: R.module_of("story_" + x)
    same = (module("a") != "") & (module("a") == module("b"))
    rated = pairs.select("*", same.alias("same_module"), ratio(R.primary_object(said("action_a", "raw_a")), R.primary_object(said("action_b", "raw_b"))).alias("alike"))
    return rated.select(*pairs.columns, (F.col("same_module") | (F.col("alike") > SAME_OBJECT)).alias("same_domain"))


def pairing(rules: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, rules, plan): all rules of a document are compared below ``least``, nearest neighbours from there on."""
    n = rules.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"))
    return n.select("doc_id", "rules", F.when(F.col("rules") < least, "all pairs").otherwise("nearest").alias("plan"))


def meetings(reps: DataFrame) -> DataFrame:
    """(doc_id, cond_key, meet), of representatives: conditions of one document that share a ``meet`` apply together.

    A condition meets itself (=), those that compare the same variable in the same direction (#) and, unless both are
    numeric, those at least ALIKE to it (~, one key for each such pair).  Texts of that likeness differ in length by a
    bounded factor, so only texts of one or neighbouring classes of length are compared.
    """
    r = reps.where("cond_key <> ''").groupBy("doc_id", "cond_key").agg(F.min("condition").alias("condition"))
    r = r.select("doc_id", "cond_key", R.condition_logic("condition").alias("num"), F.floor(F.log(F.length("cond_key").cast("double")) / math.log(1.001 * (2 - ALIKE) / ALIKE)).alias("size"))
    own = r.select("doc_id", "cond_key", F.concat(F.lit("="), "cond_key").alias("meet"))
    classed = r.where("num.operator in ('<', '<=', '>', '>=')").select("doc_id", "cond_key", F.concat(F.lit("#"), "num.variable", F.substring("num.operator", 1, 1)).alias("meet"))
    a = r.select("doc_id", "cond_key", F.col("num").isNotNull().alias("numeric"), F.explode(F.array("size", F.col("size") + 1)).alias("at"), "size")
    b = a.select(*[F.col(c).alias("b_" + c) for c in a.columns])
    near = a.join(b, a["doc_id"].eqNullSafe(b["b_doc_id"]) & (F.col("at") == F.col("b_at")) & (F.col("at") == F.greatest("size", "b_size")) & (F.col("cond_key") < F.col("b_cond_key")) & ~(F.col("numeric") & F.col("b_numeric")))
    near = near.where(_alike("cond_key", "b_cond_key")).select("doc_id", "cond_key", "b_cond_key", F.concat(F.lit("~"), "cond_key", F.lit("\u0001"), "b_cond_key").alias("meet"))
    both = near.select("doc_id", F.explode(F.array("cond_key", "b_cond_key")).alias("cond_key"), "meet")
    return own.unionByName(classed).unionByName(both)


def alike_conflicts(rules: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """Pairs of rule classes of one document that oppose each other by verb, polarity or number under conditions that meet.

    Rules without a condition meet each other, but don't oppose by verb alone.  Cheap gates come first (conditions that
    meet, different story, opposite class of verb, polarity or numbers, lengths); ratios are worked out for the pairs
    that are left.  Classes meet as a whole and by module, as any two different stories of one module pass the domain
    gate; a pair of classes is named once.
    """
    reps = cut(representatives(rules)) if reps is None else reps
    whole = classes(reps).withColumn("module", F.lit(""))
    each = whole.unionByName(classes(reps, "module").where("module <> ''")).withColumn("cond_key", F.coalesce("cond_key", F.lit("")))
    m = meetings(reps).select(F.col("doc_id").alias("md"), F.col("cond_key").alias("mk"), "meet")
    placed = each.where("cond_key <> ''").join(m, each["doc_id"].eqNullSafe(m["md"]) & (each["cond_key"] == m["mk"])).drop("md", "mk").unionByName(each.where("cond_key = ''").withColumn("meet", F.lit(GLOBAL)))
    c = placed.select("doc_id", "cond_key", "meet", "core", "action", "module", F.col("first.story_id").alias("story"), "other", R.polarity("action").alias("pol"), R.condition_logic("action").alias("num"), R.concept(R.context("action")).alias("ctx"), R.primary_object("action").alias("obj"), R.primary_object(said("action", "first.raw")).alias("gate"))
    a = c.select(*[F.col(x).alias("a_" + x) for x in c.columns])
    b = c.select(*[F.col(x).alias("b_" + x) for x in c.columns])
    likely = lambda x, least: 2 * F.least(F.length("a_" + x), F.length("b_" + x)) >= least * (F.length("a_" + x) + F.length("b_" + x))
    conditional = F.col("a_meet") != GLOBAL
    verbs = conditional & (F.col("a_core") == "permit") & (F.col("b_core") == "deny")
    signs = (F.col("a_pol") == "positive") & (F.col("b_pol") == "negative") & likely("ctx", 0.75) & likely("action", 0.45)
    turned = conditional & (F.col("a_core") == "deny") & (F.col("b_core") == "permit")
    disjoint = ((F.col("a_num.operator") == "<") & (F.col("b_num.operator") == ">") & (F.col("a_num.value") < F.col("b_num.value"))) | ((F.col("a_num.operator") == ">") & (F.col("b_num.operator") == "<") & (F.col("a_num.value") > F.col("b_num.value")))
    numbers = (F.col("a_num.variable") == F.col("b_num.variable")) & (F.col("a_action") < F.col("b_action")) & ~disjoint & ~turned & likely("action", 0.58)
    met = (F.col("a_meet") == F.col("b_meet")) & (F.col("a_meet").startswith("=") | ~conditional | (F.col("a_cond_key") != F.col("b_cond_key")))
    pairs = a.join(b, F.col("a_doc_id").eqNullSafe(F.col("b_doc_id")) & met & (F.col("a_module") == F.col("b_module")) & (verbs | signs | numbers))
    same_module = F.col("a_module") != ""
    pairs = pairs.withColumn("s", stories_of("a_story", "a_other", "b_story", "b_other")).where("s is not null")
    rated = pairs.withColumn("act", ratio("a_action", "b_action")).withColumn("ctx", ratio("a_ctx", "b_ctx")).withColumn("obj", ratio("a_obj", "b_obj")).withColumn("gate", ratio("a_gate", "b_gate"))
    gated = rated.where(same_module | (F.col("gate") > SAME_OBJECT))
    strong = (F.col("ctx") >= 0.75) & (F.col("act") >= F.when(F.col("ctx") > 0.92, 0.45).otherwise(0.70)) & (F.col("obj") >= 0.30)
    kind = F.when(verbs, "rule").when(signs & strong, "embedding").when(numbers & (F.col("act") >= 0.58), "numeric")
    conf = F.when(verbs, 0.95).when(signs & strong, F.round((F.col("ctx") + F.col("act")) / 2, 3)).otherwise(0.95)
    named = gated.withColumn("source", kind).withColumn("confidence", conf).where("source is not null")
    key = lambda x: F.struct(*[F.coalesce(x + c, F.lit("")).alias(c) for c in ("_cond_key", "_core", "_action")])
    turn = F.when(F.col("source") == "rule", 0).when(F.col("source") == "embedding", 1).otherwise(2)
    row = F.struct(turn.alias("turn"), F.col("a_module").alias("module"), F.col("a_cond_key").alias("cond_key"), F.col("b_cond_key").alias("cond_key_b"), F.col("s.a").alias("story_a"), F.col("s.b").alias("story_b"), F.col("a_action").alias("action_a"), F.col("b_action").alias("action_b"), "source", "confidence")
    once = named.groupBy("a_doc_id", F.least(key("a"), key("b")).alias("one"), F.greatest(key("a"), key("b")).alias("two")).agg(F.min(row).alias("x"))
    return once.select(F.col("a_doc_id").alias("doc_id"), "x.*").drop("turn", "module")


def conflicts(rules: DataFrame) -> DataFrame:
    """All conflicts between rule classes of one document: opposed verbs, else opposite polarity, else numbers.

    (doc_id, cond_key, cond_key_b, story_a, story_b, action_a, action_b, source, confidence)
    """
    reps = cut(representatives(rules))
    o = opposed(rules, reps).select("doc_id", "cond_key", "cond_key_b", "story_a", "story_b", F.col("permits").alias("action_a"), F.col("denies").alias("action_b"), F.lit("rule").alias("source"), F.lit(0.95).alias("confidence"))
    return o.unionByName(alike_conflicts(rules, reps).where("source <> 'rule'"))
