"""Diagrams as node and edge tables: parsing, validation, sizes, routing, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions.text import col, contains_any

CELLS = "array<struct<id:string,type:string,x:double,y:double,width:double,height:double,source:string,target:string,label:string>>"


def diagram_type(request: Column | str) -> Column:
    low = F.lower(col(request))
    return (
        F.when(contains_any(low, ("use case", "usecase", "actor")), "usecase").when(contains_any(low, ("activity", "workflow", "flowchart", "flow diagram")), "activity")
        .when(contains_any(low, ("dfd", "data flow", "dataflow", "data-flow")), "dfd").otherwise("generic")
    )


def parsed(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cell as JSON) of answers that hold an array of cells an object with cells, or one that holds such an object; fences set aside."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)```(json)?", ""), r"^\s+|\s+$", "")
    v = F.try_parse_json(bare)
    within = F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.try_variant_get(x, "$.cells", "array<variant>"))
    nested = F.get(F.filter(within, lambda x: x.isNotNull()), 0)
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), nested)
    return answers.select(key, F.posexplode(cells).alias("pos", "v")).select(key, "pos", F.to_json("v").alias("cell"))


def is_link(type_: Column | str) -> Column:
    return F.contains(F.lower(col(type_)), F.lit("link"))


def violations(cells: DataFrame) -> DataFrame:
    """(diagram_id, pos, problem) of cells(diagram_id, pos, id, type, x, y, width, height) without what drawing needs."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    no_place = F.col("x").isNull() | F.col("y").isNull() | F.col("width").isNull() | F.col("height").isNull()
    problem = F.when(empty("id") | empty("type"), "no id or type").when(~is_link("type") & no_place, "no position or size")
    return cells.select("diagram_id", "pos", problem.alias("problem")).where("problem is not null")


def connects(source: Column | str, target: Column | str) -> Column:
    """Whether a link may be drawn: it has an end, which isn't its start."""
    return col(target).isNotNull() & ~col(source).eqNullSafe(col(target))


def label_of(attrs: Column | str) -> Column:
    """A cell's label from its attributes as JSON: the label's text, else the body's, else empty."""
    return F.coalesce(F.get_json_object(col(attrs), "$.label.text"), F.get_json_object(col(attrs), "$.body.text"), F.lit(""))


def width(type_: Column | str, label: Column | str, given: Column | str) -> Column:
    """The width given or, if its label needs more, 8.5 for each character and a margin; halves are rounded up."""
    need = F.length(col(label)) * 8.5 + F.when(col(type_) == "uml.UseCase", 70).otherwise(30)
    return F.when(F.length(col(label)) > 0, F.floor(F.greatest(col(given).cast("double"), need) + 0.5)).otherwise(col(given)).cast("bigint")


def sized(nodes: DataFrame) -> DataFrame:
    """Nodes with the default size of their type where none is given."""
    w = F.create_map(*[F.lit(x) for k, (a, _) in sorted(L.SHAPE_SIZES.items()) for x in (k, a)])
    h = F.create_map(*[F.lit(x) for k, (_, b) in sorted(L.SHAPE_SIZES.items()) for x in (k, b)])
    return nodes.withColumn("width", F.coalesce("width", F.element_at(w, F.col("type")), F.lit(160))).withColumn("height", F.coalesce("height", F.element_at(h, F.col("type")), F.lit(60)))


def routed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, id, router, connector) of each link by the types at its ends."""
    ends = lambda side: nodes.select(F.col("diagram_id").alias(f"d_{side}"), F.col("id").alias(f"i_{side}"), F.col("type").alias(f"t_{side}"))
    s, t = ends("s"), ends("t")
    x = edges.join(s, (F.col("diagram_id") == F.col("d_s")) & (F.col("source") == F.col("i_s")), "left").join(t, (F.col("diagram_id") == F.col("d_t")) & (F.col("target") == F.col("i_t")), "left")
    uc, actor = (F.col("t_s") == "uml.UseCase") & (F.col("t_t") == "uml.UseCase"), (F.col("t_s") == "uml.Actor") | (F.col("t_t") == "uml.Actor")
    bent = F.col("t_s").isin(*L.ACTIVITY_NODES) | F.col("t_s").startswith("dfd.")
    router = F.when(uc, "manhattan").when(actor, "normal").when(bent, "manhattan").otherwise("normal")
    return x.select("diagram_id", "id", router.alias("router"), F.when(router == "manhattan", "rounded").otherwise("normal").alias("connector"))


def usecase_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, id, x, y): actors on the left, use cases in a column, those that others include or extend beside it."""
    uc = nodes.where("type = 'uml.UseCase'")
    target = edges.join(uc.select(F.col("diagram_id").alias("d1"), F.col("id").alias("i1")), (F.col("diagram_id") == F.col("d1")) & (F.col("source") == F.col("i1")), "left_semi").select(F.col("diagram_id").alias("d"), F.col("target").alias("t")).distinct()
    n = F.row_number().over(Window.partitionBy("diagram_id").orderBy("pos"))
    cases = uc.withColumn("n", n).join(target, (F.col("diagram_id") == F.col("d")) & (F.col("id") == F.col("t")), "left")
    placed = cases.select("diagram_id", "id", F.when(F.col("t").isNotNull(), 540).otherwise(260).alias("x"), (80 + 120 * (F.col("n") - 1)).alias("y"))
    people = nodes.where("type = 'uml.Actor'").withColumn("n", n).select("diagram_id", "id", F.lit(50).alias("x"), (100 + 240 * (F.col("n") - 1)).alias("y"))
    return placed.unionByName(people)


def boundary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, width, height) of the system boundary round the use cases."""
    u = usecase_layout(nodes, edges).where("x <> 50").groupBy("diagram_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x") + 200).alias("right"))
    return u.select("diagram_id", F.greatest(F.lit(460), F.greatest(F.lit(400), F.col("right")) - 160).cast("bigint").alias("width"), F.greatest(F.lit(400), 120 + 120 * F.col("n")).cast("bigint").alias("height"))


def dataflow_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, id, x, y): processes by label, each store beside the first process that touches it, entities left."""
    w = lambda *o: Window.partitionBy("diagram_id").orderBy(*o)
    p = nodes.where("type = 'dfd.Process'").withColumn("n", F.row_number().over(w("label", "pos"))).withColumn("y", 80 + 160 * (F.col("n") - 1))
    count = p.groupBy(F.col("diagram_id").alias("dc")).agg(F.count(F.lit(1)).alias("processes"))
    ends = edges.select("diagram_id", F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select("diagram_id", F.col("target").alias("a"), F.col("source").alias("b")))
    touch = ends.join(p.select(F.col("diagram_id").alias("dp"), F.col("id").alias("ip"), "n", F.col("y").alias("py")), (F.col("diagram_id") == F.col("dp")) & (F.col("b") == F.col("ip"))).groupBy(F.col("diagram_id").alias("dt"), "a").agg(F.min(F.struct("n", "py")).alias("first"))
    s = nodes.where("type = 'dfd.DataStore'").join(touch, (F.col("diagram_id") == F.col("dt")) & (F.col("id") == F.col("a")), "left").join(count, F.col("diagram_id") == F.col("dc"), "left")
    s = s.withColumn("n", F.col("first.n")).withColumn("k", F.row_number().over(Window.partitionBy("diagram_id", "n").orderBy("pos")) - 1)
    stores = s.select("diagram_id", "id", F.when(F.col("n").isNotNull(), 560 + 220 * F.col("k")).otherwise(300).alias("x"), F.coalesce(F.col("first.py") + 15, 80 + 160 * F.coalesce("processes", F.lit(0)) + 40 + 100 * F.col("k")).alias("y"))
    entities = nodes.where("type = 'dfd.ExternalEntity'").withColumn("n", F.row_number().over(w("pos"))).select("diagram_id", "id", F.lit(40).alias("x"), (80 + 200 * (F.col("n") - 1)).alias("y"))
    both = p.select("diagram_id", "id", F.lit(300).alias("x"), "y").unionByName(stores).unionByName(entities)
    return both.select("diagram_id", "id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
