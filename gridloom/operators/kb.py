"""Knowledge-base operators: link resolution, lookups, filters and statistics over (subj, pred, obj) edges.

Dimensions whose size is not known are joined by shuffle; adaptive execution broadcasts them when they turn out small
and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the predicate that links an entity with its class.
INSTANCE_OF = "P31"


def resolve_links(urls: DataFrame, links: DataFrame, redirects: DataFrame) -> DataFrame:
    """url -> entity: the link dictionary's entity, else that of the redirect's target unless it is a list page."""
    direct = urls.join(links.withColumnRenamed("entity", "_direct"), "url", "left").join(redirects, "url", "left")
    moved = direct.join(links.select(F.col("url").alias("target"), F.col("entity").alias("_moved")), "target", "left")
    usable = F.when(~F.col("target").contains("List_of"), F.col("_moved"))
    return moved.withColumn("entity", F.coalesce("_direct", usable)).drop("_direct", "_moved", "target")


def relations(pairs: DataFrame, kb: DataFrame, how: str = "left") -> DataFrame:
    """The predicates that hold for each (subj, obj)."""
    return pairs.join(kb.dropDuplicates(), ["subj", "obj"], how)


def exists(triples: DataFrame, kb: DataFrame) -> DataFrame:
    """Triples with ``in_kb``: whether the knowledge base has them."""
    known = kb.select("subj", "pred", "obj").dropDuplicates().withColumn("_k", F.lit(True))
    return triples.join(known, ["subj", "pred", "obj"], "left").withColumn("in_kb", F.coalesce("_k", F.lit(False))).drop("_k")


def with_property(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """Triples with their property's columns; the id stands for a name that is missing."""
    joined = triples.join(properties, "pred", "left")
    return joined.withColumn("name", F.coalesce("name", "pred"))


def filter_linked(kb: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both ends of which are among the entities."""
    known = entities.select("entity").dropDuplicates()
    return kb.join(known, kb.subj == known.entity, "left_semi").join(known, kb.obj == known.entity, "left_semi")


def filter_pairs(kb: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose ends occur as a pair, in either order."""
    both = pairs.select("subj", "obj").unionByName(pairs.select(F.col("obj").alias("subj"), F.col("subj").alias("obj")))
    return kb.join(both.dropDuplicates(), ["subj", "obj"], "left_semi").select("subj", "pred", "obj")


def reverse(kb: DataFrame) -> DataFrame:
    """Edges turned round."""
    return kb.select(F.col("obj").alias("subj"), "pred", F.col("subj").alias("obj"))


def subj_pred_count(kb: DataFrame) -> DataFrame:
    return kb.groupBy("subj", "pred").agg(F.count("*").alias("n"))


def obj_pred_count(kb: DataFrame) -> DataFrame:
    return kb.groupBy("obj", "pred").agg(F.count("*").alias("n"))


def with_counts(triples: DataFrame, kb: DataFrame) -> DataFrame:
    """Triples with ``n_obj`` (objects of subject and predicate) and ``n_subj``; zero if unknown."""
    a = subj_pred_count(kb).withColumnRenamed("n", "n_obj")
    b = obj_pred_count(kb).withColumnRenamed("n", "n_subj")
    joined = triples.join(a, ["subj", "pred"], "left").join(b, ["obj", "pred"], "left")
    return joined.fillna(0, ["n_obj", "n_subj"])


def max_by_predicate(kb: DataFrame) -> DataFrame:
    """For each predicate: the most objects of a subject and the most subjects of an object."""
    a = subj_pred_count(kb).groupBy("pred").agg(F.max("n").alias("max_obj"))
    b = obj_pred_count(kb).groupBy("pred").agg(F.max("n").alias("max_subj"))
    return a.join(b, "pred")


def property_stats(kb: DataFrame) -> DataFrame:
    """times, distinct subjects and objects, and the maxima, for each predicate."""
    base = kb.groupBy("pred").agg(F.count("*").alias("times"), F.countDistinct("subj").alias("uniq_subj"), F.countDistinct("obj").alias("uniq_obj"))
    return base.join(max_by_predicate(kb), "pred")


def classes(kb: DataFrame, predicate: str = INSTANCE_OF) -> DataFrame:
    """entity and its classes, sorted."""
    return kb.where(F.col("pred") == predicate).groupBy(F.col("subj").alias("entity")).agg(F.array_sort(F.collect_set("obj")).alias("classes"))


def class_sizes(entity_class: DataFrame) -> DataFrame:
    """Entities of each class."""
    return entity_class.dropDuplicates(["entity", "class"]).groupBy("class").agg(F.count("*").alias("n"))


def entity_class_counts(entity_class: DataFrame) -> DataFrame:
    """Each entity's classes with their sizes, smallest first."""
    sized = entity_class.dropDuplicates(["entity", "class"]).join(class_sizes(entity_class), "class")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "class"))), lambda x: F.concat_ws(":", x["class"], x["n"]))
    return sized.groupBy("entity").agg(ordered.alias("class_counts"))


def max_class(entity_class: DataFrame) -> DataFrame:
    """The largest class of each entity; the least by name of equals."""
    sized = entity_class.dropDuplicates(["entity", "class"]).join(class_sizes(entity_class), "class")
    return sized.groupBy("entity").agg(F.min(F.struct((-F.col("n")).alias("n"), "class"))["class"].alias("class"))


def domain_range(kb: DataFrame, entity_class: DataFrame, end: str) -> DataFrame:
    """For each predicate but INSTANCE_OF, how often each class stands at one end: "subj" (domain) or "obj" (range)."""
    own = entity_class.select(F.col("entity").alias(end), "class")
    return kb.where(F.col("pred") != INSTANCE_OF).join(own, end).groupBy("pred", "class").agg(F.count("*").alias("n"))


def in_classes(triples: DataFrame, entity_class: DataFrame, allowed: DataFrame, end: str) -> DataFrame:
    """``fits``: 1 if a class of the entity at that end is allowed for the predicate, 0 if none, 2 if it has none."""
    own = entity_class.select(F.col("entity").alias(end), "class").dropDuplicates()
    hits = triples.select(end, "pred").dropDuplicates().join(own, end).join(allowed.select("pred", "class").dropDuplicates(), ["pred", "class"]).select(end, "pred").dropDuplicates().withColumn("_hit", F.lit(1))
    has = own.select(end).dropDuplicates().withColumn("_has", F.lit(1))
    joined = triples.join(hits, [end, "pred"], "left").join(has, end, "left")
    return joined.withColumn("fits", F.when(F.col("_has").isNull(), 2).otherwise(F.coalesce("_hit", F.lit(0)))).drop("_hit", "_has")


def last_part(uri: F.Column) -> F.Column:
    """The last path part of an address in angle brackets."""
    return F.element_at(F.split(F.regexp_replace(uri, "[<>]", ""), "/"), -1)


def statements(triples: DataFrame, entity: str, direct: str, prop: str, statement_value: str) -> DataFrame:
    """Edges from N-Triples: direct ones, and those over a statement node, where ``prop`` leads to the node and
    ``statement_value`` of the same predicate from it to the object. ``kind``: direct, statement or literal."""
    t = triples.select("s", "p", "o")
    straight = t.where(F.col("p").startswith(direct) & F.col("s").startswith(entity))
    kind = F.when(F.col("o").startswith(entity), "direct").otherwise("literal")
    first = straight.select(last_part(F.col("s")).alias("subj"), last_part(F.col("p")).alias("pred"), F.when(F.col("o").startswith(entity), last_part(F.col("o"))).otherwise(F.col("o")).alias("obj"), kind.alias("kind"))
    to_node = t.where(F.col("p").startswith(prop) & F.col("s").startswith(entity)).select(last_part(F.col("s")).alias("subj"), last_part(F.col("p")).alias("pred"), F.col("o").alias("node"))
    from_node = t.where(F.col("p").startswith(statement_value) & F.col("o").startswith(entity)).select(F.col("s").alias("node"), last_part(F.col("p")).alias("pred"), last_part(F.col("o")).alias("obj"))
    second = to_node.join(from_node, ["node", "pred"]).select("subj", "pred", "obj", F.lit("statement").alias("kind"))
    return first.unionByName(second)
