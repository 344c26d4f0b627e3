"""Cell pairs of table rows, predicate scores and candidate triples.

cells: table_id, row_no, col_no, header, entity (one row for each entity of a cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["table_id", "c1", "c2"]


def cell_pairs(cells: DataFrame) -> DataFrame:
    """Entity pairs of different columns of a row, first column first; equal entities make no pair."""
    left = cells.select("table_id", "row_no", F.col("col_no").alias("c1"), F.col("header").alias("h1"), F.col("entity").alias("subj"))
    right = cells.select("table_id", "row_no", F.col("col_no").alias("c2"), F.col("header").alias("h2"), F.col("entity").alias("obj"))
    joined = left.join(right, ["table_id", "row_no"]).where("c1 < c2")
    return joined.where("subj IS NOT NULL AND obj IS NOT NULL AND subj <> '' AND obj <> '' AND subj <> obj")


def oriented_pairs(cells: DataFrame) -> DataFrame:
    """Pairs as features need them: headers in alphabetical order decide the direction, and one of the two cells has
    exactly one entity."""
    n = cells.groupBy("table_id", "row_no", "col_no").agg(F.count("*").alias("_n"))
    pairs = cell_pairs(cells)
    one = pairs.join(n.select("table_id", "row_no", F.col("col_no").alias("c1"), F.col("_n").alias("n1")), ["table_id", "row_no", "c1"])
    both = one.join(n.select("table_id", "row_no", F.col("col_no").alias("c2"), F.col("_n").alias("n2")), ["table_id", "row_no", "c2"]).where("n1 = 1 OR n2 = 1")
    swap = F.col("h1") > F.col("h2")
    pick = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    return both.select("table_id", "row_no", *(x for a, b in (("c1", "c2"), ("h1", "h2"), ("subj", "obj")) for x in (pick(a, b, a), pick(b, a, b))))


def protagonist_pairs(cells: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs of a table's article entity (column -1) and each cell that has exactly one entity."""
    single = cells.withColumn("_n", F.count("*").over(Window.partitionBy("table_id", "row_no", "col_no"))).where("_n = 1")
    joined = single.join(articles.select("table_id", F.col("entity").alias("subj")), "table_id").where("subj <> entity")
    return joined.select("table_id", "row_no", F.lit(-1).alias("c1"), F.col("col_no").alias("c2"), "subj", F.col("entity").alias("obj"))


def score_by_count(known: DataFrame) -> DataFrame:
    """How many entity pairs of each column pair have each predicate."""
    return known.where("pred IS NOT NULL").groupBy(*PAIR, "pred").agg(F.count("*").alias("n"))


def score_lists(known: DataFrame) -> DataFrame:
    """For each column pair its predicates, and predicates with counts, as text; column pairs without any are blank,
    and are left out where another pair of the table has some."""
    every = known.select(*PAIR).dropDuplicates()
    listed = score_by_count(known).groupBy(*PAIR).agg(
        F.array_join(F.array_sort(F.collect_list("pred")), " ").alias("relations"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pred", "n"))), " ").alias("relations_score"),
    )
    has = listed.select("table_id").dropDuplicates()
    blank = every.join(has, "table_id", "left_anti").select(*PAIR, F.lit("").alias("relations"), F.lit("").alias("relations_score"))
    return listed.unionByName(blank)


def props_by_row(known: DataFrame) -> DataFrame:
    """For each entity pair of a row its predicates as text; blank if none."""
    keys = ["table_id", "row_no", "c1", "c2", "subj", "obj"]
    return known.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("pred")), " ").alias("relations"))


def score_by_rows(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """The share of a table's rows that have each predicate in each column pair (rows 0 counts as 1), three digits."""
    n = F.when(F.col("nrows") == 0, 1).otherwise(F.col("nrows"))
    return score_by_count(known).join(sizes, "table_id").select(*PAIR, "pred", F.round(F.col("n") / n, 3).alias("score"))


def inline_score(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """The sum of 1 / rows over the entity pairs that have each predicate."""
    return known.where("pred IS NOT NULL").join(sizes, "table_id").groupBy(*PAIR, "pred").agg(F.round(F.sum(1 / F.col("nrows")), 6).alias("score"))


def best_relation(scores: DataFrame, value: str = "n") -> DataFrame:
    """The predicate with the highest score in each column pair; the last by name of equals."""
    return scores.groupBy(*PAIR).agg(F.max(F.struct(value, "pred")).alias("_m")).select(*PAIR, F.col("_m.pred").alias("pred"), F.col(f"_m.{value}").alias(value))


def relation_sets(known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The set of predicates by column pair, sorted."""
    return known.where("pred IS NOT NULL").groupBy(*(keys or PAIR)).agg(F.array_sort(F.collect_set("pred")).alias("relations"))


def candidates(pairs: DataFrame, known: DataFrame, clusters: DataFrame, cluster_relations: DataFrame) -> DataFrame:
    """Label 1 for each predicate that is known to hold, 0 for each other one of the cluster's column pair.

    pairs: table_id, row_no, c1, c2, subj, obj; clusters: table_id, cluster; cluster_relations: cluster, c1, c2, pred."""
    keys = ["table_id", "row_no", "c1", "c2", "subj", "obj"]
    placed = pairs.select(*keys).dropDuplicates().join(clusters, "table_id")
    true = placed.join(known.where("pred IS NOT NULL").select(*keys, "pred").dropDuplicates(), keys)
    possible = placed.join(cluster_relations, ["cluster", "c1", "c2"])
    false = possible.join(true.select(*keys, "pred"), [*keys, "pred"], "left_anti")
    columns = ["cluster", *keys, "pred"]
    return true.select(*columns, F.lit(1).alias("label")).unionByName(false.select(*columns, F.lit(0).alias("label")))


def candidates_three(pairs: DataFrame, known: DataFrame, clusters: DataFrame) -> DataFrame:
    """Origin 1: a predicate of the pair; 0: one of another row of the table's column pair; 2: one of another table
    of the cluster's column pair."""
    keys = ["table_id", "row_no", "c1", "c2", "subj", "obj"]
    placed = pairs.select(*keys).dropDuplicates().join(clusters, "table_id")
    facts = known.where("pred IS NOT NULL").select(*keys, "pred").dropDuplicates()
    in_table = facts.select(*PAIR, "pred").dropDuplicates()
    in_cluster = in_table.join(clusters, "table_id").select("cluster", "c1", "c2", "pred").dropDuplicates()
    one = placed.join(facts, keys)
    zero = placed.join(in_table, PAIR).join(facts, [*keys, "pred"], "left_anti")
    two = placed.join(in_cluster, ["cluster", "c1", "c2"]).join(in_table, [*PAIR, "pred"], "left_anti")
    columns = ["cluster", *keys, "pred"]
    return one.select(*columns, F.lit(1).alias("origin")).unionByName(zero.select(*columns, F.lit(0).alias("origin"))).unionByName(two.select(*columns, F.lit(2).alias("origin")))


def labelled(rows: DataFrame, of_cluster: DataFrame) -> DataFrame:
    """What :func:`candidates` gives, from rows that hold the predicates of their pair: table_id, row_no, cluster, c1,
    c2, subj, obj, preds. of_cluster: cluster, c1, c2 and ``possible``, all predicates there. Each row is joined with one
    row and expanded, so nothing is compared with an exploded copy."""
    pred = F.explode(F.coalesce("possible", "preds")).alias("pred")
    columns = ["cluster", "table_id", "row_no", "c1", "c2", "subj", "obj"]
    each = rows.join(of_cluster, ["cluster", "c1", "c2"], "left").select(*columns, "preds", pred)
    return each.select(*columns, "pred", F.when(F.array_contains("preds", F.col("pred")), 1).otherwise(0).alias("label"))


def of_origin(rows: DataFrame, of_cluster: DataFrame) -> DataFrame:
    """What :func:`candidates_three` gives, from rows as :func:`labelled` takes them, with ``near``, the predicates of the
    table's column pair."""
    pred = F.explode(F.coalesce("possible", "near")).alias("pred")
    columns = ["cluster", "table_id", "row_no", "c1", "c2", "subj", "obj"]
    each = rows.join(of_cluster, ["cluster", "c1", "c2"], "left").select(*columns, "preds", "near", pred)
    origin = F.when(F.array_contains("preds", F.col("pred")), 1).when(F.array_contains("near", F.col("pred")), 0).otherwise(2)
    return each.select(*columns, "pred", origin.alias("origin"))


def search_once(triples: DataFrame, patterns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first triple that matches each pattern on all keys."""
    first = Window.partitionBy(*keys).orderBy(order)
    return triples.join(patterns.select(*keys).dropDuplicates(), keys, "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def examples(triples: DataFrame, n: int = 5) -> DataFrame:
    """The first triples of each predicate."""
    first = Window.partitionBy("pred").orderBy("subj", "obj")
    return triples.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r")


def sample_per_group(rows: DataFrame, group: str, key: str, n: int = 2, seed: str = "0") -> DataFrame:
    """So many rows of each group, by the order of a hash of their key: a repeatable sample."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def sample_lines(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """So many rows of all, without replacement, by the order of a hash of their key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), key)), key).limit(n)
