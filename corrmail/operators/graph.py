"""Connected components: by label propagation with shortcuts, by contraction, as edges arrive; spanning forests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there, columns are pruned, and sizes are known."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, a local master gets a folder on this machine; on a cluster that would lose files, so it is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/corrmail"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return (spark.conf.get("spark.checkpoint.dir", None) or found).rstrip("/")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of ``edges`` (a, b) is connected with.

    In each round an id takes the smallest label of its neighbours and then the label of what it points at, so
    paths shorten by half or more; lineage ends at a checkpoint in every round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("id").alias("up"), F.col("new").alias("top"))
        step = checkpointed(step.join(up, F.col("new") == F.col("up"), "left").select("id", "label", F.least("new", "top").alias("new")))
        labels = step.select("id", F.col("new").alias("label"))
        if step.filter("new < label").isEmpty():
            return labels


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, root) of pointers (id, to) without cycles but a root that points at itself: paths halve in each round."""
    now = checkpointed(pointers.select("id", "to"))
    while True:
        far = now.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        step = checkpointed(now.join(far, F.col("to") == F.col("_id")).select("id", "to", "_to"))
        now = step.select("id", F.col("_to").alias("to"))
        if step.filter("to != _to").isEmpty():
            return now.select("id", F.col("to").alias("root"))


def spanning_forest(edges: DataFrame, weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """The edges (a, b, weight, others) that are accepted when they join two components, in the order of their weights.

    Returns these edges and (id, label), the smallest id of the component of each id.  Weights must differ and can be
    ordered (a struct for an order by several columns).  Each round takes the least edge of every component (Borůvka),
    so that components at least halve, and goes on with the least edge between each two components that are left:
    edges inside a component are never met again.
    """
    names = [c for c in edges.columns if c not in ("a", "b", weight)]
    kept = F.struct(F.col(weight).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"), *names)
    left = edges.filter("a != b").select(F.col("a").alias("u"), F.col("b").alias("v"), kept.alias("e"))
    accepted, levels = [], []
    while True:
        between = left.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min_by("e", "e.w").alias("e"))
        left = checkpointed(between.filter("u != v"))
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        pick = checkpointed(both.groupBy("u").agg(F.min_by(F.struct("e", "v"), "e.w").alias("p")).select("u", "p.e", "p.v"))
        accepted.append(pick.select("e"))
        # two components that take the same edge point at each other; the smaller id is the root
        other = pick.select(F.col("u").alias("_u"), F.col("e.w").alias("_w"))
        to = F.when((F.col("e.w") == F.col("_w")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v"))
        roots = _roots(pick.join(other, F.col("v") == F.col("_u")).select(F.col("u").alias("id"), to.alias("to")))
        levels.append(roots)
        name = lambda c: roots.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"_{c}_root"))  # noqa: E731, B023
        left = left.join(name("u"), F.col("u") == F.col("_u")).join(name("v"), F.col("v") == F.col("_v")).select(F.col("_u_root").alias("u"), F.col("_v_root").alias("v"), "e")
    if not levels:
        empty = edges.limit(0)
        return empty, empty.select(F.col("a").alias("id"), F.col("a").alias("label"))
    found = accepted[0]
    for more in accepted[1:]:
        found = found.unionByName(more)
    forest = checkpointed(found.dropDuplicates(["e"]).select("e.a", "e.b", F.col("e.w").alias(weight), *[f"e.{c}" for c in names]))
    labels = levels[-1]
    for roots in reversed(levels[:-1]):  # what a root became in later rounds
        later = labels.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        labels = roots.join(later, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    least = labels.groupBy("root").agg(F.min("id").alias("label"))
    return forest, checkpointed(labels.join(least, "root").select("id", "label"))


def contracted_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(id, label) as ``components``: each round contracts the graph, so a hub meets its edges once.

    An id points at the neighbour with the least hash, which differs in each round, so chains of ids in order are
    short too.  The number of edges left goes to ``rounds``.
    """
    left = checkpointed(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    levels = []
    while True:
        n = left.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(levels))).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("id"), F.least(F.col("m"), key("a")).alias("m"))
        roots = _roots(to.select("id", F.col("m.x").alias("to")))
        levels.append(roots)
        name = lambda c: roots.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"_{c}_root"))  # noqa: E731, B023
        moved = left.join(name("a"), F.col("a") == F.col("_a")).join(name("b"), F.col("b") == F.col("_b"))
        moved = moved.select(F.least("_a_root", "_b_root").alias("a"), F.greatest("_a_root", "_b_root").alias("b"))
        left = checkpointed(moved.filter("a != b").distinct())
    labels = ids.select("id", F.col("id").alias("root"))
    for roots in levels:
        step = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        labels = labels.join(step, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    least = labels.groupBy("root").agg(F.min("id").alias("label"))
    return checkpointed(labels.join(least, "root").select("id", "label"))


def changed_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of the ids whose label is new or changes when ``edges`` join stored ``labels`` (id, label).

    Edges go over to the labels of their ends, so that the graph to solve has one node for each stored component that
    the edges touch; ids of components that no edge touches are not among the result.
    """
    known = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    ends = checkpointed(edges.select("a", "b").distinct())
    met = checkpointed(ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(known, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_label", "id").alias("at"), F.col("_label").isNull().alias("fresh")))
    name = lambda c: met.select(F.col("id").alias(f"_{c}"), F.col("at").alias(f"_{c}_at"))
    small = ends.join(name("a"), F.col("a") == F.col("_a")).join(name("b"), F.col("b") == F.col("_b")).select(F.col("_a_at").alias("a"), F.col("_b_at").alias("b"))
    moves = contracted_components(small).select(F.col("id").alias("_at"), F.col("label").alias("_to"))
    new = met.filter("fresh").join(moves, F.col("at") == F.col("_at"), "left").select("id", F.coalesce("_to", "at").alias("label"))
    old = labels.join(moves.filter("_at != _to"), F.col("label") == F.col("_at")).select("id", F.col("_to").alias("label"))
    return new.unionByName(old)
