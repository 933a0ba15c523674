"""Link graph and project formation.

X2 (reference parity) — greedy one-hop groups in card order: a shared job is
a *seed* unless an earlier seed links to it; a group is a seed plus the jobs
it links to. Sequential in the reference; here by order-prefix contraction:
each round takes the longest prefix of the order whose inner links fit one bounded
task, which scans them in order and so settles the whole prefix; the jobs that
its seeds link to, the settled jobs and their links leave the state, and
the next prefix may hold twice as many links, up to a cap. In the same round
every undecided job without an undecided earlier in-neighbour is settled as a
seed wherever it stands, so links that hang together only loosely are settled
in parallel. Rounds: the logarithm of the links until the cap, then at
most links / cap. State is written to the shared checkpoint folder, so plans
stay one round deep and a lost executor re-reads it instead of replaying.

X3 (transitive) — connected components by hooking and pointer jumping with
the same round/checkpoint structure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.session import cut_lineage, scratch_path, written


def split_shared(jobs: DataFrame, flag: str = "shared_drains") -> tuple[DataFrame, DataFrame]:
    """(shared, standalone) by a boolean flag (null = standalone)."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return jobs.filter(f), jobs.filter(~f)


FIRST_LINKS, MOST_LINKS = 1 << 14, 1 << 19  # inner links of the first prefix, and of the largest


def _prefix_end(e: DataFrame, links: int, most: int):
    """(end, whole): links into an order value below ``end`` are ``most`` at best; ``whole`` if all are. From a sample of
    bounded size, then counted. (None, False) if no such end is found."""
    if links <= most:
        return None, True
    sample = sorted(r[0] for r in e.select("_do").sample(min(1.0, 20_000 / links), seed=links).collect())
    at = min(len(sample) - 1, len(sample) * most // links)
    while at > 0:
        end = sample[at]
        if 0 < e.filter(F.col("_do") < F.lit(end)).count() <= most:
            return end, False
        at //= 2
    return None, False


def _scan_prefix(inner: DataFrame) -> DataFrame:
    """The later nodes of a prefix that an earlier seed links to, by one scan of its links in order (one bounded task)."""
    node_type = inner.schema["_d"].dataType

    def scan(table):
        import pyarrow as pa
        lost: set = set()
        order = table.sort_by([("_do", "ascending")])
        for s, d in zip(order["_s"].to_pylist(), order["_d"].to_pylist()):
            if s not in lost:  # every link into s comes before: its end is earlier
                lost.add(d)
        return pa.table({"_n": pa.array(list(lost), type=table.schema.field("_d").type)})

    return inner.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(scan, f"_n {node_type.simpleString()}")


def greedy_seeds(nodes: DataFrame, edges: DataFrame, *, node: str = "name", order: str = "ord",
                 src: str = "src", dst: str = "dst", first_links: int = FIRST_LINKS, most_links: int = MOST_LINKS) -> DataFrame:
    """X2 seeds: ``(node, is_seed)`` for every row of ``nodes`` (the shared jobs).

    ``edges`` are directed links src -> dst; only links between two nodes with
    ord(src) < ord(dst) can veto a seed.
    """
    spark = nodes.sparkSession
    n = nodes.select(F.col(node).alias("_n"), F.col(order).alias("_o"))
    e = (edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
         .join(n.withColumnRenamed("_n", "_s").withColumnRenamed("_o", "_so"), "_s")
         .join(n.withColumnRenamed("_n", "_d").withColumnRenamed("_o", "_do"), "_d")
         .filter(F.col("_so") < F.col("_do")).select("_s", "_d", "_so", "_do"))
    # A seed vetoes its later neighbours at once, a member vetoes nothing: settled
    # nodes leave the links, and without links every node left is a seed. Every
    # round settles at least the sources of the earliest link.
    e = cut_lineage(e)
    members, rounds, most = scratch_path(spark, "greedy-members"), 0, first_links

    def keep(lost: DataFrame) -> DataFrame:
        lost = cut_lineage(lost.distinct())
        lost.write.mode("append").parquet(members)
        return lost

    def without(e: DataFrame, lost: DataFrame) -> DataFrame:
        return cut_lineage(e.join(lost.withColumnRenamed("_n", "_s"), "_s", "left_anti")
                           .join(lost.withColumnRenamed("_n", "_d"), "_d", "left_anti"))

    while links := e.count():
        rounds += 1
        end, whole = _prefix_end(e, links, most)
        if whole:
            keep(_scan_prefix(e))
            break
        most = min(2 * most, most_links)
        if end is not None:
            lost = cut_lineage(_scan_prefix(e.filter(F.col("_do") < F.lit(end))))
            # nodes before the end are settled: those not lost are seeds
            lost = keep(lost.unionByName(e.filter((F.col("_so") < F.lit(end)) & (F.col("_do") >= F.lit(end)))
                                         .join(lost.withColumnRenamed("_n", "_s"), "_s", "left_anti").select(F.col("_d").alias("_n"))))
            e = without(e.filter(F.col("_so") >= F.lit(end)), lost)
        # a source that is no later node is a seed: its links, and those of its members, are done
        later = e.select(F.col("_d").alias("_s")).distinct()
        lost = keep(e.join(later, "_s", "left_anti").select(F.col("_d").alias("_n")))
        e = without(e.join(later, "_s", "left_semi"), lost)
    greedy_seeds.rounds = rounds
    if not rounds:
        return n.select(F.col("_n").alias(node), F.lit(True).alias("is_seed"))
    lost = spark.read.schema(n.select("_n").schema).parquet(members).distinct().withColumn("_lost", F.lit(True))
    return n.join(lost, "_n", "left").select(F.col("_n").alias(node), F.col("_lost").isNull().alias("is_seed"))


def greedy_groups(shared: DataFrame, all_jobs: DataFrame, edges: DataFrame, *, node: str = "name",
                  order: str = "ord", src: str = "src", dst: str = "dst") -> DataFrame:
    """X2 + X4: bridge rows ``(project, job)``; project = sorted member names
    joined with ' + '. Members = seed ∪ its links that are jobs; equal names collapse."""
    edges = written(edges.select(src, dst), "links")  # for the seeds, then for their members
    seeds = greedy_seeds(shared, edges, node=node, order=order, src=src, dst=dst) \
        .filter("is_seed").select(F.col(node).alias("_seed"))
    known = all_jobs.select(F.col(node).alias("_m")).distinct()
    links = (edges.select(F.col(src).alias("_seed"), F.col(dst).alias("_m"))
             .join(seeds, "_seed").join(known, "_m"))
    members = seeds.withColumn("_m", F.col("_seed")).unionByName(links).distinct()
    # a group is a seed's direct links: bounded by one card's attachments
    names = members.groupBy("_seed").agg(F.array_join(F.array_sort(F.collect_set("_m")), " + ").alias("project"))
    return (members.join(names, "_seed")
            .select("project", F.col("_m").alias(node)).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame, *, node: str = "name", src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """``(node, component)`` with component = smallest node id reachable
    over undirected edges.

    Hooking plus pointer jumping: every round a node and its parent take the
    smallest grandparent seen over an edge, and every node skips to its own
    grandparent. Labels travel twice as far each round, so the rounds grow
    with the logarithm of the longest path, and the loop ends only when no
    label changed. Each round is partial minima and joins on one key (AQE
    splits the hot root of a giant component) and is checkpointed.
    """
    n = nodes.select(F.col(node).alias("_n")).filter(F.col("_n").isNotNull()).distinct()
    e0 = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).filter(F.col("_a") != F.col("_b"))
    e = cut_lineage(e0.unionByName(e0.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()
                    .join(n.withColumnRenamed("_n", "_a"), "_a", "left_semi")
                    .join(n.withColumnRenamed("_n", "_b"), "_b", "left_semi"))
    # only linked nodes take part in the rounds; the others are their own component
    state = cut_lineage(e.select(F.col("_a").alias("_n")).distinct().withColumn("_p", F.col("_n")))
    rounds = 0
    while True:
        rounds += 1
        up = (state.join(state.select(F.col("_n").alias("_p"), F.col("_p").alias("_g")), "_p")
              .select("_n", "_p", "_g"))
        over = (e.join(up.select(F.col("_n").alias("_b"), "_g"), "_b")
                .groupBy(F.col("_a").alias("_n")).agg(F.min("_g").alias("_m")))
        best = up.join(over, "_n", "left").withColumn("_c", F.least("_g", "_m"))
        new = (best.select("_n", F.col("_c"), F.col("_p").alias("_old"))
               .unionByName(best.select(F.col("_p").alias("_n"), "_c", F.lit(None).cast(state.schema["_n"].dataType)
                                        .alias("_old")))
               .groupBy("_n").agg(F.min("_c").alias("_p"), F.min("_old").alias("_old")))
        new = cut_lineage(new)
        changed = new.filter(F.col("_p") < F.col("_old")).limit(1).count()
        state = new.drop("_old")
        if not changed:
            break
    connected_components.rounds = rounds
    return (n.join(state, "_n", "left")
            .select(F.col("_n").alias(node), F.coalesce("_p", "_n").alias("component")))


def project_members(groups: DataFrame, standalone: DataFrame, *, node: str = "name") -> DataFrame:
    """projects = groups ∪ standalone jobs (each its own project); on a name
    clash the standalone project wins. Rows: (project, job, shared_drains)."""
    solo = standalone.select(F.col(node).alias("project"), F.col(node).alias(node),
                             F.lit(False).alias("shared_drains"))
    grp = (groups.join(solo.select("project"), "project", "left_anti")
           .select("project", node, F.lit(True).alias("shared_drains")))
    return grp.unionByName(solo)
