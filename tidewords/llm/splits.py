"""Splits that keep related records together.

Method: Boruvka's minimum-edge contraction. Sources are vertices; each shared video or person ties its
sources to one of them, a star, never all pairs. In every round each component takes its lightest edge
outwards, the chosen edges go to a spanning forest that is written to the shared folder, and components
contract to the roots of the chosen edges; their number at least halves. The forest can be written under its
own name (:func:`persist`). The components' roots are then stratified by size band and dealt to the splits
systematically, by clips: the few large ones one by one to the split that lacks most, the many small ones along the
line of their clips, which each split gets its share of every stretch of.

Weights are hashes of the edge, so all are different and every run chooses the same forest. Tables are
keyed by vertex or component; a person whom a third of the sources share is one vertex's star, summed
up before it is shuffled. Each round is written and read again, so nothing hangs on lost executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.llm.people import person_of
from tidewords.session import settle

#: A component is large if it has this part of all clips or more; so there are no more than this many.
LARGE = 4_096
#: Components of a size band to a stretch of the line; sources to a salt where a component's pairs are made, and most salts.
STRETCH, SALT, SALTS = 20, 64, 256


def video_key(video_id: Column, url: Column) -> Column:
    """The video's id, case kept; where it is null or blank, the one in the URL's query or path; else null."""
    own = F.nullif(F.trim(video_id), F.lit(""))
    query = F.nullif(F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1), F.lit(""))
    path = F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]+(?:/[^?#]*)?/([A-Za-z0-9_-]{11})/?(?:[?#]|$)", 1), F.lit(""))
    return F.coalesce(own, query, path)


def ties(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, tie``: the persons and videos of each source, once each. Nulls and labels that name nobody tie nothing."""
    person = person_of(F.col("speaker"))
    # the few distinct labels of a source are brought to one form, not every clip's
    named = clips.select("source_id", "speaker").where("speaker is not null and source_id is not null").distinct().select("source_id", person.alias("p")).where("p is not null and not startswith(p, '#')")
    video = sources.select("source_id", video_key(F.col("video_id"), F.col("source")).alias("v")).where("v is not null and source_id is not null")
    return named.select("source_id", F.concat(F.lit("p:"), "p").alias("tie")).unionByName(video.select("source_id", F.concat(F.lit("v:"), "v").alias("tie"))).distinct()


def edges(tied: DataFrame) -> DataFrame:
    """``a, b, w``: every source of a tie with the tie's least source."""
    hub = tied.groupBy("tie").agg(F.min("source_id").alias("b"), F.max("source_id").alias("top")).where("b <> top").select("tie", "b")
    out = tied.join(hub, "tie").where("source_id <> b").select(F.col("source_id").alias("a"), "b").distinct()
    return out.select("a", "b", F.struct(F.xxhash64("a", "b").alias("h"), F.col("a").alias("x"), F.col("b").alias("y")).alias("w"))


def forest(graph: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertex, root`` of every vertex and ``x, y``, the edges of the spanning forest.

    graph: ``a, b, w`` as :func:`edges` gives it; vertices: one column ``vertex``. A root is its component's
    least name after the last contraction; a vertex without edges is its own.
    """
    spark = graph.sparkSession
    labels = settle(vertices.select("vertex", F.col("vertex").alias("root")), "labels")
    live = settle(graph, "edges")
    trees: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("c"), F.col("b").alias("o"), "w").unionByName(live.select(F.col("b").alias("c"), F.col("a").alias("o"), "w"))
        best = settle(both.groupBy("c").agg(F.min(F.struct("w", "o")).alias("m")).select("c", F.col("m.o").alias("p"), F.col("m.w").alias("w")), "best")
        trees.append(best.select("w.x", "w.y").distinct())
        # of two components that chose each other the lesser is a root; longer cycles can't be, all weights differ
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = settle(best.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "up")
        while True:  # pointer jumping: the depth halves each time
            top = up.select(F.col("c").alias("p"), F.col("p").alias("g"))
            nxt = settle(up.join(top, "p").select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), "up")
            up = nxt.select("c", "p")
            if nxt.where("moved").isEmpty():
                break
        to = lambda df, col: df.join(up.select(F.col("c").alias(col), F.col("p").alias("to_" + col)), col, "left").withColumn(col, F.coalesce("to_" + col, col)).drop("to_" + col)
        labels = settle(to(labels, "root"), "labels")
        lighter = to(to(live, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        live = settle(lighter.groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    none = spark.createDataFrame([], "x string, y string")
    return labels, reduce(DataFrame.unionByName, trees, none)


def grown(clips: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outputs of :func:`forest` over every source that has a row in either table."""
    vertices = clips.select(F.col("source_id").alias("vertex")).unionByName(sources.select(F.col("source_id").alias("vertex"))).where("vertex is not null").distinct()
    return forest(edges(settle(ties(clips, sources), "ties")), vertices)


def components(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """``vertex, root`` of every source that has a row in either table."""
    return grown(clips, sources)[0]


def persist(labels: DataFrame, trees: DataFrame, folder: str) -> None:
    """Writes the forest as ``folder/membership`` (vertex, root) and ``folder/forest`` (x, y), over what is there."""
    labels.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/membership")
    trees.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/forest")


def together(labels: DataFrame) -> DataFrame:
    """``source_a, source_b``, smaller first: every pair of sources of one component.

    The pairs are the result that is asked for; membership in components says the same in a row per source. A component
    of many sources is spread over salts, so that no task makes all of its pairs.
    """
    many = labels.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    own = labels.join(many.select("root", F.least(F.lit(SALTS), F.ceil(F.col("n") / SALT)).cast("int").alias("salts")), "root")
    left = own.select("root", F.pmod(F.xxhash64("vertex"), F.col("salts")).cast("int").alias("salt"), F.col("vertex").alias("source_a"))
    right = own.select("root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("vertex").alias("source_b"))
    return left.join(right, ["root", "salt"]).where("source_a < source_b").select("source_a", "source_b")


def _deal_large(large: list[tuple[str, int]], goal: dict[str, float]) -> tuple[dict[str, str], dict[str, float]]:
    """The split of each large component, largest first, and what each split still lacks."""
    lacks, got = dict(goal), {}
    for root, n in sorted(large, key=lambda x: (-x[1], x[0])):
        split = max(lacks, key=lambda s: (lacks[s], goal[s]))
        got[root] = split
        lacks[split] -= n
    return got, lacks


def dealt(labels: DataFrame, clips: DataFrame, plan: DataFrame) -> DataFrame:
    """``id, split`` of every clip; all clips of a component get one split. plan: ``split, share``, as many rows as there are
    splits; shares that are null or not positive get nothing, others count by their sum; a plan without any is an error.

    Of all clips each split gets its share, but for one large component at most and the ends of the small ones' bands.
    A clip without source stands for itself; repeated rows count once.
    """
    shares = sorted(((r.split, float(r.share)) for r in plan.groupBy("split").agg(F.sum("share").alias("share")).where("share > 0 and split is not null and not isnan(share)").collect()), key=lambda x: (-x[1], x[0]))
    if not shares:
        raise ValueError("the plan has no split with a share")
    rows = clips.select("id", F.coalesce("source_id", F.concat(F.lit("clip:"), F.coalesce("id", F.lit("")))).alias("vertex")).distinct()
    sizes = rows.groupBy("vertex").agg(F.count("*").alias("n")).join(labels, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"), "n")
    sizes = settle(sizes, "sizes")
    roots = settle(sizes.groupBy("root").agg(F.sum("n").alias("n")), "roots")
    total = roots.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * LARGE >= total
    whole = sum(s for _, s in shares)
    goal = {name: total * s / whole for name, s in shares}
    first, lacks = _deal_large([tuple(r) for r in roots.where(large).collect()], goal)  # LARGE rows at most, as each has that part of all
    left = {name: max(0.0, x) for name, x in lacks.items()}
    left = left if sum(left.values()) > 0 else goal
    cuts, edge = [], 0.0
    for name, _ in shares:
        edge += left[name] / max(sum(left.values()), 1e-9)
        cuts.append((edge, name))
    # small components of a size band lie one after another, in hash order, on a line of clips; each stretch of the line is
    # shared out. What comes before a component is summed over hash buckets and then inside its own.
    small = roots.where(~large).select("root", "n", F.floor(F.log2("n")).alias("band"), F.xxhash64("root").alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 52))
    before = Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    band = Window.partitionBy("band")
    sums = small.groupBy("band", "bucket").agg(F.sum("n").alias("m"), F.count("*").alias("k"))
    sums = sums.select("band", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), (F.sum("m").over(band) / F.greatest(F.lit(1), F.round(F.sum("k").over(band) / STRETCH))).alias("stretch"))
    inside = F.sum("n").over(Window.partitionBy("band", "bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("start") + inside - F.col("n") / 2) / F.col("stretch")
    placed = small.join(sums, ["band", "bucket"]).select("root", (at - F.floor(at)).alias("u"))
    split = F.lit(cuts[-1][1])
    for edge, name in reversed(cuts[:-1]):
        split = F.when(F.col("u") < edge, F.lit(name)).otherwise(split)
    placed = placed.select("root", split.alias("split")).unionByName(clips.sparkSession.createDataFrame(sorted(first.items()), "root string, split string"))
    by_vertex = sizes.select("vertex", "root").join(placed, "root").select("vertex", "split")
    return rows.join(by_vertex, "vertex").select("id", "split")


def shares(splits: DataFrame) -> DataFrame:
    """``split, clips, share`` that :func:`dealt` reached."""
    n = splits.groupBy("split").agg(F.count("*").alias("clips"))
    return n.select("split", "clips", (F.col("clips") / F.sum("clips").over(Window.partitionBy())).alias("share"))  # a row per split
