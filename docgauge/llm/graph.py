"""Connected components of a graph given by edges, in joins; nothing of it reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, pin, sweep, unsent, unsized


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of edges (a, b); comp is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so
    a chain of n nodes takes about log n rounds and a star two. Hubs, and labels that many nodes have, may be split.
    """
    both = unsized(pin(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    labels = unsized(pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))))
    while True:
        near = dealt_join(both, labels, "b", "node").groupBy("a").agg(F.min("comp").alias("near"))
        new = pin(labels.join(unsent(near), F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", "near").alias("next")))
        jump = new.select(F.col("node").alias("j"), F.col("next").alias("jump"))
        new = pin(dealt_join(new, jump, "next", "j").select("node", "comp", F.least("next", "jump").alias("next")))
        changed = new.where("comp <> next").limit(1).count()
        labels = unsized(new.select("node", F.col("next").alias("comp")))
        near = jump = new = None
        sweep(edges.sparkSession)
        if not changed:
            return labels


def chains(links: DataFrame) -> DataFrame:
    """(node, comp) for links (a, b), b following a, each node at most once on either side; comp is the chain's first node, a ring's smallest.

    Pointers double each round, so a chain of n nodes takes log n rounds.
    """
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("prev")).union(links.select("a", F.lit(None).cast("long")))
    nodes = ends.groupBy("node").agg(F.max("prev").alias("prev"))
    now = pin(nodes.select("node", F.coalesce("prev", "node").alias("ptr"), F.struct(F.col("prev").isNotNull().alias("inner"), F.col("node").alias("id")).alias("best")))
    while True:
        step = now.select(F.col("node").alias("j"), F.col("ptr").alias("far"), F.col("best").alias("more"))
        new = pin(dealt_join(now, step, "ptr", "j").select("node", F.col("far").alias("ptr"), F.col("best").alias("old"), F.least("best", "more").alias("best")))
        changed = new.where("old <> best").limit(1).count()
        now, step = unsized(new.select("node", "ptr", "best")), None
        sweep(links.sparkSession)
        if not changed:
            return now.select("node", F.col("best.id").alias("comp"))


WAVES = 2


def tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{c}_{tag}") for c in df.columns])


def star_pairs(posts: DataFrame, cols: list[str], may_link: Callable[[str, str], Column], best_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """For postings (tok, id, cols...): keys that need more than these pairs, and pairs of ids with pivots: (k), (a, b).

    A key's pivot is its smallest posting by cols. With best_only an id meets the pivot it shares most keys with,
    otherwise every pivot that it may link with; keys of two postings are then done.
    """
    pivots = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*cols, "id")).alias("v")).where("c > 1")
    pivots = pin(tagged(pivots.select("tok", "c", "v.*"), "v"))
    star = dealt_join(tagged(posts, "x"), pivots, "tok_x", "tok_v").where((F.col("id_x") != F.col("id_v")) & may_link("x", "v"))
    toks = pivots.where(F.col("c_v") > (1 if best_only else 2)).select(F.col("tok_v").alias("k"))
    if not best_only:
        return toks, star.select(F.col("id_x").alias("a"), F.col("id_v").alias("b")).distinct()
    best = star.groupBy("id_x", "id_v").agg(F.count(F.lit(1)).alias("s")).groupBy("id_x").agg(F.max(F.struct("s", "id_v")).alias("m"))
    return toks, best.select(F.col("id_x").alias("a"), F.col("m.id_v").alias("b"))


def cross_waves(posts: DataFrame, cols: list[str], may_link: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], edges: DataFrame, last: Callable[[DataFrame, DataFrame], DataFrame], waves: int = WAVES) -> DataFrame:
    """Components (node, comp) of all links, given postings (tok, id, cols...) and the links found so far.

    Only keys that still join different components go on. The first waves test each
    component's pivot at a key against that of the key's largest component. The last one tests whatever pairs across
    components may still link: last(postings with comp, counts of their keys) makes these pairs (a, b), by finer keys than
    tok, so that a frequent key is not paired with itself. Pairs within a component need no test.
    """
    comps = components(edges)
    for wave in range(waves):
        own = pin(posts.join(unsent(comps), F.col("id") == F.col("node"), "left").select("tok", "id", *cols, F.coalesce("comp", "id").alias("comp")))
        stats = pin(own.groupBy(F.col("tok").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")))
        if not stats.where("lo <> hi").limit(1).count():
            break
        posts = None
        sweep(own.sparkSession)
        own = pin(dealt_join(own, stats.select("k", (F.col("lo") != F.col("hi")).alias("live")), "tok", "k").where("live").drop("k", "live"))
        if wave < waves - 1:
            by_comp = own.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*cols, "id")).alias("v"))
            hubs = by_comp.groupBy("tok").agg(F.max(F.struct("c", "comp", "v")).alias("h"))
            hubs = tagged(hubs.select("tok", F.col("h.comp").alias("comp"), "h.v.*"), "h")
            left = tagged(by_comp.select("tok", "comp", "v.*"), "x")
            meet = dealt_join(left, hubs, "tok_x", "tok_h")
            pairs = meet.where((F.col("comp_x") != F.col("comp_h")) & may_link("x", "h")).select(F.col("id_x").alias("a"), F.col("id_h").alias("b"))
        else:
            pairs = last(own, stats.where("lo <> hi").select("k", "n"))
        sweep(own.sparkSession)
        more = pin(verify(pairs.distinct()))
        if more.limit(1).count():
            edges = edges.union(more)
            comps = components(edges)
        posts = own.drop("comp")
        sweep(posts.sparkSession)
    return comps
