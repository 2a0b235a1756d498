"""Traversal, distances, PageRank, components, communities and paths over edge frames."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from chronoloom.session import settle, written


def hop_distances(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """id, distance of what lies within ``depth`` hops of start; ``edges``: a, b, both ways.

    The frontier alone is joined; every round is written to the shared folder.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id string, distance int")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front["id"] == edges["a"]).select(F.col("b").alias("id")).distinct()
        front = settle(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame, legacy: bool = False) -> DataFrame:
    """Edges (source_id, target_id, …) with both ends among nodes (id); ``legacy`` asks for one end."""
    s = edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    if legacy:
        return s.unionByName(edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")).distinct()
    return s.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 20, epsilon: float | None = None, every: int = 1) -> DataFrame:
    """Personalised PageRank: id, score.  ``edges``: a, b, w (directed); ``seeds``: id, p (sums to 1).

    s' = alpha W's + (1 - alpha) p + alpha (dangling mass) p; stops after ``rounds`` or at an L1 change below
    epsilon.  Empty edges leave the seeds' own mass.

    Plan: a round is one join of the state with the edges and one aggregation of the flows together with the
    nodes' own rows.  The state, read by both, is written to the shared folder each round (every
    ``every`` rounds); where dangling nodes or epsilon ask for sums over it, it is observed as it is written.
    """
    out = edges.groupBy("a").agg(F.sum("w").alias("t"))
    step = settle(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("t")).alias("w")))
    ends = edges.select(F.col("a").alias("id"), F.lit(0.0).alias("p"), F.lit(1).alias("has")).union(edges.select("b", F.lit(0.0), F.lit(0))).union(seeds.select("id", "p", F.lit(0)))
    nodes = settle(ends.groupBy("id").agg(F.max("p").alias("p"), (F.max("has") == 0).alias("dangling")))
    watched = epsilon is not None or nodes.where("dangling").limit(1).count() > 0
    mass = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("s"))), F.lit(0.0)).alias("lost")
    state = nodes.withColumn("s", F.col("p")).withColumn("o", F.lit(0.0))
    lost = state.agg(mass).first()[0] if watched else 0.0
    for i in range(rounds):
        flow = step.join(state.select(F.col("id").alias("a"), "s"), "a").select(F.col("b").alias("id"), (F.col("w") * F.col("s")).alias("f"), F.lit(0.0).alias("p"), F.lit(0.0).alias("o"), F.lit(False).alias("dangling"))
        own = state.select("id", F.lit(0.0).alias("f"), "p", F.col("s").alias("o"), "dangling")
        new = flow.unionByName(own).groupBy("id").agg(F.sum("f").alias("f"), F.max("p").alias("p"), F.max("o").alias("o"), F.max("dangling").alias("dangling"))
        state = new.select("id", "p", "dangling", "o", (alpha * F.col("f") + ((1 - alpha) + alpha * lost) * F.col("p")).alias("s"))
        if watched:
            seen = Observation()
            state = settle(state.observe(seen, mass, F.coalesce(F.sum(F.abs(F.col("s") - F.col("o"))), F.lit(0.0)).alias("change")))
            lost = seen.get.get("lost") or 0.0
            if epsilon is not None and (seen.get.get("change") or 0.0) < epsilon:
                break
        elif (i + 1) % every == 0:
            state = settle(state)
    return state.select("id", F.col("s").alias("score"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (its smallest id) by hash-to-min with pointer jumping; ``edges``: a, b, both ways."""
    state = settle(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    for _ in range(rounds):
        low = edges.join(state, edges["b"] == state["id"]).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        new = state.join(low, "id").select("id", F.least("c", "m").alias("c"))
        jump = new.join(new.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c"))
        new = settle(jump)
        moved = new.join(state.withColumnRenamed("c", "o"), "id").where("c != o").limit(1).count()
        state = new
        if not moved:
            break
    return state.select("id", F.col("c").alias("component"))


def strength(edges: DataFrame) -> DataFrame:
    """id, degree, strength over both ends."""
    ends = edges.select(F.col("source_id").alias("id"), "weight").union(edges.select("target_id", "weight"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """q = sum over communities of in / W - gamma (K / 2W)^2.  ``edges``: source_id, target_id, weight, each pair once."""
    m = membership.select("id", "community")
    e = edges.join(m.select(F.col("id").alias("source_id"), F.col("community").alias("cs")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("community").alias("ct")), "target_id")
    ends = e.select(F.col("cs").alias("c"), "weight").union(e.select("ct", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    inside = e.where("cs = ct").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("i"))
    total = e.agg(F.sum("weight").alias("w"))
    q = F.coalesce("i", F.lit(0.0)) / F.col("w") - gamma * F.pow(F.col("k") / (2 * F.col("w")), F.lit(2.0))
    return ends.join(inside, "c", "left").crossJoin(F.broadcast(total)).agg(F.sum(q).alias("q"))


def _local_moving(nodes: list[str], links: dict[str, dict[str, float]], gamma: float, least: float, sweeps: int) -> dict[str, int]:
    """Sequential moves of nodes to the neighbouring community with the best gain, in id order."""
    total = sum(w for x in links.values() for w in x.values()) / 2
    if total <= 0:
        return {n: i for i, n in enumerate(nodes)}
    degree = {n: sum(links[n].values()) for n in nodes}
    home = {n: i for i, n in enumerate(nodes)}
    mass = {i: degree[n] for n, i in home.items()}
    for _ in range(sweeps):
        moved = False
        for n in nodes:
            here = home[n]
            toward: dict[int, float] = defaultdict(float)
            for m, w in links[n].items():
                if m != n:
                    toward[home[m]] += w
            best, best_gain = here, 0.0
            for c in sorted(toward):
                if c == here:
                    continue
                gain = (toward[c] - toward.get(here, 0.0)) / total - gamma * degree[n] * (mass[c] - (mass[here] - degree[n])) / (2 * total * total)
                if gain > best_gain + least:
                    best, best_gain = c, gain
            if best != here:
                mass[here] -= degree[n]
                mass[best] += degree[n]
                home[n] = best
                moved = True
        if not moved:
            break
    return home


def _split_connected(home: dict[str, int], links: dict[str, dict[str, float]]) -> dict[str, int]:
    """Refinement: communities that aren't connected fall apart."""
    out: dict[str, int] = {}
    fresh = 0
    for n in sorted(home):
        if n in out:
            continue
        stack = [n]
        out[n] = fresh
        while stack:
            x = stack.pop()
            for m in links[x]:
                if m not in out and home[m] == home[n]:
                    out[m] = fresh
                    stack.append(m)
        fresh += 1
    return out


def communities(edges: DataFrame, algorithm: str = "louvain", gamma: float = 1.0, levels: int = 3, least: float = 1e-4, sweeps: int = 100, giant: int = 200_000) -> DataFrame:
    """id, level, community (its smallest member id): Louvain (one level) or Leiden (refined, up to ``levels``).

    ``edges``: source_id, target_id, weight.  Repeated edges add up.  Components are found first; each is
    one group for the sequential kernel.  A component of more than ``giant`` edges doesn't fit one task: the same
    moves, levels and refinement run over joins (:func:`moved_communities`).
    """
    ab = edges.where("source_id != target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("w"))
    ab = settle(ab)
    sym = ab.select("a", "b").union(ab.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comp = settle(components(sym))
    rows = settle(ab.join(comp.withColumnRenamed("id", "a"), "a"))
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    big = size.where(F.col("n") > giant).select("component")

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for a, b, w in zip(frame["a"], frame["b"], frame["w"]):
            links[a][b] += w
            links[b][a] += w
        nodes = sorted(links)
        out, inside = [], {n: n for n in nodes}
        top_nodes, top_links = nodes, links
        for level in range(levels if algorithm == "leiden" else 1):
            home = _local_moving(top_nodes, top_links, gamma, least, sweeps)
            if algorithm == "leiden":
                home = _split_connected(home, top_links)
            members = defaultdict(list)
            for n in top_nodes:
                members[home[n]].append(n)
            name = {n: min(members[home[n]]) for n in top_nodes}
            new = {n: name[inside[n]] for n in nodes}
            if level and new == inside:
                break
            inside = new
            out += [(n, level, c) for n, c in inside.items()]
            merged: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            for a, x in top_links.items():
                for b, w in x.items():
                    merged[name[a]][name[b]] += w
            top_links = {a: {b: w for b, w in x.items() if b != a} for a, x in merged.items()}
            top_nodes = sorted(top_links)
            if len(top_nodes) < 2:
                break
        return pd.DataFrame(out, columns=["id", "level", "community"])

    out = rows.join(F.broadcast(big) if big.count() < 10_000 else big, "component", "left_anti").groupBy("component").applyInPandas(kernel, "id string, level int, community string")
    if big.limit(1).count():
        part = rows.join(big, "component", "left_semi")
        out = out.unionByName(moved_communities(part.select("a", "b", "w"), gamma, levels if algorithm == "leiden" else 1, algorithm == "leiden", least, sweeps))
    return out


def moved_communities(edges: DataFrame, gamma: float = 1.0, levels: int = 1, refine: bool = False, least: float = 1e-4, sweeps: int = 100) -> DataFrame:
    """id, level, community by local moving over joins; ``edges``: a, b, w, each pair once.

    Each sweep a part of the nodes, drawn by hash, moves at the same time to the neighbouring community with the
    best gain of modularity; the parts take turns, so that neighbours seldom swap places.  A level ends when all
    parts stand still.  ``refine`` lets communities that aren't connected fall apart; communities are the nodes
    of the next level.  Gains are those of the whole graph given.

    Plan: a sweep aggregates link weight by node and community and joins the communities' degrees, one row each;
    the state, a row per node, is written as a table every sweep.
    """
    sym = written(edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    total = (sym.agg(F.sum("w")).first()[0] or 0.0) / 2
    inside = written(sym.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
    out, parts = None, 2
    for level in range(levels):
        degree = written(sym.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        links = written(sym.where("a != b"))
        state, still = degree.withColumn("c", F.col("id")), 0
        for i in range(sweeps):
            mass = state.groupBy("c").agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("size"))
            toward = links.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("t"))
            near = state.select("id", "k", F.col("c").alias("own")).join(toward, "id").join(mass, "c")
            turn = F.pmod(F.xxhash64("id", F.lit(i // parts)), F.lit(parts)) == i % parts
            here = F.max(F.when(F.col("c") == F.col("own"), F.struct("t", "m"))).over(Window.partitionBy("id"))
            near = near.where(turn).withColumn("here", here).join(mass.select(F.col("c").alias("own"), F.col("m").alias("mine"), F.col("size").alias("peers")), "own")
            # two nodes alone don't swap their names: the one with the smaller name stays
            near = near.where((F.col("size") > 1) | (F.col("peers") > 1) | (F.col("c") <= F.col("own")))
            gain = (F.col("t") - F.coalesce("here.t", F.lit(0.0))) / total - gamma * F.col("k") * (F.col("m") - (F.col("mine") - F.col("k"))) / (2 * total * total)
            best = near.where("c != own").withColumn("gain", gain).where(F.col("gain") > least).groupBy("id").agg(F.min_by("c", F.struct(-F.col("gain"), "c")).alias("to"))
            state = written(state.join(best, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            still = 0 if state.where("moved").limit(1).count() else still + 1
            state = state.drop("moved")
            if still >= parts:
                break
        home = state.select("id", "c")
        if refine:  # the connected pieces of each community
            same = links.join(home.withColumnRenamed("id", "a"), "a").join(home.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b")
            same = written(same)
            pieces = components(same)
            home = home.join(pieces, "id", "left").select("id", F.coalesce("component", "id").alias("c"))
        named = home.groupBy("c").agg(F.min("id").alias("name"))
        home = written(home.join(named, "c").select("id", F.col("name").alias("c")))
        new = written(inside.join(home.select(F.col("id").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")))
        if level and not new.join(inside.withColumnRenamed("c", "o"), "id").where("c != o").limit(1).count():
            break
        inside = new
        rows = inside.select("id", F.lit(level).alias("level"), F.col("c").alias("community"))
        out = rows if out is None else out.unionByName(rows)
        to = lambda x: home.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
        sym = written(sym.join(to("a"), "a").join(to("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        if sym.select("a").distinct().limit(2).count() < 2:
            break
    return out


def neighbour_votes(new: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """id, community: the community most of a new node's neighbours are in (tie: the smallest), else itself."""
    near = new.join(edges, new["id"] == edges["a"]).select(F.col("id"), F.col("b")).join(membership.select(F.col("id").alias("b"), "community"), "b")
    votes = near.groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
    return new.join(best, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def dirty_communities(changed: DataFrame, membership: DataFrame) -> DataFrame:
    """community of each changed member."""
    return changed.join(membership, "id").select("community").distinct()


def cause_paths(edges: DataFrame, effect: str, depth: int) -> DataFrame:
    """path: simple paths from a first cause down to ``effect`` of at most ``depth`` edges, as "a>b>c".

    ``edges``: cause, effect.  A path is given out when its head has no further cause, or at the depth.
    """
    spark = edges.sparkSession
    paths = spark.createDataFrame([([effect],)], "path array<string>")
    done = None
    for d in range(depth):
        more = paths.join(edges, F.element_at("path", 1) == edges["effect"], "left")
        more = more.withColumn("ok", F.col("cause").isNotNull() & ~F.array_contains("path", F.coalesce("cause", F.lit(""))))
        ended = more.groupBy("path").agg(F.max("ok").alias("any")).where("NOT any").select("path")
        done = ended if done is None else done.union(ended)
        paths = settle(more.where("ok").select(F.concat(F.array("cause"), "path").alias("path")))
        if paths.limit(1).count() == 0:
            break
    else:
        done = done.union(paths)
    return done.where(F.size("path") > 1).select(F.array_join("path", ">").alias("path"))


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 6) -> DataFrame:
    """One shortest path (the smallest by ids) as path, hops; no row if there is none within ``depth``."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, start, 0)], "id string, path string, hops int")
    seen = front.select("id")
    for d in range(1, depth + 1):
        step = front.join(edges, front["id"] == edges["a"]).groupBy(F.col("b").alias("nid")).agg(F.min("path").alias("path"))
        step = step.join(seen.select(F.col("id").alias("nid")), "nid", "left_anti")
        front = settle(step.select(F.col("nid").alias("id"), F.concat("path", F.lit(">"), "nid").alias("path"), F.lit(d).alias("hops")))
        found = front.where(F.col("id") == end)
        if found.limit(1).count() or front.limit(1).count() == 0:
            return found.select("path", "hops")
        seen = seen.union(front.select("id"))
    return front.where(F.col("id") == end).select("path", "hops")


def link_search(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score: seeds 1, one hop 0.5, two hops 0.25, the best counting."""
    one = seeds.select("id").join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
    two = one.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
    rows = seeds.select("id", F.lit(1.0).alias("score")).unionByName(one.withColumn("score", F.lit(0.5))).unionByName(two.withColumn("score", F.lit(0.25)))
    return rows.groupBy("id").agg(F.max("score").alias("score"))


def summaries(membership: DataFrame, entities: DataFrame, shown: int = 3) -> DataFrame:
    """community, n, summary: members by type, their first names, in one line."""
    rows = membership.join(entities.select("id", "name", F.lower("entity_type").alias("t")), "id")
    w = Window.partitionBy("community", "t").orderBy("name", "id")
    counts = rows.groupBy("community", "t").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown).groupBy("community", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda z: z["name"]), ", ").alias("names"))
    line = F.concat("t", F.lit(": "), "names", F.when(F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    parts = counts.join(firsts, ["community", "t"]).groupBy("community").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("parts"))
    return parts.select("community", "n", F.concat(F.lit("A community of "), F.col("n").cast("string"), F.lit(" entities: "), "parts", F.lit(".")).alias("summary"))
