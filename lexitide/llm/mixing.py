"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas, where each further
repetition of a token costs more, then whole documents picked in seeded order."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import holding, named, prepare, small, stage, uniform, unstage

#: A word, as the size of a document counts them.
WORD = r"[^\x20\x09-\x0D]+"


def quotas(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """total shared by weight; a share stops at cap times its size and the excess is shared again by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(float(total), cap * float(sum(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        if w <= 0:
            break
        share = {i: left * weights[i] / w for i in open_}
        full = [i for i in open_ if share[i] >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = cap * float(sizes[i])
            left -= out[i]
        open_ -= set(full)
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Tokens sent from each pattern to each of its sources. Pattern p has `repeats` arcs of capacity[p] tokens at
    costs 1, 2, ...; source s takes at most quota[s]. Successive shortest paths with potentials, so the flow is
    largest and, among the largest, repeats as little as possible."""
    P, S = len(capacity), len(quota)
    src, dst = P + S, P + S + 1
    head: list[list[int]] = [[] for _ in range(P + S + 2)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        head[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        head[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)

    for p in range(P):
        for r in range(repeats):
            arc(src, p, capacity[p], r + 1)
        for s in members[p]:
            arc(p, P + s, capacity[p] * repeats, 0)
    for s in range(S):
        arc(P + s, dst, quota[s], 0)
    potential = [0] * (P + S + 2)
    while True:
        far = [float("inf")] * (P + S + 2)
        by = [-1] * (P + S + 2)
        far[src], heap = 0, [(0, src)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in head[a]:
                if cap[e] > 0 and (n := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], by[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if by[dst] < 0:
            break
        for v, d in enumerate(far):
            if d < float("inf"):
                potential[v] += d
        push, v = float("inf"), dst
        while v != src:
            push, v = min(push, cap[by[v]]), to[by[v] ^ 1]
        v = dst
        while v != src:
            cap[by[v]] -= push
            cap[by[v] ^ 1] += push
            v = to[by[v] ^ 1]
    return [{to[e] - P: cap[e ^ 1] for e in head[p] if e % 2 == 0 and cap[e ^ 1] > 0} for p in range(P)]


def mix(docs: DataFrame, weights: dict[str | None, float], share: float = 1.5, max_repeats: int = 2, id_col: str = "doc_id", size_col: str = "size", sources_col: str = "sources", seed: int = 11, buckets: int = 4096, rows_per_bucket: int = 20_000, max_patterns: int = 20_000) -> tuple[DataFrame, dict]:
    """docs with taken long and copies int added (in place of columns of these names), and the plan: sizes, targets and
    tokens taken by source.

    sources_col is an array of source names, one document may be in several (nulls are a source of their own; an
    empty or null array is one too, weighing what None weighs). A source's target is its weight's part of share times
    all sizes, at most max_repeats times its size. A pattern that must give F tokens of its total T takes every
    document F // T times and, in seeded order, whole documents once more until F mod T is met: those that overshoot are
    passed over, in rounds over the ones that still fit, until none does; then the nearest one closes the gap if that
    comes nearer. The order hashes the id, the size and the sources, so rows with equal or null ids are documents of
    their own; rows that agree in all three are exchangeable. Reruns agree. A null size counts as 0; documents of size 0
    are taken 0 words. No rows give no rows. Buckets of the order grow with the data. Only patterns (at most
    max_patterns, else an error) and their sums reach the driver.
    """
    prepare(docs.sparkSession)
    docs = named(docs, "taken", "copies", needs=(id_col, size_col, sources_col))
    names = F.when(F.coalesce(F.size(sources_col), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources_col)))
    pattern = F.to_json(F.struct(F.transform(names, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))).alias("m")))
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    # The input stays in one column of its own, so none of its names can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("string").alias("id"), size.alias("n"), pattern.alias("m"))
    keyed = stage(keyed.withColumns({"u": uniform("id", "n", "m", seed=seed), "row": F.monotonically_increasing_id()}), "mix-base")
    sums = keyed.groupBy("m").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    buckets = max(buckets, sum(r["rows"] for r in sums) // rows_per_bucket)
    patterns = sorted((r["m"], int(r["n"])) for r in sums)
    inside = [[None if x == "-" else x[1:] for x in json.loads(m)["m"]] for m, _ in patterns]
    sources = sorted({s for m in inside for s in m if s is not None}) + [None] * any(None in m for m in inside)
    place = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for (_, n), m in zip(patterns, inside):
        for s in m:
            sizes[place[s]] += n
    targets = quotas(sizes, [float(weights.get(s, 0.0)) for s in sources], share * sum(n for _, n in patterns), float(max_repeats))
    flow = min_cost_flow([n for _, n in patterns], [[place[s] for s in m] for m in inside], [round(t) for t in targets], max_repeats)
    plan = []
    for (m, n), f in zip(patterns, flow):
        whole, rest = divmod(sum(f.values()), n) if n else (0, 0)
        plan.append((m, int(whole), int(rest)))
    spark = docs.sparkSession
    wanted = F.broadcast(small(spark, plan, "m string, whole int, rest long"))  # at most max_patterns rows
    slim = ["m", "b", "u", "id", "row", "n"]
    gaps = {m: rest for m, _, rest in plan if rest}
    steps: dict[str, list[tuple[int, int]]] = {m: [] for m in gaps}
    bucket = F.floor(F.col("u") * buckets).cast("int")
    pool, fits, held = keyed.where("n > 0").withColumn("b", bucket).select(*slim), None, []
    while any(gaps.values()):
        gap = F.broadcast(small(spark, [(m, g) for m, g in gaps.items() if g], "m string, gap long"))
        pool = pool.join(gap, "m").where(F.col("n") <= F.col("gap"))
        per = pool.groupBy("m", "b").agg(F.sum("n").alias("bn"), F.first("gap").alias("gap"))
        before = F.sum("bn").over(Window.partitionBy("m").orderBy("b")) - F.col("bn")
        edge = per.withColumn("before", before).where((F.col("before") <= F.col("gap")) & (F.col("before") + F.col("bn") > F.col("gap")))
        edge = F.broadcast(edge.select("m", F.col("b").alias("edge"), (F.col("gap") - F.col("before")).alias("left")))  # one row a pattern
        within = F.sum("n").over(Window.partitionBy("m", "b").orderBy("u", "id", "row"))
        pool = pool.join(edge, "m", "left").withColumn("edge", F.coalesce("edge", F.lit(buckets))).withColumn("cum", within)
        pool = stage(pool.withColumn("takes", (F.col("b") < F.col("edge")) | ((F.col("b") == F.col("edge")) & (F.col("cum") <= F.col("left")))), "mix-round")
        held.append(pool)
        got = pool.where("takes").groupBy("m").agg(F.sum("n"), F.first("edge")).collect()
        if not got:
            break
        edge_rows = pool.where("takes and b = edge").select("row")
        fits = edge_rows if fits is None else fits.unionByName(edge_rows)
        for m, n, e in got:
            steps[m].append((gaps[m], e))
            gaps[m] -= n
        # What fits nowhere now never will, as gaps shrink; a pattern without a row that fits is done.
        pool = pool.where("not takes").select(*slim)
    # A round took every document of at most its gap in the buckets before its edge, and those of the edge that are listed.
    rounds = F.broadcast(small(spark, [(m, gaps[m], [{"gap": g, "edge": e} for g, e in x]) for m, x in steps.items()], "m string, gap long, steps array<struct<gap: long, edge: int>>"))
    known = keyed.withColumn("b", bucket).join(wanted, "m").join(rounds, "m", "left")
    once = F.exists("steps", lambda x: (F.col("n") <= x["gap"]) & (F.col("b") < x["edge"]))
    fits = stage(fits if fits is not None else keyed.select("row").limit(0), "mix-fits")
    unstage(*held)
    # Only rows of an edge's bucket, few of all, are looked up in the list.
    at_edge = F.coalesce(F.exists("steps", lambda x: F.col("b") == x["edge"]), F.lit(False))
    listed = known.where(at_edge).join(fits.withColumn("fit", F.lit(True)), "row", "left")
    extra = known.where(~at_edge).withColumn("fit", F.lit(None).cast("boolean")).unionByName(listed).withColumn("once", F.coalesce(F.col("fit"), once, F.lit(False)))
    # The gap left is less than every document that isn't taken; the nearest one is taken if that brings the sum nearer.
    off = F.abs(F.col("n") - F.col("gap"))
    chosen = extra.where(~F.col("once") & (F.col("n") > 0) & (off < F.col("gap"))).groupBy("m").agg(F.min(F.struct(off.alias("off"), "u", "id", "row")).alias("c")).select("c.row")
    chosen = stage(chosen, "mix-closing")  # one row a pattern
    closing = F.broadcast(chosen.withColumn("closes", F.lit(True)))
    out = extra.join(closing, "row", "left").withColumn("copies", (F.coalesce("whole", F.lit(0)) + F.when(F.col("once") | F.coalesce("closes", F.lit(False)), 1).otherwise(0)).cast("int"))
    out = out.select("doc.*", (F.col("copies") * F.col("n")).alias("taken"), "copies")
    return holding(out, keyed, fits, chosen), {"sources": sources, "sizes": sizes, "targets": targets, "flow": flow, "patterns": patterns}
