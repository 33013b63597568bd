"""Communities: greedy modularity in each connected part, splitting of large groups, names and bridges."""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.graph import cut

MOST_ROUNDS, MOST_MEMBERS, LEAST_MEMBERS = 20, 200, 2


def connected_parts(adjacent: DataFrame) -> DataFrame:
    """(a, b) both ways -> node, part: the least node that a node is connected with. Rounds go on until nothing moves."""
    labels = cut(adjacent.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("part")))
    while True:
        seen = adjacent.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("seen"))
        new = labels.join(seen, "node").select("node", F.least("part", "seen").alias("part"), (F.col("seen") < F.col("part")).alias("moved"))
        # A part's own label may have moved on: follow it.
        hop = new.select(F.col("node").alias("part"), F.col("part").alias("further"))
        new = cut(new.join(hop, "part", "left").select("node", F.coalesce("further", "part").alias("part"), "moved"))
        labels = new.select("node", "part")
        if new.where("moved").isEmpty():
            return labels


def modularity_groups(neighbours: dict[str, list[str]], rounds: int = MOST_ROUNDS) -> dict[str, str]:
    """Local moving: a node joins the neighbouring group with the largest gain; nodes in order of name."""
    label = {x: x for x in neighbours}
    degree = {x: len(y) for x, y in neighbours.items()}
    total, twice = Counter(degree), sum(degree.values()) or 1
    for _ in range(rounds):
        moved = False
        for x in sorted(neighbours):
            own = label[x]
            total[own] -= degree[x]
            links = Counter(label[y] for y in neighbours[x])
            best = max([own, *links], key=lambda g: (links[g] - degree[x] * total[g] / twice, g == own, [-ord(c) for c in g]))
            total[best] += degree[x]
            moved |= best != own
            label[x] = best
        if not moved:
            break
    least: dict[str, str] = {}
    for x in sorted(label):
        least.setdefault(label[x], x)
    return {x: least[g] for x, g in label.items()}


def bisect(members: list[str], neighbours: dict[str, list[str]]) -> list[list[str]]:
    """Two halves grown around the two members that lie farthest apart; what neither reaches goes to the smaller."""
    inside = set(members)

    def distances(seed: str) -> dict[str, int]:
        found, todo = {seed: 0}, deque([seed])
        while todo:
            x = todo.popleft()
            for y in neighbours[x]:
                if y in inside and y not in found:
                    found[y] = found[x] + 1
                    todo.append(y)
        return found

    far = len(members) + 1
    a = min(members)
    b = max(sorted(members), key=lambda x, d=distances(a): d.get(x, far))
    da, db = distances(a), distances(b)
    left = [x for x in members if da.get(x, far) <= db.get(x, far) and x != b]
    right = [x for x in members if x not in set(left)]
    return [left, right] if left and right else [members[: len(members) // 2], members[len(members) // 2 :]]


def split_large(members: list[str], neighbours: dict[str, list[str]], most: int = MOST_MEMBERS) -> list[list[str]]:
    """Groups of at most ``most`` members; every member stays in one."""
    done, todo = [], [sorted(members)]
    while todo:
        group = todo.pop()
        if len(group) <= most:
            done.append(group)
        else:
            todo += bisect(group, neighbours)
    return done


def communities(adjacent: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(a, b) both ways -> node, community. One task for each connected part: meant for graphs of code, whose parts fit in a task."""
    parts = connected_parts(adjacent)
    rows = adjacent.join(parts.withColumnRenamed("node", "a"), "a")

    def group(pdf):
        import pandas as pd

        neighbours = pdf.groupby("a").b.apply(sorted).to_dict()
        by: dict[str, list[str]] = {}
        for x, g in modularity_groups(neighbours).items():
            by.setdefault(g, []).append(x)
        out = [(x, part[0]) for members in by.values() for part in split_large(members, neighbours, most) for x in part]
        return pd.DataFrame(out, columns=["node", "community"])

    return rows.groupBy("part").applyInPandas(group, "node string, community string")
