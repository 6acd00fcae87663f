"""Mix sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources form a pattern;
only the pattern totals, not documents, enter the flow. A unit of flow is one token: it
leaves a pattern (as often as its tokens times the most repetitions, the k-th repetition
at cost k - 1), passes a source of the pattern and ends in the source's quota. Costs are convex and
sit on the pattern arcs alone, so filling the network level by level is a cheapest flow: every
first copy that can be used comes before any second copy.

The share of a pattern is then taken as whole documents: all of them as often as the flow
covers them completely, and once more the documents that come first in a seeded order, until the
rest is met. The cut is found from sums per hash cell, twice refined, so no pattern is sorted
in one task.

Null text has no words. A null source is a source of its own. A null id orders as empty text. Rows
alike in id and text tie; both stand together on one side of the cut or are cut arbitrarily, as
they are the same. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_table(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``target`` and ``quota`` per source from (source, source_size).

    Sources in code point order, null last, take the weights in turn. A source stops at ``most``
    times its size; what it cannot take is shared by weight among the others. The sources that
    stop are a prefix of those ordered by ceiling over weight, which running sums find at once.
    The table has one row per source.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    weighed = sizes.withColumn("_at", F.row_number().over(place) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_at") % len(weights) + 1).cast("int")))
    ceiling = most * F.col("source_size")
    order = Window.orderBy(ceiling / F.col("weight"), "_at")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    since = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(ceiling).over(upto), F.lit(0))) / F.sum("weight").over(since)
    levels = weighed.withColumn("_ratio", ceiling / F.col("weight")).withColumn("_level", level)
    # The first source, in that order, whose ceiling is above the level it would get sets the level of all after it.
    water = levels.withColumn("_water", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_at", "_level"))).over(Window.partitionBy()))
    stopped = F.col("_water").isNull() | (F.struct("_ratio", "_at") < F.struct("_water._ratio", "_water._at"))
    return water.select("source", "source_size", "weight", F.when(stopped, ceiling.cast("double")).otherwise(
        F.col("weight") * F.col("_water._level")).alias("target")).withColumn("quota", F.round("target").cast("long"))


class _Network:
    def __init__(self, n: int):
        self.arcs: list[list[list[int]]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int) -> list[int]:
        there, back = [b, capacity, len(self.arcs[b])], [a, 0, len(self.arcs[a])]
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def push(self, source: int, sink: int) -> None:
        """Augment along shortest paths until none is left."""
        while True:
            came: dict[int, tuple[int, list[int]]] = {source: (source, [])}
            queue = deque([source])
            while queue and sink not in came:
                a = queue.popleft()
                for arc in self.arcs[a]:
                    if arc[1] > 0 and arc[0] not in came:
                        came[arc[0]] = (a, arc)
                        queue.append(arc[0])
            if sink not in came:
                return
            path, at = [], sink
            while at != source:
                path.append(came[at][1])
                at = came[at][0]
            least = min(arc[1] for arc in path)
            for arc in path:
                arc[1] -= least
                self.arcs[arc[0]][arc[2]][1] += least


def cheapest_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], most: int) -> list[int]:
    """Tokens each pattern (its sources, its tokens) gives towards ``quotas``, repeating as little as possible."""
    net = _Network(len(patterns) + len(quotas) + 2)
    start, end = len(patterns) + len(quotas), len(patterns) + len(quotas) + 1
    for i, (sources, tokens) in enumerate(patterns):
        for s in sources:
            net.add(i, len(patterns) + s, most * tokens)
    for s, quota in enumerate(quotas):
        net.add(len(patterns) + s, end, quota)
    taken = [0] * len(patterns)
    for _ in range(most):
        level = [net.add(start, i, tokens) for i, (_, tokens) in enumerate(patterns)]
        net.push(start, end)
        for i, arc in enumerate(level):
            taken[i] += patterns[i][1] - arc[1]
            arc[1] = net.arcs[i][arc[2]][1] = 0  # what flowed stays; dearer levels come next
    return taken


def mix(df: DataFrame, sources: Column, text: str = "text", id_column: str = "doc_id", weights: Sequence[int] = (5, 2, 1),
        most: int = 3, seed: str = "mix", most_patterns: int = 20_000) -> DataFrame:
    """Add the struct ``_mix``: size, source_size and target of the (first) source, times taken.

    ``sources`` is an array column of the sources a document belongs to; a null in it is a
    source of its own. The flow is solved over patterns and sources, never over documents; more than
    ``most_patterns`` different patterns raise an error instead of loading the driver.
    """
    spark = df.sparkSession
    pattern = F.array_sort(F.transform(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))), lambda s: F.struct(
        s.isNull().alias("nil"), F.coalesce(s, F.lit("")).alias("name"))))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), pattern.alias("pattern"),
                     count_words(F.col(f"`{text}`")).alias("size"),
                     F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")),
                                       F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).alias("seat"))
    cells = [F.conv(F.substring("seat", 1 + 3 * k, 3), 16, 10).cast("int") for k in range(2)]
    sized = rows.select("pattern", "size", "seat", *[c.alias(f"cell{k}") for k, c in enumerate(cells)])
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("tokens"))
    by_source = totals.select(F.explode("pattern").alias("s"), "tokens").groupBy("s").agg(F.sum("tokens").alias("source_size"))
    targets = target_table(by_source.select(F.when(~F.col("s.nil"), F.col("s.name")).alias("source"), "source_size"), weights, most)

    found = totals.orderBy("pattern").limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns: merge rare sources first")
    wanted = targets.collect()
    number = {(r["source"] is None, r["source"] or ""): k for k, r in enumerate(wanted)}
    flow = cheapest_flow([([number[(s["nil"], s["name"])] for s in r["pattern"]], r["tokens"]) for r in found],
                         [r["quota"] for r in wanted], most)
    first = {key: wanted[k] for key, k in number.items()}
    plan = []
    for r, given in zip(found, flow):
        full, rest = divmod(given, r["tokens"]) if r["tokens"] else (0, 0)
        of = first[(r["pattern"][0]["nil"], r["pattern"][0]["name"])] if r["pattern"] else None
        plan.append((r["pattern"], full, rest, of["source_size"] if of else None, of["target"] if of else None))
    kind = sized.schema["pattern"].dataType.simpleString()
    shares = spark.createDataFrame(plan, f"pattern {kind}, full long, rest long, source_size long, target double")
    # At most most_patterns rows.
    shares = F.broadcast(shares)

    cut = sized.join(shares.select("pattern", "rest"), "pattern").where("rest > 0")
    first_cut = _cell_cut(cut, ["pattern"], "cell0", "rest")
    second = cut.drop("rest").join(F.broadcast(first_cut), "pattern").where(F.col("cell0") == F.col("at")).withColumn("rest", F.col("left"))
    second_cut = _cell_cut(second.drop("at", "left"), ["pattern"], "cell1", "rest")
    last = second.drop("at", "left", "rest").join(F.broadcast(second_cut), "pattern").where(F.col("cell1") == F.col("at"))
    seats = last.groupBy("pattern", "left", "seat").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("pattern").orderBy("seat")
    summed = seats.withColumn("_upto", F.sum("size").over(run))
    # A seat is taken when that brings the sum nearer to what is left.
    edge = summed.where(F.col("_upto") - F.col("size") / 2 <= F.col("left")).groupBy("pattern").agg(F.max("seat").alias("edge"))
    cuts = first_cut.select("pattern", F.col("at").alias("c0")).join(
        second_cut.select("pattern", F.col("at").alias("c1")), "pattern", "left").join(edge, "pattern", "left")
    known = rows.join(shares, "pattern").join(F.broadcast(cuts), "pattern", "left")
    head = [c.alias(f"_s{k}") for k, c in enumerate(cells)]
    known = known.select("*", *head)
    inside = (F.col("rest") > 0) & (
        F.col("c0").isNull() | (F.col("_s0") < F.col("c0")) | ((F.col("_s0") == F.col("c0")) & (
            (F.col("_s1") < F.col("c1")) | ((F.col("_s1") == F.col("c1")) & (F.col("seat") <= F.col("edge"))))))
    times = F.col("full") + F.coalesce(inside, F.lit(False)).cast("long")
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c != "_mix"]
    return known.select(*own, F.struct("size", "source_size", "target", times.alias("times")).alias("_mix"))


def _cell_cut(rows: DataFrame, keys: list[str], cell: str, rest: str) -> DataFrame:
    """Per key the cell in which the running sum of sizes reaches ``rest``, and what is left for it."""
    sums = rows.groupBy(*keys, rest, cell).agg(F.sum("size").alias("size"))
    run = Window.partitionBy(*keys).orderBy(cell)  # 4,096 cells a key at most
    upto = sums.withColumn("upto", F.sum("size").over(run)).where(F.col("upto") >= F.col(rest))
    return upto.groupBy(*keys).agg(F.min(F.struct(F.col(cell).alias("at"), (F.col(rest) - F.col("upto") + F.col("size")).alias("left"))).alias("c")).select(
        *keys, "c.at", "c.left")


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    times = F.col("_mix.times").cast("int")
    return mixed.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_mix", "_copy")
