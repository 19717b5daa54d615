"""A mix of sources with target shares of all tokens, by min-cost flow over membership patterns.

Copies of one text may stand in several sources: texts are the units, and the set of sources that hold a text is its membership
pattern. Tokens are summed by pattern, which leaves at most one row for each set of sources that occurs. On this small graph, tokens
are routed from patterns to the quotas of the sources; the k-th use of the same tokens costs k - 1, so fresh tokens are used before
repeated ones, and a source uses a text no more often than its ``max_repeats``. The total is the largest for which every source that has texts at all gets its share,
unless one is given; sources without texts share out among the others, and the actual shares are reported.

Within a pattern, texts stand in the order of a seeded hash on a ring of as many tokens as they have together; each source takes the next stretch
of the ring, round after round, which gives each text its number of uses. Positions come from two sums over at most
``BUCKETS`` hash buckets, so no task ever orders a whole source.

Defined cases: null or blank sources, null or empty texts stay out; source names are compared without case and outer spaces;
duplicate targets are refused; extra columns are ignored; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .bpe import token_counts

SEED = 11
BUCKETS = 4096
#: Sources above which the sets of sources could be too many for one graph.
MAX_SOURCES, MAX_PATTERNS = 60, 100_000


def source_name(column: str) -> Column:
    """A source's name without case and outer white space; null for a blank one."""
    name = F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def targets_of(mix_targets: DataFrame) -> list[Target]:
    """The targets, one for each source: a small table by definition, more than ``MAX_SOURCES`` are refused."""
    rows = mix_targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()
    found = [Target(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows]
    if len(found) > MAX_SOURCES or len({t.source for t in found}) < len(found):
        raise ValueError(f"mix targets must be at most {MAX_SOURCES}, one for each source")
    return sorted(found, key=lambda t: t.source)


class Flow:
    """Min-cost flow by successive cheapest paths, for small graphs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: float, cost: int = 0) -> int:
        for end, capacity, price in ((b, room, cost), (a, 0.0, -cost)):
            self.out[a if end == b else b].append(len(self.to))
            self.to.append(end)
            self.room.append(capacity)
            self.cost.append(price)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> float:
        total = 0.0
        while True:
            best, via, queue = {start: 0}, {}, [start]
            while queue:
                node = queue.pop(0)
                for e in self.out[node]:
                    if self.room[e] > 1e-6 and (price := best[node] + self.cost[e]) < best.get(self.to[e], 1 << 60):
                        best[self.to[e]], via[self.to[e]] = price, e
                        queue.append(self.to[e])
            if end not in best:
                return total
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            total += step


def routed(patterns: dict[tuple[str, ...], int], targets: list[Target], total: float | None) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """(total, tokens by pattern and source)."""
    held = {source for pattern in patterns for source in pattern}
    live = [t for t in targets if t.source in held and t.share > 0 and t.repeats > 0]
    weight = sum(t.share for t in live)

    def solve(size: float) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
        flow, node = Flow(), {("source", t.source): k + 2 for k, t in enumerate(live)}
        arcs = {}
        for t in live:
            flow.arc(node["source", t.source], 1, size * t.share / weight)
        for pattern, tokens in patterns.items():
            inside = [t for t in live if t.source in pattern]
            if not inside:
                continue
            hub = len(node) + 2
            node["pattern", pattern] = hub  # type: ignore[index]
            for k in range(max(t.repeats for t in inside)):
                flow.arc(0, hub, tokens, k)
            for t in inside:
                arcs[pattern, t.source] = flow.arc(hub, node["source", t.source], tokens * t.repeats)
        done = flow.run(0, 1)
        return done, {key: flow.room[e ^ 1] for key, e in arcs.items()}

    if not live:
        return 0.0, {}
    if total is not None:
        return total, solve(total)[1]
    low, high = 0.0, float(sum(patterns.values()) * max(t.repeats for t in live))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if solve(middle)[0] >= middle * (1 - 1e-9) - 1e-3 else (low, middle)
    return low, solve(low)[1]


def units(documents: DataFrame, targets: list[Target], id_col: str, text_col: str, source_col: str, tokenizer: str | None) -> DataFrame:
    """(id, pattern, tokens): one row for each text of the targets' sources, named by its smallest id."""
    names = [t.source for t in targets]
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), source_name(source_col).alias("source"))
    rows = rows.where(F.col("source").isin(names) & (F.length("text") > 0)).select("id", "text", "source", F.md5("text").alias("hash"), F.length("text").alias("n"))
    texts = rows.groupBy("hash", "n").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("source")).alias("pattern"))
    counted = token_counts(documents.select(F.col(id_col).cast("long").alias("id"), text_col), "id", text_col, tokenizer)
    return written(texts.select("id", "pattern").join(counted, "id").where("tokens > 0"))


def planned(found: DataFrame, targets: list[Target], total: float | None) -> tuple[float, list[tuple[list[str], str, float, float, int]]]:
    """(total, rows of (pattern, source, from, to, ring)): the stretches of each pattern's ring."""
    sums = found.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of overlapping sources")
    patterns = {tuple(r.pattern): int(r.tokens) for r in sums}
    size, flows = routed(dict(sorted(patterns.items())), targets, total)
    stretches, at = [], defaultdict(float)
    for (pattern, source), tokens in sorted(flows.items()):
        if tokens > 0:
            stretches.append((list(pattern), source, at[pattern], at[pattern] + tokens, patterns[pattern]))
            at[pattern] += tokens
    return size, stretches


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each selected text is used for each source."""
    spark: SparkSession = documents.sparkSession
    targets = targets_of(mix_targets)
    found = units(documents, targets, id_col, text_col, source_col, tokenizer)
    _, stretches = planned(found, targets, total)
    plan = spark.createDataFrame(stretches, "pattern array<string>, source string, low double, high double, ring long")
    order = F.xxhash64(F.lit(seed), "id")
    placed = found.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(BUCKETS)))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum"))
    before = sums.select("pattern", "bucket", (F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1))
    at = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.col("inside") + 0.5)
    rounds = lambda end: F.ceil((F.col(end) - F.col("at")) / F.col("ring"))
    uses = (F.greatest(rounds("high"), F.lit(0)) - F.greatest(rounds("low"), F.lit(0))).cast("int")
    used = at.join(F.broadcast(plan), "pattern").select(F.col("id").alias(id_col), "source", "tokens", uses.alias("uses"))  # plan: at most MAX_PATTERNS x MAX_SOURCES rows
    return used.where("uses > 0")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, uses, tokens, actual_share, most_uses): the mix as it came out, a row for each target."""
    sums = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    names = mix_targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    joined = names.join(sums, "source", "left").na.fill(0, ["documents", "uses", "tokens", "most_uses"])
    whole = F.sum("tokens").over(Window.partitionBy())  # a row for each target
    return joined.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
