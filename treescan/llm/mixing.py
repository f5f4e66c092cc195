"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks. Block j (from 1) of a source with share w of all slots may take a slot from
floor((j-1)/w), its release, and must have one before ceil(j/w), its deadline; each slot goes to the released block of
earliest deadline. So in every prefix each source is less than one block from its target. Shares are exact fractions of
the given weights. Slots are worked out up to the end of a phase, or for one period where the phase is longer (after the
sum of whole weights the order repeats), and each row finds its place from its number in its source. When a source has
given all its rows, the others go on with their weights from there (a new phase), so no row is dropped or repeated. The
driver holds counts of sources and the slots it works out, never rows; where these would be more than MAX_SLOTS it
refuses rather than round the weights: larger blocks, or weights of a smaller common denominator, need fewer.

A null source counts as the source ''. Rows are numbered in their source by a hash of the row and then by id and
contents, so that only rows equal in all columns are interchangeable and a task that runs again gives the same numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import free_name, shuffle_partitions

PHASE = T.StructType([T.StructField(n, T.LongType()) for n in ("phase", "first_block", "first_slot", "first_row", "period", "weight")] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("slots", "releases", "deadlines")])
MAX_SLOTS = 1 << 22
#: The table of slots is broadcast up to so many (some 6 MB), else joined.
BROADCAST_SLOTS = 1 << 18

Weight = int | float | Fraction


def simplest(weight: Weight) -> Fraction:
    """A weight as a fraction: of a float the simplest one that is that float, so 1/3 is one third."""
    if not isinstance(weight, float):
        return Fraction(weight)
    bound = 1
    while float(found := Fraction(weight).limit_denominator(bound)) != weight:
        bound *= 10
    return found


def whole_weights(weights: dict[str, Weight]) -> dict[str, int]:
    """Whole numbers in the very proportion of the weights. Floats are read as their simplest fractions while these have
    a common denominator of at most MAX_SLOTS, so that the order repeats soon, else as the binary fractions they are."""
    if any(w <= 0 or (isinstance(w, float) and not math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive")
    exact, scale = {}, 1
    for s, w in weights.items():
        exact[s] = simplest(w)
        scale = math.lcm(scale, exact[s].denominator)
        if scale > MAX_SLOTS:
            exact = {s: Fraction(w) for s, w in weights.items()}
            scale = math.lcm(*(w.denominator for w in exact.values()))
            break
    whole = {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}
    g = math.gcd(*whole.values())
    return {s: w // g for s, w in whole.items()}


def tempered(rows: dict[str, int]) -> dict[str, float]:
    """Weights as the square root of a source's rows, in steps of 1/16 of the largest, so that large sources give more
    and small ones more than their share."""
    most = max(rows.values(), default=1)
    return {s: max(1.0, float(round(16 * math.sqrt(n / most)))) for s, n in rows.items()}


def phase_slots(order: list[str], weights: dict[str, int], total: int, left: dict[str, int], most: int) -> tuple[dict[str, list[int]], int]:
    """The slots of each source's blocks from slot 0 on, and their number: until a source has no block left, or for one
    period. order: the sources with blocks left, by weight; total: of their weights.

    All first blocks are released at once with deadlines in the order of weight, so they wait in that order and only
    sources that had a turn are in the heaps: the work is by slots, not by sources.
    """
    at: dict[str, list[int]] = {}
    waiting: list[tuple[int, int, int]] = []  # release, deadline, place in order
    ready: list[tuple[int, int]] = []  # deadline, place in order
    fresh = 0
    for slot in range(min(total, most + 1)):
        if slot == most:
            raise ValueError(f"the weights need more than {MAX_SLOTS} slots: take larger blocks or simpler weights")
        while waiting and waiting[0][0] <= slot:
            _, deadline, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k))
        first = (-(-total // weights[order[fresh]]), fresh) if fresh < len(order) else None
        if ready and (first is None or ready[0] < first):
            deadline, k = heapq.heappop(ready)
        else:
            deadline, k = first  # all slots are taken, as the shares add up to one
            fresh += 1
        assert slot < deadline, "earliest deadline first meets all deadlines"
        s = order[k]
        own = at.setdefault(s, [])
        own.append(slot)
        j = len(own)
        if j == left[s]:
            return at, slot + 1
        heapq.heappush(waiting, (j * total // weights[s], -(-(j + 1) * total // weights[s]), k))
    return at, total


def plan(rows: dict[str, int], weights: dict[str, int], block_rows: int, most: int = MAX_SLOTS) -> dict[str, list[tuple]]:
    """The phases of each source that has a slot in them: (phase, first_block, first_slot, first_row, blocks in a
    period, and the slots, releases and deadlines of these)."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    order = sorted(left, key=lambda s: (-weights[s], s))
    total = sum(weights[s] for s in order)
    given = dict.fromkeys(left, 0)
    slot0 = row0 = phase = 0
    out: dict[str, list[tuple]] = {s: [] for s in left}
    while order:
        at, n = phase_slots(order, weights, total, left, most)
        most -= n
        ends = {s: (left[s] - 1) // len(x) * n + x[(left[s] - 1) % len(x)] for s, x in at.items()}
        done = min(ends, key=ends.get)
        slots = ends[done] + 1
        for s, x in at.items():
            w = weights[s]
            releases, deadlines = [j * total // w for j in range(len(x))], [-(-(j + 1) * total // w) for j in range(len(x))]
            out[s].append((phase, given[s], slot0, row0, n, len(x), x, releases, deadlines))
            whole, part = divmod(slots, n)
            took = whole * len(x) + sum(k < part for k in x) if part else whole * len(x)
            given[s] += took
            left[s] -= took
        row0 += slots * block_rows - (-rows[done] % block_rows)
        slot0 += slots
        phase += 1
        order.remove(done)
        total -= weights[done]
        del left[done]
    return out


def mix(docs: DataFrame, weights: dict[str, Weight] | Callable[[dict[str, int]], dict[str, Weight]] | None = None, *, block_rows: int = 32, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with a struct column ``mix`` (or a free name; the last column): position (gapless from 0), slot, block,
    phase, release, deadline. weights: by source, any positive numbers (whole, float or Fraction), or a function that
    gives them for the rows of each source; None: all sources alike."""
    spark = docs.sparkSession
    name, mark = free_name(docs, "mix"), "_mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    source, part, row, before, starts, all_phases, number, block, now, slot, digest = (f"{mark}{k}" for k in range(11))
    parts = max(256, 4 * shuffle_partitions(spark))
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = docs.withColumn(source, F.coalesce(source_col, F.lit(""))).withColumn(digest, F.xxhash64(F.lit("mix"), *hashed)).withColumn(part, F.pmod(digest, F.lit(parts)).cast("int"))
    counts = keyed.groupBy(source, part).count()
    rows = {r[0]: r[1] for r in counts.groupBy(source).agg(F.sum("count")).collect()}
    if callable(weights):
        weights = weights(rows)
    if weights is not None and (missing := sorted(rows.keys() - weights.keys())):
        raise ValueError(f"no weight for {missing[:10]}")
    phases = plan(rows, whole_weights({s: (weights or {}).get(s, 1) for s in rows}), block_rows) if rows else {}
    # the starts stand apart, so that finding a row's phase doesn't touch the slots
    schema = T.StructType([T.StructField(source, T.StringType()), T.StructField(starts, T.ArrayType(T.LongType())), T.StructField(all_phases, T.ArrayType(PHASE))])
    table = spark.createDataFrame([(s, [p[1] for p in x], x) for s, x in sorted(phases.items())], schema)
    earlier = counts.select(source, part, (F.sum("count").over(Window.partitionBy(source).orderBy(part)) - F.col("count")).alias(before))
    numbered = keyed.withColumn(row, F.row_number().over(Window.partitionBy(source, part).orderBy(id_col, digest)) - 1)
    few = sum(len(p[6]) for x in phases.values() for p in x) + len(phases) <= BROADCAST_SLOTS
    placed = numbered.join(earlier, [source, part]).join(F.broadcast(table) if few else table, source)
    placed = placed.withColumn(number, F.col(row) + F.col(before)).withColumn(block, F.floor(F.col(number) / block_rows))
    placed = placed.withColumn(now, F.element_at(all_phases, F.size(F.filter(starts, lambda first: first <= F.col(block)))))
    at = F.col(now)
    k = F.col(block) - at["first_block"]
    turn = F.floor(k / at["weight"])
    of_turn = lambda key: at["first_slot"] + turn * at["period"] + F.element_at(at[key], (k - turn * at["weight"] + 1).cast("int"))
    placed = placed.withColumn(slot, of_turn("slots").cast("long"))
    struct = F.struct(
        (at["first_row"] + (F.col(slot) - at["first_slot"]) * block_rows + F.pmod(number, F.lit(block_rows))).cast("long").alias("position"),
        F.col(slot).alias("slot"),
        F.col(block).cast("long").alias("block"),
        at["phase"].alias("phase"),
        of_turn("releases").cast("long").alias("release"),
        of_turn("deadlines").cast("long").alias("deadline"),
    )
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], struct.alias(name))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix() in order of position, dealt over partitions by it, without the struct."""
    n = max(1, shuffle_partitions(mixed.sparkSession))
    name = mixed.columns[-1]
    position = F.col(f"`{name}`.position")
    total = mixed.select(F.max(position)).first()[0]
    if total is None:
        return mixed.drop(name)
    return mixed.repartitionById(n, F.floor(position * n / (total + 1)).cast("int")).sortWithinPartitions(position).drop(name)
