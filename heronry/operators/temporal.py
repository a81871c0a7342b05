"""Attributes as known at event time: a point-in-interval join on dyadic time nodes.

The time axis (microseconds) is a tree of dyadic ranges ``[j*2^b, (j+1)*2^b)``. A validity interval is decomposed
into the few nodes that cover it exactly, down to leaves of ``2^LEAF`` microseconds; an event names every node that
encloses it, one per level. Interval and event meet in one equi-join on (entity, node), at most once, and an exact
half-open test drops what a leaf covers too widely. No range condition is left to a nested loop.

Levels are ``STRIDE`` bits apart, so an event has len(LEVELS) keys instead of one per bit. The events of an entity
with more than HOT of them are spread over parts, and its intervals copied to each, before the nodes are spelt out: the
exploded keys never cross the network, and an entity with a third of all events is no hot partition. What a task holds
of either side is sorted, which spills; intervals are never built into a hash table.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import LAID_OUT, materialise, tune

LEAF, STRIDE, TOP = 40, 3, 55
LEVELS = tuple(range(LEAF, TOP, STRIDE))
#: Moves the axis so that 1684 to 2255 is the tree; instants outside share its outermost leaves and are told apart by the exact test.
ORIGIN = 1 << 53
FOREVER = (1 << 63) - 1
#: Keeps the row of an event that no interval holds.
NO_NODE = -1
#: Events of an entity in one part, about; an entity with more has as many parts as it takes.
HOT = 100_000
#: Parts of the events without an entity, which meet nothing.
LOST = 64
#: Rows of an entity are sorted together within slots of 2^SLOT microseconds (19 hours).
SLOT = 36


def _leaf(us: Column) -> Column:
    moved = F.least(F.greatest(us, F.lit(-ORIGIN)), F.lit(ORIGIN - 1)) + F.lit(ORIGIN)
    return F.shiftright(moved, LEAF)


def _node(level: int, index: Column) -> Column:
    return F.lit(level << 48) + index


def enclosing_nodes(us: Column) -> Column:
    """Array of the nodes that enclose an instant, one per level."""
    return F.when(us.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(*[_node(k, F.shiftright(_leaf(us), (b - LEAF))) for k, b in enumerate(LEVELS)]))


def covering_nodes(start: Column, end: Column) -> Column:
    """Array of the fewest nodes that cover the leaves of ``[start, end)``; empty if the interval is."""
    lo, hi = _leaf(start), _leaf(end - 1)
    fan = 1 << STRIDE
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    out = []
    for k in range(len(LEVELS)):
        s = k * STRIDE
        first, last = F.shiftright(lo + ((1 << s) - 1), s), F.shiftright(hi + 1, s) - 1
        if k == len(LEVELS) - 1:
            at = run(first, last)
        else:
            up, down = F.shiftright(lo + ((1 << (s + STRIDE)) - 1), s + STRIDE), F.shiftright(hi + 1, s + STRIDE) - 1
            at = F.when(up > down, run(first, last)).otherwise(F.concat(run(first, up * fan - 1), run((down + 1) * fan, last)))
        out.append(F.transform(at, partial(_node, k)))
    return F.when(start < end, F.concat(*out)).otherwise(none)


def validity(revisions: DataFrame, entity: str, at: str, attribute: str) -> DataFrame:
    """Half-open validity intervals (entity, valid_from, valid_to, attribute) of revision rows.

    Rows with a null entity or instant are left out; of several rows with one instant the largest attribute holds.
    A revision ends where the next one of its entity begins. The next one is sought within a leaf-sized time bucket
    first, then among the buckets' first instants, so the rows of one entity are never gathered in one task.
    """
    one = (
        revisions.filter(F.col(entity).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(at).alias("valid_from"))
        .agg(F.max(attribute).alias("attribute"))
        .withColumn("_bucket", _leaf(F.col("valid_from")))
    )
    later = Window.partitionBy("entity").orderBy("_bucket")
    buckets = one.groupBy("entity", "_bucket").agg(F.min("valid_from").alias("_first"))
    buckets = buckets.select("entity", "_bucket", F.lead("_first").over(later).alias("_then"))
    within = Window.partitionBy("entity", "_bucket").orderBy("valid_from")
    return (
        one.withColumn("_next", F.lead("valid_from").over(within))
        .join(buckets, ["entity", "_bucket"])
        .select("entity", "valid_from", F.coalesce("_next", "_then", F.lit(FOREVER)).alias("valid_to"), "attribute")
    )


def as_of_join(events: DataFrame, intervals: DataFrame, entity: str, at: str, keys: list[str], hot: int = HOT) -> DataFrame:
    """The attribute in force for each event: ``keys``, entity, instant and ``attribute`` (null if none was).

    ``events`` holds distinct rows of keys, entity and instant. An event on a boundary belongs to the interval that
    begins there. Should intervals overlap, the latest start wins, then the largest attribute. Events with a null
    entity or instant come out with a null attribute. No key may be called ``attribute``; other names are free.
    """
    names = [*keys, entity, at]
    # Both sides are laid out by (entity, part) on purpose, and the planner is to take that for the join on (entity, part, node) too.
    tune(tune(events.sparkSession), LAID_OUT)
    # Read twice: how many an entity has is counted before they are laid out.
    events = materialise(events.select(*[f"`{n}`" for n in names]))
    # Own names inside, so that columns of the events may be called anything.
    left = events.select(F.col(f"`{entity}`").alias("_e"), F.col(f"`{at}`").alias("_at"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    own = [f"_k{i}" for i in range(len(keys))]
    # A row per ``hot`` events at most; ordinary entities have one part and their intervals one copy.
    parts = left.filter("_e is not null").groupBy(F.col("_e").alias("_h")).agg(F.ceil(F.count("*") / hot).alias("_parts")).filter("_parts > 1")
    n_parts = F.coalesce("_parts", F.lit(1))
    # As many partitions as the session asks for: merged to the size of what is shuffled, they would hold many times that once nodes are spelt out.
    wide = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.join(F.broadcast(parts), F.col("_e") == F.col("_h"), "left")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*own), F.when(F.col("_e").isNull(), LOST).otherwise(n_parts)).cast("int")).drop("_h", "_parts").repartition(wide, "_e", "_salt")
    left = left.withColumn("_node", F.explode(F.concat(F.array(F.lit(NO_NODE)), enclosing_nodes(F.col("_at")))))
    right = (
        intervals.join(F.broadcast(parts), F.col("entity") == F.col("_h"), "left")
        .withColumn("_salt_r", F.explode(F.sequence(F.lit(0), n_parts.cast("int") - 1)))
        .repartition(wide, "entity", "_salt_r")
        .select(
            F.col("entity").alias("_e_r"), "_salt_r", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("attribute").alias("_a"),
            F.explode(covering_nodes(F.col("valid_from"), F.col("valid_to"))).alias("_node_r"),
        )
    )
    same = (F.col("_e") == F.col("_e_r")) & (F.col("_salt") == F.col("_salt_r")) & (F.col("_node") == F.col("_node_r"))
    met = left.join(right.hint("merge"), same, "left")
    inside = (F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to"))
    # Latest start, then largest attribute, in two steps whose buffers have fixed widths (where the attribute's has), so that they hash.
    event = ["_e", "_salt", *own, "_at"]
    one = met.filter(inside | (F.col("_node") == NO_NODE)).groupBy(*event, "_from").agg(F.max("_a").alias("_a"))
    out = one.groupBy(*event).agg(F.max_by("_a", "_from").alias("_a"))
    renamed = dict(zip(names, [*own, "_e", "_at"], strict=True))
    return out.select(*[F.col(renamed[n]).alias(n) for n in names], F.col("_a").alias("attribute"))


def last_known(events: DataFrame, revisions: DataFrame, entity: str, at: str, attribute: str) -> DataFrame:
    """``events`` with ``last_known``, the attribute of the latest revision not after each (largest, of one instant), without the as-of join.

    For checks of that join: no intervals and no pairs, events and revisions are sorted together within the slots of an
    entity, and what came before a slot is that of the last slot before it. So neither the rows of one entity are sorted
    in one task, nor is each of its revisions held against each of its events. Entities and instants are not null.
    """
    names = [c for c in events.columns if c not in (entity, at)]
    slot = F.shiftright(at, SLOT).alias("_slot")
    # A revision is a struct, so that one whose attribute is null is not taken for none.
    rev = revisions.select(entity, at, slot, F.struct(F.col(at).alias("at"), F.col(attribute).alias("a")).alias("_rev"))
    none = F.lit(None)
    both = rev.select("*", *[none.cast(events.schema[c].dataType).alias(c) for c in names]).unionByName(events.select(entity, at, slot, none.cast(rev.schema["_rev"].dataType).alias("_rev"), *names))
    # At one instant revisions come before events.
    within = Window.partitionBy(entity, "_slot").orderBy(at, F.col("_rev").isNull(), "_rev").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_event", F.col("_rev").isNull()).withColumn("_last", F.last("_rev", ignorenulls=True).over(within)).filter("_event").drop("_rev", "_event")
    earlier = Window.partitionBy(entity).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy(entity, "_slot").agg(F.max("_rev").alias("_rev"), F.bool_or(F.col("_rev").isNull()).alias("_asked"))
    slots = slots.withColumn("_before", F.last("_rev", ignorenulls=True).over(earlier)).filter("_asked").select(entity, "_slot", "_before")
    return inside.join(slots, [entity, "_slot"]).select(*events.columns, F.coalesce("_last", "_before")["a"].alias("last_known"))
