"""Assembly of linked rows into chains by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import stored


def ends(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, start, place, whole) for nodes (id, before): the start of each node's chain and its place from it.

    Each round doubles the reach of every pointer, so a chain of length L takes
    log2 L joins.  before is null at a start.  whole is false where the walk
    back meets a missing node or runs round a cycle; a cycle is told after as
    many rounds as its length could take.
    """
    ids = nodes.select(F.col("id").alias("there"))
    known = nodes.join(ids, F.col("before") == F.col("there"), "left")
    # a node is done once its pointer rests on a start, or at a start itself
    state = known.select("id", F.when(F.col("there").isNotNull(), F.col("before")).alias("up"), F.when(F.col("there").isNotNull(), 1).otherwise(0).cast("long").alias("place"), (F.col("before").isNull() | F.col("there").isNotNull()).alias("whole"))
    state = stored(state, "chains")
    done, open_ = state.filter("up is null"), state.filter("up is not null")
    turn = 0
    while not open_.limit(1).isEmpty():
        if turn == rounds:
            raise RuntimeError(f"chains of more than {1 << rounds} nodes")
        every = done.unionByName(open_)
        above = every.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("place").alias("a_place"), F.col("whole").alias("a_whole"))
        moved = open_.join(above, F.col("up") == F.col("a"))
        rests = F.col("a_up").isNull()
        moved = stored(moved.select("id", F.coalesce("a_up", "up").alias("up"), (F.col("place") + F.when(rests, 0).otherwise(F.col("a_place"))).alias("place"), (F.col("whole") & F.col("a_whole")).alias("whole"), rests.alias("rests")), "chains")
        # a node on a cycle, or behind one, has passed more nodes than there are
        if 1 << turn > 2 * state.count():
            done, open_ = done.unionByName(moved.drop("rests")), moved.filter("false")
            break
        done, open_ = done.unionByName(moved.filter("rests").drop("rests")), moved.filter("not rests").drop("rests")
        turn += 1
    return done.select("id", F.coalesce("up", "id").alias("start"), "place", "whole")


def stops(nodes: DataFrame) -> DataFrame:
    """Those nodes (id, before, ...) that no node follows."""
    return nodes.join(nodes.select(F.col("before").alias("there")), F.col("id") == F.col("there"), "left_anti").drop("before")


def cycles(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose start has a predecessor of its own: they lie on a cycle or behind one."""
    starts = nodes.filter("before is not null").select(F.col("id").alias("start"))
    return found.filter("whole").join(starts, "start", "left_semi").select("id")


def strings(found: DataFrame, values: DataFrame) -> DataFrame:
    """(start, n, contig): the values of each whole chain joined in order. A chain's text is one value, so it has to fit into a row (2 GB) of one task."""
    rows = found.filter("whole").join(values, "id").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    return rows.select("start", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x["value"]), "").alias("contig"))
