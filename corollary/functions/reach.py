"""Reachability as a predicate: a breadth-first walk of DataFrames from whichever end is bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bodies import CITES, Rel
from ..operators.lanes import Cell, same
from ..plans.ir import ArgType
from ..plans.vocabulary import Builtin


LEVELS = 16  # of a walk that are read apart before they are written together


def reach(relation: str, *, reflexive: bool = False, labels: tuple[str, str] = ("from", "to"), types: tuple[ArgType, ArgType] | None = None, doc: str = "") -> Builtin:
    """A generator of pairs joined by one or more steps of a base relation, from either bound end.

    Citations are those of a shortest path, in order from start to end.  `reflexive` adds each bound end itself.
    With both ends bound the walk stops when every bound pair is found.
    """

    def frame(engine, inputs: DataFrame | None, lanes: dict, arity: int) -> Rel:
        edges = engine.base(relation, engine.with_cites)
        backward = 0 not in lanes
        near, far = ("c1", "c0") if backward else ("c0", "c1")
        lane_near, lane_far = (edges.lanes[1], edges.lanes[0]) if backward else (edges.lanes[0], edges.lanes[1])
        e = edges.df.select(F.col(near).alias("near"), F.col(far).alias("far"), F.col(CITES).alias("step"))
        bound = "a1" if backward else "a0"
        seed_lane = lanes[1 if backward else 0]
        seeds = inputs.select(F.col(bound).alias("end")).distinct()
        # The walk carries the bound end along, so that one walk serves all bound inputs.
        start = Cell(F.col("end"), seed_lane)
        known = e.select("near", "far")
        nodes = known.select(F.col("near").alias("at")).unionByName(known.select(F.col("far").alias("at"))).distinct() if lane_near == lane_far else known.select(F.col("near").alias("at")).distinct()
        found = nodes.join(seeds, same(start, Cell(F.col("at"), lane_near))).select(F.col("at").alias("end"), "at", F.array().cast("array<string>").alias("path"))
        engine.ensure_checkpoints()
        level = found.checkpoint()
        seen = level if reflexive else level.limit(0)
        goal, rounds = None, 0
        if 0 in lanes and 1 in lanes:
            goal = inputs.select("a0", "a1").distinct()
        while True:
            path = F.concat("step", "path") if backward else F.concat("path", "step")
            nxt = level.join(e, F.col("at") == F.col("near")).select("end", F.col("far").alias("at"), path.alias("path"))
            nxt = nxt.groupBy("end", "at").agg(F.min("path").alias("path"))
            old = seen.select(F.col("end").alias("e0"), F.col("at").alias("t0"))
            level = nxt.join(old, F.col("end").eqNullSafe(F.col("e0")) & F.col("at").eqNullSafe(F.col("t0")), "left_anti").checkpoint()
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
            rounds += 1
            if rounds % LEVELS == 0:
                seen = seen.checkpoint()
            if goal is not None and goal.join(seen, same(Cell(F.col("a0"), lanes[0]), Cell(F.col("end"), lane_near)) & same(Cell(F.col("a1"), lanes[1]), Cell(F.col("at"), lane_far)), "left_anti").isEmpty():
                break
        ends = (F.col("at").alias("c0"), F.col("end").alias("c1")) if backward else (F.col("end").alias("c0"), F.col("at").alias("c1"))
        return Rel(seen.select(*ends, F.col("path").alias(CITES)), [edges.lanes[0], edges.lanes[1]])

    return Builtin(2, list(labels), list(types or ()), doc or f"joined by one or more steps of {relation}", frame=frame, modes=[(True, False), (False, True)])
