"""Grids of unequal cells: leaves of a quadtree, kept so that neighbours differ by one level at most.

A leaf is (level, y, x): one of 2^level by 2^level squares of the whole. Neighbours meet by equi-joins on these keys: a
leaf sends its value to the keys that can lie behind each of its sides, and only keys that are leaves receive it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.lineage import cut, discard

KEY = ["level", "y", "x"]
#: A side as the receiver sees it, and where its neighbour lies.
SIDES = {"west": (0, -1), "east": (0, 1), "south": (-1, 0), "north": (1, 0)}


def from_cells(df: DataFrame, name: str, coarsest: int, finest: int, steepest: float) -> DataFrame:
    """Leaves with the mean of a column of a 2^finest square grid (j, i); null values do not count.

    A square is divided where its values lie more than `steepest` apart, down to single cells. Each square is decided by
    itself, from its cells' extremes, so all levels are one aggregate each over the cells of the level below."""
    squares = [df.select(F.lit(finest).alias("level"), F.col("j").alias("y"), F.col("i").alias("x"), F.col(name).cast("double").alias("s"), F.col(name).isNotNull().cast("long").alias("n"), F.col(name).alias("lo"), F.col(name).alias("hi"))]
    squares[0] = squares[0].withColumn("s", F.coalesce("s", F.lit(0.0)))
    for level in range(finest - 1, coarsest - 1, -1):
        below = squares[-1].groupBy(F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
        squares.append(below.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.lit(level).alias("level"), "y", "x", "s", "n", "lo", "hi"))
    # from the coarsest down: what is divided hands its place to its four parts
    leaves, open_ = [], squares[-1].select(*KEY)
    for level in range(coarsest, finest + 1):
        here = squares[finest - level].join(open_, KEY)
        split = F.coalesce(F.col("hi") - F.col("lo") > steepest, F.lit(False)) & F.lit(level < finest)
        leaves.append(here.where(~split).select(*KEY, F.try_divide("s", "n").alias("value")))
        open_ = children(here.where(split).select(*KEY))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out


def children(leaves: DataFrame) -> DataFrame:
    """The four parts of each leaf; further columns are handed down."""
    rest = [c for c in leaves.columns if c not in KEY]
    d = leaves.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return d.select((F.col("level") + 1).alias("level"), (F.col("y") * 2 + F.expr("_q div 2").cast("int")).alias("y"), (F.col("x") * 2 + F.col("_q") % 2).alias("x"), *rest)


def _inside(y: Column, x: Column) -> Column:
    n = F.expr("shiftleft(1, level)")
    return (y >= 0) & (y < n) & (x >= 0) & (x < n)


def too_coarse(leaves: DataFrame) -> DataFrame:
    """The keys of leaves that have a neighbour of over one level more."""
    around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in SIDES.values()))
    d = leaves.select(*KEY).withColumn("o", F.explode(around)).withColumns({"ny": F.col("y") + F.col("o.dy"), "nx": F.col("x") + F.col("o.dx")})
    d = d.where(_inside(F.col("ny"), F.col("nx")) & (F.col("level") >= 2))
    # the squares two or more levels up that hold the neighbouring place
    d = d.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("level"))))
    up = d.select((F.col("level") - F.col("k")).alias("level"), F.expr("shiftright(ny, k)").alias("y"), F.expr("shiftright(nx, k)").alias("x")).distinct()
    return leaves.select(*KEY).join(up, KEY)


def balanced(leaves: DataFrame, most: int = 32) -> DataFrame:
    """leaves, divided until neighbours differ by one level at most; parts inherit their leaf's columns.

    A round divides all leaves that are too coarse at once; levels only go down towards the finest there is, so there are
    at most as many rounds as levels. Each round is written and the one before goes."""
    now, old = cut(leaves, "leaves"), None
    for _ in range(most):
        bad = cut(too_coarse(now).distinct(), "too-coarse")
        if not bad.take(1):
            discard(bad)
            return now
        old, now = now, cut(now.join(bad, KEY, "left_anti").unionByName(children(now.join(bad, KEY, "left_semi"))), "leaves")
        discard(old, bad)
    raise RuntimeError(f"not balanced after {most} rounds; a quadtree has no more levels than that")


def sides(leaves: DataFrame, value: str = "value") -> DataFrame:
    """leaves with what lies behind each side: west, east, south, north, and how many levels it is finer (1, 0, -1).

    Behind a side lie a leaf of the same size, part of a larger one, whose value stands for it, or two smaller ones, whose
    mean does. Null at the whole's border. The leaves must be balanced. Two exchanges: one join and one aggregate."""
    sent = []
    for side, (dy, dx) in SIDES.items():
        # the receiver sees the sender behind this side, so it lies the other way
        ny, nx = F.col("y") - dy, F.col("x") - dx
        same = F.struct(F.col("level").alias("level"), ny.alias("y"), nx.alias("x"), F.lit(side).alias("side"), F.lit(0).alias("finer"))
        up = F.struct((F.col("level") - 1).alias("level"), F.floor(ny / 2).cast("int").alias("y"), F.floor(nx / 2).cast("int").alias("x"), F.lit(side).alias("side"), F.lit(1).alias("finer"))
        sent += [same, up]
        for k in (0, 1):
            py = ny * 2 + (k if dx else (0 if dy < 0 else 1))
            px = nx * 2 + (k if dy else (0 if dx < 0 else 1))
            sent.append(F.struct((F.col("level") + 1).alias("level"), py.alias("y"), px.alias("x"), F.lit(side).alias("side"), F.lit(-1).alias("finer")))
    told = leaves.select(F.col(value).alias("_v"), F.explode(F.array(*sent)).alias("_s")).select("_v", "_s.*")
    # a leaf's own parent is no leaf, so a message upwards within it reaches nothing
    got = told.join(leaves.select(*KEY), KEY).groupBy(*KEY)
    pick = lambda s, c: F.when(F.col("side") == s, c)
    met = got.agg(*(F.avg(pick(s, F.col("_v"))).alias(s) for s in SIDES), *(F.max(pick(s, F.col("finer"))).alias(f"{s}_finer") for s in SIDES))
    return leaves.join(met, KEY, "left")


def laplacian(leaves: DataFrame, value: str = "value", width: float = 1.0) -> DataFrame:
    """leaves with the sum of the fluxes through their sides over their area; the whole is `width` wide, no flux at its border.

    The distance to a neighbour is that of the centres, so a flux through a side is the same seen from both of its
    leaves, and the sum over all leaves of laplacian times area is zero."""
    d = sides(leaves, value)
    size = F.lit(width) / F.expr("shiftleft(1, level)")
    flux = F.lit(0.0)
    for s in SIDES:
        apart = F.when(F.col(f"{s}_finer") == 1, size * 0.75).when(F.col(f"{s}_finer") == -1, size * 1.5).otherwise(size)
        flux = flux + F.coalesce((F.col(s) - F.col(value)) / apart * size, F.lit(0.0))
    return d.withColumn("laplacian", flux / (size * size)).select(*leaves.columns, "laplacian")
