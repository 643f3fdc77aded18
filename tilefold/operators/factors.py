"""Incomplete factorisations of sparse matrices (i, j, v) with a full diagonal, and what solves with them.

Unknowns are eliminated in the order of their index. Two of them may go at once if no chain of smaller, linked indexes
orders them, so an elimination takes as many rounds as the longest such chain: few for an index that colours or scatters
the graph, many for one that walks along it. What the first half of the rounds takes from the entries of the second half
is one join on the pivot and one grouped sum, and each half is done in the same way: an entry is written again as often as
rounds can be halved, and not once a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.functions.staging import dealt, saved, together


def fill_levels(a: DataFrame, k: int) -> DataFrame:
    """(i, j, level) of the places that a factorisation with fill of level k at most uses.

    Places of A have level 0; a place that a pivot m joins out of (i, m) and (m, j), m being less than i and j, has their
    levels' sum plus one, the least of all pivots. Each round extends the levels by one min-plus join, so k of them do.
    """
    levels = saved(a.select("i", "j").distinct().withColumn("level", F.lit(0)), "factors")
    for _ in range(k):
        lower = levels.where("i > j").select("i", F.col("j").alias("m"), F.col("level").alias("p"))
        upper = levels.where("i < j").select(F.col("i").alias("m"), "j", F.col("level").alias("q"))
        made = lower.join(upper, "m").select("i", "j", (F.col("p") + F.col("q") + 1).alias("level")).where(F.col("level") <= k)
        levels = saved(levels.unionByName(made).groupBy("i", "j").agg(F.min("level").alias("level")), "factors", instead_of=levels)
    return levels


def elimination_rounds(pattern: DataFrame) -> tuple[DataFrame, int]:
    """(node, round) and the number of rounds: an index goes once all smaller ones that it is linked with, either way, have gone."""
    links = pattern.where("i <> j").select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).distinct()
    links = saved(links, "factors")
    most = links.count()
    waits = links.groupBy("i").agg(F.count("*").alias("waits"))
    nodes = pattern.where("i = j").select("i").distinct()
    left = saved(nodes.join(waits.hint("merge"), "i", "left").select("i", F.coalesce("waits", F.lit(0).cast("bigint")).alias("waits")), "factors")
    held = dealt(links, most, "j").persist()  # dealt once, not in every round
    out = []
    try:
        while True:
            gone = saved(left.where("waits = 0").select(F.col("i").alias("node"), F.lit(len(out)).alias("round")), "factors")
            if gone.isEmpty():
                if left.isEmpty():
                    return (together(out) if out else gone), len(out)
                raise ValueError("an index is linked with one that has no diagonal")
            out.append(gone)
            told = held.join(dealt(gone.select(F.col("node").alias("j")), most, "j").hint("shuffle_hash"), "j", "left_semi").groupBy("i").agg(F.count("*").alias("n"))
            rest = left.where("waits > 0").join(told.hint("merge"), "i", "left")
            left = saved(rest.select("i", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")), "factors", instead_of=left)
    finally:
        held.unpersist()


@dataclass
class Factors:
    """A unit lower and an upper triangle (i, j, v), the lower one without its diagonal, and the rounds (node, round) in
    which their rows can be solved; where these are not given, the first solve() finds them."""

    lower: DataFrame
    upper: DataFrame
    order: DataFrame | None = None
    rounds: int = 0

    def product(self) -> DataFrame:
        """(i, j, v) of L U."""
        made = self.lower.select("i", F.col("j").alias("m"), F.col("v").alias("l")).join(self.upper.select(F.col("i").alias("m"), "j", F.col("v").alias("u")), "m")
        both = made.select("i", "j", (F.col("l") * F.col("u")).alias("v")).unionByName(self.upper.select("i", "j", "v"))
        return both.groupBy("i", "j").agg(F.sum("v").alias("v"))

    def solve(self, r: DataFrame) -> DataFrame:
        """z with L U z = r, for r (i, x) with an entry for every row: down the rounds and up again."""
        if self.order is None:
            self.order, self.rounds = elimination_rounds(self.lower.unionByName(self.upper))
        placed = self.order.select(F.col("node").alias("i"), "round")
        y = _by_rounds(self.lower, None, r, placed, range(self.rounds))
        diagonal = self.upper.where("i = j").select("i", F.col("v").alias("d"))
        return _by_rounds(self.upper.where("i < j"), diagonal, y, placed, range(self.rounds - 1, -1, -1))


def _by_rounds(t: DataFrame, diagonal: DataFrame | None, r: DataFrame, placed: DataFrame, rounds: range) -> DataFrame:
    """x with (T + D) x = r, T being strictly triangular: one round's rows after another, each from those already known."""
    rows = r.join(placed.hint("merge"), "i")
    rows = saved(rows.join(diagonal.hint("merge"), "i") if diagonal is not None else rows.withColumn("d", F.lit(1.0)), "factors")
    t = t.join(placed.hint("merge"), "i")
    known = None
    for k in rounds:
        own = rows.where(F.col("round") == k)
        if known is not None:
            told = t.where(F.col("round") == k).join(known.select(F.col("i").alias("j"), "x").hint("merge"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            own = own.join(told.hint("merge"), "i", "left").withColumn("x", F.col("x") - F.coalesce("s", F.lit(0.0)))
        new = saved(own.select("i", (F.col("x") / F.col("d")).alias("x")), "factors")
        known = new if known is None else known.unionByName(new)
    return known if known is not None else r


def incomplete_lu(a: DataFrame, k: int = 0, levels: DataFrame | None = None) -> Factors:
    """L and U on the places of fill_levels(a, k), or of given ones (i, j); there L U equals A. No pivots are changed: a zero
    on the diagonal gives infinite or undefined entries, as it does in any such factorisation."""
    pattern = (fill_levels(a, k) if levels is None else levels).select("i", "j")
    order, rounds = elimination_rounds(pattern)
    order = saved(order, "factors") if rounds else order
    summed = a.groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = lambda c: order.select(F.col("node").alias(c), F.col("round").alias(f"r{c}"))
    work = pattern.join(summed.hint("merge"), ["i", "j"], "left").join(at("i").hint("merge"), "i").join(at("j").hint("merge"), "j")
    work = saved(work.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"), "ri", "rj"), "factors")
    if not rounds:
        return Factors(work.select("i", "j", "v"), work.select("i", "j", "v"), order, rounds)
    gone = _eliminated(work, 0, rounds, whole=True)
    every = together(gone)
    pivots = every.where("i = j").select(F.col("i").alias("j"), F.col("v").alias("d"))
    column = every.where("i > j").join(pivots.hint("merge"), "j").select("i", "j", (F.col("v") / F.col("d")).alias("v"))
    done = saved(column.unionByName(every.where("i <= j").select("i", "j", "v")), "factors", instead_of=gone)
    return Factors(done.where("i > j"), done.where("i <= j"), order, rounds)


def _eliminated(work: DataFrame, first: int, last: int, whole: bool = False) -> list[DataFrame]:
    """Of entries (i, j, v, ri, rj) from which all that rounds before `first` take has been taken, those whose row or column
    goes in the rounds from `first` to `last` - 1, a table a round; columns are not yet divided by their pivots. A `whole`
    table has no others and is not read again by the caller."""
    at = F.least("ri", "rj")
    if last - first == 1:
        return [work if whole else saved(work.where(at == first), "factors")]
    half = (first + last) // 2
    early = _eliminated(work, first, half)
    gone = together(early)
    column = gone.where((F.col("i") > F.col("j")) & (F.col("ri") >= half)).select("i", F.col("j").alias("m"), F.col("v").alias("l"), "ri")
    row = gone.where((F.col("i") < F.col("j")) & (F.col("rj") >= half)).select(F.col("i").alias("m"), "j", F.col("v").alias("u"), "rj")
    pivots = gone.where("i = j").select(F.col("i").alias("m"), F.col("v").alias("d"))
    steps = column.join(row.hint("merge"), "m").where(at < last).join(pivots.hint("merge"), "m")
    taken = steps.groupBy("i", "j").agg(F.sum(F.col("l") / F.col("d") * F.col("u")).alias("s"))
    rest = work.where((at >= half) & (at < last)).join(taken.hint("merge"), ["i", "j"], "left")
    late = saved(rest.select("i", "j", (F.col("v") - F.coalesce("s", F.lit(0.0))).alias("v"), "ri", "rj"), "factors", instead_of=work if whole else None)
    return early + _eliminated(late, half, last, whole=True)


def _inverted_tiles(t: DataFrame, side: int) -> DataFrame:
    """(i, j, v): the inverse of each lower triangular diagonal tile; rows without an entry count as those of 1."""
    import numpy as np
    import pyarrow as pa

    from tilefold.operators import batched
    from tilefold.operators.matrix import blocks

    own = blocks(t.where(F.floor(F.col("i") / side) == F.floor(F.col("j") / side)), side).select("bi", "vals")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = b.column("vals").flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side).copy()
            absent = ~a.any(2)
            n, k = np.nonzero(absent)
            a[n, k, k] = 1.0
            unit = np.broadcast_to(np.eye(side), a.shape)
            inverse = np.stack([batched.triangular(a, unit[:, :, c]) for c in range(side)], 2)
            inverse[absent] = 0.0
            n, r, c = np.nonzero(inverse)
            at = b.column("bi").to_numpy()[n] * side
            yield pa.RecordBatch.from_arrays([pa.array(at + r), pa.array(at + c), pa.array(inverse[n, r, c])], names=["i", "j", "v"])

    return own.mapInArrow(run, "i bigint, j bigint, v double")


def block_triangular_solve(t: DataFrame, b: DataFrame, side: int = 16, lower: bool = True) -> DataFrame:
    """X (i, c, x) with T X = B for a triangular T (i, j, v) with a full diagonal and right sides B (i, c, x), c being the
    right side, with an entry for every row and side.

    T is cut into tiles, and those on the diagonal are inverted at once. A row of tiles is solved once all that its
    other tiles meet are: their products are taken from B, and the inverted tile is multiplied by the rest. So rounds
    follow the longest chain of tiles and not of rows, whatever the number of right sides. Tasks are as many as a round's
    products ask for, so that the memory of one does not grow.
    """
    if not lower:
        turned = block_triangular_solve(t.select((-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "v"), b.select((-F.col("i")).alias("i"), "c", "x"), side)
        return turned.select((-F.col("i")).alias("i"), "c", "x")
    tile = lambda c: F.floor(F.col(c) / side)
    if not t.where("j > i").isEmpty():
        raise ValueError("the matrix is not triangular")
    order, rounds = elimination_rounds(t.select(tile("i").alias("i"), tile("j").alias("j")).distinct())
    if not rounds:
        return b.select("i", "c", "x")
    placed = order.select(F.col("node").alias("tile"), "round")

    def of_rounds(rows: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
        """Rows with the round of their tile, and how many a round has."""
        own = dealt(rows.withColumn("tile", tile("i")), most, "tile").join(dealt(placed, most, "tile").hint("merge"), "tile").drop("tile")
        own = saved(own, "factors")
        return own, {r["round"]: r["count"] for r in own.groupBy("round").count().collect()}

    entries, most = t.count(), b.count()
    inverse, n_inverse = of_rounds(_inverted_tiles(t, side), entries)
    off, n_off = of_rounds(t.where(tile("i") != tile("j")), entries)
    rows, n_rows = of_rounds(b.select("i", "c", "x"), most)
    sides = rows.select("c").distinct().count()
    known, have = [], 0
    for k in range(rounds):
        of = lambda x: x.where(F.col("round") == k).drop("round")  # noqa: B023, E731
        size = n_rows.get(k, 0) + (n_inverse.get(k, 0) + n_off.get(k, 0)) * sides
        own = of(rows)
        if known:
            met = dealt(of(off), max(size, have), "j").join(dealt(together(known).withColumnRenamed("i", "j"), max(size, have), "j").hint("merge"), "j")
            own = own.unionByName(met.select("i", "c", (-F.col("v") * F.col("x")).alias("x")))
        own = dealt(own, size, "i").groupBy("i", "c").agg(F.sum("x").alias("x")).withColumnRenamed("i", "j")
        new = own.join(dealt(of(inverse), size, "j").hint("merge"), "j").select("i", "c", (F.col("v") * F.col("x")).alias("x"))
        known.append(saved(dealt(new, size, "i").groupBy("i", "c").agg(F.sum("x").alias("x")), "factors"))
        have += n_rows.get(k, 0)
    return together(known)


def _products(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """(i, j, s): the sums over k below both i and j of l(i, k) u(k, j)."""
    met = lower.select("i", F.col("j").alias("k"), F.col("v").alias("l")).join(upper.select(F.col("i").alias("k"), "j", F.col("v").alias("u")), "k").where("k < least(i, j)")
    return met.groupBy("i", "j").agg(F.sum(F.col("l") * F.col("u")).alias("s"))


def _sweep(placed: DataFrame) -> DataFrame:
    """(i, j, a, v, off): all entries v of L and U anew from those before, from their places with what A has there (i, j, a, v):
    a less the products of the others, below the diagonal divided by the pivot. `off` is how far L U was from A there.

    A column of L meets its row of U once, which gives it the products and the pivot."""
    lower = placed.where("i > j").select("i", F.col("j").alias("k"), F.col("v").alias("l"))
    upper = placed.where("i <= j").select(F.col("i").alias("k"), "j", F.col("v").alias("u"))
    none = F.lit(None).cast("double")
    met = lower.join(upper.hint("merge"), "k").select("i", "j", none.alias("a"), none.alias("v"), F.when(F.col("j") > F.col("k"), F.col("l") * F.col("u")).alias("p"), F.when(F.col("j") == F.col("k"), F.col("u")).alias("d"))
    both = placed.select("i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), "v", none.alias("p"), none.alias("d")).unionByName(met)
    sums = both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("v").alias("v"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.max("d").alias("d")).where("a is not null")
    value, below = F.col("a") - F.col("p"), F.col("i") > F.col("j")
    return sums.select("i", "j", "a", F.when(below, value / F.col("d")).otherwise(value).alias("v"), (value - F.when(below, F.col("v") * F.col("d")).otherwise(F.col("v"))).alias("off"))


#: Sweeps after which settled() gives up, and how far L U may be from A, as a share of the largest entry of A.
SWEEPS, SETTLED = 40, 1e-13


def settled(a: DataFrame, start: DataFrame) -> Factors | None:
    """incomplete_lu() on the places of start (i, j, v), by sweeps from its values until L U equals A there; None if SWEEPS
    of them do not get there.

    What elimination gives is the only table of entries that a sweep leaves as it is. Sweeps reach it after as many as an
    elimination has rounds, and where the diagonal is heavy after a dozen, however long the chains of linked indexes are.
    """
    placed = saved(start.join(a.select("i", "j", F.col("v").alias("a")), ["i", "j"], "left").select("i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), "v"), "factors")
    largest = placed.agg(F.max(F.abs("a"))).first()[0] or 0.0
    for _ in range(SWEEPS):
        placed = saved(_sweep(placed), "factors", instead_of=placed)
        off = placed.agg(F.max(F.abs("off"))).first()[0]  # of the entries before; a sweep more only makes it less
        if off is None or off <= SETTLED * largest:
            return Factors(placed.where("i > j").select("i", "j", "v"), placed.where("i <= j").select("i", "j", "v"))
        if not off < float("inf"):
            return None
    return None


def threshold_lu(a: DataFrame, fill: float = 1.5, steps: int = 2) -> Factors:
    """L and U of as many entries as `fill` times the triangles of A have, at the places where the entries are largest.

    Each step adds all places where L U departs from A, sweeps over all entries at once (each from the values before, so
    a sweep is a join and not an elimination), keeps the largest entries of each triangle by an exact selection of the
    threshold, equal ones together, with the diagonal, and sweeps again. The factors on the places that are left at the end are
    incomplete_lu()'s, so L U equals A there: found by further sweeps, or by its elimination where these do not settle.
    """
    from tilefold.operators.selection import kth_largest

    a = saved(a.groupBy("i", "j").agg(F.sum("v").alias("v")), "factors")
    sides = {"i > j": "", "i < j": ""}
    most = {side: int(fill * a.where(side).count()) for side in sides}
    diagonal = a.where("i = j").select("j", F.col("v").alias("d"))
    both = saved(a.join(diagonal, "j").select("i", "j", F.when(F.col("i") > F.col("j"), F.col("v") / F.col("d")).otherwise(F.col("v")).alias("v")), "factors")
    of_a = a.select("i", "j", F.col("v").alias("a"))
    swept = lambda t: saved(_sweep(t.join(of_a, ["i", "j"], "left")).select("i", "j", "v"), "factors", instead_of=t)
    for _ in range(steps):
        lower, upper = both.where("i > j"), both.where("i <= j")
        pivots = upper.where("i = j").select("j", F.col("v").alias("d"))
        new = _products(lower, upper).join(both.select("i", "j"), ["i", "j"], "left_anti").join(a, ["i", "j"], "left").join(pivots, "j")
        rest = F.coalesce("v", F.lit(0.0)) - F.col("s")
        new = new.where(rest != 0).select("i", "j", F.when(F.col("i") > F.col("j"), rest / F.col("d")).otherwise(rest).alias("v"))
        both = saved(both.unionByName(new), "factors", instead_of=both)
        both = swept(both)
        kept = both.where("i = j")
        for side, n in most.items():
            own = both.where(side).withColumn("size", F.round(F.abs("v"), 12))
            least = kth_largest(own, "size", n)
            kept = kept.unionByName((own if least is None else own.where(F.col("size") >= least)).select("i", "j", "v"))
        both = saved(kept, "factors", instead_of=both)
        both = swept(both)
    return settled(a, both) or incomplete_lu(a, levels=both)


def discarded_fill(a: DataFrame, pattern: DataFrame) -> DataFrame:
    """(node, discarded): the root of the sum of squares of what elimination of a node would put at places outside the
    pattern: a(i, m) a(m, j) / a(m, m) for i and j other than m and each other."""
    off = a.where("i <> j")
    pivots = a.where("i = j").select(F.col("i").alias("m"), F.col("v").alias("d"))
    met = off.select("i", F.col("j").alias("m"), F.col("v").alias("p")).join(off.select(F.col("i").alias("m"), "j", F.col("v").alias("q")), "m").where("i <> j")
    lost = met.join(pattern.select("i", "j"), ["i", "j"], "left_anti").join(pivots, "m")
    sums = lost.groupBy("m").agg(F.sqrt(F.sum((F.col("p") * F.col("q") / F.col("d")) ** 2)).alias("discarded"))
    return pivots.join(sums, "m", "left").select(F.col("m").alias("node"), F.coalesce("discarded", F.lit(0.0)).alias("discarded"))


def least_fill_order(a: DataFrame) -> DataFrame:
    """(node, round, discarded): an order of elimination in which little is discarded outside the places of A, by rounds.

    In each round those nodes go whose discarded fill is the least of all open nodes within two links (to nine digits,
    then by id). They do not touch each other's rows, so they go at once; the entries that they change are updated on A's
    places, and what the rest would discard is found anew.
    """
    work = saved(a.groupBy("i", "j").agg(F.sum("v").alias("v")), "factors")
    out, n = None, 0
    while True:
        links = work.where("i <> j").select("i", "j")
        links = saved(links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "factors")
        keys = discarded_fill(work, work).select("node", F.struct(F.round("discarded", 9).alias("discarded"), "node").alias("key"))
        keys = saved(keys, "factors")
        if keys.isEmpty():
            return out if out is not None else keys.select("node", F.lit(0).alias("round"), "key.discarded")
        near = keys
        for _ in range(2):
            sent = links.join(near.select(F.col("node").alias("i"), "key"), "i").select(F.col("j").alias("node"), "key")
            near = near.unionByName(sent).groupBy("node").agg(F.min("key").alias("key"))
        gone = saved(keys.join(near.select("node", F.col("key").alias("least")), "node").where("key = least").select("node", F.lit(n).alias("round"), "key.discarded"), "factors")
        out, n = gone if out is None else out.unionByName(gone), n + 1
        at = lambda c: gone.select(F.col("node").alias(c))
        column, row = work.where("i <> j").join(at("j"), "j"), work.where("i <> j").join(at("i"), "i")
        pivots = work.where("i = j").select(F.col("i").alias("m"), F.col("v").alias("d"))
        steps = column.select("i", F.col("j").alias("m"), F.col("v").alias("p")).join(row.select(F.col("i").alias("m"), "j", F.col("v").alias("q")), "m").join(pivots, "m")
        taken = steps.groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q") / F.col("d")).alias("s"))
        rest = work.join(at("i"), "i", "left_anti").join(at("j"), "j", "left_anti").join(taken, ["i", "j"], "left")
        work = saved(rest.select("i", "j", (F.col("v") - F.coalesce("s", F.lit(0.0))).alias("v")), "factors", instead_of=work)
