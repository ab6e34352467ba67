"""Drawing attributes that exclude each other, without rejection.

The rules forbid combinations of values.  The joint shares of the allowed ones
are fitted so that every attribute still has its given shares (iterative
proportional fitting over a table of all combinations, whose size depends on
the attributes and not on the data), and each row makes one draw from them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.samples import hash_order

Cell = tuple[str, ...]


def fit(shares: list[dict[str, float]], allowed: Callable[..., bool], rounds: int = 10_000, exact: float = 1e-12) -> dict[Cell, float]:
    """The share of each allowed combination, one value of each attribute, with the marginals of ``shares``.

    Raises ValueError if no combination of shares can have those marginals,
    for instance if a value with a share above zero is allowed nowhere.
    """
    totals = [sum(s.values()) for s in shares]
    aims = [{v: w / t for v, w in s.items()} for s, t in zip(shares, totals)]
    cells = {c: 1.0 for c in product(*aims) if allowed(*c) and all(a[v] > 0 for a, v in zip(aims, c))}
    for _ in range(rounds):
        worst = 0.0
        for k, aim in enumerate(aims):
            held = dict.fromkeys(aim, 0.0)
            for c, p in cells.items():
                held[c[k]] += p
            if any(aim[v] > 0 and held[v] == 0 for v in aim):
                raise ValueError(f"the rules leave no place for {[v for v in aim if aim[v] > 0 and held[v] == 0]}")
            worst = max(worst, *(abs(held[v] - aim[v]) for v in aim))
            cells = {c: p * aim[c[k]] / held[c[k]] for c, p in cells.items()}
        if worst < exact:
            return cells
    raise ValueError("no shares of the allowed combinations have these marginals")


def steps(cells: dict[Cell, float], given: int = 0) -> dict[Cell, list[tuple[Cell, float]]]:
    """For each combination of the first ``given`` values the rest, with the upper ends of their intervals in [0, 1)."""
    out: dict[Cell, list[tuple[Cell, float]]] = {}
    for c, p in sorted(cells.items()):
        held = out.setdefault(c[:given], [])
        held.append((c[given:], p + (held[-1][1] if held else 0.0)))
    return {c: [(v, (u / held[-1][1]) if k < len(held) - 1 else 1.0) for k, (v, u) in enumerate(held)] for c, held in out.items()}


def unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) with 32 bits for each key."""
    return F.conv(F.left(hash_order(seed, key), F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)


def drawn(df: DataFrame, key: Column, cells: dict[Cell, float], names: list[str], given: list[str] | None = None, seed: str = "42") -> DataFrame:
    """``df`` with a column for each of ``names``, the attributes of ``cells`` after those that ``given`` already has.

    A row whose given values are in no allowed combination gets nulls.
    """
    given = given or []
    table = F.array(*[F.struct(F.lit("\x1f".join(g)).alias("given"), F.array(*[F.lit(u) for _, u in held]).alias("upto"), F.array(*[F.array(*map(F.lit, v)) for v, _ in held]).alias("values")) for g, held in sorted(steps(cells, len(given)).items())])
    own = F.concat_ws("\x1f", *[F.col(g) for g in given]) if given else F.lit("")
    row = df.withColumn("u_", unit(seed, key)).withColumn("of_", F.get(F.filter(table, lambda t: t["given"] == own), F.lit(0)))
    row = row.withColumn("pick_", F.get(F.col("of_.values"), F.size(F.filter("of_.upto", lambda u: u <= F.col("u_")))))
    return row.select(*df.columns, *[F.get("pick_", F.lit(k)).alias(n) for k, n in enumerate(names)])
