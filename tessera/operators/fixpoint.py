"""Semi-naive iteration to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.operators.errors import RelError
from tessera.operators.shared import checkpointed


#: Rounds after which what is known is written as one table: until then it is the union of the rounds' tables.
MERGE = 8


def iterate(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int | None = None, distinct_seed: bool = False) -> DataFrame:
    """The rows reachable from seed: each round step(all, new) gives rows, and those not seen yet are the next new ones.

    The seed keeps its repeated rows unless distinct_seed. Each round is cut from its lineage in the shared
    folder and written once; the rounds' new rows are the only thing that is joined against what is known.
    It ends when a round finds nothing new; most_rounds is the caller's own bound, beyond which it raises.
    """
    new = checkpointed(seed.distinct() if distinct_seed else seed)
    total, rounds = new, 0
    while most_rounds is None or rounds < most_rounds:
        made = step(total, new).toDF(*seed.columns).distinct()
        condition = None
        for c in seed.columns:
            same = made[c].eqNullSafe(total[c])
            condition = same if condition is None else condition & same
        new = checkpointed(made.join(total, condition, "left_anti"))
        if new.isEmpty():
            return total
        rounds += 1
        total = total.unionByName(new)
        if rounds % MERGE == 0:
            total = checkpointed(total)
    raise RelError(f"no fixpoint after {most_rounds} rounds")
