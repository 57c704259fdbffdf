"""Sequential folds over the events of a key, in bounded runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.cluster import cut
from lockstep.functions import trees
from lockstep.functions.documents import once
from lockstep.operators.chains import Chain, fold_chains


def _same(value: str) -> str:
    return value


def fold_runs(
    state: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    step: Callable[[str, str], str],
    per_round: int = 256,
    enter: Callable[[str], str] = _same,
    leave: Callable[[str], str] = _same,
    arrive: Callable[[str], str] = _same,
    types: tuple[str, str] | None = None,
    chain: Chain | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fold ``events`` (keys, seq, event) into ``state`` (keys, state) in ``seq`` order per key.

    ``seq`` is a number or a struct of them. Events that share it are all folded, in the
    order of their content.

    ``step(state, event)`` maps SQL expressions to the SQL expression of a struct:
    the new ``state`` and an ``emit`` value, null when nothing is emitted. Returns the new states and the emitted
    rows (keys, seq, emit).

    ``enter`` and ``arrive`` turn states and events into the form ``step`` works
    on, ``leave`` turns states back. They are applied after the shuffle, so only
    the compact form travels. ``types`` names the types of the entered state and of
    what is emitted; without it they are found by analysing ``step`` once more.

    Every round takes the next ``per_round`` events of each key into one row and
    folds them there. One round does when no key has more events than that; for a
    longer run the events are numbered once and written, and further rounds read
    their part of them. They cost time, not memory.
    """
    keys = list(keys)
    by_seq = Window.partitionBy(*keys).orderBy("seq", "event")
    if types is None:
        inner = state.join(events, keys).select(
            F.expr(enter("state")).alias("state"), F.expr(arrive("event")).alias("event")
        )
        probe = inner.select(F.expr(step("state", "event")).alias("r"))
        types = (
            inner.schema["state"].dataType.simpleString(),
            probe.schema["r"].dataType["emit"].dataType.simpleString(),
        )
    state_type, emit_type = types
    seq_type = events.schema["seq"].dataType.simpleString()
    out_type = f"array<struct<seq:{seq_type},emit:{emit_type}>>"

    def advance(acc: str, x: str) -> str:
        def settle(r: str) -> str:
            said = f"named_struct('seq', {x}.seq, 'emit', {r}.emit)"
            return (
                f"named_struct('state', cast({r}.state AS {state_type}), 'out', "
                f"cast(if({r}.emit IS NULL, {acc}.out, array_append({acc}.out, {said})) AS {out_type}))"
            )

        return trees.let(step(f"{acc}.state", f"{x}.event"), settle)

    arrived = f"transform(_run, x -> named_struct('seq', x.seq, 'event', {arrive('x.event')}))"
    start = f"named_struct('state', cast({enter('state')} AS {state_type}), 'out', cast(array() AS {out_type}))"
    fold = F.expr(f"if(_run IS NULL, NULL, aggregate(_arrived, {start}, (acc, x) -> {advance('acc', 'x')}))")

    longest = events.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    rounds = -(-longest // per_round)
    if not rounds:
        return state, events.select(*keys, "seq", F.lit(None).cast(emit_type).alias("emit")).where(F.lit(False))

    if rounds > 1 and chain is not None:
        # what follows reads them five times, and each time would decode them anew
        events = cut(events)
        long = cut(events.groupBy(*keys).count().where(F.col("count") > per_round).select(*keys))
        short = [x.join(long, keys, "left_anti") for x in (state, events)]
        after, emitted = fold_runs(*short, keys, step, per_round, enter, leave, arrive, types)
        busy = [x.join(long, keys, "left_semi") for x in (state, events)]
        chained, said = fold_chains(*busy, keys, step, chain, per_round, enter, leave, arrive, types)
        return after.unionByName(chained), emitted.unionByName(said)

    touched = events.select(*keys).distinct()
    if rounds > 1:
        events = cut(events.withColumn("_n", F.row_number().over(by_seq) - 1))
    active, emitted = state, None
    for number in range(rounds):
        part = events
        if rounds > 1:
            part = events.where((F.col("_n") >= number * per_round) & (F.col("_n") < (number + 1) * per_round))
        runs = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("_run"))
        # every touched key has a run in the first round; the states of the others stay where they are
        met = runs.join(active, keys, "left") if number == 0 else active.join(runs, keys, "left")
        folded = once(met.withColumn("_arrived", F.expr(arrived)), "_end", fold)
        after = F.when(F.col("_run").isNull(), F.col("state")).otherwise(F.expr(leave("_end.state")))
        # states and emitted rows come from one computation; its size follows the events
        folded = cut(folded.select(*keys, after.alias("state"), "_end.out"))
        said = folded.select(*keys, F.explode("out").alias("_o")).select(*keys, "_o.*")
        emitted = said if emitted is None else emitted.unionByName(said)
        active = folded.select(*keys, "state")
    untouched = state.join(touched, keys, "left_anti")
    return untouched.unionByName(active.where(F.col("state").isNotNull())), emitted
