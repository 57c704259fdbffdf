"""Running composition per key, in rounds that grow with the logarithm of a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.cluster import cut
from lockstep.operators.ordered import in_ranges


@dataclass(frozen=True)
class Steps:
    """What events do to a state, as values that can be composed before the state is known.

    ``type`` is the SQL type of such a value, ``nothing`` the value that changes nothing. ``lift`` maps
    the SQL expression of an event to that of its value, ``then`` two of them to the first followed by
    the second; it must be associative.
    """

    type: str
    nothing: str
    lift: Callable[[str], str]
    then: Callable[[str, str], str]

    def of_composed(self) -> Steps:
        """The same steps over events that are composed already."""
        return Steps(self.type, self.nothing, lambda x: x, self.then)


def running(events: DataFrame, keys: Sequence[str], steps: Steps, per_run: int = 64, ranges: int | None = None) -> DataFrame:
    """Add ``before``: what all earlier events of the key do, one after another.

    ``events`` has the keys, ``seq`` (a number or struct) and ``event`` (a struct that can be ordered);
    events that share a ``seq`` come in the order of their content, and equal ones all stay.

    A key's events are cut into runs of at most ``per_run``, wherever they lie; each run is composed by
    itself, the composed runs are put through the same operator, and each run is walked once more from
    what enters it. A key with n events takes log(n) rounds, and no task holds more of it
    than one of the ``ranges`` of all events.
    """
    keys = list(keys)
    order = ["seq", "event"]
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    runs = (
        in_ranges(events.select(*keys, *order), keys, *order, ranges=ranges)
        .withColumn("_run", F.floor((F.row_number().over(inside) - 1) / F.lit(per_run)))
        .groupBy(*keys, "_part", "_run")
        .agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_events"))
    )
    nothing = f"cast({steps.nothing} AS {steps.type})"

    def after(state: str) -> str:
        return f"cast({steps.then(state, steps.lift('x.event'))} AS {steps.type})"

    runs = cut(runs.withColumn("_whole", F.expr(f"aggregate(_events, {nothing}, (acc, x) -> {after('acc')})")))
    crowded = runs.groupBy(*keys).count().where("count > 1").drop("count")
    entering = F.expr(nothing)
    if not crowded.isEmpty():
        wholes = runs.join(crowded, keys, "left_semi").select(
            *keys, F.struct("_part", "_run").alias("seq"), F.col("_whole").alias("event")
        )
        # fewer ranges each time: one that holds a single run of a key would leave as many as before
        before = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = running(wholes, keys, steps.of_composed(), per_run, max(1, before // per_run))
        met = met.select(*keys, "seq._part", "seq._run", F.col("before").alias("_before"))
        runs = runs.join(met, [*keys, "_part", "_run"], "left")
        entering = F.coalesce("_before", entering)

    types = {field.name: field.dataType.simpleString() for field in events.select(*order).schema}
    out = f"array<struct<seq:{types['seq']},event:{types['event']},before:{steps.type}>>"
    walked = F.expr(
        f"aggregate(_events, named_struct('state', _enters, 'out', cast(array() AS {out})), (acc, x) -> "
        f"named_struct('state', {after('acc.state')}, 'out', cast(array_append(acc.out, "
        f"named_struct('seq', x.seq, 'event', x.event, 'before', acc.state)) AS {out}))).out"
    )
    return runs.withColumn("_enters", entering).select(*keys, F.explode(walked).alias("_o")).select(*keys, "_o.*")
