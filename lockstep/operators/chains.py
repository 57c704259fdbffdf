"""Long runs of messages to one object: changes composed before the object is known, and folded in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.cluster import cut
from lockstep.functions import trees
from lockstep.functions.documents import once
from lockstep.model import DELETE_OBJECT, LEAVES, PATCH_OBJECT, PUT_OBJECT
from lockstep.operators.ordered import in_ranges
from lockstep.operators.scans import Steps, running

# What an edit holds in place of a member that it removes; no JSON text is like it.
REMOVED = "'~'"
# A null that a document holds, while a patch is applied in which null means removal.
HELD_NULL = "' null'"

#: ``gone``: the object is deleted. ``fresh``: paths that are emptied before ``leaves`` are set, the root of them
#: for a put. ``doc``: the text of a put that nothing has changed since.
EDIT = f"struct<gone:boolean,fresh:array<string>,leaves:{LEAVES},doc:string>"


def edit(gone: str = "false", fresh: str = "array()", leaves: str = "array()", doc: str = "NULL") -> str:
    return f"cast(named_struct('gone', {gone}, 'fresh', {fresh}, 'leaves', {leaves}, 'doc', {doc}) AS {EDIT})"


def absolute(e: str) -> str:
    """Whether the edit leads to the same object whatever was there."""
    return f"({e}.gone OR array_contains({e}.fresh, ''))"


def _idle(e: str) -> str:
    return f"(NOT {e}.gone AND size({e}.leaves) = 0)"


def _at_or_under_any(path: str, tops: str) -> str:
    return trees.some(tops, lambda q: trees.at_or_under(path, q))


def lift(m: str) -> str:
    """The edit of a message that is accepted; gets, verifications and unreadable patches change nothing."""
    removals = trees.each(
        f"{m}.leaves", lambda x: trees.pair(f"{x}.path", f"if({x}.value = 'null', {REMOVED}, {x}.value)")
    )
    return (
        f"CASE WHEN {m}.event = {trees.text(DELETE_OBJECT)} OR ({m}.event = {trees.text(PUT_OBJECT)} AND {m}.object IS NULL) "
        f"THEN {edit(gone='true')} "
        f"WHEN {m}.event = {trees.text(PUT_OBJECT)} THEN {edit(fresh="array('')", leaves=f'{m}.leaves', doc=f'{m}.object')} "
        f"WHEN {m}.event = {trees.text(PATCH_OBJECT)} AND {m}.patched AND {m}.leaves IS NOT NULL THEN {edit(leaves=removals)} "
        f"ELSE {edit()} END"
    )


def then(first: str, second: str) -> str:
    """Two edits as one.

    Merge patches alone don't compose: a plain value that is then patched becomes an object of the
    patch's members only, whatever the object held before. Such paths are marked as fresh.
    """

    def merge(p: str, q: str) -> str:
        left = trees.keep(f"{p}.leaves", lambda x: f"NOT {_at_or_under_any(f'{x}.path', f'{q}.fresh')}")

        def settle(old: str) -> str:
            replaced = trees.keep(
                old,
                lambda x: f"{x}.value <> '{{}}' AND "
                + trees.some(
                    f"{q}.leaves",
                    lambda y: f"{trees.under(f'{y}.path', f'{x}.path')} OR ({y}.path = {x}.path AND {y}.value = '{{}}')",
                ),
            )
            # a plain value above a fresh path takes its place
            still = trees.keep(
                f"{p}.fresh",
                lambda f: f"NOT {_at_or_under_any(f, f'{q}.fresh')} AND NOT "
                + trees.some(f"{q}.leaves", lambda y: f"{y}.value <> '{{}}' AND {trees.at_or_under(f, f'{y}.path')}"),
            )
            fresh = f"array_distinct(concat({still}, {trees.paths_of(replaced)}, {q}.fresh))"
            return edit(fresh=fresh, leaves=_plain_patch(old, f"{q}.leaves"))

        return trees.let(left, settle)

    def build(p: str, q: str) -> str:
        return (
            f"CASE WHEN {_idle(q)} THEN {p} WHEN {absolute(q)} OR {_idle(p)} THEN {q} "
            f"WHEN {p}.gone OR {p}.leaves IS NULL THEN {p} ELSE {merge(p, q)} END"
        )

    return trees.let(first, lambda p: trees.let(second, lambda q: build(p, q)))


def _swap(leaves: str, old: str, new: str) -> str:
    return trees.each(leaves, lambda x: trees.pair(f"{x}.path", f"if({x}.value = {old}, {new}, {x}.value)"))


def _plain_patch(base: str, change: str) -> str:
    """``trees.patch`` in which a null is a value like any other."""
    patched = trees.let(_swap(change, "'null'", HELD_NULL), lambda c: trees.patch(base, c))
    return _swap(patched, HELD_NULL, "'null'")


def apply_edit(e: str, s: str, version: Callable[[str], str]) -> str:
    """State ``s`` (version, doc, tree) after an edit."""
    kept = trees.keep(f"{s}.tree", lambda x: f"NOT {_at_or_under_any(f'{x}.path', f'{e}.fresh')}")
    change = _swap(_swap(f"{e}.leaves", "'null'", HELD_NULL), REMOVED, "'null'")
    merged = trees.let(
        f"coalesce({kept}, cast(array() AS {LEAVES}))", lambda b: trees.let(change, lambda c: trees.patch(b, c))
    )
    tree = f"if({e}.doc IS NOT NULL, {e}.leaves, {_swap(merged, HELD_NULL, "'null'")})"
    after = trees.let(
        tree,
        lambda t: f"named_struct('version', {version(t)}, 'doc', coalesce({e}.doc, {trees.to_json(t)}), 'tree', {t})",
    )
    return (
        f"CASE WHEN {_idle(e)} THEN {s} WHEN {e}.gone THEN NULL "
        f"WHEN {absolute(e)} OR {s}.tree IS NOT NULL THEN {after} ELSE {s} END"
    )


@dataclass(frozen=True)
class Chain:
    """How the events of a fold compose.

    Their steps, an edit put to a state, which edits ignore the state, which events may change it, and
    those of the edits in an array that matter to what all of them do.
    """

    steps: Steps
    apply: Callable[[str, str], str]
    absolute: Callable[[str], str]
    changes: Callable[[str], str]
    lasting: Callable[[str], str]


def lasting(edits: str) -> str:
    """The edits without those of which every leaf is set once more, or removed, by a later one.

    The later value replaces what is at its path and below, and opens the same objects above it, so an earlier
    one leaves no trace. An empty object replaces nothing where an object is; edits with one all stay,
    as do puts and deletes.
    """

    def settle(a: str) -> str:
        e, i = f"_v{next(trees._names)}", f"_v{next(trees._names)}"
        # from the last edit back: the place of an edit that sets a path is where the path comes first
        sets = trees.each(
            f"reverse({a})",
            lambda x: trees.paths_of(trees.keep(f"{x}.leaves", lambda y: f"{y}.value <> '{{}}'")),
        )

        def last(paths: str) -> str:
            def places(names: str) -> str:
                at = trees.each(names, lambda q: f"size({paths}) - array_position({trees.each(paths, lambda l: f'array_contains({l}, {q})')}, true)")
                return trees.let(
                    f"array_distinct({at})",
                    lambda n: f"filter({a}, ({e}, {i}) -> array_contains({n}, {i}) OR {e}.gone OR size({e}.fresh) > 0 "
                    f"OR {trees.some(f'{e}.leaves', lambda y: f'{y}.value = {trees.text('{}')}')})",
                )

            return trees.let(f"array_distinct(flatten({paths}))", places)

        return trees.let(sets, last)

    return trees.let(edits, settle)


def object_chain(version: Callable[[str], str]) -> Chain:
    """The chain of messages to an object, where puts replace it whole."""
    writing = ", ".join(trees.text(e) for e in (PATCH_OBJECT, PUT_OBJECT, DELETE_OBJECT))
    steps = Steps(EDIT, edit(), lift, then)
    return Chain(steps, lambda e, s: apply_edit(e, s, version), absolute, lambda m: f"{m}.event IN ({writing})", lasting)


def fold_chains(
    state: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    step: Callable[[str, str], str],
    chain: Chain,
    per_run: int,
    enter: Callable[[str], str],
    leave: Callable[[str], str],
    arrive: Callable[[str], str],
    types: tuple[str, str],
) -> tuple[DataFrame, DataFrame]:
    """What ``fold_runs`` returns for keys that all have events, with the runs of a key folded at the same time.

    ``step`` also says whether the event was ``taken``. A key's events are cut into runs; each run is
    composed as if all its events were taken, a scan over the composed runs gives the state that enters
    each, and all runs are folded from there one event after another. What the folds took is scanned in
    turn. Where that gives the states the runs were folded from, they are right. Otherwise all runs
    before the first wrong one of their key are, and the others are folded again. Without
    refused events that is two scans of log(n) rounds and one fold; each further round settles all
    runs up to the next that refuses something, at least one per key. Where a run ends with a refusal,
    those after it are expected to refuse everything until one replaces the object: who misses
    a patch misses what it changed.
    """
    keys = list(keys)
    place = [*keys, "_part", "_run"]
    at = F.struct("_part", "_run")
    steps, (state_type, emit_type) = chain.steps, types
    fields = {c: events.schema[c].dataType.simpleString() for c in ("seq", "event")}
    out_type = f"array<struct<seq:{fields['seq']},emit:{emit_type}>>"
    nothing = f"cast({steps.nothing} AS {steps.type})"

    numbered = in_ranges(events.select(*keys, "seq", "event"), keys, "seq", "event")
    number = f"row_number() OVER (PARTITION BY {', '.join([*(f'`{k}`' for k in keys), '_part'])} ORDER BY seq, event) - 1"
    numbered = numbered.withColumn("_run", F.floor(F.expr(number) / F.lit(per_run)))
    runs = numbered.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("_events"))
    arrived = f"transform(_events, x -> named_struct('seq', x.seq, 'event', {arrive('x.event')}))"
    runs = runs.withColumn("_events", F.expr(arrived))
    hoped = f"aggregate(_lasting, {nothing}, (acc, x) -> cast({steps.then('acc', 'x')} AS {steps.type}))"
    lifted = f"transform(_events, x -> cast({steps.lift('x.event')} AS {steps.type}))"
    runs = runs.withColumn("_lifted", F.expr(lifted)).withColumn("_lasting", F.expr(chain.lasting("_lifted")))
    runs = cut(runs.withColumn("_hoped", F.expr(hoped)).drop("_lifted", "_lasting"))

    def entering(edits: DataFrame, name: str) -> DataFrame:
        """The state before each run, if all runs do what ``edits`` (in ``_edit``) say."""
        wholes = edits.select(*keys, at.alias("seq"), F.col("_edit").alias("event"))
        met = running(wholes, keys, steps.of_composed()).select(*keys, "seq.*", "before")
        begun = f"cast({trees.let(f'cast({enter('state')} AS {state_type})', lambda s: chain.apply('before', s))} AS {state_type})"
        met = met.join(state.select(*keys, "state"), keys, "left").withColumn("_begun", F.expr(begun))
        return cut(met.select(*place, F.expr(leave("_begun")).alias(name)))

    def advance(acc: str, x: str) -> str:
        def settle(r: str) -> str:
            said = f"named_struct('seq', {x}.seq, 'emit', {r}.emit)"
            return (
                f"named_struct('state', cast({r}.state AS {state_type}), 'took', array_append({acc}.took, {r}.taken), "
                f"'out', cast(if({r}.emit IS NULL, {acc}.out, array_append({acc}.out, {said})) AS {out_type}))"
            )

        return trees.let(step(f"{acc}.state", f"{x}.event"), settle)

    start = (
        f"named_struct('state', cast({enter('_enters')} AS {state_type}), "
        f"'took', cast(array() AS array<boolean>), 'out', cast(array() AS {out_type}))"
    )
    walk = F.expr(f"aggregate(_events, {start}, (acc, x) -> {advance('acc', 'x')})")
    took = f"zip_with(_events, _end.took, (x, t) -> if(t, cast({steps.lift('x.event')} AS {steps.type}), {nothing}))"
    # a run of which everything was taken does what was hoped
    refused = f"exists(zip_with(_events, _end.took, (x, t) -> NOT t AND {chain.changes('x.event')}), r -> r)"
    after_refusal = f"aggregate({chain.lasting(took)}, {nothing}, (acc, x) -> cast({steps.then('acc', 'x')} AS {steps.type}))"
    composed = F.expr(f"if({refused}, {after_refusal}, _hoped)")

    writes = f"zip_with(_events, _end.took, (x, t) -> if({chain.changes('x.event')}, t, NULL))"
    lost = F.expr(f"coalesce(NOT try_element_at(filter({writes}, t -> t IS NOT NULL), -1), false)")

    def folded(begun: DataFrame) -> DataFrame:
        walked = once(runs.join(begun, place), "_end", walk)
        left = F.expr(leave("_end.state"))
        return walked.select(*place, "_enters", left.alias("_leaves"), composed.alias("_edit"), lost.alias("_lost"), "_end.out")

    done = cut(folded(entering(runs.withColumnRenamed("_hoped", "_edit"), "_enters")))
    while True:
        met = done.join(entering(done, "_true"), place)
        wrong = cut(met.where(~F.col("_enters").eqNullSafe(F.col("_true"))).groupBy(*keys).agg(F.min(at).alias("_first")))
        if wrong.isEmpty():
            break
        marked = done.join(wrong, keys, "left").withColumn("_open", F.coalesce(at >= F.col("_first"), F.lit(False)))
        replaced = F.expr(chain.absolute("_edit"))
        known = marked.where(F.col("_first").isNotNull()).groupBy(*keys).agg(
            F.max_by("_lost", F.when(~F.col("_open"), at)).alias("_missing"),
            F.min(F.when(F.col("_open") & replaced, at)).alias("_mended"),
        )
        missing = F.col("_missing") & F.coalesce(at < F.col("_mended"), F.lit(True))
        # a run folded from a wrong state says little, unless it replaced the object
        guess = marked.join(known, keys, "left").join(runs.select(*place, "_hoped"), place).withColumn(
            "_edit",
            F.when(~F.col("_open") | replaced, F.col("_edit")).when(missing, F.expr(nothing)).otherwise(F.col("_hoped")),
        )
        again = marked.where("_open").select(*place)
        refolded = folded(entering(guess, "_enters").join(again, place, "left_semi"))
        done = cut(marked.where("NOT _open").select(*done.columns).unionByName(refolded))
    after = done.groupBy(*keys).agg(F.max_by("_leaves", at).alias("state")).where(F.col("state").isNotNull())
    said = done.select(*keys, F.explode("out").alias("_o")).select(*keys, "_o.*")
    return after, said
