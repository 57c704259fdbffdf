"""Operators that compare messages with a store of objects, and change it.

A store has the columns kind, ns, name (one row per key), version and doc. With the
columns account and cluster it holds the objects of several clients, one row per client
and key; whatever meets it must have these columns too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.functions import trees
from lockstep.functions.identity import to_version, version_newer
from lockstep.model import DELETE_OBJECT, GET_OBJECT, LEAVES, PATCH, PATCH_OBJECT, PUT_OBJECT, VERIFY_OBJECT
from lockstep.operators.batches import unpack_batches
from lockstep.operators.chains import object_chain
from lockstep.operators.folds import fold_runs
from lockstep.operators.guards import VERSION_PATH, version_only
from lockstep.operators.ordered import last_by_key
from lockstep.operators.paths import KEYS, join_on, object_keys, store_keys


def verify(messages: DataFrame, store: DataFrame) -> DataFrame:
    """Requests for the objects whose checksum does not match the store.

    The stored object goes along as base unless it is missing or unreadable.
    Matching objects give no row.
    """
    keys = store_keys(store, messages)
    found = store.select(*keys, F.col("doc").alias("_doc"))
    return (
        docs.once(join_on(messages, found, keys, "left"), "_sum", docs.checksum("_doc"))
        .where(F.coalesce(F.col("_sum") != F.col("checksum"), F.lit(True)))
        .withColumns(
            {
                "event": F.lit(GET_OBJECT),
                "base_object": F.when(F.col("_sum").isNotNull(), F.col("_doc")),
                "reason": F.when(F.col("_doc").isNull(), "missing")
                .when(F.col("_sum").isNull(), "unreadable")
                .otherwise("mismatch"),
            }
        )
        .drop("_doc", "_sum")
    )


def encode_changes(df: DataFrame, base: str, strategy: str) -> DataFrame:
    """Objects in ``doc`` as put or patch messages against the column ``base``.

    Copy, or no base: put. Otherwise a merge patch with the checksum of the
    merged result; a patch that moves only the version is dropped.
    """
    as_patch = f"{strategy} = '{PATCH}' AND {base} IS NOT NULL"
    trees_of = df.withColumns(
        {
            "_old": F.expr(f"if({as_patch}, {trees.leaves(base)}, NULL)"),
            "_new": F.expr(f"if({as_patch}, {trees.leaves('doc')}, NULL)"),
        }
    ).withColumn("_change", docs.diff("_old", "_new"))
    # The generator drops version-only patches. A filter would be pushed down
    # and evaluate the diff a second time.
    useful = trees.keep(
        "array(named_struct('leaves', _change))",
        lambda c: f"{c}.leaves IS NULL OR NOT {version_only(f'{c}.leaves')}",
    )
    kept = trees_of.withColumn("_kept", F.explode(F.expr(useful)))
    change = "_kept.leaves"
    # Merging leads to the new document, except that explicit nulls vanish from it.
    has_null = trees.some("_new", lambda x: f"{x}.value = 'null'")
    merged = f"if({has_null}, {trees.to_json(trees.patch('_old', change))}, doc)"
    is_patch = f"{change} IS NOT NULL"
    return kept.withColumns(
        {
            "event": F.expr(f"if({is_patch}, '{PATCH_OBJECT}', '{PUT_OBJECT}')"),
            "checksum": docs.checksum(f"if({is_patch}, {merged}, doc)"),
            "patch": F.expr(f"if({is_patch}, coalesce({trees.to_json(change)}, '{{}}'), NULL)"),
            "object": F.expr(f"if({is_patch}, NULL, doc)"),
        }
    ).drop("_old", "_new", "_change", "_kept", "doc")


def put_or_patch(
    new: DataFrame, known: DataFrame, kinds: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Messages that bring the other side up to ``new``, given what it is known to hold.

    A ``base_object`` sent along overrides the known state. After sending, the
    known state is ``advance_known(known, new)``.
    """
    keys = keys or store_keys(known, new)
    joined = (
        join_on(new, known.select(*keys, F.col("doc").alias("_known")), keys, "left")
        .join(kinds.select("kind", F.col("strategy").alias("_strategy")), "kind", "left")
    )
    base = F.col("_known")
    if "base_object" in new.columns:
        base = F.coalesce(F.nullif(F.col("base_object"), F.lit("")), base)
    joined = joined.withColumn("_known", base)
    return encode_changes(joined, "_known", "_strategy").drop("_known", "_strategy", "base_object")


def advance_known(known: DataFrame, sent: DataFrame) -> DataFrame:
    """Known state after ``sent`` went out: its documents replace the older ones."""
    keys = store_keys(known, sent)
    older = known.select(*keys, "doc", F.lit(0).alias("_age"))
    newer = sent.select(*keys, "doc", F.lit(1).alias("_age"))
    return last_by_key(older.unionByName(newer), keys, "_age").drop("_age")


def apply_patches(messages: DataFrame, store: DataFrame, kinds: DataFrame) -> DataFrame:
    """Outcome of each patch message: ``stored`` with the new document, or ``get``.

    A patch is accepted when the checksum of the result is the announced one.
    Otherwise the object is asked for: without base when its kind is not patched
    or the object is missing, with the stored object as base in all other cases.
    """
    keys = store_keys(store, messages)
    merged = trees.to_json(trees.patch(trees.leaves("_doc"), trees.leaves("patch")))
    joined = (
        join_on(messages, store.select(*keys, F.col("doc").alias("_doc")), keys, "left")
        .join(kinds.select("kind", F.col("strategy").alias("_strategy")), "kind", "left")
        .withColumn("_doc", F.when(F.col("_strategy") == PATCH, F.col("_doc")))
    )
    tried = docs.once(joined, "_merged", F.expr(f"if(_doc IS NULL, NULL, {merged})"))
    tried = docs.once(tried, "_good", F.expr(f"coalesce({trees.checksum('_merged')} = checksum, false)"))
    good = F.col("_good")
    return tried.withColumns(
        {
            "outcome": F.when(good, "stored").otherwise("get"),
            "doc": F.when(good, F.col("_merged")),
            "base_object": F.when(~good, F.col("_doc")),
        }
    ).drop("_doc", "_strategy", "_merged", "_good")


def save_if_newer(store: DataFrame, puts: DataFrame, check: bool = True) -> DataFrame:
    """The store after one put per key.

    A new object is inserted; a stored one is replaced only by a strictly newer
    version, or when either document cannot be read. ``check=False`` always replaces.
    """
    keys = store_keys(store, puts)
    rest = [c for c in store.columns if c not in keys]
    both = join_on(
        store.select(*keys, F.struct(*rest).alias("_s")),
        puts.select(*keys, F.struct(*rest).alias("_p")),
        keys,
        "full_outer",
    )
    replace = F.lit(True)
    if check:
        replace = version_newer(F.col("_p.version"), F.col("_s.version"))
        if "doc" in rest:
            replace = replace | ~docs.is_valid("_p.doc") | ~docs.is_valid("_s.doc")
    winner = (
        F.when(F.col("_s").isNull(), F.col("_p"))
        .when(F.col("_p").isNull(), F.col("_s"))
        .when(replace, F.col("_p"))
        .otherwise(F.col("_s"))
    )
    return both.select(*keys, winner.alias("_w")).select(*keys, "_w.*")


def serve_gets(
    requests: DataFrame, store: DataFrame, known: DataFrame, kinds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Answers to get requests as puts or patches, and the requests for unknown objects."""
    drop = [c for c in ("version", "doc") if c in requests.columns]
    keys = store_keys(store, requests, known)
    held = join_on(requests.drop(*drop), store.select(*keys, "version", "doc"), keys, "left")
    return answer_gets(held, known, kinds, keys)


def answer_gets(
    found: DataFrame, known: DataFrame, kinds: DataFrame, keys: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Objects that were asked for as puts or patches, and the requests that found none (``doc`` null)."""
    answers = put_or_patch(found.where(F.col("doc").isNotNull()), known, kinds, keys)
    errors = found.where(F.col("doc").isNull()).drop("version", "doc").withColumn("error", F.lit("object not found"))
    return answers, errors


def resolve_conflicts(cluster: DataFrame, backend: DataFrame) -> DataFrame:
    """One object per key: the higher version, the backend's on a tie."""
    both = cluster.withColumn("origin", F.lit("cluster")).unionByName(backend.withColumn("origin", F.lit("backend")))
    both = both.withColumns({"_v": to_version(F.col("version")), "_o": (F.col("origin") == "backend").cast("int")})
    return last_by_key(both, store_keys(backend, cluster), "_v", "_o").drop("_v", "_o")


def apply_changes(target: DataFrame, changes: DataFrame, order: str = "seq", keep_metadata: bool = False) -> DataFrame:
    """The target after creating, updating and deleting by key (``op`` is put or delete).

    Of several changes to a key the last one counts. ``keep_metadata`` leaves the
    metadata of an updated document in place and only adds labels and annotations.
    """
    keys = store_keys(target, changes)
    rest = [c for c in target.columns if c not in keys]
    last = last_by_key(changes, keys, order)
    both = join_on(
        target.select(*keys, F.struct(*rest).alias("_t")),
        last.select(*keys, "op", F.struct(*rest).alias("_c")),
        keys,
        "full_outer",
    )
    updated = F.col("_c")
    if keep_metadata and "doc" in rest:
        merged = F.col("_c").withField("doc", docs.merge_metadata("_t.doc", "_c.doc"))
        updated = F.when(F.col("_t").isNull(), F.col("_c")).otherwise(merged)
    return (
        both.where(~F.col("op").eqNullSafe("delete"))
        .select(*keys, F.when(F.col("op").isNull(), F.col("_t")).otherwise(updated).alias("_w"))
        .select(*keys, "_w.*")
    )


@dataclass
class BatchResult:
    """A store after batches were applied, and the messages that followed from them."""

    store: DataFrame
    requests: DataFrame
    answers: DataFrame
    errors: DataFrame


def replay(
    store: DataFrame,
    messages: DataFrame,
    check: bool = True,
    per_round: int = 256,
    kinds: DataFrame | None = None,
    keep_metadata: bool = False,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply get, verify, delete, patch and put messages to the store in ``seq`` order per key.

    Returns the new store, the get requests that arise, and what the gets found: the
    object as it was then, null if there was none. Both carry the ``carry`` columns of
    the message they follow from. ``seq`` is a number or a struct of them.

    ``check`` stores only what is newer, or where either document cannot be read.
    ``kinds`` limits patches to the kinds patched: on others they ask for the object
    without base. ``keep_metadata`` leaves the metadata of a stored object in place when
    a put replaces it. Senders debounce per key, so a single round of ``fold_runs``
    nearly always does. Longer runs of a key are composed and folded in parallel, except
    with ``keep_metadata``: what such a put stores depends on the object it meets.
    """
    patched = F.lit(True)
    if kinds is not None:
        strategies = kinds.select("kind", F.col("strategy").alias("_strategy"))
        messages = messages.join(strategies, "kind", "left")
        patched = F.col("_strategy").eqNullSafe(PATCH)
    event = F.struct(
        *[_column(messages, c).alias(c) for c in ("event", "checksum", "patch", "object", "base_object")],
        patched.alias("patched"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("origin"),
    )
    events = messages.select(*keys, "seq", event.alias("event"))
    held = store.select(*keys, F.struct(F.col("version").cast("string").alias("version"), "doc").alias("state"))

    # each document is unfolded once; the fold works on leaves
    def enter(s: str) -> str:
        unfolded = f"named_struct('version', {s}.version, 'doc', {s}.doc, 'tree', {trees.leaves(f'{s}.doc')})"
        return f"if({s}.doc IS NULL, NULL, {unfolded})"

    def leave(s: str) -> str:
        return f"if({s}.doc IS NULL, NULL, named_struct('version', {s}.version, 'doc', {s}.doc))"

    def arrive(m: str) -> str:
        body = f"if({m}.event = {trees.text(PATCH_OBJECT)}, {m}.patch, {m}.object)"
        return (
            f"named_struct('event', {m}.event, 'checksum', {m}.checksum, 'object', {m}.object, "
            f"'base_object', {m}.base_object, 'patched', {m}.patched, 'origin', {m}.origin, "
            f"'leaves', {trees.leaves(body)})"
        )

    def version(tree: str) -> str:
        return f"trim('\"' FROM {trees.leaf(tree, VERSION_PATH)})"

    def step(s: str, m: str) -> str:
        is_patch, is_put, is_verify, is_delete, is_get = (
            f"{m}.event = '{e}'" for e in (PATCH_OBJECT, PUT_OBJECT, VERIFY_OBJECT, DELETE_OBJECT, GET_OBJECT)
        )
        # what the message offers to store: leaves and their text
        rewritten = is_patch
        offered = f"WHEN {is_patch} THEN {trees.patch(f'{s}.tree', f'{m}.leaves')} ELSE {m}.leaves"
        if keep_metadata:
            settled = f"({is_put} AND {s}.tree IS NOT NULL)"
            rewritten = f"({is_patch} OR {settled})"
            offered = f"WHEN {settled} THEN {trees.merged_metadata(f'{s}.tree', f'{m}.leaves')} {offered}"

        def judge(o: str) -> str:
            # one checksum, which only patches and verifications need
            same = (
                f"(({is_patch} AND {m}.patched) OR {is_verify}) AND coalesce({trees.checksum(f'{o}.doc')} = {m}.checksum, false)"
            )
            return trees.let(same, lambda fits: settle(o, fits))

        def settle(o: str, fits: str) -> str:
            newer = "true"
            if check:
                numbers = [trees.integer(version(f"{side}.tree")) for side in (o, s)]
                newer = f"({s}.tree IS NULL OR {o}.tree IS NULL OR coalesce({' > '.join(numbers)}, false))"
            stored = f"named_struct('version', {version(f'{o}.tree')}, 'doc', {o}.doc, 'tree', {o}.tree)"
            after = (
                f"CASE WHEN {is_delete} THEN NULL"
                f" WHEN ({is_put} OR ({is_patch} AND {fits})) AND {newer} THEN {stored} ELSE {s} END"
            )
            base = f"if(({is_patch} AND {m}.patched) OR ({is_verify} AND {s}.tree IS NOT NULL), {s}.doc, NULL)"

            def said(base: str, found: str) -> str:
                return (
                    f"named_struct('get', {is_get}, 'base_object', {base}, 'version', if({is_get}, {s}.version, NULL), "
                    f"'doc', {found}, 'origin', {m}.origin)"
                )

            told = (
                f"CASE WHEN {is_get} THEN {said(f'{m}.base_object', f'{s}.doc')} "
                f"WHEN ({is_patch} OR {is_verify}) AND NOT {fits} THEN {said(base, 'cast(NULL AS STRING)')} END"
            )
            taken = f"coalesce({is_delete} OR (({is_put} OR ({is_patch} AND {fits})) AND {newer}), false)"
            return f"named_struct('state', {after}, 'emit', {told}, 'taken', {taken})"

        def told(tree: str) -> str:
            text = (
                f"CASE WHEN {is_verify} THEN {s}.doc WHEN {is_patch} THEN {trees.to_json(tree)} "
                f"WHEN {rewritten} THEN coalesce({trees.to_json(tree)}, {m}.object) ELSE {m}.object END"
            )
            return trees.let(f"named_struct('tree', {tree}, 'doc', {text})", judge)

        return trees.let(f"CASE {offered} END", told)

    origin = events.schema["event"].dataType["origin"].dataType.simpleString()
    types = (
        f"struct<version:string,doc:string,tree:{LEAVES}>",
        f"struct<get:boolean,base_object:string,version:string,doc:string,origin:{origin}>",
    )
    chain = None if keep_metadata else object_chain(version)
    after, said = fold_runs(held, events, keys, step, per_round, enter, leave, arrive, types, chain)
    told = said.select(*keys, "seq", "emit.*").select(
        *keys, "seq", "get", "base_object", "version", "doc", *[F.col(f"origin.{c}").alias(c) for c in carry]
    )
    return (
        after.select(*keys, "state.version", "state.doc"),
        told.where(~F.col("get")).drop("get", "version", "doc"),
        told.where(F.col("get")).drop("get"),
    )


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def fold_batches(
    store: DataFrame,
    batches: DataFrame,
    kinds: DataFrame,
    known: DataFrame | None = None,
    check: bool = True,
    per_round: int = 256,
    order: str | None = None,
) -> BatchResult:
    """Effect of batches on the store, one batch after another by the column ``order``.

    Within a batch gets and verifications come first, then deletes, the patches of a
    key one after another, and puts. Each sees the store as it is then. A patch on an
    object that is missing, or whose checksum is off, asks for the object. Without
    ``order`` the batches count as one. A store with account and cluster is kept apart
    by client, and its batches name theirs.
    """
    keys = object_keys(store)
    items = unpack_batches(batches)
    # batches not ordered among themselves interleave by list, as one batch would
    at = [F.col(order).alias("batch")] if order else []
    place = F.struct(*at, F.col("op_rank"), F.col("seq").alias("item"))
    items = items.withColumns({"_item": F.col("seq"), "seq": place})
    after, requests, found = replay(store, items, check, per_round, keys=keys, carry=("_item",))
    requests, found = (x.drop("seq").withColumnRenamed("_item", "seq") for x in (requests, found))
    answers, errors = answer_gets(found, store.where(F.lit(False)) if known is None else known, kinds, keys)
    return BatchResult(after, requests, answers, errors)
