"""The library's operators chained into the flows a deployment runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.functions.identity import derived_id, lineage
from lockstep.model import DELETE_OBJECT, GET_OBJECT, PATCH, PATCH_OBJECT, PUT_OBJECT, VERIFY_OBJECT
from lockstep.operators import guards, scope
from lockstep.operators.batches import unpack_reconciliation
from lockstep.operators.changes import change_ops, debounce
from lockstep.operators.clients import route_to_connected
from lockstep.operators.messages import decode_log_messages, envelope
from lockstep.operators.paths import CLIENT, KEYS, clean_objects, mask_env, object_keys, store_keys
from lockstep.operators.reconcile import DELETE, PUT, VERIFY, reconcile, reconciled, with_documents
from lockstep.operators.store import answer_gets, apply_changes, apply_patches, replay, serve_gets, verify
from lockstep.sources.tables import usable_changes, with_properties


@dataclass(frozen=True)
class Settings:
    """What a deployment configures."""

    own_key: str
    operator_ns: str = ""
    include: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    muted_accounts: Sequence[str] = field(default_factory=tuple)
    max_bytes: int | str | None = None


def cluster_to_backend(
    changes: DataFrame, kinds: DataFrame, account: str | None, cluster: str | None, s: Settings
) -> DataFrame:
    """Watch stream to message log: debounce, scope, clean, mask, classify, guard, wrap.

    ``account`` and ``cluster`` say whose changes these are. With None they are columns
    of ``changes``, and the objects of each client are kept apart.
    """
    if account is not None and cluster is not None:
        changes = changes.withColumns({"account": F.lit(account), "cluster": F.lit(cluster)})
    keys = [*CLIENT, *KEYS]
    usable, _ = usable_changes(changes)
    wanted, _ = scope.configured_kinds(usable, kinds)
    kept = debounce(wanted, keys).drop("n_events")
    kept = scope.in_scope(scope.with_object_fields(kept), s.operator_ns, s.include, s.exclude)
    kept = kept.drop("object_kind", "owners", "labels")
    cleaned = mask_env(clean_objects(kept))
    messages = change_ops(cleaned, kinds, keys).withColumns(
        {
            "depth": F.lit(None).cast("int"),
            "msg_id": F.lit(None).cast("string"),
        }
    )
    guarded = guards.size_guard(guards.mute_accounts(messages, s.muted_accounts), s.max_bytes, payload="object")
    new_id = derived_id(*[F.col(c) for c in ("account", "cluster", *KEYS, "event", "ts", "seq")])
    return envelope(lineage(guarded, new_id=new_id), s.own_key)


def ingest_to_log(
    requests: DataFrame, routes: Sequence[tuple[str, str, str, str]], s: Settings, annotation: str
) -> tuple[DataFrame, DataFrame]:
    """Posted objects to message log, and the requests that are refused, with their status.

    ``requests`` has method, path, body, account, cluster and ts. A body that is accepted
    is sent as put or patch, as its route says, with the checksum that the object carries
    under the metadata annotation of that name, empty without one.
    """
    checked = guards.validate_ingest(requests, routes)
    accepted = checked.where(F.col("status") == 202)
    is_patch = F.col("strategy") == PATCH
    carried = F.get_json_object("body", f"$.metadata.annotations['{annotation}']")
    messages = accepted.select(
        "account",
        "cluster",
        "ts",
        F.concat_ws("/", "identity.group", "identity.version", "identity.resource").alias("kind"),
        "identity.ns",
        "identity.name",
        F.when(is_patch, PATCH_OBJECT).otherwise(PUT_OBJECT).alias("event"),
        F.coalesce(carried, F.lit("")).alias("checksum"),
        F.when(is_patch, F.col("body")).alias("patch"),
        F.when(~is_patch, F.col("body")).alias("object"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("msg_id"),
    )
    new_id = derived_id(*[F.col(c) for c in ("account", "cluster", *KEYS, "event", "ts", "checksum", "object", "patch")])
    return envelope(lineage(messages, new_id=new_id), s.own_key), checked.where(F.col("status") != 202)


@dataclass
class Applied:
    """Result of applying messages to a store."""

    store: DataFrame
    requests: DataFrame
    answers: DataFrame
    errors: DataFrame
    rejected: DataFrame


def backend_to_store(
    log: DataFrame,
    clients: DataFrame,
    kinds: DataFrame,
    store: DataFrame,
    s: Settings,
    check: bool = False,
    keep_metadata: bool = True,
    known: DataFrame | None = None,
) -> Applied:
    """Message log to store: drop own, route, decode, guard, replay in order; answer gets, ask where sides disagree.

    Messages are taken in the order of time, partition and offset; of those that share
    all three the order is that of their content. A store with account and cluster is
    kept apart by client. By default puts overwrite and keep the metadata of the stored
    object, as in a cluster; ``check`` stores only newer versions, as a backend does.
    """
    routed = route_to_connected(guards.drop_own_messages(with_properties(log), s.own_key), clients)
    usable, rejected = guards.quarantine(decode_log_messages(routed))
    wanted, _ = scope.configured_kinds(guards.depth_guard(usable), kinds)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    places = [F.col(c).cast("bigint").alias(c) for c in ("partition", "offset") if c in wanted.columns]
    messages = wanted.withColumn("seq", F.struct(micros.alias("at"), *places))
    keys = object_keys(store)
    carry = [c for c in ("account", "cluster", "depth", "msg_id") if c not in keys]
    after, gets, found = replay(
        store, messages, check, kinds=kinds, keep_metadata=keep_metadata, keys=keys, carry=carry
    )
    answers, errors = answer_gets(found, store.where(F.lit(False)) if known is None else known, kinds, keys)
    requests = gets.withColumn("event", F.lit(GET_OBJECT))
    return Applied(after, lineage(requests), lineage(answers), errors, rejected)


def reconcile_request(
    requests: DataFrame, source: DataFrame, s: Settings, in_scope: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reconciliation requests to the messages that answer them, and the kinds that cannot be read.

    A request lists, by kind, what the other side holds of a client. ``source`` has account
    and cluster beside the object columns. Only the kinds that a request lists objects of
    are compared; objects that only the source has are verified, changed versions are put,
    and what the source lacks is deleted. Messages keep the request's id, one level deeper, and its
    time, ``ts``, so that a repeated run gives the same rows.
    """
    listed, rejected = unpack_reconciliation(requests)
    listed = listed.drop("event", "batch_type", "checksum")
    request = [*CLIENT, "kind", "msg_id"]
    asked = listed.groupBy(*request).agg(F.max("depth").alias("depth"), *[F.max("ts").alias("ts")] * ("ts" in listed.columns))
    listed = listed.drop("ts")
    mine = source.select(*CLIENT, *KEYS, "version", "doc").join(asked.select(*request), [*CLIENT, "kind"])
    keys = [*CLIENT, "msg_id", *KEYS]
    plan = with_documents(reconcile(mine, listed, in_scope, allow_empty=True, keys=keys), mine, keys)
    event = (
        F.when(F.col("op") == DELETE, DELETE_OBJECT).when(F.col("op") == VERIFY, VERIFY_OBJECT).otherwise(PUT_OBJECT)
    )
    messages = plan.join(asked, request).withColumns(
        {
            "event": event,
            "checksum": docs.checksum("doc"),
            "object": F.when(F.col("op") == PUT, F.col("doc")),
            "version": F.coalesce("source_version", "target_version"),
            "ts": F.col("ts") if "ts" in asked.columns else F.lit(None).cast("timestamp"),
        }
    )
    return envelope(lineage(messages), s.own_key), rejected


def sync_round(source: DataFrame, target: DataFrame, in_scope: Column | None = None) -> DataFrame:
    """The target after one reconciliation exchange; it then equals the in-scope source."""
    return reconciled(source, target, in_scope)


def verify_round(source: DataFrame, target: DataFrame, kinds: DataFrame) -> DataFrame:
    """The target after a verify, get, put-or-patch exchange driven by checksums.

    Every source object is verified; the target asks for those that differ, with
    its own copy as base, and is answered with a put or a patch against that copy.
    """
    keys = store_keys(target, source)
    asked = verify(source.select(*keys, docs.checksum("doc").alias("checksum")), target)
    nothing_known = target.where(F.lit(False))
    answers, _ = serve_gets(asked.select(*keys, "base_object"), source, nothing_known, kinds)
    # puts find no patch to try and bring their document along
    tried = apply_patches(answers, target, kinds)
    changes = tried.withColumn("doc", F.coalesce("doc", "object")).where(F.col("doc").isNotNull())
    changes = changes.select(*keys, "version", "doc", F.lit("put").alias("op"), F.lit(0).alias("seq"))
    return apply_changes(target, changes)
