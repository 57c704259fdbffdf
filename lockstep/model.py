"""Schemas, wire constants and lookup values of the synchronization model."""

from __future__ import annotations

from pyspark.sql import types as T

# Event names in wire order; the position is the number on the wire.
EVENT_NAMES = [
    "newChecksum",
    "objectAdded",
    "objectDeleted",
    "objectModified",
    "getObject",
    "patchObject",
    "putObject",
    "ping",
    "batch",
]
EVENT_NUMBER = {name: number for number, name in enumerate(EVENT_NAMES)}

# Event property of the message log.
GET_OBJECT = "GetObject"
PATCH_OBJECT = "PatchObject"
VERIFY_OBJECT = "VerifyObject"
DELETE_OBJECT = "DeleteObject"
PUT_OBJECT = "PutObject"
SERVER_CONNECTED = "ServerConnected"
RECONCILIATION_REQUEST = "ReconciliationRequest"
RECONCILIATION_REQUEST_BATCH = "ReconciliationRequestBatch"
CONNECTED_CLIENTS = "ConnectedClients"

# Batch item lists in the order they are processed.
BATCH_LISTS = [
    ("getObject", GET_OBJECT),
    ("newChecksum", VERIFY_OBJECT),
    ("objectDeleted", DELETE_OBJECT),
    ("patchObject", PATCH_OBJECT),
    ("putObject", PUT_OBJECT),
]

# Batch types.
DEFAULT_BATCH = ""
RECONCILIATION_BATCH = "reconciliation"

# Strategies, and the request method each one is posted with.
COPY = "copy"
PATCH = "patch"
METHOD_STRATEGY = {"PUT": PATCH, "POST": COPY}

# Limits and the masking text.
MAX_DEPTH = 8
BATCH_VERSION = "v0.0.57"
DEBOUNCE_SECONDS = 5
MASK = "XXXXXX"

# Kinds that can be owned, and the owner API versions that count.
OWNED_KINDS = ["Pod", "Job", "ReplicaSet"]
OWNER_API_VERSIONS = ["apps/v1", "batch/v1", "batch/v1beta1"]
TEMPLATE_HASH_LABEL = "pod-template-hash"

# The kind whose puts can be muted per account.
MUTABLE_RESOURCE = "runtimealerts"

# Paths dropped from every object, as JSON pointers.
BOOKKEEPING_PATHS = [
    "/metadata/managedFields",
    "/metadata/annotations/kubectl.kubernetes.io~1last-applied-configuration",
]

# Paths set to null per kind. A key that starts with a slash is the
# whole kind of the empty group; any other key is version/resource in any group.
CLEARED_PATHS = {
    "/v1/nodes": ["/status/conditions"],
    "v1beta1/sbomsyfts": ["/spec/syft/descriptor", "/spec/syft/files", "/spec/syft/artifactRelationships"],
    "v1beta1/sbomsyftfiltereds": ["/spec/syft/descriptor", "/spec/syft/files", "/spec/syft/artifactRelationships"],
}

# Where each workload kind keeps its pod spec.
POD_SPEC = {
    "Pod": "/spec",
    "Deployment": "/spec/template/spec",
    "ReplicaSet": "/spec/template/spec",
    "DaemonSet": "/spec/template/spec",
    "StatefulSet": "/spec/template/spec",
    "Job": "/spec/template/spec",
    "CronJob": "/spec/jobTemplate/spec/template/spec",
}
CONTAINER_LISTS = ["containers", "initContainers", "ephemeralContainers"]

KIND = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("resource", T.StringType()),
    ]
)

OBJECT_SCHEMA = "kind string, ns string, name string, version string, doc string"
CHANGE_SCHEMA = "op string, kind string, ns string, name string, version string, doc string, ts timestamp, seq bigint"
LOG_SCHEMA = "key string, properties map<string,string>, payload string, ts timestamp, partition int, offset bigint"
INGEST_SCHEMA = "method string, path string, body string"
KINDS_SCHEMA = "kind string, strategy string"

LEAF = "struct<path:string,value:string>"
LEAVES = f"array<{LEAF}>"

# Field names of the socket messages.
SOCKET_KIND = "Kind struct<Group:string,Version:string,Resource:string>"
SOCKET_HEADER = f"Depth int, Event int, {SOCKET_KIND}, MsgId string"
SOCKET_ITEM = (
    f"{SOCKET_HEADER}, Name string, Namespace string, ResourceVersion bigint, "
    "Checksum string, BaseObject string, Patch string, Object string"
)
SOCKET_LISTS = ["GetObject", "NewChecksum", "ObjectDeleted", "PatchObject", "PutObject"]
SOCKET_BATCH = f"{SOCKET_HEADER}, BatchType string, Items struct<" + (
    ", ".join(f"{name} array<struct<{SOCKET_ITEM}>>" for name in SOCKET_LISTS) + ">"
)

# Field names of the log messages; byte fields travel as base64 text.
LOG_BODY = (
    "account string, cluster string, depth int, kind string, msgId string, name string, "
    "namespace string, resourceVersion bigint, checksum string, baseObject string, patch string"
)
RECONCILIATION_BODY = (
    "account string, cluster string, depth int, msgId string, serverInitiated boolean, "
    "kindToObject map<string,array<struct<checksum:string,resourceVersion:bigint,name:string,namespace:string>>>"
)
