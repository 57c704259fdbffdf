"""SQL text of the document functions.

Every function takes SQL expressions and returns one. Text is parsed in a single
step on the JVM, whereas building trees of this size column by column costs
seconds per query. ``documents`` offers the same functions as columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

from lockstep.model import LEAVES, MASK

Body = Callable[[str], str]

# Text that is an integer and nothing else.
INTEGER = r"^[+-]?[0-9]+\z"

# Text that needs no escaping inside a JSON string.
PLAIN = r"^[0-9A-Za-z_ .:/@+-]*\z"

# Objects without arrays and escapes, and one leaf in their text: objects that close, names, a value.
SIMPLE = r'^\{"[^\[\\]*\z'
PIECE = r'\}*,?(?:"[^"/~]*":\{)*"[^"/~]*":(?:"[^"]*"|\{\}|[^"{},]+)'
# Fewer objects than these are unfolded in less time than a text is cut.
DEEP = 6

_names = count()


def fn(body: Body) -> str:
    """A lambda with a fresh variable."""
    v = f"_v{next(_names)}"
    return f"{v} -> {body(v)}"


def let(value: str, body: Body) -> str:
    """Evaluate ``value`` once and use it in ``body``; a plain name is used as it is."""
    if re.fullmatch(r"[\w.]+", value):
        return body(value)
    return f"transform(array({value}), {fn(body)})[0]"


def each(items: str, body: Body) -> str:
    return f"transform({items}, {fn(body)})"


def keep(items: str, test: Body) -> str:
    return f"filter({items}, {fn(test)})"


def some(items: str, test: Body) -> str:
    return f"exists({items}, {fn(test)})"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def integer(value: str) -> str:
    """The integer a text holds, null for anything else."""
    return f"if({value} RLIKE {text(INTEGER)}, try_cast({value} AS BIGINT), NULL)"


def pair(path: str, value: str) -> str:
    return f"named_struct('path', {path}, 'value', {value})"


def members(v: str) -> str:
    """Members of a variant object as map, null for any other variant."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def is_nested(v: str) -> str:
    """Whether a variant is an object with members."""
    return f"coalesce(size({members(v)}), 0) > 0"


def items(v: str) -> str:
    """Items of a variant array, null for any other variant."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def escape(token: str) -> str:
    return f"if({token} RLIKE '[~/]', replace(replace({token}, '~', '~0'), '/', '~1'), {token})"


def unescape(token: str) -> str:
    return f"if(contains({token}, '~'), replace(replace({token}, '~1', '/'), '~0', '~'), {token})"


def quote(token: str) -> str:
    """JSON string literal of a text, null for null."""
    listed = f"to_json(array({token}))"
    return (
        f"CASE WHEN {token} IS NULL THEN NULL WHEN {token} RLIKE {text(PLAIN)} THEN concat('\"', {token}, '\"') "
        f"ELSE substring({listed}, 2, length({listed}) - 2) END"
    )


def tokens(path: str) -> str:
    return f"split({path}, '/', -1)"


def ancestors(path: str) -> str:
    """All pointers from the root down to ``path`` itself."""
    return each(f"sequence(1, size({tokens(path)}))", lambda n: f"substring_index({path}, '/', {n})")


def enclosing(path: str) -> str:
    """All pointers strictly above ``path``."""
    above = each(f"sequence(1, size({tokens(path)}) - 1)", lambda n: f"substring_index({path}, '/', {n})")
    return f"if({path} = '', cast(array() AS array<string>), {above})"


def all_ancestors(paths: str) -> str:
    return f"flatten({each(paths, ancestors)})"


def parent(path: str) -> str:
    """Pointer of the enclosing object."""
    return f"left({path}, length({path}) - length(substring_index({path}, '/', -1)) - 1)"


def under(path: str, top: str) -> str:
    return f"startswith({path}, concat({top}, '/'))"


def at_or_under(path: str, top: str) -> str:
    return f"({path} = {top} OR {under(path, top)})"


def paths_of(leaves: str) -> str:
    return each(leaves, lambda x: f"{x}.path")


def parsed(doc: str) -> str:
    """The document as variant, null for invalid JSON.

    The parser stops after the first value, so the text is read as the first of
    two array items: whatever follows a complete value makes the array unreadable
    or displaces the second item.
    """

    def read(d: str) -> str:
        return let(
            f"try_parse_json(concat('[', {d}, ',', cast(xxhash64({d}) AS STRING), ']'))",
            lambda v: f"if(try_variant_get({v}, '$[1]', 'bigint') = xxhash64({d}),"
            f" try_variant_get({v}, '$[0]', 'variant'), NULL)",
        )

    return let(doc, read)


def is_canonical(d: str) -> str:
    """Whether a text is the canonical text of a whole document; false also for texts of 2,000 characters or more.

    A text that its first value writes in full has nothing after that value. Shorter texts can't
    nest as deep as the parser refuses.
    """
    return f"(length({d}) < 2000 AND coalesce(to_json(try_parse_json({d})) = {d}, false))"


def canonical(doc: str) -> str:
    """Canonical text: members sorted, whitespace gone; null for invalid JSON."""
    return f"to_json({parsed(doc)})"


def checksum(doc: str) -> str:
    """Digest of the canonical text, null for invalid JSON."""
    return f"sha2({canonical(doc)}, 256)"


def leaves(doc: str) -> str:
    """Leaves of a JSON text, however deep it nests; null for invalid JSON.

    The pieces of a canonical text that nests deep are its leaves already, see :func:`pieces`. Any other
    text is unfolded level by level: what is no object with members is done, the rest is opened. The text
    has at least as many opening braces as levels, so that many steps always do, and
    those after the last level cost nothing. The parser itself refuses text that nests
    beyond 1,000 levels; like any other unreadable text it has no leaves.
    """

    def node(path: str, v: str) -> str:
        # a null value marks an object with members
        return let(
            members(v),
            lambda m: f"named_struct('path', {path}, 'value', "
            f"if(coalesce(size({m}), 0) > 0, cast(NULL AS STRING), coalesce(to_json({v}), 'null')), 'm', {m})",
        )

    def level(nodes: str, done: str) -> str:
        opened = keep(nodes, lambda x: f"{x}.value IS NULL")
        closed = each(keep(nodes, lambda x: f"{x}.value IS NOT NULL"), lambda x: pair(f"{x}.path", f"{x}.value"))
        return f"named_struct('open', {opened}, 'done', concat({done}, {closed}))"

    def children(x: str) -> str:
        return each(
            f"map_entries({x}.m)", lambda e: node(f"concat({x}.path, '/', {escape(f'{e}.key')})", f"{e}.value")
        )

    def whole(d: str, v: str) -> str:
        acc, step = f"_v{next(_names)}", f"_v{next(_names)}"
        below = let(f"flatten({each(f'{acc}.open', children)})", lambda n: level(n, f"{acc}.done"))
        root = let(f"array({node(text(''), v)})", lambda n: level(n, f"cast(array() AS {LEAVES})"))
        braces = f"length({d}) - length(replace({d}, '{{', ''))"
        unfolded = (
            f"aggregate(sequence(0, {braces}), {root}, "
            f"({acc}, {step}) -> if(size({acc}.open) = 0, {acc}, {below}), {acc} -> {acc}.done)"
        )
        return f"if({v} IS NULL, NULL, {unfolded})"

    def unfolded(d: str) -> str:
        return let(parsed(d), lambda v: whole(d, v))

    return let(doc, lambda d: let(pieces(d), lambda p: f"if({p} IS NULL, {unfolded(d)}, {of_pieces(p)})"))


def pieces(d: str) -> str:
    """A canonical text of at least ``DEEP`` objects, cut after each leaf.

    Null for any other text, and for one with ``[``, a backslash, or ``~`` or ``/`` in a name.

    Without backslashes every quote begins or ends a text. A piece closes the objects that the leaf
    before it leaves, opens its own, and ends with its value.
    """
    cut = f"regexp_extract_all({d}, {text(PIECE)}, 0)"

    def whole(p: str) -> str:
        joined = f"array_join({p}, '')"
        return let(
            joined,
            lambda j: f"if(startswith({d}, concat('{{', {j})) AND replace(substring({d}, length({j}) + 2), '}}', '') = '', {p}, NULL)",
        )

    # a value that begins with a colon would look like the end of a name
    simple = (
        f"length({d}) - length(replace({d}, '{{', '')) >= {DEEP} AND {d} RLIKE {text(SIMPLE)} AND NOT contains({d}, ':\":')"
    )
    return f"if({simple} AND {is_canonical(d)}, {let(cut, whole)}, NULL)"


def of_pieces(p: str) -> str:
    """The leaves whose :func:`pieces` these are."""
    acc, x = f"_v{next(_names)}", f"_v{next(_names)}"

    def place(m: str) -> str:
        value = f"substring_index({m}, '\":', -1)"

        def leaf(w: str) -> str:
            names = f"substring({m}, 2, length({m}) - length({w}) - 3)"
            # what of the last path stays: without its name, and without one more for each object closed
            closed = f"greatest(length({x}) - length({m}) - 1, 0)"
            above = f"length({acc}.path) - length(replace({acc}.path, '/', '')) - {closed}"
            path = f"concat(substring_index({acc}.path, '/', {above}), '/', replace({names}, '\":{{\"', '/'))"
            return let(
                path, lambda q: f"named_struct('path', {q}, 'done', array_append({acc}.done, {pair(q, w)}))"
            )

        return let(value, leaf)

    start = f"named_struct('path', '', 'done', {'cast(array() AS ' + LEAVES + ')'})"
    kept = let(f"ltrim('}},', {x})", place)
    state = f"struct<path:string,done:{LEAVES}>"
    return f"aggregate({p}, cast({start} AS {state}), ({acc}, {x}) -> cast({kept} AS {state}), {acc} -> {acc}.done)"


def struct_leaves(fields: dict[str, str]) -> str:
    """Leaves of a row with known columns: pointer -> JSON text, null = absent."""
    rows = ", ".join(pair(text(path), value) for path, value in fields.items())
    return keep(f"array({rows})", lambda x: f"{x}.value IS NOT NULL")


def to_json(tree: str) -> str:
    """JSON text of a document in leaf form, members in canonical order.

    Leaves are sorted by path; between two neighbours the containers they do not
    share are closed and opened.
    """

    def piece(before: str, x: str) -> str:
        def write(n: str) -> str:
            # n: how many containers the previous leaf and this one share
            own = f"slice({x}.t, greatest({n}, 1) + 1, size({x}.t))"
            quoted = each(own, lambda t: let(unescape(t), lambda u: f"concat({quote(u)}, ':')"))
            names = (
                f"CASE WHEN size({x}.t) = 1 THEN '' "
                f"WHEN {x}.path RLIKE {text(PLAIN)} THEN concat('\"', array_join({own}, '\":{{\"'), '\":') "
                f"ELSE array_join({quoted}, '{{') END"
            )
            return (
                f"concat(if({before} IS NULL, '', concat(repeat('}}', size({before}.t) - 1 - {n}), ',')), "
                f"if({n} = 0 AND size({x}.t) > 1, '{{', ''), {names}, {x}.value)"
            )

        return let(f"if({before} IS NULL, 0, {shared(f'{before}.t', f'{x}.t')})", write)

    def shared(t: str, u: str) -> str:
        """How many tokens two paths begin with in common, their names aside."""
        i, j = f"_v{next(_names)}", f"_v{next(_names)}"
        differ = f"array_position(zip_with({t}, {u}, ({i}, {j}) -> {i} <=> {j}), false)"
        both = f"least(size({t}), size({u})) - 1"
        return let(f"cast({differ} AS INT)", lambda k: f"if({k} = 0, {both}, least({k} - 1, {both}))")

    def render(s: str) -> str:
        b, x = f"_v{next(_names)}", f"_v{next(_names)}"
        pieces = f"zip_with(array_prepend({s}, NULL), {s}, ({b}, {x}) -> if({x} IS NULL, NULL, {piece(b, x)}))"
        return f"concat(array_join({pieces}, ''), repeat('}}', size(element_at({s}, -1).t) - 1))"

    def whole(tree: str) -> str:
        # k sorts the members of an object next to each other
        rows = each(
            tree,
            lambda x: f"named_struct('k', translate({x}.path, '/', chr(1)), 't', {tokens(f'{x}.path')}, "
            f"'path', {x}.path, 'value', {x}.value)",
        )
        return f"if(size({tree}) > 0, {let(f'array_sort({rows})', render)}, NULL)"

    return let(tree, whole)


def pairs(old: str, new: str) -> str:
    """Both sides per path, matched by hash: array of (path, old, new)."""
    k, o, n = (f"_v{next(_names)}" for _ in range(3))
    zipped = (
        f"map_zip_with(map_from_entries({old}), map_from_entries({new}), "
        f"({k}, {o}, {n}) -> named_struct('old', {o}, 'new', {n}))"
    )
    return each(
        f"map_entries({zipped})",
        lambda e: f"named_struct('path', {e}.key, 'old', {e}.value.old, 'new', {e}.value.new)",
    )


def diff(old: str, new: str) -> str:
    """Merge patch, in leaf form, that turns ``old`` into ``new``.

    A member that is gone is removed at its highest vanished ancestor, so that
    applying the patch leaves no empty shell behind.
    """

    def removals(d: str, gone: str, solid: str) -> str:
        # a vanished path counts when its parent is still there, and is not now a plain value
        alive = f"array_except(array_except({each(gone, parent)}, {gone}), {solid})"
        return let(
            alive,
            lambda a: each(keep(gone, lambda q: f"array_contains({a}, {parent(q)})"), lambda q: pair(q, "'null'")),
        )

    def with_losses(p: str, d: str) -> str:
        still = all_ancestors(paths_of(keep(p, lambda x: f"{x}.new IS NOT NULL")))
        solid = paths_of(keep(f"{d}.changed", lambda x: f"{x}.new <> '{{}}'"))
        return let(
            all_ancestors(f"{d}.lost"),
            lambda was: let(
                f"array_except({was}, {still})",
                lambda gone: "concat("
                + each(
                    # an object that was emptied is left to the removals
                    keep(f"{d}.changed", lambda x: f"{x}.new <> '{{}}' OR NOT array_contains({was}, {x}.path)"),
                    lambda x: pair(f"{x}.path", f"{x}.new"),
                )
                + f", {let(solid, lambda s: removals(d, gone, s))})",
            ),
        )

    def build(p: str) -> str:
        lost = paths_of(keep(p, lambda x: f"{x}.new IS NULL"))
        changed = keep(p, lambda x: f"{x}.new IS NOT NULL AND NOT ({x}.new <=> {x}.old)")
        return let(
            f"named_struct('lost', {lost}, 'changed', {changed})",
            lambda d: f"if(size({d}.lost) = 0, "
            + each(f"{d}.changed", lambda x: pair(f"{x}.path", f"{x}.new"))
            + f", {with_losses(p, d)})",
        )

    return let(pairs(old, new), build)


def shells(tree: str, holders: str) -> str:
    """Empty objects for holders that have no leaf left at or below them."""
    return let(
        f"array_except({holders}, {all_ancestors(paths_of(tree))})",
        lambda e: each(f"array_except({e}, flatten({each(e, enclosing)}))", lambda q: pair(q, "'{}'")),
    )


def patch(base: str, change: str) -> str:
    """``base`` with a merge patch applied; both in leaf form."""

    def removal(x: str) -> str:
        return f"({x}.new = 'null' AND {x}.path <> '')"

    def result(p: str, s: str) -> str:
        # s: patch paths without a leaf in base; only they can replace a subtree or a value above them
        kept = keep(
            p,
            lambda x: f"{x}.new IS NULL AND NOT "
            + some(
                s,
                lambda q: f"({under(f'{x}.path', f'{q}.path')} AND {q}.new <> '{{}}') OR {under(f'{q}.path', f'{x}.path')}",
            ),
        )
        placed = keep(
            p,
            lambda x: f"{x}.new IS NOT NULL AND NOT {removal(x)} AND ({x}.new <> '{{}}' OR {x}.old IS NOT NULL OR NOT "
            + some(p, lambda y: under(f"{y}.path", f"{x}.path"))
            + ")",
        )
        return (
            f"concat({each(kept, lambda x: pair(f'{x}.path', f'{x}.old'))}, "
            f"{each(placed, lambda x: pair(f'{x}.path', f'{x}.new'))})"
        )

    def build(p: str) -> str:
        emptied = each(keep(p, removal), lambda x: parent(f"{x}.path"))
        return let(
            let(keep(p, lambda x: f"{x}.old IS NULL"), lambda s: result(p, s)),
            lambda r: let(emptied, lambda h: f"if(size({h}) = 0, {r}, concat({r}, {shells(r, h)}))"),
        )

    return let(pairs(base, change), build)


def drop_paths(tree: str, paths: str) -> str:
    """Remove what lies at or below ``paths``; an emptied object stays as ``{}``."""

    def hit(x: str) -> str:
        return some(paths, lambda q: at_or_under(f"{x}.path", q))

    def build(d: str) -> str:
        present = keep(paths, lambda q: some(f"{d}.cut", lambda x: at_or_under(f"{x}.path", q)))
        return f"concat({d}.kept, {shells(f'{d}.kept', each(present, parent))})"

    split = f"named_struct('kept', {keep(tree, lambda x: f'NOT {hit(x)}')}, 'cut', {keep(tree, hit)})"
    return let(split, lambda d: f"if(size({d}.cut) = 0, {d}.kept, {build(d)})")


def clear_paths(tree: str, paths: str) -> str:
    """Replace what lies at or below ``paths`` by a null member that stays."""
    present = keep(paths, lambda q: some(tree, lambda x: at_or_under(f"{x}.path", q)))
    rest = keep(tree, lambda x: "NOT " + some(paths, lambda q: at_or_under(f"{x}.path", q)))
    return f"concat({rest}, {each(present, lambda q: pair(q, text('null')))})"


def leaf(tree: str, path: str) -> str:
    """JSON text of one leaf, null when absent."""
    return f"try_element_at({keep(tree, lambda x: f'{x}.path = {text(path)}')}, 1).value"


def with_values(m: str, name: str, value: Body) -> str:
    """A variant object with one member replaced."""
    k, x = f"_v{next(_names)}", f"_v{next(_names)}"
    return f"to_variant_object(transform_values({m}, ({k}, {x}) -> if({k} = {text(name)}, {value(x)}, {x})))"


def mask_containers(value: str) -> str:
    """Mask ``env[].value`` in the JSON text of a container list.

    Entries that are no objects, and ``valueFrom``, stay as they are.
    """
    masked = f"parse_json('\"{MASK}\"')"

    def entry(e: str) -> str:
        return let(
            members(e),
            lambda m: f"if(map_contains_key({m}, 'value'), {with_values(m, 'value', lambda _: masked)}, {e})",
        )

    def container(c: str) -> str:
        def env(x: str) -> str:
            return f"to_variant_object({each(items(x), entry)})"

        return let(
            members(c),
            lambda m: f"if({items(f'try_element_at({m}, {text('env')})')} IS NOT NULL, {with_values(m, 'env', env)}, {c})",
        )

    return f"coalesce(to_json(to_variant_object({each(items(parsed(value)), container)})), {value})"


def merge_metadata(old: str, new: str) -> str:
    """``new`` with the metadata of the stored ``old``; labels and annotations only gain members."""
    return f"coalesce({to_json(merged_metadata(leaves(old), leaves(new)))}, {new})"


def merged_metadata(old: str, new: str) -> str:
    """:func:`merge_metadata` on leaves; null if either side is."""
    maps = ("'/metadata/labels'", "'/metadata/annotations'")

    def settle(t: str) -> str:
        stored = keep(f"{t}.old", lambda x: at_or_under(f"{x}.path", "'/metadata'"))

        def build(s: str) -> str:
            gained = keep(
                f"{t}.new",
                lambda x: "("
                + " OR ".join(at_or_under(f"{x}.path", m) for m in maps)
                + f") AND NOT array_contains({paths_of(s)}, {x}.path)",
            )
            # an empty map gives way to the members it gains
            settled = let(
                f"concat({s}, {gained})",
                lambda b: keep(
                    b, lambda x: f"{x}.value <> '{{}}' OR NOT " + some(b, lambda y: under(f"{y}.path", f"{x}.path"))
                ),
            )
            body = keep(f"{t}.new", lambda x: "NOT " + at_or_under(f"{x}.path", "'/metadata'"))
            return f"concat({body}, {settled})"

        return let(stored, build)

    return let(f"named_struct('old', {old}, 'new', {new})", settle)
