"""Plain-Python models that the operators are compared with."""

import json


def merge_patch(target, patch):
    """RFC 7386."""
    if not isinstance(patch, dict):
        return patch
    result = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            result.pop(key, None)
        else:
            result[key] = merge_patch(result.get(key), value)
    return result


def without_nulls(value):
    if not isinstance(value, dict):
        return value
    return {k: without_nulls(v) for k, v in value.items() if v is not None}


def random_json(rng, depth):
    if depth > 0 and rng.random() < 0.45:
        names = ["a", "b", "c", "d/e", "f~g", 'é"', "~1"]
        return {rng.choice(names): random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([None, 1, -2.5, "x", "y", True, [1, {"q": None}], [], {}, "{}", "null", "a\nb"])


def compact(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
