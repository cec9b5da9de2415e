"""Expressions as SQL text.

The page expressions are deep.  Handing Spark one text per column costs one call into the JVM,
where building the same tree from Column objects costs thousands.
"""

from itertools import count

_ids = count()


def q(text: str) -> str:
    """String literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def rx(pattern: str) -> str:
    r"""Regular-expression literal with ``\b`` spelt out over [A-Za-z0-9_]; the JVM's own ``\b``
    also looks at other letters.  A leading ``\b``, tried at every character of a text, gets the
    short form where the rest of the pattern can only start with a word character."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    rest = pattern[len(flags):]
    if rest.startswith(r"\b") and "★" not in rest:
        rest = r"(?<!\w)(?=\w)" + rest[2:]
    return q(flags + rest.replace(r"\b", _EDGE))


def strings(items) -> str:
    return "array(" + ", ".join(q(i) for i in items) + ")"


def listed(items) -> str:
    return "(" + ", ".join(q(i) if isinstance(i, str) else str(i) for i in items) + ")"


def fn(body) -> str:
    """Lambda text; ``body`` gets the name of its variable."""
    v = f"v{next(_ids)}"
    return f"{v} -> {body(v)}"


def let(value: str, body) -> str:
    """Name an intermediate value, so that it is computed once however often it is used."""
    return f"transform(array({value}), {fn(body)})[0]"


def each(items: str, body) -> str:
    return f"transform({items}, {fn(body)})"


def keep(items: str, test) -> str:
    return f"filter({items}, {fn(test)})"


def first(items: str) -> str:
    return f"get({items}, 0)"


def tail(items: str) -> str:
    """All but the first element."""
    return let(items, lambda v: f"slice({v}, 2, size({v}))")


def concat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"
