"""Making macros from templates."""

from __future__ import annotations

from collections.abc import Callable


def macro(*templates: str) -> Callable[[list[str]], str]:
    """A macro with one template for each number of arguments: {0}, {1}, ..."""
    by = {max([-1, *(k for k in range(9) if "{%d}" % k in t)]) + 1: t for t in templates}

    def expand(args: list[str]) -> str:
        if len(args) not in by:
            raise ValueError(f"{len(args)} arguments given, {sorted(by)} possible")
        return "(" + by[len(args)].format(*(f"({a})" for a in args)) + ")"

    return expand


def renamed(name: str) -> Callable[[list[str]], str]:
    """A macro that only has another name in Spark."""
    return lambda args: f"{name}({', '.join(args)})"


def literal(arg: str) -> str:
    """The value of a string literal argument."""
    arg = arg.strip()
    while arg.startswith("(") and arg.endswith(")"):
        arg = arg[1:-1].strip()
    if not (len(arg) >= 2 and arg[0] == arg[-1] == "'"):
        raise ValueError(f"a string literal is needed, not {arg}")
    return arg[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def quoted(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
