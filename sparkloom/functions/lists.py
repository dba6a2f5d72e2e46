"""List functions; lists are arrays."""

from __future__ import annotations

from sparkloom.functions._macro import literal, macro


def _sort(args: list[str], descending: bool = False) -> str:
    """list_sort(list[, order[, nulls]]): nulls last by default."""
    x = args[0]
    order = literal(args[1]).upper() if len(args) > 1 else "DESC" if descending else "ASC"
    default = "NULLS LAST"
    nulls = literal(args[2]).upper() if len(args) > 2 else default
    if order not in ("ASC", "DESC") or nulls not in ("NULLS FIRST", "NULLS LAST"):
        raise ValueError("the order is ASC or DESC, nulls are NULLS FIRST or NULLS LAST")
    sign = 1 if order == "ASC" else -1
    null = -1 if nulls == "NULLS FIRST" else 1
    rule = (
        f"(a, b) -> CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN {null} WHEN b IS NULL THEN {-null} "
        f"WHEN a < b THEN {-sign} WHEN a > b THEN {sign} ELSE 0 END"
    )
    return f"array_sort({x}, {rule})"


def _aggregate(args: list[str]) -> str:
    """list_aggregate(list, name[, separator])"""
    x, name = f"({args[0]})", literal(args[1]).lower()
    kept = f"filter({x}, e -> e IS NOT NULL)"
    if name == "string_agg":
        sep = args[2] if len(args) > 2 else "','"
        return f"CASE WHEN size({kept}) > 0 THEN array_join({kept}, {sep}) END"
    by = {
        "count": f"CAST(size({kept}) AS BIGINT)",
        "min": f"array_min({kept})",
        "max": f"array_max({kept})",
        "first": f"try_element_at({x}, 1)",
        "last": f"try_element_at({x}, -1)",
        "sum": f"aggregate({kept}, CAST(NULL AS DOUBLE), (s, e) -> coalesce(s, 0.0D) + e)",
    }
    if name not in by:
        raise ValueError(f"unknown aggregate {name}")
    return by[name]


# bounds of a slice: 1-based, inclusive, negative ones from the end
_BEGIN = "CASE WHEN {1} IS NULL THEN 1 WHEN {1} < 0 THEN greatest(size({0}) + {1} + 1, 1) ELSE greatest({1}, 1) END"
_END = "CASE WHEN {2} IS NULL THEN size({0}) WHEN {2} < 0 THEN size({0}) + {2} + 1 ELSE least({2}, size({0})) END"
_SLICE = f"CASE WHEN {{0}} IS NOT NULL THEN slice({{0}}, CAST({_BEGIN} AS INT), CAST(greatest({_END} - {_BEGIN} + 1, 0) AS INT)) END"
_CONTAINS = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN NULL ELSE coalesce(array_contains({0}, {1}), false) END"
_POSITION = (
    "CASE WHEN {0} IS NULL THEN NULL WHEN {1} IS NULL THEN try_element_at(filter(sequence(1, greatest(size({0}), 1)), k -> try_element_at({0}, k) IS NULL AND k <= size({0})), 1) "
    "ELSE CAST(nullif(array_position({0}, {1}), 0) AS INT) END"
)
_DISTINCT = "array_distinct(filter({0}, e -> e IS NOT NULL))"
_HAS_ANY = "arrays_overlap(filter({0}, e -> e IS NOT NULL), filter({1}, e -> e IS NOT NULL))"
_HAS_ALL = "size(array_except(filter({1}, e -> e IS NOT NULL), filter({0}, e -> e IS NOT NULL))) = 0"
_ELEMENT = "try_element_at({0}, nullif(CAST({1} AS INT), 0))"
_SPLIT = "CASE WHEN {1} = '' THEN filter(split({0}, ''), e -> e <> '') ELSE split({0}, concat('\\\\Q', {1}, '\\\\E'), -1) END"


def _named(names: str, expand) -> dict:
    return {n: expand for n in names.split()}


FUNCTIONS = (
    _named("string_split str_split string_to_array", macro(_SPLIT))
    | _named("list_contains list_has array_contains array_has", macro(_CONTAINS))
    | _named("list_has_any array_has_any", macro(_HAS_ANY))
    | _named("list_has_all array_has_all", macro(_HAS_ALL))
    | _named("list_position list_indexof array_position array_indexof", macro(_POSITION))
    | _named("list_extract list_element array_extract", macro(_ELEMENT))
    | _named("list_value list_pack", lambda a: f"array({', '.join(a)})")
    | _named("array_to_string", macro("array_join({0}, coalesce({1}, ','))"))
    | _named("list_aggregate list_aggr array_aggregate array_aggr", _aggregate)
    | _named("list_distinct array_distinct", macro(_DISTINCT))
    | _named("list_unique array_unique", macro(f"CAST(size({_DISTINCT}) AS BIGINT)"))
    | _named("list_sort array_sort", _sort)
    | _named("list_reverse_sort array_reverse_sort", lambda a: _sort(a, True))
    | _named("list_reverse array_reverse", macro("reverse({0})"))
    | _named("list_slice array_slice", macro(_SLICE))
    | _named("list_concat list_cat array_concat array_cat", lambda a: "concat(" + ", ".join(f"coalesce({x}, array())" for x in a) + ")")
)
