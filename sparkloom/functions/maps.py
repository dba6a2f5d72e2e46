"""Map functions for maps of text to text."""

from __future__ import annotations

from sparkloom.functions._macro import macro, renamed

FUNCTIONS = {
    "map_extract_value": macro("try_element_at({0}, {1})"),
    "map_get_ci": macro("try_element_at(map_values(map_filter({0}, (k, v) -> lower(k) = lower({1}))), 1)"),
    "element_at": macro("CASE WHEN map_contains_key({0}, {1}) THEN array(try_element_at({0}, {1})) ELSE slice(map_values({0}), 1, 0) END"),
    "map_extract": macro("CASE WHEN map_contains_key({0}, {1}) THEN array(try_element_at({0}, {1})) ELSE slice(map_values({0}), 1, 0) END"),
    "map_keys": renamed("map_keys"),
    "map_values": renamed("map_values"),
    "cardinality": macro("CAST(cardinality({0}) AS BIGINT)"),
}
