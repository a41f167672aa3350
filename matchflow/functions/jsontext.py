"""Event JSON: types, set pieces, property maps, shot reading. All JVM-side JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, num

EVENTS_SCHEMA = "array<struct<event_type:string,property:map<string,string>>>"

# Words of the shot properties that decide "on target" and keys that may hold xG.
ON_TARGET_WORDS = ("ontarget", "on_target", "on target", "goal", "gol", "save", "saved", "savedshot", "shotontarget")
OFF_TARGET_WORDS = ("offtarget", "off_target", "off target", "blocked", "woodwork", "post", "bar", "outside")
XG_KEYS = ("xg", "xG", "expected_goals", "expected_goal", "expectedGoal", "expectedGoals", "shot_xg", "shotXg")


def parse_events(text) -> Column:
    """JSON text to an array of events; text that is not a JSON list gives NULL."""
    t = F.trim(col(text))
    return F.when(t.startswith("["), F.from_json(t, EVENTS_SCHEMA))


def event_types(events) -> Column:
    """Lower-cased types, in order, missing types left out; an empty array when unreadable."""
    types = F.transform(col(events), lambda e: F.lower(e["event_type"]))
    return F.coalesce(F.filter(types, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def event_property(events, kind: str) -> Column:
    """Property map of the first event of a type; an empty map when absent."""
    hit = F.try_element_at(F.filter(col(events), lambda e: F.lower(e["event_type"]) == kind), F.lit(1))
    return F.coalesce(hit["property"], F.create_map().cast("map<string,string>"))


def setpiece_type(events) -> Column:
    """Type of the first set-piece event that states one."""
    hits = F.filter(col(events), lambda e: (F.lower(e["event_type"]) == "setpiece")
                    & F.try_element_at(e["property"], F.lit("type")).isNotNull())
    return F.lower(F.try_element_at(F.try_element_at(hits, F.lit(1))["property"], F.lit("type")))


def property_text(prop) -> Column:
    """All property values as one lower-case text."""
    return F.lower(F.array_join(F.map_values(col(prop)), " "))


def _contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(words))


def shot_on_target(prop) -> Column:
    text = property_text(prop)
    return F.coalesce(~_contains_any(text, OFF_TARGET_WORDS) & _contains_any(text, ON_TARGET_WORDS), F.lit(False))


def is_goal(prop) -> Column:
    return F.coalesce(property_text(prop).rlike("goal|gol"), F.lit(False))


def shot_xg(prop) -> Column:
    """xG of a property map: the first known key present decides, even when it is not a number;
    without one, the first key that mentions xg or expected and holds a number."""
    p = col(prop)
    out = None
    for key in XG_KEYS:
        hit, value = F.map_contains_key(p, key), num(F.try_element_at(p, F.lit(key)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    loose = F.filter(F.map_entries(p), lambda e: F.lower(e["key"]).rlike("xg|expected")
                     & e["value"].try_cast("double").isNotNull())
    return out.otherwise(num(F.try_element_at(loose, F.lit(1))["value"]))


def id_list(text) -> Column:
    """JSON list or comma text to an array of strings; JSON that is no list gives an empty array."""
    t = F.trim(col(text))
    empty = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(t, ","), lambda v: F.trim(v)), lambda v: v != "")
    listed = F.from_json(t, "array<string>")
    other_json = t.rlike(r'^(\{.*\}|".*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)$')
    return (F.when(t.isNull() | (t == ""), empty).when(t.startswith("[") & listed.isNotNull(), listed)
            .when(other_json, empty).otherwise(parts))


def has_event(types, names) -> Column:
    """Exact membership of any name in an array of types."""
    return F.coalesce(F.exists(col(types), lambda t: F.lower(t).isin(*sorted(names))), F.lit(False))


def has_event_text(text, names) -> Column:
    """Substring test of the same names on plain text."""
    return F.coalesce(F.lower(col(text)).rlike("|".join(sorted(names))), F.lit(False))
