"""JSON merge patches on flat objects, by map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(target: Column, patch: Column) -> Column:
    """The target object with the patch's values; a null in the patch deletes the key. Keys come out in order; values keep their JSON form."""
    t, p = (F.from_json(c, "map<string,variant>") for c in (target, patch))
    kept = F.map_filter(t, lambda k, v: ~F.map_contains_key(p, k))
    new = F.map_filter(p, lambda k, v: ~F.is_variant_null(v))
    entries = F.map_entries(F.map_concat(kept, new))
    told = F.transform(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}"))


#: What a patch of a rule set may name.
RULESET_FIELDS = ["purpose", "non_goals", "allowed_paths", "protected_paths", "compatibility", "verifier_commands", "risk_ceiling", "budget", "hash"]
BUDGET_FIELDS = ["attempts", "wall_secs", "subprocesses"]


def patch_problem(patch: Column) -> Column:
    """Null for a patch that names only known fields; else `not an object`, or the first unknown field by name, those of the budget as `budget.<field>`. A null
    patch is no object; a budget that is no object is not looked into."""
    keys = F.json_object_keys(patch)
    within = F.array_sort(F.array_except(F.json_object_keys(F.get_json_object(patch, "$.budget")), F.array(*map(F.lit, BUDGET_FIELDS))))
    inner = F.when(F.size(within) > 0, F.struct(F.lit("budget").alias("key"), F.concat(F.lit("budget."), within[0]).alias("field")))
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, RULESET_FIELDS))), lambda k: F.struct(k.alias("key"), k.alias("field")))
    first = F.try_element_at(F.array_sort(F.array_compact(F.concat(unknown, F.array(inner)))), F.lit(1))
    return F.when(keys.isNull(), "not an object").otherwise(first["field"])
