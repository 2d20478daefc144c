"""The tool catalogue: union, difference, lifecycle, exposure, invocation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_equal
from ..schema import STATES
from .merge import upsert


def catalog(tools: DataFrame, resources: DataFrame, kind: str | None = None, state: str | None = None, risk: str | None = None) -> DataFrame:
    """Tools and resources in one list by name. Resources have no risk: a filter on it drops them all."""
    t = tools.select(F.lit("tool").alias("kind"), "name", "state", "risk", F.col("source_file").alias("source"))
    r = resources.select(F.lit("resource").alias("kind"), "name", "state", F.lit(None).cast("string").alias("risk"), F.col("file_path").alias("source"))
    out = t.unionByName(r)
    for column, value in (("kind", kind), ("state", state), ("risk", risk)):
        if value:
            out = out.filter(F.col(column) == value)
    return out.orderBy("kind", "name")


def catalog_diff(current: DataFrame, discovered: DataFrame) -> DataFrame:
    """(name, mark, reasons): '+' discovered only, '-' current only, '~' changed, with what has changed."""
    c = current.select("name", *(F.col(x).alias(f"c_{x}") for x in ("description", "input_schema", "content_hash")), F.lit(True).alias("old"))
    d = discovered.select("name", "description", "input_schema", "content_hash", F.lit(True).alias("new"))
    j = c.join(d, "name", "full_outer")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("c_description").eqNullSafe(F.col("description")), "description"),
            F.when(~json_equal(F.col("c_input_schema"), F.col("input_schema")), "schema"),
            F.when(~F.col("c_content_hash").eqNullSafe(F.col("content_hash")), "content hash"),
        )
    )
    mark = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(F.size(reasons) > 0, "~")
    return j.select("name", mark.alias("mark"), F.when(mark == "~", F.array_join(reasons, ", ")).otherwise("").alias("reasons")).filter("mark IS NOT NULL").orderBy("name")


def unique_names(discovered: DataFrame, order: list[str]) -> DataFrame:
    """The second tool of a name becomes name_2, the third name_3, in scan order."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return discovered.withColumn("n", n).withColumn("name", F.when(F.col("n") > 1, F.concat_ws("_", "name", "n")).otherwise(F.col("name"))).drop("n")


def transition_error(old: Column, new: Column) -> Column:
    """Null where a state may change so: between any two of the four states, not to itself."""
    return F.when(~new.isin(*STATES), F.concat(F.lit("unknown state "), new)).when(old == new, F.concat(F.lit("already "), new)).when(~old.isin(*STATES), F.concat(F.lit("unknown state "), old))


def update_states(tools: DataFrame, changes: DataFrame) -> DataFrame:
    """All tools, with the state of ``changes`` (name, new_state) where it is allowed, and the error where it is not."""
    j = tools.join(changes, "name", "left")
    error = F.when(F.col("new_state").isNotNull(), transition_error(F.col("state"), F.col("new_state")))
    return j.select(*(c for c in tools.columns if c != "state"), F.when(F.col("new_state").isNotNull() & error.isNull(), F.col("new_state")).otherwise(F.col("state")).alias("state"), error.alias("error"))


def review(tools: DataFrame, approve: list[str] = (), disable: list[str] = (), confirm: list[str] = (), resources: list[str] = ()) -> DataFrame:
    """Batches of decisions. A name in two batches is a conflict; resources can't require confirmation."""
    seen: dict[str, str] = {}
    for state, names in (("enabled", approve), ("disabled", disable), ("requires_confirmation", confirm)):
        for n in names:
            if n in seen:
                raise ValueError(f"conflict: {n} is in two batches")
            if state == "requires_confirmation" and n in resources:
                raise ValueError(f"resource {n} can't require confirmation")
            seen[n] = state
    return update_states(tools, tools.sparkSession.createDataFrame(list(seen.items()), "name string, new_state string"))


def upsert_tools(current: DataFrame, discovered: DataFrame) -> DataFrame:
    """A new scan keeps state, dependency state and the content hash that was approved."""
    return upsert(current, discovered, ["name"], keep=["state", "dep_state", "content_hash"])


def upsert_resources(current: DataFrame, discovered: DataFrame) -> DataFrame:
    return upsert(current, discovered, ["name"], keep=["state"])


def initialise(discovered: DataFrame, overrides: DataFrame) -> DataFrame:
    """Discovered tools with state and risk from the configuration; a schema that is no JSON becomes {}."""
    o = overrides.select("name", F.col("state").alias("o_state"), F.col("risk").alias("o_risk"))
    schema = F.when(F.try_parse_json("input_schema").isNull(), "{}").otherwise(F.col("input_schema"))
    return discovered.join(o, "name", "left").withColumns({"state": F.coalesce("o_state", "state", F.lit("pending")), "risk": F.coalesce("o_risk", "risk"), "input_schema": schema}).select(*discovered.columns)


def exposed(tools: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Tools that are enabled or require confirmation, and, with a profile, are named in it."""
    out = tools.filter(F.col("state").isin("enabled", "requires_confirmation"))
    return out.join(profile.select("name").distinct(), "name", "left_semi") if profile is not None else out


def profile_names(profiles: dict[str, list[str]], name: str) -> list[str]:
    if name not in profiles:
        raise KeyError(f"unknown profile {name}")
    return profiles[name]


def agent_card(tools: DataFrame, name: str, version: str) -> DataFrame:
    """One JSON text of the exposed tools; the list is never null."""
    entry = F.struct("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("input_schema", F.lit("{}")).alias("input_schema"))
    return exposed(tools).agg(F.sort_array(F.collect_list(entry)).alias("tools")).select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), "tools")).alias("card"))


def state_counts(tools: DataFrame) -> DataFrame:
    """Counts by state and by dependency state in one pass."""
    return tools.groupingSets([[F.col("state")], [F.col("dep_state")]], "state", "dep_state").agg(F.count("*").alias("n"))


def gauges(tools: DataFrame) -> DataFrame:
    """(gauge, value): all tools and enabled ones, in one pass."""
    row = tools.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "enabled").alias("enabled"))
    return row.select(F.stack(F.lit(2), F.lit("tools_total"), F.col("total"), F.lit("tools_enabled"), F.col("enabled")).alias("gauge", "value"))


def invocation(tools: DataFrame, current_hash: Column) -> DataFrame:
    """What a call would meet: first rule that applies."""
    rule = (
        F.when(F.col("state") == "disabled", "deny: disabled")
        .when(F.col("state") == "pending", "deny: pending")
        .when(F.col("dep_state").isin("resolving", "failed"), F.concat(F.lit("error: dependencies "), F.col("dep_state")))
        .when(F.col("content_hash").isNotNull() & (F.col("content_hash") != current_hash), "deny: content changed")
        .when(F.col("state") == "requires_confirmation", "confirm")
        .otherwise("run")
    )
    return tools.select("name", rule.alias("decision")).orderBy("name")
