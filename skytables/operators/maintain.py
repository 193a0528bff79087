"""Batch maintenance. Every function takes a table and a DataFrame of changes and
returns the new table with what could not be applied; nothing is overwritten in place.

The big table is shuffled only if the changes are too many to broadcast.
Ids are repeatable: the SHA-256 of a row's natural key (fixed source: catalog,
name, RA, Dec; point: object, time) and its number among the rows of the batch with
that key, so that the same batch inserted twice gives the same ids. Of every batch,
rows in = added + already there with equal values + rejected.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import wrap_ra
from ..functions.values import double_key, row_key
from ..schema import FIXED_SOURCES, MOVING_SOURCES, SERVICES, SOLARSYSTEM_OBJECTS, conform, folded, names
from .lookups import raise_if_any
from .numbering import number_occurrences
from .skew import broadcast_if_small, dimension_join, is_small, restrict, saved


class Change(NamedTuple):
    table: DataFrame
    missing: DataFrame
    rejected: DataFrame


class Insert(NamedTuple):
    table: DataFrame
    added: DataFrame
    rejected: DataFrame


# --- insert --------------------------------------------------------------------------------

def _split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def position_fault(required: bool = True, columns: tuple[str, ...] = ("ra_deg", "dec_deg")) -> Column:
    """Why a position is not acceptable, else null. `columns` are those that are there."""
    outside, none = F.lit(False), F.lit(False)
    for c in columns:
        value = F.col(c)
        none = none | value.isNull()
        outside = outside | F.isnan(c) | (F.abs(value) == float("inf"))
        if c == "dec_deg":
            outside = outside | (F.abs(value) > 90.0)
    fault = F.when(outside, F.lit("position out of range"))
    return F.coalesce(F.when(none, F.lit("missing position")), fault) if required else fault


def _with_default(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = {c.lower() for c in rows.columns}
    for name, kind in columns.items():
        if name.lower() not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def _by_json(df: DataFrame, schema) -> DataFrame:
    """Maps as JSON text, which unlike maps can be grouped and compared."""
    for f in schema.fields:
        if f.dataType.typeName() == "map":
            df = df.withColumn(f.name, F.to_json(f.name))
    return df


def _from_json(df: DataFrame, schema, *more: str) -> DataFrame:
    for f in schema.fields:
        if f.dataType.typeName() == "map":
            df = df.withColumn(f.name, F.from_json(f.name, "map<string,string>"))
    return df.select(*names(schema), *more)


def _identify(rows: DataFrame, schema, kind: str, natural: list[str], tag: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows in `schema` with an id, its first column, where the caller gave none; rejected).

    Equal rows with one given id count once; different rows with one given id are
    rejected. Ids are made where the rows are: only rows whose `natural` key occurs
    again, found by counting a hash of it, are shuffled to be numbered.
    """
    key, *values = names(schema)
    own = key in rows.columns
    rows = _by_json(conform(_with_default(rows, {key: "string"}), schema), schema)
    doubles = {f.name for f in schema.fields if f.dataType.typeName() == "double"}
    fresh = rows.where(F.col(key).isNull()).drop(key).withColumn("_natural", F.xxhash64(*natural))
    again = fresh.groupBy("_natural").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_natural", F.lit(True).alias("_again"))
    marked = fresh.join(broadcast_if_small(again), "_natural", "left").drop("_natural")
    once = marked.where(F.col("_again").isNull()).select(*values, F.lit(1).cast("bigint").alias("_copy"))
    fresh = once.unionByName(number_occurrences(marked.where("_again").select(*values), natural, "_copy"))
    parts = [double_key(F.col(v)) if v in doubles else F.col(v) for v in natural]
    fresh = _from_json(fresh.withColumn(key, row_key(kind, F.lit(tag), *parts, F.col("_copy"))), schema)
    if not own:
        return fresh, fresh.limit(0).withColumn("reason", F.lit("duplicate key"))
    given = rows.where(F.col(key).isNotNull()).distinct()
    repeated = given.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    marked = dimension_join(given, repeated, [key], "left")
    clash = _from_json(marked.where(F.col("_n").isNotNull()), schema).withColumn("reason", F.lit("duplicate key"))
    return _from_json(marked.where(F.col("_n").isNull()), schema).unionByName(fresh), clash


def _with_clashes(rejected: DataFrame, clash: DataFrame) -> DataFrame:
    """Both lists of rejected rows; columns that only one of them has are null in the other."""
    return rejected.unionByName(clash, allowMissingColumns=True)


def _append(table: DataFrame, rows: DataFrame, new: DataFrame, schema, rejected: DataFrame) -> Insert:
    """Appends the rows whose id is not there yet. Of the others, those with equal values are there already; the rest are rejected.

    If the incoming `rows` are few, the table is only scanned for their ids, not shuffled.
    """
    key, *values = names(schema)
    table = conform(table, schema)
    there = restrict(_by_json(table, schema), new, [key], small=is_small(rows)).dropDuplicates([key])
    there = there.select(key, F.struct(*values).alias("_there"))
    marked = _by_json(new, schema).join(there, key, "left")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col("_there")[v])
    added = _from_json(marked.where(F.col("_there").isNull()), schema)
    clash = marked.where(F.col("_there").isNotNull() & ~same).withColumn("reason", F.lit("duplicate key"))
    return Insert(table.unionByName(added), added, _with_clashes(rejected, _from_json(clash, schema, "reason")))


def fixed_rows(rows: DataFrame, catalog: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows in the fixed-source schema with defaults and ids, rejected)."""
    rows = folded(rows, *names(FIXED_SOURCES))
    usable, rejected = _split(rows, position_fault())
    usable = usable.withColumn("ra_deg", wrap_ra(F.col("ra_deg")))
    if "name" not in rows.columns:
        usable = usable.withColumn("name", F.lit(None).cast("string"))
    named, clash = _identify(usable, FIXED_SOURCES, "fixed", ["name", "ra_deg", "dec_deg"], catalog)
    return named, _with_clashes(rejected, clash) if "source_id" in rows.columns else rejected


def insert_fixed(table: DataFrame, rows: DataFrame, catalog: str = "") -> Insert:
    """Adds fixed sources; a position is required, name and flux are optional, flags default to false."""
    new, rejected = fixed_rows(rows, catalog)
    return _append(table, rows, new, FIXED_SOURCES, rejected)


def sso_id_of(name: Column) -> Column:
    return row_key("sso", name)


def insert_sso(table: DataFrame, rows: DataFrame) -> Insert:
    """Adds solar-system objects. Id, name and MPC id are unique, also against the table.

    Equal rows count once, and rows equal to one of the table are there already.
    Rows that contradict each other over an id, a name or an MPC id are all rejected,
    since a batch has no first one.
    """
    schema = names(SOLARSYSTEM_OBJECTS)
    rows = _with_default(folded(rows, *schema), {"sso_id": "string", "name": "string", "MPC_id": "bigint"})
    rows = conform(rows, SOLARSYSTEM_OBJECTS)
    usable, unnamed = _split(rows, F.when(F.col("name").isNull(), F.lit("missing name")))
    usable = usable.withColumn("sso_id", F.coalesce("sso_id", sso_id_of(F.col("name")))).distinct()
    table = conform(table, SOLARSYSTEM_OBJECTS)
    marked = usable
    for column in ("sso_id", "name", "MPC_id"):
        batch = usable.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(f"_{column}_rows"))
        owner = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*schema)).alias(f"_{column}_owner"))
        # Nulls match nothing: without them they do not meet in one task.
        known = marked.where(F.col(column).isNotNull()).join(batch, column, "left").join(owner, column, "left")
        marked = known.unionByName(marked.where(F.col(column).isNull()), allowMissingColumns=True)

    def clash(column: str) -> Column:
        return (F.col(f"_{column}_rows") > 1) | F.col(f"_{column}_owner").isNotNull()

    reason = F.lit(None).cast("string")
    for column in ("sso_id", "MPC_id", "name"):
        reason = F.when(clash(column), F.lit(f"{column} not unique")).otherwise(reason)
    same = F.lit(True)
    for column in schema:
        same = same & F.col("_sso_id_owner")[column].eqNullSafe(F.col(column))
    there = F.col("_sso_id_owner").isNotNull() & same
    fresh, rejected = _split(marked.where(~there), reason)
    added = fresh.select(*schema)
    return Insert(table.unionByName(added), added, unnamed.unionByName(rejected.select(*unnamed.columns)))


def insert_ephem(table: DataFrame, ssos: DataFrame, rows: DataFrame) -> Insert:
    """Adds ephemeris points of known objects; id, MPC id and name must be those of the object.

    Missing MPC id or name is filled in from the object.
    """
    rows = folded(rows, *names(MOVING_SOURCES))
    rows = _with_default(rows, {"ephem_id": "string", "MPC_id": "bigint", "name": "string", "flux_mJy": "double"})
    owner = ssos.select(F.col("sso_id").cast("string").alias("sso_id"), F.col("MPC_id").alias("_mpc"),
                        F.col("name").alias("_name"))
    rows = rows.withColumn("sso_id", F.col("sso_id").cast("string"))
    owned = dimension_join(rows, owner, ["sso_id"], "left")
    reason = F.coalesce(
        position_fault(),
        F.when(F.col("time").isNull(), F.lit("missing time")),
        F.when(F.col("_name").isNull(), F.lit("unknown sso_id")),
        F.when(F.coalesce(F.col("name") != F.col("_name"), F.lit(False))
               | F.coalesce(F.col("MPC_id") != F.col("_mpc"), F.col("MPC_id").isNotNull()),
               F.lit("name or MPC_id of another object")))
    usable, rejected = _split(owned, reason)
    usable = (
        usable.withColumn("name", F.col("_name")).withColumn("MPC_id", F.col("_mpc"))
        .withColumn("ra_deg", wrap_ra(F.col("ra_deg")))
    )
    new, clash = _identify(usable, MOVING_SOURCES, "ephem", ["sso_id", "time"])
    return _append(table, rows, new, MOVING_SOURCES, _with_clashes(rejected.drop("_mpc", "_name"), clash))


def ephem_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in the ephemeris schema with ids, rejected) for objects known to exist."""
    rows = folded(rows, *names(MOVING_SOURCES))
    fault = F.coalesce(position_fault(), F.when(F.col("time").isNull(), F.lit("missing time")))
    usable, rejected = _split(rows, fault)
    return _identify(usable, MOVING_SOURCES, "ephem", ["sso_id", "time"])[0], rejected


def insert_service(table: DataFrame, rows: DataFrame) -> Insert:
    """Adds providers; names may repeat."""
    rows = folded(rows, *names(SERVICES))
    none = F.col("name").isNull() | F.col("config").isNull()
    usable, rejected = _split(rows, F.when(none, F.lit("missing name or config")))
    new, clash = _identify(usable, SERVICES, "service", ["name", "config"])
    return _append(table, rows, new, SERVICES, _with_clashes(rejected, clash))


# --- update --------------------------------------------------------------------------------

def partial_update(
    table: DataFrame, updates: DataFrame, key: str, columns: list[str], order: str | None = None,
    strict: bool = False, unique: tuple[str, ...] = (), parents: dict[str, DataFrame] | None = None,
) -> Change:
    """Sets the non-null `columns` of `updates`; null leaves a value alone.

    Rejected: no key, nothing set, a position out of range, (without `order`)
    several updates of one key, (with it) no order. With `order`, later updates win
    column by column, of equally late ones the greater value. Each column's last value
    is a partial aggregate. All updates of a key are rejected if its new value of a
    `unique` column would be another row's too once all are applied, or if that of a
    column in `parents` is not among that table's values.
    """
    updates = folded(updates, key, *columns, *([order] if order else []))
    present = [c for c in columns if c in updates.columns]
    nothing = F.lit(True)
    for c in present:
        nothing = nothing & F.col(c).isNull()
    reason = F.when(F.col(key).isNull(), F.lit("missing key")).when(nothing, F.lit("nothing to update"))
    placed = tuple(c for c in ("ra_deg", "dec_deg") if c in present)
    if placed:
        fault = position_fault(False, placed)
        reason = reason.when(fault.isNotNull(), fault)
    if order is not None:
        reason = reason.when(F.col(order).isNull(), F.lit("missing order"))
    usable, rejected = _split(updates, reason)
    if "ra_deg" in present:
        usable = usable.withColumn("ra_deg", wrap_ra(F.col("ra_deg")))
    if order is None:
        repeated = usable.groupBy(key).count().where("count > 1").select(key).withColumn("_many", F.lit(True))
        marked = usable.join(broadcast_if_small(repeated), key, "left")
        again = marked.where(F.col("_many")).drop("_many").withColumn("reason", F.lit("several updates, no order"))
        rejected = rejected.unionByName(again.select(*rejected.columns))
        latest = marked.where(F.col("_many").isNull()).select(key, *present)
    else:
        def rank(c: str) -> Column:
            value = F.to_json(c) if updates.schema[c].dataType.typeName() == "map" else F.col(c)
            return F.when(F.col(c).isNotNull(), F.struct(F.col(order), value))

        latest = usable.groupBy(key).agg(*[F.max_by(c, rank(c)).alias(c) for c in present])
    small = is_small(updates)
    refused = _refused(table, latest, key, [c for c in unique if c in present], {c: p for c, p in (parents or {}).items() if c in present})
    if refused is not None:
        bad = usable.join(refused, key)
        rejected = rejected.unionByName(bad.select(*rejected.columns))
        latest = latest.join(refused, key, "left_anti")
    fields = latest.select(F.col(key), *[F.col(c).alias(f"_new_{c.lower()}") for c in present])
    joined = dimension_join(table, fields, [key], "left", small)
    changed = {c.lower() for c in present}
    new = joined.select(*[
        F.coalesce(F.col(f"_new_{c.lower()}"), F.col(c)).alias(c) if c.lower() in changed else F.col(c)
        for c in table.columns])
    ids = restrict(table.select(key), latest, [key], small).distinct()
    missing = latest.select(key).join(ids, key, "left_anti")
    if strict:
        raise_if_any(rejected, "rejected update")
        raise_if_any(missing, f"unknown {key}")
    return Change(new, missing, rejected)


def _refused(table: DataFrame, latest: DataFrame, key: str, unique: list[str], parents: dict[str, DataFrame]) -> DataFrame | None:
    """(key, reason) of updates that would leave a `unique` value with two owners, or name a value that its parent table lacks.

    Judged as of the end of the statement: a value is free if the row that has it gives it up
    by an update that is itself not refused, so two rows may swap names. Old and new owners
    of a value meet in one aggregate, which counts them and keeps one; no pairs are made.
    """
    if not unique and not parents:
        return None
    state = latest.select(key)
    edges = []
    for c in unique:
        state = state.join(_claims(table, latest, key, c).withColumnsRenamed({"reason": f"_why_{c}", "after": f"_after_{c}"}), key, "left")
        edges.append(f"_after_{c}")
    for c, parent in parents.items():
        strange = latest.where(F.col(c).isNotNull()).select(key, c).join(parent.select(c), c, "left_anti")
        state = state.join(strange.select(key, F.lit(f"unknown {c}").alias(f"_why_{c}")), key, "left")
    reasons = [F.col(f"_why_{c}") for c in [*unique, *parents]]
    state = saved(state.select(key, F.least(*reasons, F.lit(None)).alias("reason"), *edges), "update-verdicts")
    bad, n_bad = state.where("reason is not null").select(key, "reason"), -1
    waits = [c for c in unique if state.where(F.col(f"_after_{c}").isNotNull()).take(1)]
    while waits and bad.count() != n_bad:  # with one such column a single pass is enough
        n_bad = bad.count()
        for c in waits:
            bad = _follow(state.select(key, F.col(f"_after_{c}").alias("after")), bad, key, f"{c} not unique")
        if len(waits) == 1:
            break
    return bad


def _claims(table: DataFrame, latest: DataFrame, key: str, c: str) -> DataFrame:
    """(key, reason, after) per update that sets `c`: why it cannot be, or which other row must give up the value first."""
    values = latest.where(F.col(c).isNotNull()).select(key, c)
    owned = restrict(table.where(F.col(c).isNotNull()), values, [c]).select(c, F.col(key).alias("_old"), F.lit(None).cast("boolean").alias("_new"))
    tagged = owned.unionByName(values.select(c, F.lit(None).cast(table.schema[key].dataType).alias("_old"), F.lit(True).alias("_new")))
    per_value = tagged.groupBy(c).agg(
        F.count("_new").alias("n_new"), F.count("_old").alias("n_old"), F.min("_old").alias("least"), F.max("_old").alias("most")).where("n_new > 0")
    judged = values.join(per_value, c).withColumn("owner", F.when(F.col("least") != F.col(key), F.col("least")).when(F.col("most") != F.col(key), F.col("most")))
    movers = values.select(F.col(key).alias("owner"), F.lit(True).alias("_moves"))
    judged = judged.join(movers, "owner", "left")
    stays = F.col("owner").isNotNull() & (F.col("_moves").isNull() | (F.col("n_old") > 1))
    clash = (F.col("n_new") > 1) | stays
    return judged.select(key, F.when(clash, F.lit(f"{c} not unique")).alias("reason"), F.when(~clash, F.col("owner")).alias("after"))


def _follow(waits: DataFrame, bad: DataFrame, key: str, reason: str) -> DataFrame:
    """`bad` with all updates that wait, over any number of others, for one in it. Each round looks twice as far."""
    state = saved(waits.join(bad, key, "left"), "update-waits")
    n = state.where("reason is not null").count()
    while True:
        hop = state.select(F.col(key).alias("after"), F.col("reason").alias("_why"), F.col("after").alias("_then"))
        state = saved(state.join(hop, "after", "left").select(
            key, F.col("_then").alias("after"), F.coalesce("reason", F.when(F.col("_why").isNotNull(), F.lit(reason))).alias("reason")), "update-waits")
        more = state.where("reason is not null").count()
        if more == n:
            return state.where("reason is not null").select(key, "reason")
        n = more


def update_source(table, updates, order=None, strict=False) -> Change:
    columns = ["ra_deg", "dec_deg", "flux_mJy", "name", "monitored", "pointing"]
    return partial_update(table, updates, "source_id", columns, order, strict)


def update_sso(table, updates, order=None, strict=False) -> Change:
    return partial_update(table, updates, "sso_id", ["name", "MPC_id"], order, strict, ("name", "MPC_id"))


def update_ephem(table, updates, order=None, strict=False, ssos: DataFrame | None = None) -> Change:
    """With `ssos`, a point can only be given to an object that is there."""
    columns = ["sso_id", "MPC_id", "name", "time", "ra_deg", "dec_deg", "flux_mJy"]
    return partial_update(table, updates, "ephem_id", columns, order, strict, parents=None if ssos is None else {"sso_id": ssos})


def update_service(table, updates, order=None, strict=False) -> Change:
    return partial_update(table, updates, "service_id", ["name", "config"], order, strict)


class Cascade(NamedTuple):
    ssos: DataFrame
    points: DataFrame
    missing: DataFrame
    rejected: DataFrame


def update_sso_cascade(ssos, points, updates, order=None, strict=False) -> Cascade:
    """A changed name or MPC id also reaches the object's points."""
    updates = folded(updates, "sso_id")
    change = update_sso(ssos, updates, order, strict)
    small = is_small(updates)
    changed = change.table.join(updates.select("sso_id").distinct(), "sso_id", "left_semi")
    fields = changed.select("sso_id", F.col("name").alias("_name"), F.col("MPC_id").alias("_mpc"), F.lit(True).alias("_to"))
    joined = dimension_join(points, fields, ["sso_id"], "left", small)
    swap = {"name": "_name", "mpc_id": "_mpc"}
    moved = joined.select(*[
        F.when(F.col("_to"), F.col(swap[c.lower()])).otherwise(F.col(c)).alias(c) if c.lower() in swap else F.col(c)
        for c in points.columns])
    return Cascade(change.table, moved, change.missing, change.rejected)


# --- delete --------------------------------------------------------------------------------

def delete(table: DataFrame, keys: DataFrame, key: str, strict: bool = False) -> Change:
    """Removes the rows with these keys. An unknown key is reported as missing and otherwise ignored."""
    gone = keys.select(key).where(F.col(key).isNotNull()).distinct()
    small = is_small(gone)
    ids = restrict(table.select(key), gone, [key], small).distinct()
    missing = gone.join(ids, key, "left_anti")
    if strict:
        raise_if_any(missing, f"unknown {key}")
    nothing = keys.select(key).where(F.col(key).isNull()).withColumn("reason", F.lit("missing key"))
    return Change(dimension_join(table, gone, [key], "left_anti", small), missing, nothing)


def delete_sso_cascade(ssos: DataFrame, points: DataFrame, keys: DataFrame, strict: bool = False) -> Cascade:
    """Removes objects together with their points."""
    change = delete(ssos, keys, "sso_id", strict)
    left = delete(points, keys, "sso_id").table
    return Cascade(change.table, left, change.missing, change.rejected)
