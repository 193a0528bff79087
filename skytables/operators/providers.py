"""External catalogs ("providers") loaded as tables: cone search and name resolution.

Every provider names its own columns in a config:
`{"name_col": ..., "ra_col": ..., "dec_col": ...[, "flux_col": ...]}`.
Positions are degrees and fluxes mJy.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import flat_distance, wrap_ra
from .maintain import insert_fixed
from .skew import HOT_ROWS, broadcast_if_small, restrict, saved
from .sky_join import within_radius

NEEDED = ("name_col", "ra_col", "dec_col")


class Provider(NamedTuple):
    name: str
    table: DataFrame
    config: dict[str, str] | DataFrame  # one config, or a table of them in column `config`


class Resolved(NamedTuple):
    found: DataFrame
    missing: DataFrame
    rejected: DataFrame


def provider_table(provider: Provider) -> DataFrame:
    """(provider, name, ra_deg, dec_deg, flux_mJy) read through the provider's config."""
    config = provider.config
    if isinstance(config, DataFrame):
        return _through_configs(provider.name, provider.table, config)
    lacking = sorted(set(NEEDED) - set(config))
    if lacking:
        raise ValueError(f"config of {provider.name} lacks {lacking}")
    flux = F.col(config["flux_col"]).cast("double") if "flux_col" in config else F.lit(None).cast("double")
    return provider.table.select(
        F.lit(provider.name).alias("provider"), F.col(config["name_col"]).cast("string").alias("name"),
        wrap_ra(F.col(config["ra_col"]).cast("double")).alias("ra_deg"),
        F.col(config["dec_col"]).cast("double").alias("dec_deg"), flux.alias("flux_mJy"))


def _through_configs(name: str, table: DataFrame, configs: DataFrame) -> DataFrame:
    """`provider_table` for every config in a table: rows carry the columns that some config names, and each config picks from them."""
    keys = F.map_keys("config")
    bad = configs.where(F.size(F.array_intersect(keys, F.lit([*NEEDED]))) < len(NEEDED)).take(1)
    if bad:
        raise ValueError(f"config of {name} lacks {sorted(set(NEEDED) - set(bad[0].config))}")
    known = {c.lower(): c for c in table.columns}
    named = configs.select(F.explode(F.map_values("config")).alias("c")).distinct()
    strange = named.where(~F.lower("c").isin(list(known))).take(1)
    if strange:
        raise ValueError(f"{name} has no column {strange[0].c}")
    used = sorted(known[r.c] for r in named.select(F.lower("c").alias("c")).distinct().collect())  # no more than the table has columns
    values = F.create_map(*[x for c in used for x in (F.lit(c.lower()), F.col(f"`{c}`").cast("string"))])
    rows = table.select(F.lit(name).alias("provider"), values.alias("_values"))
    each = configs.select(F.lit(name).alias("provider"), "config")

    def pick(key: str) -> Column:
        return F.try_element_at("_values", F.lower(F.try_element_at("config", F.lit(key))))

    return rows.join(broadcast_if_small(each), "provider").select(
        "provider", pick("name_col").alias("name"), wrap_ra(pick("ra_col").cast("double")).alias("ra_deg"),
        pick("dec_col").cast("double").alias("dec_deg"), pick("flux_col").cast("double").alias("flux_mJy"))


def load_providers(services: DataFrame, tables: dict[str, DataFrame]) -> list[Provider]:
    """The tables at hand that are registered as services (`name`, `config` map), each with its distinct configs."""
    configs = F.map_from_entries("entries").alias("config")
    found = []
    for name in sorted(tables):
        own = services.where(F.col("name") == name).select(F.array_sort(F.map_entries("config")).alias("entries")).distinct().select(configs)
        if own.take(1):
            found.append(Provider(name, tables[name], own))
    return found


def all_providers(providers: list[Provider]) -> DataFrame:
    return reduce(DataFrame.unionByName, [provider_table(p) for p in providers])


def cone_search(
    cones: DataFrame, providers: list[Provider], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """What each provider lists within each cone (`cone_id`, `ra_deg`, `dec_deg`, `radius_deg`).

    The radius is a great-circle one and included; `distance` is the flat
    distance in degrees, beside `separation_deg`.
    """
    targets = cones.select("cone_id", F.col("ra_deg").alias("t_ra"), F.col("dec_deg").alias("t_dec"), "radius_deg")
    listed = all_providers(providers).withColumnsRenamed({"ra_deg": "p_ra", "dec_deg": "p_dec"})
    pairs = within_radius(targets, listed, hot_rows=hot_rows)
    flat = flat_distance(F.col("t_ra"), F.col("t_dec"), F.col("p_ra"), F.col("p_dec"))
    return pairs.select(
        "cone_id", "provider", "name", F.col("p_ra").alias("ra_deg"), F.col("p_dec").alias("dec_deg"),
        "flux_mJy", "separation_deg", flat.alias("distance"))


def radius_from_arcmin(arcmin: Column) -> Column:
    return arcmin / 60.0


def resolve_name(
    names: DataFrame, catalog: DataFrame, services: DataFrame, order: tuple[str, ...] = ("ra_deg", "dec_deg", "flux_mJy"),
) -> Resolved:
    """First match of each (`provider`, `name`) in `catalog`, by the declared order.

    `catalog` is as made by `all_providers`. Requests to a provider that is not
    in `services` are rejected; requests without a match are missing. `n_matches`
    above 1 says that others were passed over. The first match is an aggregate,
    so a name that fills the catalog is combined before it is shuffled.
    """
    keys = ["provider", "name"]
    wanted = names.select(*keys).distinct()
    registered = services.select(F.col("name").alias("provider")).distinct().withColumn("_known", F.lit(True))
    marked = wanted.join(registered, "provider", "left")
    rejected = marked.where(F.col("_known").isNull()).select(*keys, F.lit("unknown provider").alias("reason"))
    usable = marked.where(F.col("_known")).select(*keys)
    values = F.struct("ra_deg", "dec_deg", "flux_mJy")
    first = restrict(catalog, wanted, keys).groupBy(*keys).agg(
        F.min_by(values, F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n_matches"))
    found = usable.join(first, keys).select(*keys, "first.*", "n_matches")
    return Resolved(found, usable.join(first, keys, "left_anti"), rejected)


class Created(NamedTuple):
    table: DataFrame
    added: DataFrame
    missing: DataFrame
    rejected: DataFrame


def create_by_name(
    fixed: DataFrame, names: DataFrame, catalog: DataFrame, services: DataFrame,
    order: tuple[str, ...] = ("ra_deg", "dec_deg", "flux_mJy"),
) -> Created:
    """Resolves names and adds what was found to the fixed sources."""
    resolved = resolve_name(names, catalog, services, order)
    found = saved(resolved.found.select("name", "ra_deg", "dec_deg", "flux_mJy"), "resolved")
    done = insert_fixed(fixed, found, "by-name")
    return Created(done.table, done.added, resolved.missing, resolved.rejected)
