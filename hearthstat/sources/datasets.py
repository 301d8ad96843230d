"""Typed tables out of raw observations: a dataset is a list of fields and keys, compiled to columns over VARIANT payloads.

Raw observations: slug, row_hash, payload (JSON text), loaded_at.  One table a dataset, partitioned by slug, keeps every
version; the compiled table shows the latest one of each complete natural key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hearthstat.functions.clean import to_iso_date

#: Identifiers that are text though sources write them as numbers.
CODES = ("locality_code", "statistical_area_code", "block", "parcel", "subparcel", "institution_code")


@dataclass(frozen=True)
class Field:
    """``kind``: text, number, json, flag (false unless true), date (a day, else the first of its year) or constant."""

    name: str
    source: str | None = None
    kind: str = "text"
    constant: float | str | None = None


@dataclass(frozen=True)
class Dataset:
    slug: str
    adapter: str
    keys: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()


def _municipal(**measures: str) -> list[Dataset]:
    own = (Field("municipality"), Field("observation_year", kind="number"))
    return [Dataset(slug, "archive", ("municipality", "observation_year"), (*own, Field(measure, kind="number"))) for slug, measure in measures.items()]


def _series(*slugs: str) -> list[Dataset]:
    fields = (Field("series_code"), Field("observation_period"), Field("value", kind="number"), Field("attributes", kind="json"))
    return [Dataset(s, "series", ("series_code", "observation_period"), fields) for s in slugs]


def _keyed(adapter: str, **keys: tuple[str, ...]) -> list[Dataset]:
    return [Dataset(s, adapter, k, tuple(Field(x) for x in k)) for s, k in keys.items()]


_AREA, _ITEM, _PLAN = ("locality_code", "statistical_area_code"), ("listing_id",), ("source_id", "source_plan_id")
#: The datasets with their keys (fixed values).  Families know their fields; the fields of the others come from a catalogue
#: (``from_catalogue``) or from the payloads (``discovered``).
DATASETS: dict[str, Dataset] = {d.slug: d for d in [
    *_municipal(
        municipal_wages="average_wage", municipal_migration="net_internal_migration", municipal_population="population", municipal_natural_growth="natural_growth",
        construction_starts="housing_starts", municipal_development="value", municipal_capital_expenditure="value", municipal_capital_revenue="value", municipal_development_funds="value",
        municipal_revenue="value", municipal_debt="value", municipal_debt_ratio="value", municipal_deficit_ratio="value", municipal_commercial_tax_ratio="value", municipal_tax_collection="value"),
    *_keyed("archive", transactions=(), haifa_streets=(), census_2022=_AREA, statistical_areas_2022=_AREA, area_population_2023=_AREA, area_population_2024=_AREA, municipal_age_groups=(),
            municipal_education_subsidy=(), election_2022_polling=("locality_code", "polling_station"), election_2022_locality=("locality_code",), parcels=("parcel_id",), school_locations=("institution_code",),
            national_transport_plans=(), brt_routes=(), light_rail_stations=(), rail_stations=(), metronit_routes=(), metro_stations=(), metro_routes=(), haifa_transport_2040=(), jerusalem_building_files=("case_number",)),
    *_keyed("feature", urban_renewal_complexes=("complex_id",), housing_plans=()),
    *_series("policy_interest_rates", "mortgage_rates", "price_indices", "housing_market_series"),
    *_keyed("native", sale_listings=_ITEM, rent_listings=_ITEM, statutory_plans=_PLAN, infrastructure_projects=_PLAN),
    *_keyed("blocked", national_addresses=(), municipal_elections_2024=()),
]}


def from_catalogue(text: str) -> dict[str, Dataset]:
    """Datasets out of a JSON list of {slug, adapter, keys, fields: [{name, source, type, constant}]}."""
    kinds = {"integer": "number", "boolean": "flag"}

    def field(f: dict) -> Field:
        constant = f.get("constant")
        return Field(f["name"], f.get("source"), "constant" if constant is not None else kinds.get(f.get("type", "text"), f.get("type", "text")), constant)

    return {d["slug"]: Dataset(d["slug"], d["adapter"], tuple(d.get("keys", ())), tuple(field(f) for f in d.get("fields", ()))) for d in json.loads(text)}


def discovered(raw: DataFrame, slug: str) -> Dataset:
    """A dataset whose fields are the names in its payloads, as text; its keys are known from ``DATASETS``."""
    keys = F.explode(F.json_object_keys("payload"))
    names = sorted(r[0] for r in raw.filter(F.col("slug") == slug).select(keys).distinct().collect())  # names of columns
    known = DATASETS.get(slug, Dataset(slug, "archive"))
    return Dataset(slug, known.adapter, known.keys, tuple(Field(n) for n in names))


def field_column(f: Field, payload: Column) -> Column:
    """The typed column of one field of a VARIANT payload; what does not parse is NULL, never zero."""
    if f.kind == "constant":
        return F.lit(f.constant)
    source = f.source or f.name
    mark = '"' if "'" in source else "'"  # paths know no escapes
    if mark in source:
        raise ValueError(f"a field's source may hold one kind of quotation mark: {source}")
    path = f"$[{mark}{source}{mark}]"
    text = F.try_variant_get(payload, path, "string")
    if f.kind == "json":
        return F.to_json(F.try_variant_get(payload, path, "variant"))
    if f.kind == "flag":
        return F.coalesce(text == "true", F.lit(False))
    if f.kind == "number":
        plain = F.regexp_replace(F.trim(text), "[,%]", "")
        return F.when(plain.rlike(r"^-?[0-9]+([.][0-9]+)?$"), plain.try_cast("double"))
    if f.kind == "date":
        year = F.when(text.rlike(r"^\d{4}$"), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))
        return F.coalesce(to_iso_date(text), year)
    known = F.nullif(text, F.lit(""))
    return F.regexp_replace(known, r"[.]0+$", "") if f.name in CODES else known


def compiled(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """record_id, loaded_at and the dataset's fields, the latest version of each complete key; a row whose key has a NULL
    stands for itself, so that missing keys do not fold into one.  Payloads that are no JSON give no row.

    Latest: by the payload's own first sight, then load time, then hash, as one maximum with partial aggregation.
    """
    rows = raw.filter(F.col("slug") == dataset.slug).withColumn("payload", F.try_parse_json("payload")).filter("payload IS NOT NULL")
    seen = F.coalesce(*[F.try_variant_get("payload", f"$.{n}", "string") for n in ("first_seen", "_first_seen")], F.lit(""))
    at = F.struct(seen.alias("seen"), F.col("loaded_at").alias("loaded"), F.col("row_hash").alias("hash"))
    columns = [field_column(f, F.col("payload")).alias(f.name) for f in dataset.fields]
    named = rows.select("row_hash", "loaded_at", at.alias("at"), F.struct(*columns).alias("row") if columns else F.lit(None).alias("row"))
    parts = [F.col("row").getField(k) for k in dataset.keys]
    complete = F.lit(bool(parts))
    for p in parts:
        complete = complete & p.isNotNull()
    key = F.when(complete, F.to_json(F.array(*[p.cast("string") for p in parts]))) if parts else F.lit(None).cast("string")
    best = named.groupBy(key.alias("natural"), F.when(~complete, F.col("row_hash")).alias("own")).agg(F.max_by(F.struct("row_hash", "loaded_at", "row"), "at").alias("best"))
    return best.select(F.col("best.row_hash").alias("record_id"), F.col("best.loaded_at").alias("loaded_at"), *[F.col("best.row").getField(f.name).alias(f.name) for f in dataset.fields])


def compile_all(raw: DataFrame, datasets: dict[str, Dataset] = DATASETS) -> dict[str, DataFrame]:
    """Every dataset that is not blocked as a lazily built table; a filter on the slug reads its partition only."""
    return {d.slug: compiled(raw, d) for d in datasets.values() if d.adapter != "blocked"}


def append_counted(page: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, Observation, Observation]:
    """The rows of a page that are not stored yet, one a key, and what was fetched and inserted (known once they are written)."""
    fetched, inserted = Observation("fetched"), Observation("inserted")
    rest = [c for c in page.columns if c not in keys]
    once = page.observe(fetched, F.count("*").alias("rows")).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("r")).select(*keys, "r.*")
    return once.join(stored.select(*keys), keys, "left_anti").observe(inserted, F.count("*").alias("rows")), fetched, inserted
