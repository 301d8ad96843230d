"""Column functions that turn source text into typed values; missing evidence stays NULL."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def to_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def to_number(c: Column) -> Column:
    """A number without currency signs, thousands separators and spaces; NULL for anything else."""
    return F.regexp_replace(c.cast("string"), r"[₪$€,%\s]", "").try_cast("double")


def to_int(c: Column) -> Column:
    return to_number(c).cast("long")


def to_iso_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(text, "d/M/yyyy"), F.try_to_date(text, "d.M.yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def is_iso_date(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def clean_code(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def pick(*cols: Column) -> Column:
    return F.coalesce(*[to_text(c) for c in cols])


def normalize_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\p{P}\p{S}]", ""))


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC); for columns of distinct texts, a batch at a time."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkd(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def composed(df: DataFrame, column: str, form=nfkc) -> DataFrame:
    """``df`` with a text column in one Unicode form: ASCII texts stay as they are, of others each distinct one is
    rewritten once and joined back."""
    odd = F.octet_length(column) > F.char_length(column)
    forms = df.filter(odd).select(F.col(column).alias("_plain")).distinct().withColumn("_form", form("_plain"))
    return df.join(forms, F.col(column) == F.col("_plain"), "left").withColumn(column, F.coalesce("_form", column)).drop("_plain", "_form")


def project_address(c: Column) -> Column:
    """An address of a project: quotation marks go, commas and runs of white space are one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[\"״׳']", ""), ",", " "), r"\s+", " "))


#: Spellings of cities in sources and the names they stand for (fixed values); a city counts where its name occurs.
SPELLINGS = (("קרית", "קריית"), ("פתח תקוה", "פתח תקווה"))
CITIES = ("חיפה", "נתניה", "פתח תקווה")


def city_name(c: Column, spellings: tuple = SPELLINGS, cities: tuple = CITIES) -> Column:
    """The known city that source text names, whatever its spelling; NULL for others."""
    for old, new in spellings:
        c = F.regexp_replace(c, old, new)
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    out = F.lit(None).cast("string")
    for name in reversed(cities):
        out = F.when(F.contains(c, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def normalize_address(c: Column) -> Column:
    """Lower case, punctuation as single spaces; for Unicode forms see ``composed``."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}]+", " "))


def street_key(c: Column) -> Column:
    """The street of an address: no house numbers, no words of units."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_address(c), r"\b(\d+\p{L}?|no|apt|apartment|floor|unit)\b", " "), " +", " "))


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, no trailing slash."""
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    bare = F.regexp_replace(F.concat(F.lower(host), F.substr(c, F.length(host) + 1)), "#.*$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike("^(utm_[a-z]+|fbclid|gclid)=") & (p != ""))
    path = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/$", "")
    return F.when(F.size(query) > 0, F.concat(path, F.lit("?"), F.array_join(query, "&"))).otherwise(path)


def ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), a / b)


def pct_change(new: Column, old: Column) -> Column:
    return F.when(old > 0, 100 * (new / old - 1))


def discount_pct(price: Column, base: Column) -> Column:
    return F.when(base > 0, 100 * (base - price) / base)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sample_label(n: Column) -> Column:
    """How far a sample carries: 20, 8 and 3 observations are the steps."""
    return F.when(n >= 20, "high").when(n >= 8, "medium").when(n >= 3, "low").otherwise("insufficient")


def freshness_weight(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 14, 0.9).when(days <= 30, 0.75).when(days <= 60, 0.5).otherwise(0.0)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def median_of(value: Column, when: Column | None = None, q: float = 0.5) -> Column:
    """Exact interpolated percentile over the non-NULL values that meet a condition."""
    return F.percentile(value if when is None else F.when(when, value), F.lit(q))


def digits_number(c: Column) -> Column:
    """The number that a text's digits and points spell; NULL for none."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"[^0-9.]", ""), F.lit("")).try_cast("double")


def year_of(c: Column) -> Column:
    """The year of D/M/YYYY, YYYY or YYYY-MM-DD text; NULL for any other form."""
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.right(c, F.lit(4))).when(c.rlike(r"^\d{4}($|-\d{2}-\d{2})"), F.left(c, F.lit(4))).cast("int")


def url_kind(c: Column) -> Column:
    """Whether a link leads to one item, to a search, or elsewhere."""
    return F.when(c.rlike(r"/item/[A-Za-z0-9]+"), "item").when(c.rlike(r"[?&](q|page|city|rooms)=|/search"), "search").otherwise("unknown")


def source_key(source_id: Column, url: Column, *attributes: Column) -> Column:
    """A stable key: the source's own id, else a hash of the link, else of the attributes."""
    known = F.when(normalize_url(url) != "", F.sha2(normalize_url(url), 256))
    return F.coalesce(to_text(source_id), known, F.sha2(F.concat_ws("|", *[F.coalesce(a.cast("string"), F.lit("")) for a in attributes]), 256))


def unit_confidence(c: Column) -> Column:
    """Confidence between 0 and 1; what is above 1 was a per cent."""
    return clamp(F.when(c > 1, c / 100).otherwise(c), 0.0, 1.0)


def seller_motivation(days: Column, reductions: Column) -> Column:
    return F.when(days.isNull(), "unknown").when((reductions >= 2) | ((reductions >= 1) & (days >= 60)), "high").when((reductions >= 1) | (days >= 90), "medium").otherwise("low")


def relative_signal(*discounts: Column) -> Column:
    """The first discount known: a premium or discount from ten per cent on, else neutral."""
    d = F.coalesce(*discounts)
    return F.when(d.isNull(), "insufficient").when(d >= 10, "discount").when(d <= -10, "premium").otherwise("neutral")


def strings(c: Column) -> Column:
    """Distinct texts in order, without NULL and empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def set_flags(c: Column) -> Column:
    """Names that a map marks as true."""
    return F.array_sort(F.map_keys(F.map_filter(c, lambda _, v: v)))


def location_problems(lon: Column, lat: Column, source: Column, accuracy: Column, sources: list[str], accuracies: list[str]) -> Column:
    """Every rule a location breaks: half a pair, out of range, unknown source or accuracy."""
    return F.array_compact(F.array(
        F.when(lon.isNull() != lat.isNull(), "incomplete_pair"), F.when(~(lon.between(-180, 180) & lat.between(-90, 90)), "out_of_range"),
        F.when(~F.coalesce(source.isin(*sources), F.lit(False)), "unknown_source"), F.when(~F.coalesce(accuracy.isin(*accuracies), F.lit(False)), "unknown_accuracy")))
