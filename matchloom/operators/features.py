"""Record features, fingerprints and text views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def normalize_ascii(df: DataFrame, name: str, address: str, country: str) -> DataFrame:
    """Adds norm_name, norm_address, norm_country (ASCII only)."""
    return df.withColumns({
        "norm_name": T.clean_text(F.col(name)), "norm_address": T.clean_text(F.col(address)), "norm_country": T.normalize_country(F.col(country))
    })


def normalize_unicode(df: DataFrame, name: str, address: str, country: str) -> DataFrame:
    """Adds address_missing, name_norm, address_norm, country_norm, postal_code (Unicode kept)."""
    return df.withColumns({
        "address_missing": T.is_missing(F.col(address)), "name_norm": T.normalize_name(F.col(name)),
        "address_norm": T.normalize_address(F.col(address)), "country_norm": T.normalize_country(F.col(country)),
        "postal_code": T.extract_postal_code(F.col(address)),
    })


def completeness(df: DataFrame, raw: list[str], name: str, address: str, country: str) -> DataFrame:
    """Adds quality_* columns over normalized name and address and the raw fields."""
    n, a = F.size(T.space_tokens(F.col(name))), F.size(T.space_tokens(F.col(address)))
    numbers = F.size(T.number_list(F.col(address)))
    has = lambda c: c.cast("int")
    country_there = F.coalesce(F.col(country) != "", F.lit(False))
    return df.withColumns({
        "quality_non_null_count": reduce(Column.__add__, (has(F.col(c).isNotNull()) for c in raw)),
        "quality_name_len": F.length(T.or_empty(F.col(name))), "quality_address_len": F.length(T.or_empty(F.col(address))),
        "quality_name_tokens": n, "quality_address_tokens": a, "quality_address_numbers": numbers,
        "quality_score": 2 * has(n > 0) + 2 * has(a > 0) + has(numbers > 0) + has(country_there),
    })


def record_quality(name: Column, address: Column) -> Column:
    """0.1 to 1.0: less for a missing or short address and a short name."""
    address_len, name_len = F.length(T.or_empty(address)), F.length(T.or_empty(name))
    penalty = F.when(T.is_missing(address) == 1, 0.4).when(address_len < 10, 0.2).otherwise(0.0) + F.when(name_len < 5, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.round(1.0 - penalty, 2))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(T.space_tokens(x)), " ")


def fingerprints(df: DataFrame, name: str, address: str) -> DataFrame:
    """Adds fp_address_numbers, fp_name_alpha, fp_name_sorted, fp_address_sorted."""
    return df.withColumns({
        "fp_address_numbers": T.extract_numbers(F.col(address)),
        "fp_name_alpha": F.regexp_replace(T.or_empty(F.col(name)), " ", ""),
        "fp_name_sorted": sorted_tokens(F.col(name)), "fp_address_sorted": sorted_tokens(F.col(address)),
    })


def narrow_features(df: DataFrame, key: str, name: str, address: str, raw_name: str, raw_address: str) -> DataFrame:
    """The ten-column feature table of a record."""
    n, a = F.col(name), F.col(address)
    return df.select(
        F.col(key).alias("entity_id"),
        F.length(T.or_empty(n)).alias("name_char_count"), F.length(T.or_empty(a)).alias("addr_char_count"),
        F.size(T.space_tokens(n)).alias("name_token_count"), F.size(T.space_tokens(a)).alias("addr_token_count"),
        T.extract_numbers(n).alias("name_numbers"), T.extract_numbers(a).alias("addr_numbers"),
        T.phone_digits(F.col(raw_name)).alias("name_phone"), T.phone_digits(F.col(raw_address)).alias("addr_phone"),
        record_quality(n, a).alias("record_quality"),
    )


def view(*parts: Column) -> Column:
    """The non-empty parts joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def plain_view(*parts: Column) -> Column:
    """All parts joined by spaces, stripped."""
    return T.strip(F.concat_ws(" ", *(T.or_empty(p) for p in parts)))
