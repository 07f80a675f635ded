"""Column builders for ``key=value;`` annotations and per-record read counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def info_first(info: Column, key: str, word_start: bool = True) -> Column:
    """First value of ``key``; null if absent."""
    head = r"\b" if word_start else ""
    return _blank_to_null(F.regexp_extract(info, rf"{head}{key}=([^\s;]+)", 1))


def info_last(info: Column, key: str) -> Column:
    """Last value of ``key`` (a later assignment overrides an earlier one); null if absent."""
    return _blank_to_null(F.regexp_extract(info, rf"^(?:.*[;\s])?{key}=([^;\s=]+)", 1))


def info_long(info: Column, key: str) -> Column:
    return info_first(info, key).try_cast("bigint")


def strand_count_total(count_text: Column) -> Column:
    """``a:3,4|b:1,0`` -> 8; null when the text is null."""
    fwd = F.regexp_extract_all(count_text, F.lit(r"[^\s:|]+:(\d+),(\d+)"), F.lit(1))
    rev = F.regexp_extract_all(count_text, F.lit(r"[^\s:|]+:(\d+),(\d+)"), F.lit(2))
    return F.aggregate(
        F.concat(fwd, rev), F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint")
    )


def sample_values(fields: Column, name: str | tuple[str, ...]) -> Column:
    """Values of one FORMAT entry for every sample column of a VCF row, as strings.

    Null when the entry is missing or named more than once.
    """
    names = [name] if isinstance(name, str) else list(name)
    fmt = F.split(F.get(fields, F.lit(8)), ":")
    is_hit = F.transform(fmt, lambda x: x.isin(*names))
    n_hit = F.size(F.filter(is_hit, lambda x: x))
    at = F.array_position(is_hit, F.lit(True)).cast("int")
    samples = F.slice(fields, F.lit(10), F.greatest(F.size(fields) - 9, F.lit(0)))
    return F.when(n_hit == 1, F.transform(samples, lambda s: F.get(F.split(s, ":"), at - 1)))


def vcf_support(fields: Column) -> Column:
    """Supporting reads of a VCF row: an INFO support key, else DV/VR over all samples, else -1."""
    info = F.get(fields, F.lit(7))
    key = r"(?:^|[;\s])(?:SUPPORT|TUMOUR_SUPPORT|TUMOUR_READ_SUPPORT)=([^;\s=]+)"
    by_info = _blank_to_null(F.regexp_extract(info, key, 1)).try_cast("bigint")
    per_sample = F.when(F.size(fields) >= 10, sample_values(fields, ("DV", "VR")))
    by_sample = F.aggregate(
        per_sample,
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")),
    )
    return F.coalesce(by_info, by_sample, F.lit(-1).cast("bigint"))
