"""From raw text columns to typed, valid, standardised operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.numbers import BLANKS, nan_to_null, parse_number
from garimpo.operators import dims
from garimpo.operators.rank import quantile_columns
from garimpo.schema import AMOUNT, COMPANY, DATE, LAT, LON, PLACE, STATE, SUBSTANCE, scalar_of, stage


def normalise_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trim and upper-case column names and map aliases to canonical names.

    Several sources of one canonical column are merged: first non-null, in column order.
    """
    aliases = dims.HEADER_ALIASES if aliases is None else aliases
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    sources: dict[str, list[str]] = {}
    for i, name in enumerate(df.columns):
        name = name.strip().upper()
        sources.setdefault(aliases.get(name, name), []).append(f"c{i}")
    return plain.select(
        *[
            (F.coalesce(*cols) if len(cols) > 1 else F.col(cols[0])).alias(name)
            for name, cols in sources.items()
        ]
    )


def key_text(c: Column, null_token: str | None = None) -> Column:
    """Trim every kind of blank and upper-case; ``null_token`` replaces nulls if given."""
    text = F.upper(F.trim(c.cast("string"), F.lit(BLANKS)))
    return text if null_token is None else F.coalesce(text, F.lit(null_token))


def normalise_keys(df: DataFrame, columns=None, null_token: str | None = None) -> DataFrame:
    present = [c for c in columns or (COMPANY, PLACE, STATE, SUBSTANCE) if c in df.columns]
    return df.withColumns({c: key_text(df[c], null_token) for c in present})


def parse_numbers(df: DataFrame, columns=(LON, LAT, AMOUNT)) -> DataFrame:
    """Locale-tolerant numbers; columns that are numeric already only lose NaN."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: parse_number(df[c]) if types[c] == "string" else nan_to_null(df[c].cast("double"))
            for c in columns
            if c in types
        }
    )


def parse_dates(df: DataFrame, column: str = DATE) -> DataFrame:
    """Day-first dates; text that is no such date becomes null."""
    if column not in df.columns or dict(df.dtypes)[column] != "string":
        return df
    text = F.trim(F.col(column), F.lit(BLANKS))
    return df.withColumn(column, F.try_to_timestamp(text, F.lit("d/M/yyyy")))


def valid_coordinates(df: DataFrame) -> DataFrame:
    if not {LON, LAT} <= set(df.columns):
        return df
    box = dims.COUNTRY_BOX
    return df.where(
        F.col(LON).between(box["lon_min"], box["lon_max"])
        & F.col(LAT).between(box["lat_min"], box["lat_max"])
    )


def positive_amounts(df: DataFrame) -> DataFrame:
    return df.where(F.col(AMOUNT) > 0)


def flag_outliers(df: DataFrame, factor: float = 3.0) -> DataFrame:
    """``CFEM_OUTLIER``: outside the quartiles by more than ``factor`` interquartile ranges."""
    # the passes of the quantiles read one written column instead of making the rows again
    q = scalar_of(stage(quantile_columns(stage(df.select(AMOUNT)), AMOUNT, {"q1": 0.25, "q3": 0.75})))
    reach = factor * (q["q3"] - q["q1"])
    return df.withColumn(
        "CFEM_OUTLIER",
        (F.col(AMOUNT) < q["q1"] - reach) | (F.col(AMOUNT) > q["q3"] + reach),
    )


def state_codes(df: DataFrame) -> DataFrame:
    """State names to codes (27-row broadcast), then only rows of the 27 known codes."""
    names = F.broadcast(dims.state_names(df.sparkSession))
    columns = [
        F.coalesce("state_code", STATE).alias(STATE) if c == STATE else F.col(f"`{c}`")
        for c in df.columns
    ]
    return (
        df.join(names, F.col(STATE) == F.col("state_name"), "left")
        .select(*columns)
        .where(F.col(STATE).isin(list(dims.STATE_CODES.values())))
    )


def company_name(c: Column, strict: bool = False) -> Column:
    """Drop punctuation other than ``.`` and ``-`` and unify legal suffixes.

    ``strict`` keeps the historical result of the dotted suffix: its last dot stays and is
    followed by the one of the replacement.
    """
    name = F.regexp_replace(c, r"(?U)[^\w\s.-]", "")
    # Suffix pattern -> canonical suffix, applied in this order. ME, EPP and EIRELI
    # are canonical as they stand, so they need no pass.
    rules = [
        (r"\bLTDA\.?\b", "LTDA"),
        (r"\bS\.?A\.?\b" if strict else r"\bS\.?A\b\.?", "S.A."),
        (r"\bS\.?A\.?\s+LTDA\.?\b", "S.A."),
    ]
    for pattern, suffix in rules:
        name = F.regexp_replace(name, "(?U)" + pattern, suffix)
    return name


def company_names(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.withColumn(COMPANY, company_name(F.col(COMPANY), strict)) if COMPANY in df.columns else df


def clean(df: DataFrame, null_token: str | None = None, strict: bool = False) -> DataFrame:
    """Raw table to clean table.

    The outlier quartiles are taken after the coordinate and amount filters but before the
    state filter; that order is part of the result. Text is parsed once: the typed rows are
    written as a table. The filters are then plain predicates on its columns, pushed into the
    scan instead of repeating the parsing, and the quartile passes read three columns of it.
    """
    out = normalise_headers(df)
    out = normalise_keys(out, null_token=null_token)
    out = valid_coordinates(stage(parse_dates(parse_numbers(out))))
    if AMOUNT in out.columns:
        out = flag_outliers(positive_amounts(out))
    if STATE in out.columns:
        out = state_codes(out)
    return company_names(out, strict)
