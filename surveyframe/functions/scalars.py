"""Column expressions for cleaning and labelling survey data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" in an integer field.
MISSING_TOKENS = ("", " ", "NA", "N/A", "na", "n/a")
# Fixed value: tolerance of the float comparison.
NEAR_TOLERANCE = 1.5e-8
# Fixed value: normal quantile of the plotted bands.
BAND_Z = 1.96

ColumnOrName = Column | str

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: ColumnOrName, places: int = 6) -> Column:
    """Round for display; negative zero becomes zero."""
    return F.round(as_col(c), places) + F.lit(0.0)


def nan_to_null(c: ColumnOrName) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def safe_double(c: ColumnOrName) -> Column:
    """Text to double; anything that is not a plain decimal number is null."""
    text = F.trim(as_col(c).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def safe_int(c: ColumnOrName, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Text to integer, decimals cut off towards zero; missing-value tokens are null.

    Tokens that are no number are null anyway, so only numeric ones cost a comparison. A plain integer, as most
    cells are, is recognised by writing it back; anything else goes through the pattern of ``safe_double``.
    """
    text = as_col(c).cast("string")
    numeric = [t for t in tokens if t.strip().lstrip("+-").replace(".", "", 1).isdigit()]
    if numeric:
        text = F.when(~text.isin(numeric), text)
    plain = text.try_cast("int")
    return F.when(plain.cast("string") == text, plain).otherwise(safe_double(text).try_cast("int"))


def parse_date(c: ColumnOrName) -> Column:
    """``month/day/year`` text to a date; trailing text is ignored, a bad date is null.

    A two-digit year is read literally (year 23), so ``repair_year`` can mend it. A date written without leading
    zeros, with a four-digit year and a day that every month has, is put together from its numbers; any other
    text goes through the pattern.
    """
    text = as_col(c).cast("string")
    month, day, year = (F.split_part(text, F.lit("/"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    plain = (F.concat_ws("/", month, day, year) == text) & month.between(1, 12) & day.between(1, 28) & year.between(1000, 9999)
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{1,4})"
    part = lambda i, width: F.lpad(F.regexp_extract(text, pattern, i), width, "0")
    iso = F.concat_ws("-", part(3, 4), part(1, 2), part(2, 2))
    return F.when(plain, F.make_date(year, month, day)).when(text.rlike(pattern), F.try_to_date(iso, "yyyy-MM-dd"))


def repair_year(c: ColumnOrName, floor: str, year: int) -> Column:
    """Dates before ``floor`` keep month and day and move to ``year``."""
    c = as_col(c)
    moved = F.try_to_date(F.concat(F.lit(f"{year:04d}-"), F.date_format(c, "MM-dd")), "yyyy-MM-dd")
    return F.when(c < F.lit(floor).cast("date"), moved).otherwise(c)


def recode(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, leave all others."""
    c = as_col(c)
    if not mapping:
        return c
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def matches(c: ColumnOrName, pattern: str) -> Column:
    return F.trim(as_col(c)).rlike(pattern)


def parse_number(c: ColumnOrName) -> Column:
    """First number inside a text, grouping commas removed."""
    hit = F.regexp_extract(as_col(c).cast("string"), r"(-?(\d[\d,]*\.?\d*|\.\d+))", 1)
    return F.regexp_replace(hit, ",", "").try_cast("double")


def visibility_text(c: ColumnOrName, na_tokens: Sequence[str] = ("NA",)) -> Column:
    """A scanned text column holds null for a blank cell and the token for a missing one;
    the filter below needs it the other way round."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit("")).when(F.trim(c).isin(list(na_tokens)), F.lit(None)).otherwise(c)


def visibility_kept(raw: ColumnOrName, minimum: float = 3.0) -> Column:
    """True for rows to keep: unknown distance is kept, a "<3" text or a small number is
    not, and a missing text is not (its flag is unknown)."""
    raw = as_col(raw)
    flag = matches(raw, r"^<\s*3")
    value = parse_number(raw)
    return F.coalesce(~flag & (value.isNull() | (value >= minimum)), F.lit(False))


def in_list(c: ColumnOrName, values: Sequence) -> Column:
    """Membership that is never null."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def up_count(c: ColumnOrName) -> Column:
    """Missing count is zero, fractions round up."""
    return F.ceil(F.coalesce(as_col(c), F.lit(0.0)))


def period_flag(date: ColumnOrName, event_date: ColumnOrName) -> Column:
    """"Post" from the event date on, and always where there is no event date."""
    date, event_date = as_col(date), as_col(event_date)
    return F.when(event_date.isNull() | (date >= event_date), "Post").otherwise("Pre")


def months_since(date: ColumnOrName, anchor: ColumnOrName | str) -> Column:
    """Whole months since ``anchor`` plus the share of the month begun, never below zero."""
    date = as_col(date)
    anchor = F.to_date(F.lit(anchor)) if isinstance(anchor, str) else anchor
    span = (F.year(date) - F.year(anchor)) * 12 + F.month(date) - F.month(anchor)
    whole = span - F.when(F.add_months(anchor, span) > date, 1).otherwise(0)
    start, end = F.add_months(anchor, whole), F.add_months(anchor, whole + 1)
    value = whole + F.datediff(date, start) / F.datediff(end, start)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def as_level(c: ColumnOrName, levels: Sequence[str]) -> Column:
    """Value where it is a known level, else null."""
    c = as_col(c)
    return F.when(c.isin(list(levels)), c)


def level_index(c: ColumnOrName, levels: Sequence[str]) -> Column:
    """Position of the level for ordering, null outside the list."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.when(position > 0, position).cast("int")


def survey_key(site: ColumnOrName, date: ColumnOrName) -> Column:
    text = lambda c: F.coalesce(as_col(c).cast("string"), F.lit("NA"))
    return F.concat_ws("_", text(site), text(date))


def p_below(lower: ColumnOrName, upper: ColumnOrName, cut: ColumnOrName) -> Column:
    """Share of a size bin below a cut: all, none, or the linear part; no cut gives null."""
    lower, upper, cut = as_col(lower), as_col(upper), as_col(cut)
    return (
        F.when(cut.isNull(), F.lit(None).cast("double"))
        .when(upper <= cut, 1.0)
        .when(lower >= cut, 0.0)
        .otherwise(F.try_divide(cut - lower, upper - lower))
    )


def split_count(n: ColumnOrName, p: ColumnOrName) -> tuple[Column, Column]:
    """Part ``n*p`` rounded half to even, and the remainder."""
    n = as_col(n)
    part = F.rint(n * as_col(p)).cast("bigint")
    return part, n.cast("bigint") - part


def null_where(c: ColumnOrName, condition: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), as_col(c))


def safe_ratio(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.try_divide(as_col(x), as_col(y))


# The texts of both labels.
def trajectory_label(estimate: ColumnOrName, p: ColumnOrName, alpha: float = 0.05) -> Column:
    estimate, p = as_col(estimate), as_col(p)
    return (
        F.when((p < alpha) & (estimate > 0), "increase")
        .when((p < alpha) & (estimate < 0), "decrease")
        .otherwise("no significant change")
    )


def significance_label(p: ColumnOrName, alpha: float = 0.05) -> Column:
    p = as_col(p)
    return F.when(p < alpha, "Significant").when(p >= alpha, "Non-significant")


def format_p(p: ColumnOrName) -> Column:
    p = as_col(p)
    return F.when(p.isNull(), None).when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def interaction_key(columns: Sequence[ColumnOrName], sep: str = ".") -> Column:
    """One text key of several columns; null where any part is null."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit(sep)] if i else []) + [as_col(c).cast("string")]])


def invert_ratio(ratio: ColumnOrName, lower: ColumnOrName, upper: ColumnOrName) -> tuple[Column, Column, Column]:
    """Reciprocal of a ratio; its bounds swap places."""
    one = F.lit(1.0)
    return F.try_divide(one, as_col(ratio)), F.try_divide(one, as_col(upper)), F.try_divide(one, as_col(lower))


def odds_to_prop(odds: ColumnOrName) -> Column:
    odds = as_col(odds)
    return odds / (F.lit(1.0) + odds)


def back_transform(link: ColumnOrName, se: ColumnOrName, log_link: bool = True) -> tuple[Column, Column, Column]:
    """Response and its band from the link scale."""
    link, se = as_col(link), as_col(se)
    inverse = F.exp if log_link else (lambda c: c)
    return inverse(link), inverse(link - BAND_Z * se), inverse(link + BAND_Z * se)


def near(a: ColumnOrName, b: ColumnOrName, tol: float = NEAR_TOLERANCE) -> Column:
    return F.abs(as_col(a) - as_col(b)) < tol


def signif(c: ColumnOrName, digits: int = 3) -> Column:
    """Round to significant figures."""
    c = as_col(c)
    places = F.floor(F.log10(F.abs(c))).cast("int") - digits + 1
    up, down = F.pow(F.lit(10.0), -places), F.pow(F.lit(10.0), places)
    value = F.when(places <= 0, F.round(c * up) / up).otherwise(F.round(c / down) * down)
    return F.when(c == 0, F.lit(0.0)).otherwise(value)
