"""Prices, percentages, dates and small arithmetic of offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, squeeze

NUMBER = r"[0-9]{1,3}(?:[.,\s][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?"
DAY = r"[0-9]{1,2}[./\-][0-9]{1,2}(?:[./\-][0-9]{2,4})?"
#: Greek months as flyers write them, without accents.
MONTHS = {
    1: ("ιανουαριου", "ιανουαριος"), 2: ("φεβρουαριου", "φεβρουαριος"), 3: ("μαρτιου", "μαρτιος"), 4: ("απριλιου", "απριλιος"),
    5: ("μαιου", "μαιος"), 6: ("ιουνιου", "ιουνιος"), 7: ("ιουλιου", "ιουλιος"), 8: ("αυγουστου", "αυγουστος"),
    9: ("σεπτεμβριου", "σεπτεμβριος"), 10: ("οκτωβριου", "οκτωβριος"), 11: ("νοεμβριου", "νοεμβριος"), 12: ("δεκεμβριου", "δεκεμβριος"),
}


def _decimal(col: Column, kind: str = "decimal(12,2)") -> Column:
    return col.try_cast(kind)


def parse_price(raw: Column) -> Column:
    """The first number of a text. With both separators the last one is decimal; a comma alone is; a point stays a point.

    More than one comma without a point is no number.
    """
    num = F.nullif(F.regexp_extract(F.trim(raw), f"({NUMBER})", 1), F.lit(""))
    last_comma, last_point = F.length(F.regexp_extract(num, "^(.*),", 1)), F.length(F.regexp_extract(num, r"^(.*)\.", 1))
    comma_last = F.replace(F.replace(num, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    both = F.when(last_comma > last_point, comma_last).otherwise(F.replace(num, F.lit(","), F.lit("")))
    text = F.when(num.contains(".") & num.contains(","), both).otherwise(F.replace(num, F.lit(","), F.lit(".")))
    return F.regexp_replace(text, " ", "").try_cast("decimal(18,3)")


def parse_percent(raw: Column) -> Column:
    """The first ``N%``, if it is 0 to 100."""
    n = F.regexp_extract(raw, r"([0-9]{1,3})\s*%", 1).try_cast("int")
    return F.when(n.between(0, 100), n)


def comma_price(raw: Column) -> Column:
    """``€1.234,56`` as 1234.56: points group, a comma is decimal."""
    return _decimal(F.trim(F.translate(F.replace(raw, F.lit("."), F.lit("")), ",€", ".")))


def compose_price(whole: Column, fraction: Column) -> Column:
    """Euros and cents from two fields; a lone digit of cents is the last one."""
    cents = F.lpad(F.coalesce(F.nullif(F.regexp_replace(fraction, "[^0-9]", ""), F.lit("")), F.lit("00")), 2, "0")
    return _decimal(F.concat(F.nullif(F.regexp_replace(whole, "[^0-9]", ""), F.lit("")), F.lit("."), cents))


def mean_price(price: Column) -> Column:
    """The mean to whole cents, a half always up: binary fractions that fall just short of one are lifted over it."""
    return F.round(F.avg(price) + F.lit(1e-7), 2)


def in_range(value: Column, lo: int, hi: int) -> Column:
    n = value.try_cast("int")
    return F.when(n.between(lo, hi), n)


def percent_off(original: Column, sale: Column) -> Column:
    """Rounded half to even, null unless it is a discount of a positive price."""
    return F.when((original > 0) & (original > sale), F.bround((original - sale) / original * 100, 0).cast("int"))


def real_original(original: Column, sale: Column) -> Column:
    """An original price that isn't higher than the sale price is none."""
    return F.when(original > sale, original)


def _from_parts(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _one_day(text: Column, default_year: int) -> Column:
    part = lambda n: F.regexp_extract(text, r"^([0-9]{1,2})[./\-]([0-9]{1,2})(?:[./\-]([0-9]{2,4}))?", n).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    return F.when(text != "", _from_parts(part(1), part(2), F.coalesce(year, F.lit(default_year))))


def parse_date(raw: Column, default_year: int) -> Column:
    """``28 Μαΐου 2026``, ``28.05``, ``28/05/2026``, ``28-05-26``; a missing year is the default one."""
    text = normalize(raw)
    pattern = r"([0-9]{1,2})\s+([α-ω]+)(?:\s+([0-9]{4}))?"
    months = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (F.lit(n), F.lit(m))])
    month = F.element_at(months, F.regexp_extract(text, pattern, 2))
    year = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(default_year))
    worded = _from_parts(F.regexp_extract(text, pattern, 1).try_cast("int"), month, year)
    return F.when(month.isNotNull(), worded).otherwise(_one_day(F.regexp_extract(text, f"({DAY})", 1), default_year))


def parse_date_range(raw: Column, default_year: int) -> Column:
    """struct(valid_from, valid_to): the first and the last day of a text; a lone day is the start."""
    days = F.regexp_extract_all(raw, F.lit(f"({DAY})"), F.lit(1))
    first = _one_day(F.try_element_at(days, F.lit(1)), default_year)
    last = F.when(F.size(days) > 1, _one_day(F.try_element_at(days, F.lit(-1)), default_year))
    return F.struct(first.alias("valid_from"), last.alias("valid_to"))


def written_date(raw: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """The date as written in a timestamp, whatever its zone."""
    return F.try_to_date(F.substring(raw, 1, 10), fmt)


def promo_label(raw: Column) -> Column:
    """Single spaces, ``N + M free`` in Greek, 80 characters at most."""
    text = squeeze(raw)
    text = F.regexp_replace(text, r"(?i)^([0-9]+)\s*\+\s*([0-9]+)\s*free$", "$1+$2 δώρο")
    return F.nullif(F.rtrim(F.substring(text, 1, 80)), F.lit(""))


def multi_buy(title: Column) -> Column:
    """struct(buy, free) of ``N + M``; null unless both are 1 to 20."""
    n, m = (F.regexp_extract(title, r"([0-9]+)\s*\+\s*([0-9]+)", i).try_cast("int") for i in (1, 2))
    return F.when(n.between(1, 20) & m.between(1, 20), F.struct(n.alias("buy"), m.alias("free")))


def euro_discount(title: Column) -> Column:
    """The positive amount before or after the euro sign."""
    amount = F.regexp_extract(title, r"([0-9]+(?:[.,][0-9]{1,2})?)\s*€|€\s*([0-9]+(?:[.,][0-9]{1,2})?)", 0)
    value = F.replace(F.regexp_extract(amount, r"[0-9]+(?:[.,][0-9]{1,2})?", 0), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")
    return F.when(value > 0, value)


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).when(url.startswith("/"), F.concat(F.lit(base), url))


def cosine(a: Column, b: Column) -> Column:
    """Of two unit vectors: their dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def savings(lowest: Column, highest: Column) -> tuple[Column, Column]:
    """(amount, whole percent of the highest); 0 without a positive highest price."""
    amount = F.round(highest - lowest, 2)
    return amount, F.when(highest > 0, F.round(amount / highest * 100).cast("int")).otherwise(0)


def days_left(until: Column, today) -> Column:
    """The label of a closing day: expired, today, tomorrow, days, or the date."""
    n = F.datediff(until, F.lit(today).cast("date"))
    return F.when(n < 0, "expired").when(n == 0, "today").when(n == 1, "tomorrow").when(n <= 7, F.concat(n.cast("string"), F.lit(" days"))).otherwise(F.date_format(until, "d MMM"))
