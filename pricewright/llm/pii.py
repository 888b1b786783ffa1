"""Format-preserving pseudonyms for personal data, by DataFrame functions alone.

One pattern cuts a text into plain segments and candidates. A candidate that validates (check digits, calendar,
ranges) is permuted within its own format by a keyed Feistel network, so equal values stay equal across documents, in
whatever accepted form they are written, and different ones stay different; anything else stays as it was. Addresses and
secrets, which have no finite format of numbers, get a keyed digest; two of them share one with a chance of 2**-64.

No pattern repeats a group without bound unless the repeat is possessive, which the regex engine does in a loop; a greedy
one recurses once a repeat and ends a long text with a stack overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

ROUNDS = 5
#: Stands for a secret key of the installation; real runs pass their own.
DEMO_KEY = "pricewright-demo-key"
#: The session's setting that names the key of the pipeline.
KEY_SETTING = "spark.pricewright.pii.key"

#: What candidates look like. A candidate never starts or ends inside a longer run of letters or digits.
START, END = r"(?<![\p{L}0-9])", r"(?![\p{L}0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A label before a value, and what a value may hold. After a colon, a value without any digit is taken for a word.
LABEL = r"(?i:password|passwd|pwd|api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token)"
VALUE = r"[^\s\"'<>,;&]"
SHAPES = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++",
    "pem": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[^-]*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----",
    "labelled": START + LABEL + r"[\"']?[ \t]{0,3}(?:=|:(?=[ \t]{0,3}[\"']?" + VALUE + r"{0,200}[0-9]))[ \t]{0,3}[\"']?" + VALUE + r"{6,}+",
    "secret": START + r"(?:[Aa][Kk][Ii][Aa][0-9A-Za-z]{16}|[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:sk|pk|ghp|gho|xox[abp])[_-][0-9A-Za-z_-]{16,}|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)" + END,
    "iban": START + r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)" + END,
    "ip": r"(?<![\p{L}0-9.])(?<!(?i:version|release|section|chapter|ver|rev|v)[ .]{0,2})(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\.?[0-9])" + END,
    "date": START + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + END,
    "ssn": START + r"(?:(?i:ssn|social security(?: number)?)[:# ]{1,3}[0-9]{3} [0-9]{2} [0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})" + END,
    "phone": r"(?<![\p{L}0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + END,
    "card": START + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + END,
}
#: Country codes of telephone numbers, none of which begins another; those not named have three digits.
COUNTRY_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Lengths of IBANs by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
)
ANY = "|".join(SHAPES.values())
WHOLE = {k: rf"^(?:{v})$" for k, v in SHAPES.items()}
#: Days of 1800-01-01 to 2199-12-31, one cycle of the calendar, as 189 x 773.
EPOCH, DAY_SIDES = "1800-01-01", (189, 773)
#: Valid area x group numbers and serial numbers of a social security number.
SSN_SIDES = (898 * 99, 9999)


def _prf(key: str, tweak: str, rnd: Column, value: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), rnd.cast("string"), value.cast("string"), size.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of (left < a, right < b): each round adds a function of one side to the other, modulo its size."""

    def step(s, i):
        new = F.pmod(s["l"] + _prf(key, tweak, i * 2, s["r"], a), a)
        return F.struct(new.alias("l"), F.pmod(s["r"] + _prf(key, tweak, i * 2 + 1, new, b), b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another digit string of the same length, 2 to 36 digits."""
    n = F.length(digits)
    m = F.ceil(n / 2).cast("int")
    k = n - m
    got = feistel(F.substring(digits, F.lit(1), m), F.substring(digits, m + 1, k), _pow10(m), _pow10(k), key, tweak)
    return let(got, lambda s: F.concat(F.lpad(s["l"].cast("string"), m, "0"), F.lpad(s["r"].cast("string"), k, "0")))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def lay_out(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    at = lambda i: F.length(digits_of(F.substring(shape, F.lit(1), i + 1)))
    put = lambda d: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(d, at(i), F.lit(1))).otherwise(c)), "")
    return let(digits, put)


def luhn_sum(digits: Column) -> Column:
    """Of digits whose last one counts once."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda x, y: x + y)


def _card(m: Column, key: str) -> Column:
    digits = digits_of(m)

    def swapped(d):
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(digits, lambda d: F.when(luhn_sum(d) % 10 == 0, lay_out(m, swapped(d))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; a number without one is of the same plan as those of code 1, and equal to them."""

    def moved(digits):
        code = F.when(m.startswith("+"), F.regexp_extract(digits, f"^({COUNTRY_CODE})", 1)).otherwise(F.lit(""))
        new = let(code, lambda c: let(F.substring(digits, F.length(c) + 1, F.length(digits)), lambda rest: F.concat(c, permute_digits(rest, key, "phone"))))
        return F.when(F.length(digits).between(8, 15), lay_out(m, new)).otherwise(m)

    return let(digits_of(m), moved)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    side = F.lit(65536).cast("long")
    got = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], side, side, key, "ip")
    octets = lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256)))
    return let(got, octets)


def _moved_day(day: Column, key: str) -> Column:
    """Another day of the cycle, before the 13th of a month if and only if this one is.

    The permutation of all days is walked until it comes back to days of that kind, which permutes them. Kinds make a
    date that only one order of day and month can mean stay one. A walk of 128 steps never runs out in practice.
    """
    a, b = (F.lit(x).cast("long") for x in DAY_SIDES)
    late = F.dayofmonth(day) > 12

    def moved(d):
        n = F.datediff(d, F.lit(EPOCH).cast("date")).cast("long")
        got = feistel(F.floor(n / b), n % b, a, b, key, "date")
        return let(got, lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s["l"] * b + s["r"]).cast("int")))

    step = lambda s, _: F.when(s["walked"] & ((F.dayofmonth(s["d"]) > 12) == late), s).otherwise(F.struct(moved(s["d"]).alias("d"), F.lit(True).alias("walked")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), F.struct(day.alias("d"), F.lit(False).alias("walked")), step)["d"]


def _date(m: Column, key: str) -> Column:
    """ISO, day.month.year and day/month/year; the last also month/day/year where only that is a date."""
    ok = lambda d: d.isNotNull() & F.year(d).between(1800, 2199)

    def swap(parse: str, fmt: str, short: str):
        day = F.try_to_date(m, parse)
        moved = _moved_day(day, key)
        return ok(day), F.when(F.length(m) == 10, F.date_format(moved, fmt)).otherwise(F.date_format(moved, short))

    iso, dot = swap("yyyy-MM-dd", "yyyy-MM-dd", "yyyy-MM-dd"), swap("d.M.yyyy", "dd.MM.yyyy", "d.M.yyyy")
    slash, us = swap("d/M/yyyy", "dd/MM/yyyy", "d/M/yyyy"), swap("M/d/yyyy", "MM/dd/yyyy", "M/d/yyyy")
    named = F.when(m.contains("-"), F.when(iso[0], iso[1]).otherwise(m)).when(m.contains("."), F.when(dot[0], dot[1]).otherwise(m))
    return named.otherwise(F.when(slash[0], slash[1]).when(us[0], us[1]).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    digits = digits_of(m)
    area, group, serial = (F.substring(digits, p, n).cast("long") for p, n in ((1, 3), (4, 2), (6, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    a, b = (F.lit(x).cast("long") for x in SSN_SIDES)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    got = feistel(left, serial - 1, a, b, key, "ssn")

    def shown(s):
        x = F.floor(s["l"] / 99) + 1
        return F.format_string("%03d%02d%04d", x + F.when(x >= 666, 1).otherwise(0), s["l"] % 99 + 1, s["r"] + 1)

    return F.when(good, lay_out(m, let(got, shown))).otherwise(m)


def _iban_mod(text: Column) -> Column:
    """The number of an IBAN, country and check digits last, modulo 97."""
    moved = F.filter(F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    """The letters stay. What follows the length of a known country isn't part of the number; in small letters only those count."""

    def swapped(x):
        def of(flat):
            country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
            check = lambda new: F.lpad((F.lit(98) - _iban_mod(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
            moved = lambda b, d: let(lay_out(b, permute_digits(d, key, "iban")), lambda new: lay_out(x, digits_of(F.concat(check(new), new))))
            return F.when(_iban_mod(flat) == 1, let(body, lambda b: let(digits_of(b), lambda d: F.when(F.length(d).between(2, 36), moved(b, d)))))

        return let(F.upper(F.regexp_replace(x, " ", "")), of)

    size = F.element_at(F.create_map(*[F.lit(x) for c in IBAN_LENGTHS.split() for x in (c[:2], int(c[2:]))]), F.upper(F.substring(m, 1, 2)))
    own = F.regexp_substr(m, F.concat(F.lit("^(?:[A-Za-z0-9] ?){"), (size - 1).cast("string"), F.lit("}[A-Za-z0-9]")))
    known = let(own, lambda x: F.when(x.isNotNull(), F.concat(swapped(x), F.substring(m, F.length(x) + 1, F.length(m)))))
    return F.coalesce(known, F.when(m == F.upper(m), swapped(m)), m)


def _keyed(m: Column, key: str, tweak: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), m), 256)


def _email(m: Column, key: str) -> Column:
    """A keyed name at a keyed host of a reserved domain; equal hosts stay equal, letter case doesn't count."""
    low = F.lower(m)
    return F.concat(F.substring(_keyed(low, key, "email"), 1, 24), F.lit("@"), F.substring(_keyed(F.regexp_extract(low, "@(.*)$", 1), key, "host"), 1, 16), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    """Digits of a keyed digest, as many as the value has characters; letter case doesn't count."""
    pieces = lambda seed: F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int")), lambda i: F.sha2(F.concat_ws(":", seed, i.cast("string")), 256))
    fill = F.substring(let(_keyed(F.lower(m), key, "secret"), lambda seed: F.array_join(pieces(seed), "")), F.lit(1), F.length(m))
    return let(fill, lambda x: F.when(m == F.upper(m), F.upper(x)).otherwise(x))


def _labelled(m: Column, key: str) -> Column:
    """The label stays."""
    head = F.regexp_extract(m, r"^([^=:]*[=:][ \t]*[\"']?)", 1)
    return F.concat(head, _secret(F.substring(m, F.length(head) + 1, F.length(m)), key))


def _pem(m: Column, key: str) -> Column:
    """The lines that begin and end the key stay."""
    return F.concat(F.regexp_extract(m, "^(-----BEGIN [^-]*-----)", 1), F.lit("\n"), _keyed(F.regexp_replace(m, r"\s", ""), key, "pem"), F.lit("\n"), F.regexp_extract(m, "(-----END [^-]*-----)$", 1))


MAKERS = {"email": _email, "pem": _pem, "labelled": _labelled, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """Of one candidate; the first shape that fits it whole decides."""
    out = None
    for kind, make in MAKERS.items():
        fits = m.rlike(WHOLE[kind])
        out = F.when(fits, make(m, key)) if out is None else out.when(fits, make(m, key))
    return out.otherwise(m)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``text`` with every validated value replaced; other columns stay, ``count`` names a column for how many changed.

    Null texts stay null (count 0), empty ones empty. Candidates that don't validate stay as they are. Repeated rows
    and rows of equal values change alike. Texts of any length go through whole; no shuffle and no Python.
    """
    c = F.col(text)
    # Every shape but that of some secrets holds one of these; texts without skip the patterns.
    busy = c.rlike("[0-9@=]|-----BEGIN") | c.rlike(SHAPES["secret"])
    found = F.when(busy, F.regexp_extract_all(c, F.lit(ANY), F.lit(0)))
    plain = F.when(busy, F.split(c, ANY, -1))
    names = dict(zip(("found", "plain", "new"), fresh(docs, "pw_found", "pw_plain", "pw_new"), strict=True))
    rows = docs.withColumns({names["found"]: found, names["plain"]: plain})
    rows = rows.withColumn(names["new"], F.transform(F.col(names["found"]), lambda m: pseudonym(m, key)))
    joined = F.array_join(F.flatten(F.zip_with(F.col(names["plain"]), F.col(names["new"]), lambda s, p: F.array(s, F.coalesce(p, F.lit(""))))), "")
    out = rows.withColumn(text, F.when(F.size(F.col(names["found"])) > 0, joined).otherwise(c))
    if count:
        changed = F.size(F.filter(F.zip_with(F.col(names["found"]), F.col(names["new"]), lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count, F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)))
    return out.drop(*names.values())


def op10_feistel_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY, count="n_replaced").select("doc_id", "text", "n_replaced")
