"""Product names: normalisation and the features that equal products share.

Two profiles exist on purpose. ``offline`` serves matching across chains; ``catalogue`` fills the stored family columns.
They differ in units, designators, percent tokens and what an empty slug becomes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek letters in Latin ones, and the two that need more than one letter.
GREEK, LATIN = "αβγδεζηικλμνξοπρστυφχως", "abgdezhiklmnxoprstyfxos"
GREEK_PAIRS = (("θ", "th"), ("ψ", "ps"))
#: Look-alikes only, for the aggressive key.
LOOKALIKE_GREEK, LOOKALIKE_LATIN = "αβεζηικμνοπρτυχ", "abezhikmnoprtyx"

#: Units by the names that lists give them, without accents.
UNITS = {
    "g": ("γραμμαρια", "γρ.", "γρ", "gr.", "gr", "g.", "g"),
    "kg": ("κιλα", "κιλο", "κιλ.", "κιλ", "kg.", "kg"),
    "ml": ("ml.", "ml", "μλ"),
    "l": ("λιτρα", "λτ.", "λτ", "lt.", "lt", "l.", "l"),
    "τεμ": ("τεμαχια", "τεμαχιο", "τεμ.", "τεμ", "τμχ.", "τμχ", "pcs.", "pcs"),
}
#: Of the offline profile alone, all pieces.
MORE_PIECES = ("ρολλα", "ρολα", "φυλλα", "μεριδες", "μεζουρες")
VOLUMES, DESIGNATOR = ("ml", "l"), "no"
#: Words that say nothing about a variant, in Latin letters, and the chains' own labels, which are no makers.
STOPWORDS = "the of and with for in on from to at pack value new kai me se sto sthn stoys stis toy ths ton twn h o ta oi oti ena mia tem temaxio temaxia tmx fyllo fylla rolla rola merides".split()
PRIVATE_LABELS = {
    "my-gusto": ("my gusto",),
    "ab": ("ab vassilopoulos", "ab choice"),
    "pilos": ("pilos",),
    "combino": ("combino",),
    "milbona": ("milbona",),
    "solevita": ("solevita",),
    "w5": ("w5",),
    "crusti-croc": ("crusti croc", "crusti-croc"),
    "freeway": ("freeway",),
    "master-deal": ("master deal", "masterdeal"),
    "home-market": ("home market", "home masoutis"),
    "masoutis-pl": ("μασουτης",),
    "my-market-brand": ("my market",),
}
#: Makers of the worked examples. The full dictionary is a table of the installation: ``read_brands`` reads it, and every function takes it as ``brands``.
BRANDS = {
    "coca-cola": ("coca-cola", "coca cola", "cocacola"),
    "pepsi": ("pepsi",),
    "lacta": ("lacta",),
    "nirvana": ("nirvana",),
    "pampers": ("pampers",),
    "melissa": ("melissa",),
    "rio-mare": ("rio mare",),
    "kri-kri": ("kri-kri", "kri kri"),
    "dodoni": ("dodoni", "δωδωνη"),
    "fage": ("fage", "φαγε"),
    "heineken": ("heineken",),
    "mythos": ("mythos", "μυθος"),
    "red-bull": ("red bull", "redbull"),
    "comfort": ("comfort",),
    "amita": ("amita",),
    "loux": ("loux", "λουξ"),
}


#: Aliases of a maker dictionary at most; more would need a join instead of a pattern.
MOST_ALIASES = 20_000


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with marks and their plain letters, of all scripts up to Greek Extended, by canonical decomposition."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


def strip_accents(col: Column) -> Column:
    marked, plain = _accents()
    return F.regexp_replace(F.translate(col, marked, plain), r"[\u0300-\u036f]", "")


def squeeze(col: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize(col: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return squeeze(strip_accents(F.lower(col)))


def normalize_literal(text: str) -> str:
    marks = {c for c in map(chr, range(0x300, 0x370))}
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if c not in marks)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", plain)).strip()


def clean_text(col: Column) -> Column:
    """Single spaces; nothing left is null."""
    return F.nullif(squeeze(col), F.lit(""))


def to_latin(col: Column) -> Column:
    for greek, latin in GREEK_PAIRS:
        col = F.replace(col, F.lit(greek), F.lit(latin))
    return F.translate(col, GREEK + "σ", LATIN + "s")


def match_key(col: Column, fold_letters: bool = False) -> Column:
    """The aggressive key: decimal points, units glued to their number, short unit names, no marks."""
    s = F.regexp_replace(normalize(col), r"([0-9]+)[.,]([0-9]+)", "$1.$2")
    s = F.regexp_replace(s, r"([0-9])(?U:\s*)(ml|l|lt|λτ|λιτ|gr|g|γρ|κιλ|kg|τεμ|pcs|pack|τμχ)\b", "$1$2")
    for old, new in (("lt", "l"), ("λτ", "l"), ("λιτ", "l"), ("γρ", "g"), ("gr", "g")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"""[.,/()\[\]+*'"`!?]""", " ")
    return squeeze(F.translate(s, LOOKALIKE_GREEK, LOOKALIKE_LATIN) if fold_letters else s)


def _alternatives(names: Sequence[str]) -> str:
    return "|".join(re.escape(n).replace(r"\-", "-").replace(r"\ ", " ") for n in sorted(names, key=lambda n: (-len(n), n)))


#: What may stand before and after an alias in a name: white space, these marks, and a bracket that opens or closes.
MARKS = "-/.,"
BEFORE, AFTER = (rf"\s{re.escape(MARKS)}{bracket}" for bracket in (r"(\[", r")\]"))


def _at_start(names: Sequence[str]) -> str:
    """One of the names after at most one word, between separators."""
    return rf"(?U)^(?:[^\s]*[{BEFORE}])??(?:\s*)({_alternatives(names)})(?=$|[{AFTER}])"


def manufacturer(name: Column, brands: Mapping[str, Sequence[str]] = BRANDS, private: Mapping[str, Sequence[str]] = PRIVATE_LABELS) -> Column:
    """The maker whose alias leads the name, the longest alias first; a store's own label is none.

    One pattern holds all aliases, so a name is searched once however many makers there are.
    """
    folded = normalize(name)
    own = folded.rlike(_at_start([a for names in private.values() for a in names]))
    key_of = {a: k for k, names in brands.items() for a in names}
    hits = [F.regexp_extract(folded, _at_start([a for a in key_of if len(a) == n]), 1) for n in sorted({len(a) for a in key_of}, reverse=True)]
    alias = F.coalesce(*[F.nullif(h, F.lit("")) for h in hits])
    key = F.create_map(*[F.lit(x) for pair in key_of.items() for x in pair])
    return F.when(~own, F.element_at(key, alias))


def read_brands(table) -> dict[str, tuple[str, ...]]:
    """A maker dictionary from a table with the columns ``maker`` and ``alias``, one row an alias; aliases lose accents and capitals.

    Rows without either are left out. The dictionary goes into patterns, so it is for thousands of makers, not millions.
    """
    rows = table.select("maker", normalize(F.col("alias")).alias("alias")).where("maker is not null and alias <> ''").distinct().orderBy("maker", "alias").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["maker"], []).append(r["alias"])
    return {maker: tuple(aliases) for maker, aliases in found.items()}


def _unit_names(profile: str) -> dict[str, str]:
    names = {n: unit for unit, ns in UNITS.items() for n in ns}
    return names | ({n: "τεμ" for n in MORE_PIECES} if profile == "offline" else {})


def _size_pattern(profile: str) -> str:
    sized = rf"([0-9]+(?:[.,][0-9]+)?)\s*(?:({_alternatives(_unit_names(profile))})(?![a-zα-ω])" + (r"|(?<=[0-9])(no|νο)(?![a-zα-ω0-9]))" if profile == "offline" else ")")
    return (r"(?<![a-zα-ω0-9])(?:no|νο)\s*[0-9]+(?![a-zα-ω0-9.,])|" if profile == "offline" else "") + sized


def size(name: Column, profile: str = "offline") -> Column:
    """struct(value, unit): a designator such as No7 if there is one, else the last volume, else the last size; null if none."""
    found = F.regexp_extract_all(normalize(name), F.lit(_size_pattern(profile)), F.lit(0))
    units = _unit_names(profile)
    unit_of = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])

    def parse(m):
        number = F.regexp_extract(m, r"[0-9]+(?:[.,][0-9]+)?", 0)
        word = F.trim(F.regexp_replace(m, r"^[0-9]+(?:[.,][0-9]+)?\s*", ""))
        unit = F.when(m.rlike(r"^(?:no|νο)|(?:no|νο)$"), F.lit(DESIGNATOR)).otherwise(F.element_at(unit_of, word))
        return F.struct(F.replace(number, F.lit(","), F.lit(".")).cast("double").alias("value"), unit.alias("unit"))

    sizes = F.filter(F.transform(found, parse), lambda s: (s["unit"] != DESIGNATOR) | (s["value"] == F.floor(s["value"])))
    last = lambda keep: F.try_element_at(F.filter(sizes, keep), F.lit(-1))
    return F.coalesce(last(lambda s: s["unit"] == DESIGNATOR), last(lambda s: s["unit"].isin(*VOLUMES)), F.try_element_at(sizes, F.lit(-1)))


PACK = {"offline": r"(?<![a-z0-9])([0-9]{1,2})\s*[x×χ]\s*(?=[0-9])", "catalogue": r"(?<![a-zα-ω0-9])([0-9]{1,2})\s*[x×χ]\s*(?=[0-9])"}
FREE = r"\+\s*([0-9]{1,2})\s*(?:δωρο|free|gift)"


def pack_count(name: Column, profile: str = "offline") -> Column:
    """The N of ``Nx`` before a digit, 1 to 48, and up to 12 given free on top; else 1."""
    folded = normalize(name)
    n = F.regexp_extract(folded, PACK[profile], 1).try_cast("int")
    free = F.regexp_extract(folded, FREE, 1).try_cast("int")
    return F.when(n.between(1, 48), n).otherwise(1) + F.when(free.between(1, 12), free).otherwise(0)


def variant_tokens(name: Column, maker: Column, brands: Mapping[str, Sequence[str]] = BRANDS, profile: str = "offline") -> Column:
    """The words of a name that are left without maker, size, pack, numbers and fillers; sorted, each once.

    The offline profile keeps percentages, such as the fat of yoghurt.
    """
    s = normalize(name)
    aliases = [a for names in brands.values() for a in names]
    key_of = F.create_map(*[F.lit(x) for k, names in brands.items() for a in names for x in (a, k)])
    around = rf"(?:^|(?<=[{BEFORE}]))({_alternatives(aliases)})(?=$|[{AFTER}])"
    there = F.regexp_extract_all(s, F.lit(around), F.lit(1))
    own = F.filter(F.array_distinct(there), lambda a: F.element_at(key_of, a) == maker)
    s = F.aggregate(F.coalesce(own, F.array().cast("array<string>")), s, lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(rf"(?:^|(?<=[{BEFORE}]))\Q"), a, F.lit(rf"\E(?=$|[{AFTER}])")), F.lit(" ")))
    percents = F.array().cast("array<string>")
    if profile == "offline":
        number = F.regexp_extract_all(s, F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*%"), F.lit(1))
        percents = F.transform(number, lambda n: F.concat(F.regexp_replace(F.replace(n, F.lit(","), F.lit(".")), r"\.0$", ""), F.lit("%")))
        s = F.regexp_replace(s, r"[0-9]+(?:[.,][0-9]+)?\s*%", " ")
    for pattern in (PACK[profile], r"\b[0-9]{1,2}\s*[x×]\b", _size_pattern(profile), FREE, r"\b[0-9]+(?:[.,][0-9]+)?\b", r"\bx\b"):
        s = F.regexp_replace(s, pattern, " ")
    words = F.split(to_latin(s), "[^a-zα-ω0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.concat(kept, percents)))


def variant_slug(tokens: Column, profile: str = "offline") -> Column:
    """The first four tokens joined by hyphens; without any ``x``, or null in the catalogue profile."""
    joined = F.array_join(F.slice(F.array_sort(tokens), 1, 4), "-")
    if profile == "catalogue":
        return F.nullif(joined, F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9%]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit("x"))


def size_part(size: Column) -> Column:
    whole = size["value"] == F.floor(size["value"])
    number = F.when(whole, size["value"].cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", size["value"]), r"(\.[0-9]*?)0+$", "$1"))
    return F.when(size.isNull(), F.lit("nosize")).otherwise(F.concat(number, size["unit"]))


def canonical_key(maker: Column, tokens: Column, size: Column, pack: Column) -> Column:
    """maker:slug:size:pack, null without a maker."""
    return F.concat(maker, F.lit(":"), variant_slug(tokens), F.lit(":"), size_part(size), F.lit(":"), pack.cast("string"))


def features(name: str = "name", brands: Mapping[str, Sequence[str]] = BRANDS, profile: str = "offline") -> dict[str, Column]:
    """Columns of the feature bundle, to be added in this order with ``withColumns`` one after the other."""
    n = F.col(name)
    return {
        "manufacturer": manufacturer(n, brands),
        "size": size(n, profile),
        "pack": pack_count(n, profile),
        "variant_tokens": variant_tokens(n, F.col("manufacturer"), brands, profile),
        "canonical_key": canonical_key(F.col("manufacturer"), F.col("variant_tokens"), F.col("size"), F.col("pack")),
    }


def with_features(df, name: str = "name", brands: Mapping[str, Sequence[str]] = BRANDS, profile: str = "offline"):
    for c, expr in features(name, brands, profile).items():
        df = df.withColumn(c, expr)
    return df
