"""Text functions as column expressions: normalisation, ordered rules, numbers and units in text, tags, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def normal_name(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ordered_rules(texts: Sequence[Column], rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that the first text matches, else the second text, and so on."""
    found = []
    for text in texts:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern in rules:
            chain = chain.when(text.rlike("(?i)" + pattern), name)
        found.append(chain)
    return F.coalesce(*found, F.lit(otherwise))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The entry of a short fixed table, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key) if table else key


def clean_tags(text: Column, aliases: Mapping[str, str]) -> Column:
    """Comma-separated tags: trimmed, lower case, renamed by aliases, each once, blanks left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.array_distinct(F.transform(parts, lambda t: lookup(t, aliases)))


def leading_number(text: Column) -> Column:
    """The number a text begins with, like 1.056 of '1.056 SG'; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*(-?[0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).try_cast("double")


def number_range(text: Column) -> Column:
    """'39 - 48%', '1,0 - 1,7', '<1%' or '12' as struct<lo, hi>, in order; null without a number."""
    plain = F.replace(text, F.lit(","), F.lit("."))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"([0-9]+(?:[.][0-9]+)?)"), 1), lambda x: x.cast("double"))
    first, second = F.get(numbers, F.lit(0)), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)))
    return F.when(F.size(numbers) > 0, F.struct(F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi")))


def labelled_number(text: Column, label: str, reach: int = 40) -> Column:
    """The first number at most ``reach`` characters after a label."""
    return F.nullif(F.regexp_extract(text, rf"(?is)(?<![A-Za-z]){label}\b.{{0,{reach}}}?(-?[0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).try_cast("double")


def in_unit(text: Column, factors: Mapping[str, float], default: str) -> Column:
    """A quantity with a unit, times the unit's factor: in_unit('10 lb', {'lb': 0.4536, 'kg': 1}) is 4.536."""
    units = "|".join(sorted(factors, key=len, reverse=True))
    value = leading_number(F.replace(text, F.lit(","), F.lit("")))
    unit = F.lower(F.regexp_extract(text, rf"(?i)[0-9.]\s*({units})\b", 1))
    rate = F.create_map(*[F.lit(x) for k, v in factors.items() for x in (k, float(v))])
    return value * F.coalesce(rate[unit], F.lit(float(factors[default])))


#: Weights in kilograms and grams, volumes in litres, by unit.
KILOGRAMS = {"kg": 1.0, "g": 0.001, "lb": 0.45359237, "lbs": 0.45359237, "oz": 0.028349523125}
GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237, "lbs": 453.59237}
LITRES = {"l": 1.0, "liters": 1.0, "litres": 1.0, "ml": 0.001, "gal": 3.785411784, "gallon": 3.785411784, "gallons": 3.785411784, "qt": 0.946352946}


def strip_tags(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags out, the common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of the links of a page, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"']+)["']"""), 1))


def lexicon_strength(texts: Sequence[Column], terms: Mapping[str, str]) -> Column:
    """For each term (name, pattern) that occurs: struct<name, strength>, where strength counts the texts that hold it."""
    entries = [F.struct(F.lit(n).alias("name"), sum((F.coalesce(t.rlike("(?i)" + p), F.lit(False)).cast("int") for t in texts), F.lit(0)).alias("strength")) for n, p in terms.items()]
    return F.filter(F.array(*entries), lambda e: e["strength"] > 0)


def file_name(text: Column) -> Column:
    """A safe file name: letters, digits, blanks, _ and - stay; runs of blanks become one -; lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, "(?i)[^a-z0-9 _-]", "")), r"\s+", "-"))


def shortened(text: Column, most: int = 260) -> Column:
    return F.substring(text, 1, most)


def last_year(text: Column) -> Column:
    """The year that a date like 09/2010 ends with; null where its last four characters are no number."""
    return F.right(text, F.lit(4)).try_cast("int")


def export_link(html: Column, key: Column, site: str, kind: str) -> Column:
    """The address of a page's export of some kind: the first link that names it, made absolute, else the usual one for the key."""
    found = F.nullif(F.regexp_extract(html, rf'(?i)href="([^"]*{kind}[^"]*)"', 1), F.lit(""))
    whole = F.when(found.startswith("http"), found).otherwise(F.concat(F.lit(site), found))
    usual = F.when(key.isNotNull() & (key != ""), F.concat(F.lit(f"{site}/homebrew/recipe/{kind}1.0/"), key))
    return F.coalesce(whole, usual)


def labelled_words(text: Column, label: str, ends: str) -> Column:
    """The words after a label, up to two blanks or one of the words in ``ends`` (a pattern); null without."""
    words = F.regexp_extract(text, rf"{label}:?\s+([\p{{L}}0-9 .'&/-]+?)(?:\s{{2,}}|\s(?:{ends})\b)", 1)
    return blank_to_null(words)
