"""Style statistics, tags, bills, aroma and oil profiles, and imported recipes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.steps import dealt, worked_out
from . import domain, text, units

# Results depend on these names, patterns and limits.

NAME_TAGS = [
    ("sour", r"sour|gose|lambic|gueuze|berliner|flanders|brett|wild"),
    ("smoke", r"smoke|rauch"),
    ("wood", r"wood|barrel"),
    ("wheat-beer-family", r"wheat|weiss|weizen|wit"),
    ("ipa-family", r"ipa|india pale"),
    ("stout-family", r"stout"),
    ("porter-family", r"porter"),
    ("pilsner-family", r"pilsner|pilsener|pils"),
    ("bock-family", r"bock"),
]

AROMA_AXES = ["Citrus", "Resin/Pine", "Spice", "Herbal", "Grassy", "Floral", "Berry", "Stone Fruit", "Tropical Fruit"]

DESCRIPTOR_AXES = {
    "citrus": "Citrus",
    "piney": "Resin/Pine",
    "dank": "Resin/Pine",
    "floral": "Floral",
    "herbal": "Herbal",
    "earthy": "Herbal",
    "spicy hops": "Spice",
    "tropical fruit": "Tropical Fruit",
    "melon": "Tropical Fruit",
    "stone fruit": "Stone Fruit",
    "berry": "Berry",
}

NOTE_AXES = [
    ("Citrus", r"citrus|grapefruit|orange|lemon|lime|tangerine|mandarin"),
    ("Resin/Pine", r"pine|resin|dank"),
    ("Spice", r"spice|spicy|pepper|anise"),
    ("Herbal", r"herbal|tea|mint|sage|woody|tobacco|earth"),
    ("Grassy", r"grass|green|hay"),
    ("Floral", r"floral|flower|rose|lavender|elderflower|blossom"),
    ("Berry", r"berry|currant|blueberry|strawberry|raspberry"),
    ("Stone Fruit", r"stone fruit|peach|apricot|cherry|plum"),
    ("Tropical Fruit", r"tropical|mango|passion|pineapple|melon|guava|papaya|coconut|lychee"),
]

HOMELANDS = {
    "central-europe": ["Germany", "Czech Republic", "Slovenia", "Austria", "Poland", "France"],
    "eastern-europe": ["Czech Republic", "Poland", "Slovenia"],
    "british-isles": ["United Kingdom", "UK", "England"],
    "north-america": ["United States", "USA", "Canada"],
    "pacific": ["Australia", "New Zealand"],
    "western-europe": ["Belgium", "France", "Germany", "United Kingdom", "UK"],
}

NEW_WORLD = ["United States", "USA", "Canada", "Australia", "New Zealand"]

OIL_LIMITS = {
    "myrcene": (10, 85),
    "humulene": (0, 50),
    "caryophyllene": (0, 22),
    "farnesene": (0, 25),
    "geraniol": (0, 6),
    "linalool": (0, 3.5),
}

# End of the fixed values.

RANGE = "struct<lo:double,hi:double>"
RECIPE_JSON = """name string, og string, estimatedOg string, fg string, estimatedFg string, abv string, ibu string, estimatedIbu string,
    srm string, estimatedSrm string, color string, estimatedColor string, ebc string,
    yeasts array<struct<name:string,type:string,form:string>>, fermentables array<struct<name:string,amount:double>>,
    hops array<struct<name:string,amount:double,use:string,time:double>>"""


def middle(box: Column) -> Column:
    return (box["lo"] + box["hi"]) / 2


def sanitised(og: Column, fg: Column, abv: Column, ibu: Column, srm: Column) -> dict[str, Column]:
    """Style ranges without catch-alls; a missing final gravity is estimated from strength and original gravity."""
    og = F.when(~((og["lo"] <= 1.0) | ((og["lo"] <= 1.005) & (og["hi"] >= 1.1))), og)
    fg = F.when(~((fg["lo"] < 0.98) | F.coalesce(fg["hi"] > og["hi"], F.lit(False))), fg)
    abv = F.when(~((abv["lo"] <= 0) & (abv["hi"] >= 20)), abv)
    ibu = F.when(~((ibu["lo"] <= 0) & (ibu["hi"] >= 95)), ibu)
    srm = F.when(~((srm["lo"] <= 0) & (srm["hi"] >= 50)), srm)
    ends = [F.round(og[x] - abv[x] / 131.25, 3) for x in ("lo", "hi")]
    guess = F.when(og.isNotNull() & abv.isNotNull(), F.struct(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi")))
    return {"og": og, "fg": F.coalesce(fg, guess), "abv": abv, "ibu": ibu, "srm": srm}


def derived_tags(name: Column, og: Column, abv: Column, ibu: Column, srm: Column, yeast: Column | None = None) -> Column:
    """Tags of strength, colour, balance, yeast and name; unknown numbers give none."""
    strength = F.when(abv < 4.3, "session-strength").when(abv < 6.3, "standard-strength").when(abv < 9.0, "high-strength").when(abv >= 9.0, "very-high-strength")
    colour = F.when(srm < 9, "pale-color").when(srm < 20, "amber-color").when(srm >= 20, "dark-color")
    ratio = F.when(og > 1, ibu / ((og - 1) * 1000))
    balance = F.when(ratio >= 0.85, "hoppy").when(ratio <= 0.45, "malty").when(ratio.isNotNull(), "balanced")
    found = [strength, colour, balance]
    if yeast is not None:
        y = F.lower(yeast)
        found += [
            F.when(y.contains("lager"), "bottom-fermented").when(y.rlike("ale|wheat"), "top-fermented").when(y.rlike("brett|wild"), "wild-fermented"),
            F.when(y.contains("lager"), "lagered"),
        ]
    found += [F.when(F.lower(name).rlike(p), t) for t, p in NAME_TAGS]
    return F.array_compact(F.array(*found))


def malt_key(name: Column) -> Column:
    """One key for the spellings of a malt."""
    for pattern, by in ((r"weyernmann|weyermann|simpsons|thomas fawcett|crisp\b", ""), (r"\bmalt\b", ""), (r"\btype\s*(\d)", "$1"), (r"\boats?\b", "oat"), (r"[^a-z0-9]+", " ")):
        name = F.regexp_replace(F.lower(name), pattern, by)
    return F.trim(name)


def grist(malts: Column) -> Column:
    """array<struct<name, kg>> with classes and percentages of the bill; 0 where nothing weighs."""
    total = F.aggregate(malts, F.lit(0.0), lambda s, m: s + m["kg"])
    share = lambda m: F.when(total > 0, F.round(m["kg"] / total * 100, 1)).otherwise(0.0)
    return F.transform(malts, lambda m: F.struct(m["name"].alias("name"), F.round(m["kg"], 3).alias("kg"), domain.malt_class(m["name"]).alias("class"), share(m).alias("pct")))


def grist_share(malts: Column, *classes: str) -> Column:
    return F.aggregate(F.filter(malts, lambda m: m["class"].isin(*classes)), F.lit(0.0), lambda s, m: s + m["pct"])


def hop_dose(hops: Column, litres: Column) -> Column:
    """Grams a litre of all additions; null without a batch size."""
    return F.when(litres > 0, F.aggregate(hops, F.lit(0.0), lambda s, h: s + h["g"]) / litres)


def examples(listed: Column) -> Column:
    """Up to six commercial examples of a text: split, without what stands before a dash, 3 to 54 characters."""
    names = F.transform(F.split(listed, "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"^.*[–—-]\s+", "")))
    return F.slice(F.filter(names, lambda x: (F.length(x) > 2) & (F.length(x) < 55)), 1, 6)


def unit_sum(vector: Column) -> Column:
    # a lambda variable holds what is used more than once, so that it is worked out once
    def shared(v: Column) -> Column:
        return F.element_at(F.transform(F.array(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)), lambda total: F.when(total > 0, F.transform(v, lambda x: x / total))), 1)

    return F.element_at(F.transform(F.array(vector), shared), 1)


def hop_aroma(profile: Column, notes: Column) -> Column:
    """A hop's aroma on the nine axes, summing to 1: its profile, else how many of its notes name each axis."""
    def named(pattern: str) -> Column:
        return F.size(F.filter(notes, lambda n: F.lower(n).rlike(pattern))).cast("double")

    patterns = dict(NOTE_AXES)
    order = F.array(*[named(patterns[axis]) for axis in AROMA_AXES])
    return unit_sum(F.when(profile.isNotNull(), profile).when(F.size(notes) > 0, order))


def style_aroma(found: Column) -> Column:
    """What a style's descriptors (domain.descriptors) ask of its hops, on the nine axes, summing to 1."""
    def on(found: Column, axis: str) -> Column:
        names = [d for d, a in DESCRIPTOR_AXES.items() if a == axis]
        return F.aggregate(F.filter(found, lambda d: d["name"].isin(*names)), F.lit(0.0), lambda s, d: s + d["strength"]) if names else F.lit(0.0)

    return unit_sum(F.element_at(F.transform(F.array(found), lambda f: F.array(*[on(f, a) for a in AROMA_AXES])), 1))


def tradition(tags: Column, country: Column) -> Column:
    """1 for a hop of the style's homeland, 0.85 for a New World hop in a craft style, else 0.15; 0.5 if the style names no home."""
    homes = F.create_map(*[x for k, v in HOMELANDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.flatten(F.transform(F.filter(tags, lambda t: t.isin(*HOMELANDS)), lambda t: homes[t]))
    place = F.lower(F.coalesce(country, F.lit("")))
    home = F.exists(wanted, lambda h: F.contains(place, F.lower(h)))
    craft, new = F.array_contains(tags, "craft-style"), F.exists(F.array(*map(F.lit, NEW_WORLD)), lambda h: F.contains(place, F.lower(h)))
    return F.when((F.size(wanted) == 0) & ~craft, 0.5).when(home, 1.0).when(craft & new, 0.85).otherwise(0.15)


def oil_profile(first: Column, second: Column, third: Column) -> Column:
    """Oil shares of a hop from up to three producers' records (structs of texts), the likeliest reading of each field.

    The first producer's labels are sometimes shifted, so its record is read both ways; the reading that breaks the
    fewest limits wins, of equal ones the fuller, of those the first. Fields still beyond their limits are dropped,
    and gaps filled from the second, then from the third, whose amounts are millilitres in 100 g.
    """
    null = F.lit(None).cast(RANGE)
    read = lambda record, field: text.number_range(record[field]) if field else null
    ways = [
        (first, ["myrcene", "humulene", "caryophyllene", "farnesene", "geraniol", None]),
        (first, ["caryophyllene", None, "humulene", "geraniol", "farnesene", "myrcene"]),
        (second, ["myrcene", None, "caryophyllene", "farnesene", None, None]),
    ]
    inside = lambda r, f: (r["hi"] >= OIL_LIMITS[f][0]) & (r["hi"] <= OIL_LIMITS[f][1])

    # lambda variables hold what is used more than once, so that it is read once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def scored(i: int, record: Column, fields: list) -> Column:
        def of(oils: Column) -> Column:
            filled = sum((F.when(oils[f].isNotNull(), 1).otherwise(0) for f in OIL_LIMITS), F.lit(0))
            broken = sum((F.when(oils[f].isNotNull() & ~inside(oils[f], f), 1).otherwise(0) for f in OIL_LIMITS), F.lit(0))
            return F.struct(filled.alias("filled"), broken.alias("broken"), oils.alias("oils"))

        def judged(o: Column) -> Column:
            broken = o["broken"] + F.when(o["oils"]["myrcene"].isNull() & (o["filled"] >= 3), 1).otherwise(0)
            return F.when(o["filled"] > 0, F.struct((broken * 100 - o["filled"]).alias("score"), F.lit(i).alias("way"), o["oils"].alias("oils")))

        oils = F.struct(*[read(record, f).alias(name) for name, f in zip(OIL_LIMITS, fields, strict=True)])
        return once(once(oils, of), judged)

    best = F.array_min(F.array_compact(F.array(*[scored(i, *w) for i, w in enumerate(ways)])))["oils"]
    percent = lambda f, total: F.when(middle(total) != 0, middle(text.number_range(third[f])) / middle(total) * 100)
    about = lambda p: F.when(p.isNotNull(), F.struct(F.round(p * 0.85, 1).alias("lo"), F.round(p * 1.15, 1).alias("hi")))
    gaps = once(text.number_range(third["oils"]), lambda t: F.struct(*[once(percent(f, t), about).alias(f) for f in ("humulene", "farnesene")], text.number_range(third["linalool"]).alias("linalool")))

    def filled_in(all_of: Column) -> Column:
        found, last = all_of["best"], all_of["gaps"]

        def field(f: str) -> Column:
            options = [F.when(inside(found[f], f), found[f])]
            if f in ("myrcene", "caryophyllene", "farnesene"):
                options.append(once(text.number_range(second[f]), lambda r: F.when(inside(r, f), r)))
            if f in ("humulene", "farnesene", "linalool"):
                options.append(F.when(last[f]["hi"] <= OIL_LIMITS[f][1], last[f]))
            return F.coalesce(*options)

        return F.struct(*[field(f).alias(f) for f in OIL_LIMITS])

    return once(F.struct(best.alias("best"), gaps.alias("gaps")), filled_in)


def cohumulone(low: Column, high: Column, *texts: Column) -> Column:
    """A hop's cohumulone range: the measured ends if either isn't 0, else the first text that holds a range."""
    measured = F.when((F.coalesce(low, F.lit(0.0)) != 0) | (F.coalesce(high, F.lit(0.0)) != 0), F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi")))
    return F.coalesce(measured, *[text.number_range(t) for t in texts])


def import_json(exports: DataFrame, content: str, colour_unit: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Recipes of JSON exports (a recipe, or a batch that holds one), and the exports that lack gravities, bitterness or colour.

    A missing strength is computed. ``colour_unit`` (auto, srm, ebc) overrides the unit that the fields tell.
    """
    inner = F.coalesce(F.get_json_object(content, "$.recipe"), F.col(content))
    rows = worked_out(dealt(exports), r=F.from_json(inner, RECIPE_JSON))
    number = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"r.{n}")), F.lit("")).try_cast("double") for n in names])
    colour = number("srm", "estimatedSrm", "color", "estimatedColor", "ebc")
    is_ebc = F.lit(colour_unit == "ebc") | (F.lit(colour_unit == "auto") & number("srm", "estimatedSrm").isNull() & number("ebc").isNotNull())
    og, fg, ibu = number("og", "estimatedOg"), number("fg", "estimatedFg"), number("ibu", "estimatedIbu")
    good = og.isNotNull() & fg.isNotNull() & ibu.isNotNull() & colour.isNotNull()
    abv, srm = F.coalesce(number("abv"), units.alcohol(og, fg)), F.when(is_ebc, units.srm_from_ebc(colour)).otherwise(colour)
    name = F.coalesce(text.blank_to_null(F.col("r.name")), F.lit("Imported recipe"))
    yeast = F.get(F.col("r.yeasts"), F.lit(0))
    malts = F.filter(F.col("r.fermentables"), lambda f: f["name"].isNotNull() & (f["amount"] > 0))

    def hop(h: Column) -> Column:
        use = F.lower(F.coalesce(h["use"], F.lit("")))
        stage = F.when(use.contains("dry"), "dry").when(use.rlike("aroma|hopstand|whirlpool"), "late").when(use.rlike("first wort|mash"), "bittering").when(F.coalesce(h["time"], F.lit(0.0)) >= 45, "bittering").otherwise("late")
        return F.struct(h["name"].alias("name"), h["amount"].alias("g"), stage.alias("stage"))

    hops = F.transform(F.filter(F.col("r.hops"), lambda h: h["name"].isNotNull() & (h["amount"] > 0)), hop)
    keep = [c for c in exports.columns if c != content]
    found = rows.where(good).select(
        *keep,
        name.alias("name"),
        F.struct(og.alias("og"), fg.alias("fg"), abv.alias("abv"), ibu.alias("ibu"), srm.alias("srm")).alias("vitals"),
        derived_tags(name, og, abv, ibu, srm, F.coalesce(yeast["type"], yeast["form"])).alias("tags"),
        grist(F.transform(malts, lambda m: F.struct(m["name"].alias("name"), m["amount"].alias("kg")))).alias("fermentables"),
        hops.alias("hop_schedule"),
        yeast["name"].alias("yeast"),
    )
    return found, rows.where(~good).drop("r")
