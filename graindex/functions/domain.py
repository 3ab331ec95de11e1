"""Rules of the recipe domain: fixed word lists and patterns, and the column expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import leading_number, lookup, ordered_rules

# Results depend on these rules, their wording and their order.

MALT_CLASSES = [
    ("roasted", r"black|roast|chocolate|carafa|patent|midnight"),
    ("crystal & caramel", r"crystal|caramalt|caramel|carapils|carahell|caramunich|carared|caraaroma|carabelge|dextrin|special [bw]|t50|double roasted"),
    ("wheat, oats & rye", r"wheat|oat|rye|spelt|torrified|flaked (barley|maize|corn|rice)"),
    ("sugars & adjuncts", r"sugar|dextrose|glucose|honey|lactose|maple|molasses|treacle|candi|syrup|raisins?|fruit"),
    ("smoked", r"smoke|rauch|peat"),
    ("base", r"pale|pilsner|pils|maris|munich|vienna|golden promise|ale malt|lager malt|extra pale|propino|2.row|low colour|amber|brown|mild"),
]

STAGES = [
    ("dry", r"dry|fv|hd\d|secondary|maturation|wood ageing"),
    ("bittering", r"start|first wort|fwh|mash"),
    ("late", r"end|flame|whirlpool|whp|hopstand|hop stand|aroma|kettle|middle|additions"),
]

FAMILIES = [
    ("barley wine", r"barley ?wine"),
    ("stout", r"stout"),
    ("porter", r"porter"),
    ("sour & wild", r"sour|berliner|gose\b|lambic|brett|wild|kettle-?soured"),
    ("wheat & wit", r"wheat|weizen|weisse|witbier|\bwit\b|hefe"),
    ("saison & farmhouse", r"saison|farmhouse|biere de garde"),
    ("belgian", r"belgian|abbey|dubbel|tripel|quad|trappist"),
    ("ipa", r"\bipa\b|india pale ale"),
    ("red & amber", r"\bred ale\b|amber|irish red|\bred\b"),
    ("brown & dark ale", r"brown ale|dark ale|old ale|\bmild\b"),
    ("scotch & strong ale", r"scotch|wee heavy|strong ale|barrel-aged ale"),
    ("lager & pilsner", r"lager|pilsner|pilsener|helles|bock|kolsch|k[öo]lsch|steam beer|zwickel"),
    ("golden & blonde", r"golden ale|blonde?\b"),
    ("pale ale", r"pale ale|\bapa\b|bitter\b"),
]

HOP_ALIASES = {
    "columbus": "ctz",
    "columbus tomahawk": "ctz",
    "zeus": "ctz",
    "h blanc": "hallertau blanc",
    "hallertauer blanc": "hallertau blanc",
    "fuggles": "fuggle",
    "east kent goldings": "east kent golding",
    "styrian goldings": "styrian golding",
    "equinox": "ekuanot",
    "tettnang": "tettnanger",
    "h mittelfruh": "hallertauer mittelfruh",
    "hallertau mittelfruh": "hallertauer mittelfruh",
    "hallertau tradition": "hallertauer tradition",
    "german cascade": "cascade",
    "saphire": "saphir",
    "tomahawk": "ctz",
    "dana": "extra styrian dana",
    "hallertau hersbrucker": "hersbrucker",
    "hersbrucker hallertau": "hersbrucker",
    "hallertau": "hallertauer mittelfruh",
    "hallertauer": "hallertauer mittelfruh",
    "kent goldings": "east kent golding",
    "kent golding": "east kent golding",
    "goldings": "goldings",
    "spalt": "spalter",
    "spalt select": "spalter select",
    "brewer s gold": "brewers gold",
    "millenium": "millennium",
    "williamette": "willamette",
    "lemon drop": "lemondrop",
    "styrian goldings celeia": "celeia",
}

#: Aliases of producers' spellings.
PRODUCER_ALIASES = {
    "columbus": "ctz",
    "columbus tomahawk": "ctz",
    "zeus": "ctz",
    "east kent goldings": "east kent golding",
    "tettnang tettnanger": "tettnanger",
    "spalt spalter": "spalter",
    "whitbread goldings variety": "whitbread golding",
    "styrian savinjski golding": "styrian golding",
    "savinjski golding": "styrian golding",
    "hallertauer mittelfr h": "hallertauer mittelfruh",
    "hallertau mittelfr h": "hallertauer mittelfruh",
    "hallertau mittelfrueh": "hallertauer mittelfruh",
    "strisselspalter": "strisselspalt",
    "golding": "goldings",
}

FERMENTATION_TAGS = [("wild-fermented", "Wild & sour"), ("bottom-fermented", "Lager"), ("top-fermented", "Ale")]
FERMENTATION_WORDS = [
    ("Wild & sour", r"sour|lambic|gueuze|brett|wild"),
    ("Lager", r"lager|pils|bock|helles|m[äa]rzen|schwarz|dunkel|kellerbier|zwickel"),
    ("Ale", r"ale|ipa|stout|porter|bitter|saison|weiss|weizen|wit"),
]
ANY_FERMENTATION = "Any yeast / specialty"

#: A yeast's product code.
YEAST_CODE = r"\b(wlp ?\d{3,4}|wy ?\d{4}|[a-z]{1,2}-\d{2,3}|34/70|\d{4})\b"

STOP_WORDS = ["style", "beer", "ale", "lager", "or", "and"]

TOKEN_ALIASES = {
    "pils": "pilsner",
    "pilsener": "pilsner",
    "munchner": "munich",
    "muenchner": "munich",
    "maerzen": "marzen",
    "oktoberfest": "marzen",
    "wiesn": "marzen",
    "hefeweizen": "weizen",
    "weissbier": "weizen",
    "hefeweissbier": "weizen",
    "dunkles": "dunkel",
    "heller": "helles",
    "koelsch": "kolsch",
    "english": "british",
    "blond": "blonde",
}

GENERIC_TOKENS = [
    "mixed", "wild", "specialty", "strong", "fruit", "spice", "spiced", "smoked",
    "sour", "amber", "dark", "pale", "light", "golden", "blonde", "brown", "red",
    "cream", "common", "session", "imperial", "double", "extra", "special",
    "ordinary", "robust", "sweet", "dry", "old", "other", "wheat", "rye",
]

LEXICON = [
    ("malt", "bready", r"\bbread|doughy\b"),
    ("malt", "biscuity", r"\bbiscuit"),
    ("malt", "toasty", r"\btoast"),
    ("malt", "grainy", r"\bgrain(y|-like)|\bcereal\b"),
    ("malt", "caramel", r"\bcaramel"),
    ("malt", "toffee", r"\btoffee"),
    ("malt", "nutty", r"\bnut(ty|-like)"),
    ("malt", "honey", r"\bhoney"),
    ("malt", "molasses", r"\bmolasses|\btreacle"),
    ("malt", "chocolate", r"\bchocolate|\bcocoa"),
    ("malt", "coffee", r"\bcoffee|\bespresso"),
    ("malt", "roasty", r"\broast"),
    ("malt", "burnt", r"\bburnt|\bcharred|\bacrid"),
    ("malt", "smoky", r"\bsmok(e|y|ed)|\brauch"),
    ("malt", "corn-like", r"\bcorn(y|-like)?\b|\bdms\b"),
    ("hops", "citrus", r"\bcitrus|\bgrapefruit|\borange\b|\blemon|\blime\b"),
    ("hops", "piney", r"\bpine|\bresin"),
    ("hops", "floral", r"\bfloral|\bflower|\bperfum"),
    ("hops", "spicy hops", r"\bspicy hop|\bpepper(y)? hop|hop.{0,12}spic"),
    ("hops", "herbal", r"\bherbal|\bgrass(y)?\b|\bminty?\b"),
    ("hops", "earthy", r"\bearth(y|iness)"),
    ("hops", "tropical fruit", r"\btropical|\bmango|\bpassion ?fruit|\bpineapple|\bguava"),
    ("hops", "stone fruit", r"\bstone fruit|\bpeach|\bapricot|\bnectarine"),
    ("hops", "melon", r"\bmelon"),
    ("hops", "dank", r"\bdank|\bcatty|\bonion|\bgarlic"),
    ("hops", "berry", r"\bberr(y|ies)|\bcurrant|\bblack ?currant"),
    ("fermentation", "fruity esters", r"\bester|\bfruity|\bfruit(iness)?\b"),
    ("fermentation", "banana", r"\bbanana"),
    ("fermentation", "clove", r"\bclove"),
    ("fermentation", "phenolic", r"\bphenol"),
    ("fermentation", "peppery", r"\bpepper(y)?\b"),
    ("fermentation", "apple", r"\bapple"),
    ("fermentation", "pear", r"\bpear\b"),
    ("fermentation", "dark fruit", r"\bdark fruit|\bplum|\braisin|\bprune|\bfig\b|\bdate\b"),
    ("fermentation", "cherry", r"\bcherr(y|ies)"),
    ("fermentation", "vinous", r"\bvinous|\bwine|\bwiney|\bgrape\b|\bsherry|\bport\b"),
    ("fermentation", "alcohol warmth", r"\balcohol(ic)? (warm|strength|presence|character|flavor|aroma)|\bwarming|\bboozy|\bspirit"),
    ("fermentation", "solvent", r"\bsolvent|\bfusel|\bhot alcohol"),
    ("fermentation", "funky", r"\bfunk(y)?|\bbarnyard|\bhorse|\bleather(y)?\b|\bbrett(anomyces)?\b|\bmusty\b"),
    ("fermentation", "sour/tart", r"\bsour(ness)?\b|\btart(ness)?\b|\bacidic|\bacidity|\blactic|\bacetic|\bvinegar"),
    ("fermentation", "buttery", r"\bdiacetyl|\bbutter(y|scotch)"),
    ("fermentation", "sulfur", r"\bsulfur|\bsulphur|\bsulfid"),
    ("mouthfeel & other", "sweet", r"\bsweet(ness|ish)?\b"),
    ("mouthfeel & other", "dry finish", r"\bdry (finish|palate)|\bfinishes? dry|\bdryness|\bcrisp"),
    ("mouthfeel & other", "creamy", r"\bcream(y|iness)|\bsilky|\bsmooth\b|\bvelvet"),
    ("mouthfeel & other", "full-bodied", r"\bfull[- ]bod|\bchewy|\brich\b|\bluscious"),
    ("mouthfeel & other", "light-bodied", r"\blight[- ]bod|\bwatery|\bthin\b|\bdelicate\b"),
    ("mouthfeel & other", "vanilla", r"\bvanilla"),
    ("mouthfeel & other", "oak", r"\boak|\bwood(y|-aged)?\b|\bbarrel"),
    ("mouthfeel & other", "licorice", r"\blicorice|\bliquorice|\banise"),
    ("mouthfeel & other", "mineral", r"\bmineral|\bflint|\bchalk"),
    ("mouthfeel & other", "salty", r"\bsalt(y|iness)?\b|\bbriny"),
    ("mouthfeel & other", "spiced", r"\bspice[sd]?\b|\bcoriander|\bcinnamon|\bginger\b|\bnutmeg"),
    ("mouthfeel & other", "bitter finish", r"\bbitter(ness)?\b"),
]

# End of the fixed values.


def malt_class(name: Column) -> Column:
    return ordered_rules([name], MALT_CLASSES, "other")


def family(*texts: Column) -> Column:
    return ordered_rules([F.nullif(t, F.lit("")) for t in texts], FAMILIES, "other")


def stage(addition: Column) -> Column:
    """Free text of a hop addition as bittering, late or dry; minutes of 45 or more are bittering."""
    text = F.lower(F.trim(F.coalesce(addition, F.lit(""))))
    minutes = leading_number(F.regexp_replace(text, r"^boil\s*", ""))
    rest = F.when(minutes >= 45, "bittering").when(minutes.isNotNull(), "late").when(F.contains(text, F.lit("boil")), "bittering").otherwise("late")
    named = F.nullif(ordered_rules([text], STAGES, ""), F.lit(""))
    return F.coalesce(named, rest)


def hop_name(name: Column) -> Column:
    """A hop's plain name: accents, packaging, amounts and punctuation out, then aliases, then origin words."""
    n = F.translate(F.lower(name), "äàüùöò®™", "aauuoo")
    for pattern, by in (
        (r"\([^)]*\)", " "),
        (r"\b(co2|c02)\b|\bextract\b|\bpellets?\b|\bleaf\b|\bwhole\b|\bcryo\b|\blupomax\b|\blupuln2\b", ""),
        (r"\b\d+(\.\d+)?\s*%?\s*aa\b", " "),
        (r"[^a-z0-9]+", " "),
    ):
        n = F.regexp_replace(n, pattern, by)
    n = F.trim(n)
    known = lookup(n, HOP_ALIASES)
    stripped = F.regexp_replace(n, r"^(domestic|german|czech|french|us|u s|uk|au|nz|american|slovenian)\s+", "")
    return F.when(known != n, known).otherwise(lookup(stripped, HOP_ALIASES))


def producer_name(name: Column) -> Column:
    """A producer's hop name: marks out, numbered breeding lines as one word, punctuation as blanks, then aliases."""
    n = F.regexp_replace(F.lower(name), "[®™]", "")
    n = F.regexp_replace(n, r"\b(hbc|yqh)\s*(\d+)\b", "$1$2")
    return lookup(F.trim(F.regexp_replace(n, "[^a-z0-9]+", " ")), PRODUCER_ALIASES)


def yeast_key(name: Column) -> Column:
    """A yeast's product code without blanks, else its cleaned name; null for names without a letter or digit."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9/ -]+", " "), r"\s+", " "))
    code = F.nullif(F.replace(F.regexp_extract(cleaned, YEAST_CODE, 1), F.lit(" "), F.lit("")), F.lit(""))
    return F.when(cleaned.rlike("[a-z0-9]"), F.coalesce(code, cleaned))


def fermentation(tags: Column, name: Column, category: Column) -> Column:
    """Fermentation family of a style, by its tags in their order, else by words of its name and category."""
    known = F.coalesce(*[F.when(F.array_contains(tags, t), f) for t, f in FERMENTATION_TAGS])
    return F.coalesce(known, ordered_rules([F.concat_ws(" ", name, category)], FERMENTATION_WORDS, ANY_FERMENTATION))


def style_name(name: Column) -> Column:
    """A guideline name for matching."""
    n = F.translate(F.lower(name), "äàáâöòóôüùúûéèêë", "aaaaoooouuuueeee")
    n = F.replace(n, F.lit("ß"), F.lit("ss"))
    for pattern, by in (
        (r"[-/&]", " "),
        (r"india pale ale", "ipa"),
        (r"barley ?wine", "barleywine"),
        (r"wheat ?wine", "wheatwine"),
        (r"^\d+[a-z]?\s+", ""),
        (r"[^a-z0-9 ]", ""),
        (r" +", " "),
    ):
        n = F.regexp_replace(n, pattern, by)
    return F.trim(n)


def name_tokens(normal: Column) -> Column:
    """The set of telling words of a normalised name."""
    words = F.filter(F.split(normal, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: lookup(w, TOKEN_ALIASES)))


def alternative_names(name: Column) -> Column:
    """The readings of a name with commas or 'or': itself, each part, and short parts with the last one's end."""
    parts = F.filter(F.transform(F.split(name, r"(?i),|\bor\b"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.split(F.element_at(parts, -1), r"\s+")

    def lengthened(p: Column) -> Column:
        words = F.split(p, r"\s+")
        return F.when(F.size(words) < F.size(last), style_name(F.array_join(F.concat(words, F.slice(last, F.size(words) + 1, F.size(last))), " ")))

    more = F.flatten(F.transform(parts, lambda p: F.array(style_name(p), lengthened(p))))
    every = F.when(F.size(parts) > 1, F.concat(F.array(style_name(name)), more)).otherwise(F.array(style_name(name)))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def descriptors(*prose: Column) -> Column:
    """Sensory descriptors in up to three prose fields: array<struct<family, name, strength>>, strength by fields."""
    low = [F.lower(p) for p in prose]
    count = lambda pattern: sum((F.coalesce(t.rlike(pattern), F.lit(False)).cast("int") for t in low), F.lit(0))
    entries = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("name"), count(p).alias("strength")) for f, n, p in LEXICON]
    return F.filter(F.array(*entries), lambda e: e["strength"] > 0)
