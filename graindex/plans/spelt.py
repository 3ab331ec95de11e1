"""Rules about names and texts over spellings made of parts and documents; the SQL applies the same rules by itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brewing, domain
from ..operators import matching
from ..operators.steps import dealt
from .recipes import _pick, _sql_pick
from .tables import Registry, table

REGISTRY = Registry()
query = REGISTRY.add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_chain(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    """Replacements of patterns, one after another."""
    for pattern, by in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return expr


def sql_first(expr: str, rules: Sequence[tuple[str, str]], otherwise: str) -> str:
    """The name of the first rule that a text matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in rules) + f" ELSE {otherwise} END"


def sql_alias(expr: str, names: Mapping[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {expr} END"


def _made(*picks: tuple[str, list[str]]) -> tuple[str, Callable[[], Column]]:
    """A spelling put together of words by numbers of a part, in SQL and as a column; '#name' stands for the part's own."""
    sql = " || ".join("p_name" if words == ["#name"] else _sql_pick(number, words) for number, words in picks)
    words_of = lambda number, words: F.col("p_name") if words == ["#name"] else _pick(F.expr(number.replace("//", "div")), words)
    return f"({sql})", lambda: F.concat(*[words_of(*p) for p in picks])


NUMBER = r"CASE WHEN regexp_matches({0}, '^\s*-?[0-9]') THEN regexp_extract({0}, '^\s*(-?[0-9]+(?:[.][0-9]+)?)', 1)::DOUBLE END"

BEFORE = ["", "Boil ", "boil", "Dry Hop - ", " Start of ", "First Wort ", "FWH ", "Mash ", "FV ", "wood ageing ", "HD2 ", "End of boil "]
AFTER = ["", " min", " minutes", "", " Whirlpool", " flame out", " hopstand", " secondary", " aroma", " 60 boil"]
ADDED = _made(("p_partkey", BEFORE), ("p_size", ["60", "45", "44.5", "10", "0", "", " x", "-5"]), ("p_partkey // 11", AFTER))


@query(rf"""WITH t AS (SELECT p_partkey, lower(trim({ADDED[0]})) AS t FROM part), m AS (SELECT *, regexp_replace(t, '^boil\s*', '') AS rest FROM t), n AS (SELECT *, {NUMBER.format("rest")} AS minutes FROM m)
  SELECT p_partkey, {sql_first("t", domain.STAGES, "CASE WHEN minutes >= 45 THEN 'bittering' WHEN minutes IS NOT NULL THEN 'late' WHEN contains(t, 'boil') THEN 'bittering' ELSE 'late' END")} AS stage FROM n""")
def spelt_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stage of hop additions in many wordings."""
    return dealt(table(spark, sf, "part")).select("p_partkey", domain.stage(ADDED[1]()).alias("stage"))


HOP = _made(
    ("p_size", ["", "US ", "German ", "czech ", "NZ ", "Domestic ", "U.S. "]),
    ("p_partkey", ["Columbus", "Fuggles", "East Kent Goldings", "Hallertau Mittelfrüh", "Tettnang", "Saphire", "Cascade", "H. Blanc", "Goldings", "Spalt Select", "Lemon Drop", "Brewer's Gold", "Zeus", "Citra"]),
    ("p_partkey // 14", ["", " Pellets", " (T90)", " 3.5% AA", "® Cryo", " whole leaf", " CO2 Extract", " [2019]", " LUPOMAX 17.0 % aa"]),
)
PACKED = [
    (r"\([^)]*\)", " "),
    (r"\b(co2|c02)\b|\bextract\b|\bpellets?\b|\bleaf\b|\bwhole\b|\bcryo\b|\blupomax\b|\blupuln2\b", ""),
    (r"\b\d+(\.\d+)?\s*%?\s*aa\b", " "),
    (r"[^a-z0-9]+", " "),
]
ORIGIN = r"^(domestic|german|czech|french|us|u s|uk|au|nz|american|slovenian)\s+"


@query(rf"""WITH n AS (SELECT p_partkey, trim({sql_chain(f"translate(replace(replace(lower({HOP[0]}), '®', ''), '™', ''), 'äàüùöò', 'aauuoo')", PACKED)}) AS n FROM part),
  k AS (SELECT *, {sql_alias("n", domain.HOP_ALIASES)} AS known, regexp_replace(n, {quoted(ORIGIN)}, '') AS bare FROM n)
  SELECT p_partkey, CASE WHEN known <> n THEN known ELSE {sql_alias("bare", domain.HOP_ALIASES)} END AS hop FROM k""")
def spelt_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Plain names of hops with origins, packaging and amounts."""
    return dealt(table(spark, sf, "part")).select("p_partkey", domain.hop_name(HOP[1]()).alias("hop"))


GROWN = _made(
    ("p_size", ["", "", "  "]),
    ("p_partkey", ["HBC 472", "YQH  1320", "Columbus / Tomahawk", "Zeus", "Styrian Savinjski Golding", "Hallertau Mittelfrueh", "Golding", "Strisselspalter", "Tettnang Tettnanger", "Whitbread Goldings Variety", "Hallertauer Mittelfrüh", "hbc586x"]),
    ("p_partkey // 12", ["", "®", "™", " (experimental)", "-", " #2"]),
)


@query(rf"""WITH n AS (SELECT p_partkey, trim({sql_chain(f"lower({GROWN[0]})", [("[®™]", ""), (r"\b(hbc|yqh)\s*(\d+)\b", r"\1\2"), ("[^a-z0-9]+", " ")])}) AS n FROM part) SELECT p_partkey, {sql_alias("n", domain.PRODUCER_ALIASES)} AS hop FROM n""")
def spelt_producers(spark: SparkSession, sf: str) -> DataFrame:
    """Producers' names of hops: breeding numbers, marks and aliases."""
    return dealt(table(spark, sf, "part")).select("p_partkey", domain.producer_name(GROWN[1]()).alias("hop"))


MALT = _made(
    ("p_size", ["", "Weyermann ", "Simpsons ", "Thomas Fawcett ", "Crisp ", "Weyernmann® "]),
    ("p_partkey", ["#name"]),
    ("p_partkey // 3", [" Malt", " Pale Ale Malt", " flaked oats", " Oat", " Malt Type 2", " type  1 Crystal", " Black  Patent", " Rauch-malt", " Candi Sugar", " Vienna"]),
)
BRANDS = [(r"weyernmann|weyermann|simpsons|thomas fawcett|crisp\b", ""), (r"\bmalt\b", ""), (r"\btype\s*(\d)", r"\1"), (r"\boats?\b", "oat"), (r"[^a-z0-9]+", " ")]


@query(rf"""WITH m AS (SELECT p_partkey, {MALT[0]} AS m FROM part) SELECT p_partkey, trim({sql_chain("lower(m)", BRANDS)}) AS malt, {sql_first("m", domain.MALT_CLASSES, "'other'")} AS class FROM m""")
def spelt_malts(spark: SparkSession, sf: str) -> DataFrame:
    """One key for the spellings of malts, and their classes."""
    return dealt(table(spark, sf, "part")).select("p_partkey", brewing.malt_key(MALT[1]()).alias("malt"), domain.malt_class(MALT[1]()).alias("class"))


GUIDE = _made(
    ("p_size", ["", "11B ", "7 ", "American-Style ", "Münchner "]),
    ("p_partkey", ["#name"]),
    ("p_partkey // 5", [" India Pale Ale", " Barley Wine", " or Blonde Ale", ", Dark or Brown Lager", " & Wheatwine", " Kölsch/Helles", " Weißbier", " Special Bitter or Best Bitter", " orange"]),
)
PLAIN = [(r"[-/&]", " "), (r"india pale ale", "ipa"), (r"barley ?wine", "barleywine"), (r"wheat ?wine", "wheatwine"), (r"^\d+[a-z]?\s+", ""), (r"[^a-z0-9 ]", ""), (r" +", " ")]


def sql_style(expr: str) -> str:
    plain = f"replace(translate(lower({expr}), 'äàáâöòóôüùúûéèêë', 'aaaaoooouuuueeee'), 'ß', 'ss')"
    return f"trim({sql_chain(plain, PLAIN)})"


TOKEN = sql_alias("w", domain.TOKEN_ALIASES)
STOPS = ", ".join(map(quoted, domain.STOP_WORDS))


@query(rf"""WITH g AS (SELECT p_partkey, {GUIDE[0]} AS g FROM part),
  p AS (SELECT *, {sql_style("g")} AS norm, list_filter(list_transform(string_split_regex(g, '(?i),|\bor\b'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM g),
  l AS (SELECT *, string_split_regex(parts[len(parts)], '\s+') AS last FROM p),
  e AS (SELECT p_partkey, norm, 0 AS k, norm AS reading FROM l UNION ALL
    SELECT p_partkey, norm, 2 * i AS k, {sql_style("parts[i]")} FROM l, range(1, 9) r(i) WHERE i <= len(parts) AND len(parts) > 1 UNION ALL
    SELECT p_partkey, norm, 2 * i + 1, {sql_style("array_to_string(list_concat(string_split_regex(parts[i], '\\s+'), last[len(string_split_regex(parts[i], '\\s+')) + 1:]), ' ')").replace(chr(92) * 2, chr(92))} FROM l, range(1, 9) r(i)
      WHERE i <= len(parts) AND len(parts) > 1 AND len(string_split_regex(parts[i], '\s+')) < len(last)),
  d AS (SELECT p_partkey, norm, reading, min(k) AS k FROM e WHERE reading <> '' OR k = 0 GROUP BY ALL),
  w AS (SELECT p_partkey, norm, unnest(string_split(norm, ' ')) AS w, generate_subscripts(string_split(norm, ' '), 1) AS i FROM p),
  t AS (SELECT p_partkey, {TOKEN} AS token, min(i) AS i FROM w WHERE w <> '' AND w NOT IN ({STOPS}) GROUP BY 1, 2)
  SELECT p_partkey, norm, (SELECT string_agg(reading, '|' ORDER BY k) FROM d WHERE d.p_partkey = p.p_partkey AND reading <> '') AS readings,
    coalesce((SELECT string_agg(token, '|' ORDER BY i) FROM t WHERE t.p_partkey = p.p_partkey), '') AS tokens FROM p""")
def spelt_guides(spark: SparkSession, sf: str) -> DataFrame:
    """Guideline names for matching: normal form, alternative readings and telling words."""
    norm, rows = domain.style_name(F.col("g")), dealt(table(spark, sf, "part")).select("p_partkey", GUIDE[1]().alias("g"))
    return rows.select("p_partkey", norm.alias("norm"), F.array_join(domain.alternative_names(F.col("g")), "|").alias("readings"), F.array_join(domain.name_tokens(norm), "|").alias("tokens"))


NOTES = ["Lemon zest", "pine & resin", "Black Pepper", "green tea", "cut grass, hay", "rose blossom", "black currant", "stone fruit", "Mango", "sweet", "spicy citrus"]
NOTE = [_made((f"p_partkey // {k} + p_size", NOTES)) for k in (1, 3, 11)]
COUNTS = ", ".join(f"(SELECT count(*) FROM unnest(notes) u(x) WHERE regexp_matches(lower(x), {quoted(dict(brewing.NOTE_AXES)[a])}))::DOUBLE" for a in brewing.AROMA_AXES)


@query(rf"""WITH n AS (SELECT p_partkey, p_size, [{", ".join(x[0] for x in NOTE)}] AS notes FROM part),
  v AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN list_transform(range(0, 9), lambda i: ((p_partkey * (i + 1)) % 5)::DOUBLE) WHEN p_size % 7 > 0 THEN [{COUNTS}] END AS v FROM n)
  SELECT p_partkey, array_to_string(list_transform(CASE WHEN list_sum(v) > 0 THEN list_transform(v, lambda x: x / list_sum(v)) END, lambda x: printf('%.6f', x)), ',') AS aroma FROM v""")
def spelt_aromas(spark: SparkSession, sf: str) -> DataFrame:
    """Aroma of hops on the nine axes, by profile or else by their notes."""
    profile = F.when(F.col("p_size") % 3 == 0, F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.col("p_partkey") * (i + 1) % 5).cast("double")))
    notes = F.when(F.col("p_size") % 7 > 0, F.array(*[x[1]() for x in NOTE])).otherwise(F.expr("cast(array() as array<string>)"))
    aroma = brewing.hop_aroma(profile, notes)
    return dealt(table(spark, sf, "part")).select("p_partkey", F.array_join(F.transform(aroma, lambda x: F.format_string("%.6f", x)), ",").alias("aroma"))


PROSE = ["Grapefruit and pine.", "Citrus, mango", "earthy; floral hops", "peach, apricot, berries", "plain malt", "dank resin with a spicy hop note", "melon & tropical fruit", "honey"]
TOLD = [_made((f"p_partkey // {k}", PROSE)) for k in (1, 5)]
ASKED = "[" + ", ".join(
    "(0.0::DOUBLE" + "".join(f" + (regexp_matches(lower(a), {quoted(p)}))::INT + (regexp_matches(lower(b), {quoted(p)}))::INT" for f, n, p in domain.LEXICON if brewing.DESCRIPTOR_AXES.get(n) == axis) + ")" for axis in brewing.AROMA_AXES
) + "]"


@query(rf"""WITH s AS (SELECT p_partkey, p_size, {TOLD[0][0]} AS a, {TOLD[1][0]} AS b, CASE WHEN p_size % 5 > 0 THEN p_size / 3.0::DOUBLE END AS alpha, 15 + (p_partkey % 30)::DOUBLE AS co, CASE WHEN p_partkey % 9 > 0 THEN (p_partkey % 90)::DOUBLE END AS ibu FROM part),
  v AS (SELECT *, {ASKED} AS asked, list_transform(range(0, 9), lambda i: ((p_partkey * (i + 1)) % 5)::DOUBLE) AS raw FROM s),
  u AS (SELECT *, CASE WHEN list_sum(asked) > 0 THEN list_transform(asked, lambda x: x / list_sum(asked)) END AS t, CASE WHEN list_sum(raw) > 0 THEN list_transform(raw, lambda x: x / list_sum(raw)) END AS h FROM v),
  r AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: t[i] * h[i])) / sqrt(list_sum(list_transform(t, lambda x: x * x)) * list_sum(list_transform(h, lambda x: x * x))) AS aroma,
    CASE WHEN alpha IS NULL OR ibu IS NULL THEN 0.7 ELSE least(greatest(greatest(0, 1 - abs(alpha - least(greatest(ibu / 5, 4), 14)) / 14) + CASE WHEN ibu < 30 AND co <= 25 THEN 0.15 WHEN ibu < 30 AND co >= 35 THEN -0.15 ELSE 0 END, 0), 1) END AS role FROM u)
  SELECT p_partkey, round((CASE WHEN aroma IS NOT NULL THEN 0.55 * aroma + 0.25 * 0.5 + 0.2 * role ELSE 0.82 * (0.55 * 0.5 + 0.45 * role) END)::DOUBLE, 6) AS score FROM r""")
def aroma_pairings(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of hops for styles with aroma: what the prose asks for against the hop's profile."""
    target = brewing.style_aroma(domain.descriptors(TOLD[0][1](), TOLD[1][1]()))
    profile = brewing.unit_sum(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.col("p_partkey") * (i + 1) % 5).cast("double")))
    alpha, ibu = F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 3.0), F.when(F.col("p_partkey") % 9 > 0, (F.col("p_partkey") % 90).cast("double"))
    score = matching.pairing_score(target, profile, F.lit(0.5), alpha, (15 + F.col("p_partkey") % 30).cast("double"), ibu)
    return dealt(table(spark, sf, "part")).select("p_partkey", F.round(score, 6).alias("score"))


#: Records of three producers by number: field, SQL value (null where it is unknown).
OILS = {
    "a_m": "CASE WHEN p_partkey % 3 = 0 THEN p_size % 5 * 1.0 WHEN p_partkey % 13 > 0 THEN p_size * 2.0 END",
    "a_h": "CASE WHEN p_partkey % 4 > 0 THEN p_size * 0.7 END",
    "a_c": "CASE WHEN p_partkey % 3 = 0 THEN p_size + 30.0 WHEN p_partkey % 5 > 0 THEN p_size * 0.5 END",
    "a_f": "CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 30 * 1.0 END",
    "a_g": "CASE WHEN p_partkey % 6 > 1 THEN p_partkey % 9 * 1.0 END",
    "b_m": "CASE WHEN p_partkey % 8 > 2 THEN p_size + 9.0 END",
    "b_c": "CASE WHEN p_partkey % 8 > 3 THEN p_size * 0.6 END",
    "b_f": "CASE WHEN p_partkey % 8 > 4 THEN p_size * 0.4 END",
    "c_oils": "CASE WHEN p_partkey % 10 > 1 THEN 1.0 + p_size % 3 END",
    "c_h": "CASE WHEN p_partkey % 10 > 2 THEN p_size / 40.0 END",
    "c_f": "CASE WHEN p_partkey % 10 > 3 THEN p_size / 90.0 END",
    "c_l": "CASE WHEN p_partkey % 10 > 4 THEN p_size / 10.0 END",
}
LIMITS = list(brewing.OIL_LIMITS.items())
WAYS = (["a_m", "a_h", "a_c", "a_f", "a_g", None], ["a_c", None, "a_h", "a_g", "a_f", "a_m"], ["b_m", None, "b_c", "b_f", None, None])


def _inside(x: str, i: int) -> str:
    low, high = LIMITS[i][1]
    return f"({x} >= {low} AND {x} <= {high})"


def _way(i: int, fields: Sequence[str | None]) -> str:
    filled = " + ".join(f"({f} IS NOT NULL)::INT" for f in fields if f)
    broken = " + ".join(f"coalesce((NOT {_inside(f, j)})::INT, 0)" for j, f in enumerate(fields) if f)
    lost = f"(({fields[0]} IS NULL) AND ({filled}) >= 3)::INT"
    values = ", ".join(f or "NULL::DOUBLE" for f in fields)
    return f"CASE WHEN ({filled}) > 0 THEN {{'score': ({broken} + {lost}) * 100 - ({filled}), 'way': {i}, 'v': [{values}]}} END"


def _gap(field: str, i: int) -> str:
    high = f"round(({field} / c_oils * 100 * 1.15)::DOUBLE, 1)" if field != "c_l" else "c_l"
    return f"CASE WHEN {high} <= {LIMITS[i][1][1]} THEN {high} END"


FOUND = [
    f"CASE WHEN {_inside('b.v[1]', 0)} THEN b.v[1] WHEN {_inside('b_m', 0)} THEN b_m END",
    f"CASE WHEN {_inside('b.v[2]', 1)} THEN b.v[2] ELSE {_gap('c_h', 1)} END",
    f"CASE WHEN {_inside('b.v[3]', 2)} THEN b.v[3] WHEN {_inside('b_c', 2)} THEN b_c END",
    f"CASE WHEN {_inside('b.v[4]', 3)} THEN b.v[4] WHEN {_inside('b_f', 3)} THEN b_f ELSE {_gap('c_f', 3)} END",
    f"CASE WHEN {_inside('b.v[5]', 4)} THEN b.v[5] END",
    f"CASE WHEN {_inside('b.v[6]', 5)} THEN b.v[6] ELSE {_gap('c_l', 5)} END",
]


@query(f"""WITH t AS (SELECT p_partkey, {", ".join(f"({x})::DOUBLE AS {k}" for k, x in OILS.items())} FROM part), w AS (SELECT *, list_filter([{", ".join(_way(i, f) for i, f in enumerate(WAYS))}], lambda x: x IS NOT NULL) AS ways FROM t),
  b AS (SELECT *, list_min(ways) AS b FROM w) SELECT p_partkey, {", ".join(f"round({x}, 6) AS {n}" for x, (n, _) in zip(FOUND, LIMITS, strict=True))} FROM b""")
def producer_oils(spark: SparkSession, sf: str) -> DataFrame:
    """Oil shares from three producers' records: shifted labels, limits, and gaps filled from the others."""
    value = {k: F.expr(x).cast("double") for k, x in OILS.items()}
    told = lambda k: F.concat(value[k].cast("string"), F.lit("%")) if k else F.lit(None).cast("string")
    names = ("myrcene", "humulene", "caryophyllene", "farnesene", "geraniol", "linalool", "oils")
    record = lambda *keys: F.struct(*[told(k).alias(n) for n, k in zip(names, keys, strict=True)])
    rows = dealt(table(spark, sf, "part")).select("p_partkey", record("a_m", "a_h", "a_c", "a_f", "a_g", None, None).alias("a"), record("b_m", None, "b_c", "b_f", None, None, None).alias("b"), record(None, "c_h", None, "c_f", None, "c_l", "c_oils").alias("c"))
    oils = rows.select("p_partkey", brewing.oil_profile(F.col("a"), F.col("b"), F.col("c")).alias("o"))
    return oils.select("p_partkey", *[F.round(F.col(f"o.{n}.hi"), 6).alias(n) for n, _ in LIMITS])
