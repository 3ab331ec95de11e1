"""Sources and sinks of nested documents: explicit schemas, tolerant reads, and page, JSON and XML parsers as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import domain, text, units
from ..operators.steps import dealt, worked_out

VITALS = "struct<og:double,fg:double,abv:double,ibu:double,srm:double>"
INTERCHANGE = f"""url string, id string, name string, style string, method string, batchL double, vitals {VITALS},
    malts array<struct<name:string,kg:double>>, hops array<struct<name:string,g:double,use:string,stage:string>>, yeast string"""
RECIPE = f"""id bigint, name string, tagline string, year string, family string, origin string, vitals {VITALS}, batchL double,
    malts array<struct<name:string,kg:double,class:string,pct:double>>,
    hops array<struct<name:string,key:string,g:double,stage:string,timeMin:double>>, yeast string, description string"""


def read_array(spark: SparkSession, path: str, field: str | None, schema: str) -> DataFrame:
    """Rows of an array in one large JSON object, or of a file that is an array. Lines of JSON are better: they can be split."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    outer = f"{field} array<struct<{_inner(schema)}>>"
    return spark.read.schema(outer).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def _inner(schema: str) -> str:
    return T.StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def read_lines(spark: SparkSession, path: str, schema: str, needed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON lines as good rows and rejected lines: malformed ones, and those that lack a needed field."""
    whole = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt_record").isNotNull()
    for name in needed:
        kind = T.StructType.fromDDL(schema)[name].dataType
        missing = F.col(name).isNull() | (F.size(name) == 0 if isinstance(kind, T.ArrayType) else F.lit(False))
        bad = bad | missing
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad)


def object_values(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of a JSON object of objects, in order of its keys: key and the fields of the value."""
    return df.select(F.explode(F.from_json(column, f"map<string,struct<{_inner(value)}>>")).alias("key", "v")).select("key", "v.*")


def unpivot_arrays(df: DataFrame, ids: str, groups: Mapping[tuple[str, float], str]) -> DataFrame:
    """Parallel arrays of coordinates by (method, blend) as rows: id, method, blend, x, y, z."""
    parts = []
    for (method, blend), column in groups.items():
        rows = df.select(F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(column).alias("c"))).alias("p"))
        parts.append(rows.select(F.col("p.i").alias("id"), F.lit(method).alias("method"), F.lit(float(blend)).alias("blend"), *[F.get(F.col("p.c"), F.lit(k)).alias(x) for k, x in enumerate("xyz")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_schema(recipes: DataFrame) -> dict[str, DataFrame]:
    """Facts and dimensions of nested recipes: recipes, recipe_malts, recipe_hops, malts, hops."""
    facts = recipes.select(
        "id", "name", "family", "origin", F.expr("try_cast(year as int)").alias("year"), "vitals.og", "vitals.fg", "vitals.abv", "vitals.ibu", "vitals.srm", F.col("batchL").alias("batch_l"), "yeast"
    )
    malts = recipes.select(F.col("id").alias("recipe_id"), F.explode("malts").alias("m")).select("recipe_id", F.col("m.name").alias("malt_name"), F.col("m.class").alias("malt_class"), "m.kg", "m.pct")
    hops = recipes.select(F.col("id").alias("recipe_id"), F.explode("hops").alias("h"))
    key = F.coalesce(F.nullif(F.col("h.key"), F.lit("")), F.lower(F.trim(F.col("h.name"))))
    hops = hops.select("recipe_id", F.col("h.name").alias("hop_name"), key.alias("hop_key"), F.col("h.g").alias("grams"), F.col("h.stage").alias("stage"))
    malt_key = F.lower(F.trim("malt_name")).alias("malt_key")
    users = F.countDistinct("recipe_id").cast("int").alias("n_recipes")
    return {
        "recipes": facts,
        "recipe_malts": malts,
        "recipe_hops": hops,
        "malts": malts.groupBy(malt_key).agg(F.min("malt_name").alias("name"), F.min("malt_class").alias("class"), users),
        "hops": hops.groupBy("hop_key").agg(F.min("hop_name").alias("name"), users),
    }


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Replace the tables under a folder; readers that hold the old files are not disturbed until they open again."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(tables: Mapping[str, DataFrame], path: str) -> None:
    """Replace the tables under a folder by lines of JSON, nulls included."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def export_views(views: Mapping[str, tuple[DataFrame, Sequence[Column], int]], path: str) -> None:
    """The first rows of each view (rows, order, number) as lines of JSON, in one file a view."""
    write_json({name: df.orderBy(*order).limit(n).coalesce(1) for name, (df, order, n) in views.items()}, path)


# Pages: an HTML recipe page as one record, by nested regular expressions in the JVM.


def html_tables(html: Column) -> Column:
    """array<array<array<string>>>: the cell texts of all tables, by row."""
    each = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?is)(<{tag}[\s>].*?</{tag}>)"), 1)
    return F.transform(each(html, "table"), lambda t: F.transform(each(t, "tr"), lambda r: F.transform(each(r, "t[hd]"), text.strip_tags)))


def json_ld(html: Column, kind: str, schema: str) -> Column:
    """The first JSON-LD object of a page whose @type is, or lists, ``kind``; its fields by ``schema``.

    A block is an object or an array of objects, all of which are looked at; malformed blocks are passed over.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    one = T.StructType([T.StructField("@type", T.StringType()), *T.StructType.fromDDL(schema).fields])
    each = lambda b: F.when(F.trim(b).startswith("["), F.from_json(b, T.ArrayType(one))).otherwise(F.array(F.from_json(b, one)))
    typed = lambda o: (o["@type"] == kind) | F.coalesce(F.array_contains(F.from_json(o["@type"], "array<string>"), kind), F.lit(False))
    found = F.filter(F.flatten(F.transform(blocks, lambda b: F.coalesce(each(b), F.array()))), lambda o: o.isNotNull() & typed(o))
    return F.get(found, F.lit(0))


def listing_links(df: DataFrame, html: str, pattern: str, page: str | None = None) -> DataFrame:
    """Distinct links of listing pages: id and slug by the two groups of ``pattern``, in order of first place; the last slug wins.

    ``page`` numbers pages of one listing; links of later pages come after those of earlier ones.
    """
    found = F.posexplode(F.regexp_extract_all(html, F.lit(f"(?i)({pattern})"), 1)).alias("pos", "link")
    rows = df.select((F.col(page) if page else F.lit(0)).alias("page"), found).withColumn("id", F.regexp_extract("link", f"(?i){pattern}", 1)).withColumn("slug", F.regexp_extract("link", f"(?i){pattern}", 2))
    place = F.struct("page", "pos")
    return rows.groupBy("id").agg(F.min(place).alias("first"), F.max_by("slug", place).alias("slug")).select("id", F.col("first.pos").alias("pos"), "slug", F.col("first.page").alias("page"))


def parse_recipe_page(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One interchange record a page: id, name, vitals, batchL, method, malts (kg) and hops (g, stage)."""
    number = lambda *labels: F.coalesce(*[text.labelled_number(F.col("plain"), w) for w in labels])
    rows = dealt(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))
    rows = worked_out(rows, plain=text.strip_tags(F.col("html")), tables=html_tables(F.col("html")), ld=json_ld(F.col("html"), "Recipe", "name string, recipeCategory string"))
    head = lambda t: F.lower(F.array_join(F.element_at(t, 1), " "))
    long = F.filter("tables", lambda t: F.size(t) > 1)
    body = lambda t: F.slice(t, F.lit(2), F.size(t))
    grains = F.flatten(F.transform(F.filter(long, lambda t: head(t).rlike("fermentable|grain|°l|ppg")), body))
    bills = F.filter(long, lambda t: head(t).rlike("variety|hops") & head(t).rlike("use|time") & ~head(t).rlike("fermentable|grain|°l|ppg"))
    column = lambda t, w: F.array_position(F.transform(F.element_at(t, 1), lambda c: F.lower(c).rlike(w)), True)
    cell = lambda r, i: F.when(i > 0, F.get(r, i.cast("int") - 1)).otherwise(F.lit(""))
    malt = lambda r: F.struct(F.trim(F.regexp_replace(F.get(r, F.lit(1)), r"\s*\([^)]*\)\s*$", "")).alias("name"), F.round(text.in_unit(F.get(r, F.lit(0)), text.KILOGRAMS, "kg"), 3).alias("kg"))

    def hop(t: Column, r: Column) -> Column:
        use, time = cell(r, column(t, "use")), cell(r, column(t, "time"))
        by = F.when(time.rlike("(?i)min") & use.rlike("(?i)boil"), time).otherwise(use)
        return F.struct(F.trim(F.get(r, F.lit(1))).alias("name"), F.round(text.in_unit(F.get(r, F.lit(0)), text.GRAMS, "g"), 1).alias("g"), F.trim(F.concat(use, F.lit(" "), time)).alias("use"), domain.stage(by).alias("stage"))

    malts = F.filter(F.transform(F.filter(grains, lambda r: F.size(r) > 1), malt), lambda m: (m["kg"] > 0) & (m["name"] != "") & ~F.lower(m["name"]).startswith("total"))
    hops = F.flatten(F.transform(bills, lambda t: F.transform(F.filter(body(t), lambda r: (F.size(r) > 1) & ~F.get(r, F.lit(0)).rlike("(?i)total")), lambda r: hop(t, r))))
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?i)<title>([^<]+)</title>", 1), r"(?i)\s*[-|]\s*Beer Recipe.*$", ""))
    h1 = text.strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return rows.select(
        "url",
        F.nullif(F.regexp_extract(F.concat_ws(" ", "url", "html"), r"/view/(\d+)/", 1), F.lit("")).alias("id"),
        text.first_text(F.col("ld.name"), title, h1).alias("name"),
        F.struct(number("Original Gravity", "OG").alias("og"), number("Final Gravity", "FG").alias("fg"), number("ABV").alias("abv"), number("IBU").alias("ibu"), number("SRM").alias("srm")).alias("vitals"),
        F.round(text.in_unit(F.regexp_extract("plain", r"(?i)Batch Size:?\s+([\d.]+\s*[a-z]+)", 1), text.LITRES, "l"), 1).alias("batchL"),
        F.nullif(F.regexp_extract("plain", r"(?i)\b(All Grain|BIAB|Partial Mash|Extract)\b", 1), F.lit("")).alias("method"),
        F.coalesce("ld.recipeCategory", text.labelled_words(F.col("plain"), "Style", "Boil|Batch|Method|OG|Original")).alias("style"),
        text.labelled_words(F.col("plain"), "Yeast", "Starter|Attenuation|Flocculation|Optimum|Fermentation").alias("yeast"),
        malts.alias("malts"),
        F.filter(hops, lambda h: (h["g"] > 0) & (h["name"] != "")).alias("hops"),
    )


# Brewing XML: one record from the first RECIPE element, by XPath in the JVM.


#: The texts of a recipe, and the lists of its bills, by their paths.
XML_TEXTS = ["NAME", "STYLE/NAME", "TYPE", "BATCH_SIZE", "EST_OG", "OG", "EST_FG", "FG", "EST_ABV", "ABV", "IBU", "EST_COLOR", "COLOR", "YEASTS/YEAST[1]/NAME"]
XML_LISTS = ["FERMENTABLES/FERMENTABLE/NAME", "FERMENTABLES/FERMENTABLE/AMOUNT", "HOPS/HOP/NAME", "HOPS/HOP/AMOUNT", "HOPS/HOP/USE", "HOPS/HOP/TIME"]
#: No XML holds this character, so it parts texts that one path finds together.
XML_NEVER = "\ufffe"


def _read_xml(docs: DataFrame, xml: str) -> DataFrame:
    """The documents that hold a recipe, with _texts and _lists: all its texts by one path, since each path reads the whole document."""
    at = "//RECIPE[1]"
    texts = F.split(F.xpath_string(xml, F.lit("concat(" + f", '{XML_NEVER}', ".join(f"{at}/{p}" for p in XML_TEXTS) + ")")), XML_NEVER, -1)
    lists = F.struct(*[F.xpath(xml, F.lit(f"{at}/{p}/text()")).alias(f"l{i}") for i, p in enumerate(XML_LISTS)])
    return worked_out(docs.where(F.col(xml).rlike("(?is)<RECIPE>")), _texts=texts).withColumn("_lists", lists)


def _xml_number(*paths: str) -> Column:
    return F.coalesce(*[text.leading_number(_xml_text(p)) for p in paths])


def _xml_text(path: str) -> Column:
    return F.get(F.col("_texts"), F.lit(XML_TEXTS.index(path)))


def _xml_record(read: DataFrame, xml: str) -> DataFrame:
    many = lambda path: F.col(f"_lists.l{XML_LISTS.index(path)}")
    malts = F.arrays_zip(many("FERMENTABLES/FERMENTABLE/NAME").alias("name"), F.transform(many("FERMENTABLES/FERMENTABLE/AMOUNT"), text.leading_number).alias("kg"))
    hops = F.arrays_zip(many("HOPS/HOP/NAME").alias("name"), many("HOPS/HOP/AMOUNT").alias("kg"), many("HOPS/HOP/USE").alias("use"), many("HOPS/HOP/TIME").alias("time"))

    def hop(h: Column) -> Column:
        use = F.coalesce(h["use"], F.lit(""))
        minutes = F.coalesce(text.leading_number(h["time"]), F.lit(0.0))
        stage = F.when(use.rlike("(?i)dry"), "dry").when(use.rlike("(?i)aroma|whirlpool"), "late").when(use.rlike("(?i)first wort|mash"), "bittering").when(minutes >= 45, "bittering").otherwise("late")
        return F.struct(F.coalesce(h["name"], F.lit("Hop")).alias("name"), F.round(F.coalesce(text.leading_number(h["kg"]), F.lit(0.0)) * 1000, 1).alias("g"), use.alias("use"), stage.alias("stage"))

    return read.select(
        *[c for c in read.columns if c not in (xml, "_texts", "_lists")],
        _xml_text("NAME").alias("name"),
        _xml_text("STYLE/NAME").alias("style"),
        _xml_text("TYPE").alias("method"),
        _xml_number("BATCH_SIZE").alias("batchL"),
        F.struct(
            _xml_number("EST_OG", "OG").alias("og"),
            _xml_number("EST_FG", "FG").alias("fg"),
            _xml_number("EST_ABV", "ABV").alias("abv"),
            _xml_number("IBU").alias("ibu"),
            _xml_number("EST_COLOR", "COLOR").alias("srm"),
        ).alias("vitals"),
        F.filter(F.transform(malts, lambda m: F.struct(m["name"].alias("name"), F.round(m["kg"], 3).alias("kg"))), lambda m: m["kg"] > 0).alias("malts"),
        F.transform(hops, hop).alias("hops"),
        _xml_text("YEASTS/YEAST[1]/NAME").alias("yeast"),
    )


def parse_recipe_xml(docs: DataFrame, xml: str) -> DataFrame:
    """The interchange record of an XML recipe: amounts are kilograms, batch sizes litres; a missing TIME counts as 0."""
    return _xml_record(_read_xml(dealt(docs), xml), xml)


def import_xml(docs: DataFrame, xml: str, colour_unit: str = "srm") -> tuple[DataFrame, DataFrame]:
    """Recipes of user XML, and the files that lack a gravity, bitterness or colour; a missing strength is computed."""
    docs = dealt(docs)
    read = _read_xml(docs, xml)
    good = F.lit(True)
    for paths in (("EST_OG", "OG"), ("EST_FG", "FG"), ("IBU",), ("EST_COLOR", "COLOR")):
        good = good & _xml_number(*paths).isNotNull()
    v = lambda x: F.col(f"vitals.{x}")
    srm = units.srm_from_ebc(v("srm")) if colour_unit == "ebc" else v("srm")
    vitals = F.struct(v("og").alias("og"), v("fg").alias("fg"), F.coalesce(v("abv"), units.alcohol(v("og"), v("fg"))).alias("abv"), v("ibu").alias("ibu"), srm.alias("srm"))
    bad = read.where(~good).select(xml, *[c for c in docs.columns if c != xml])
    none = docs.where(~F.coalesce(F.col(xml).rlike("(?is)<RECIPE>"), F.lit(False)))
    return _xml_record(read.where(good), xml).withColumn("vitals", vitals), bad.unionByName(none.select(*bad.columns))


def sniff(content: Column) -> Column:
    """xml or json, by the first character that isn't blank."""
    return F.when(F.ltrim(content).startswith("<"), "xml").otherwise("json")
