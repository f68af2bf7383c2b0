"""JSON-LD: extraction, types, validation, field-level diff, organisation data and builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.numbers import round_to
from ..functions.text import contains_any, falsy, let, strip
from ..plans.shapes import dealt

BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?[^"'>]*ld\+json[^>]*>(.*?)</script"""
EXACT_BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script"""

# Schema types recognised by substring, in test order.
KNOWN_TYPES = ["Organization", "Article", "FAQPage", "HowTo", "Product", "Person"]

# Fields each schema type must have.
REQUIRED_FIELDS = {
    "JobPosting": ["title", "description", "hiringOrganization"],
    "Product": ["name", "offers"],
    "Article": ["headline", "author", "publisher", "datePublished"],
    "Event": ["name", "startDate", "location"],
    "Organization": ["name"],
    "LocalBusiness": ["name", "address"],
    "Person": ["name"],
    "Recipe": ["name", "recipeIngredient"],
}

# Keys checked as dates although they do not contain the word.
DATE_KEYS = ["validThrough", "expires", "datePublished", "dateModified"]

# Types accepted as the organisation of a document.
ORG_TYPES = ["Organization", "LocalBusiness", "Corporation"]

# Social profiles recognised in sameAs and the host marks of each, in test order.
SOCIAL_MARKS = [
    ("linkedin_url", ["linkedin.com"]),
    ("twitter_url", ["twitter.com", "x.com"]),
    ("facebook_url", ["facebook.com"]),
    ("instagram_url", ["instagram.com"]),
    ("youtube_url", ["youtube.com"]),
]

# Master-data columns listed as sameAs, in order.
PROFILE_COLUMNS = ["wikipedia_url", "linkedin_url", "twitter_url", "facebook_url", "instagram_url", "youtube_url",
                   "tiktok_url"]


# ---------------------------------------------------------------- extraction

def jsonld_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Valid JSON-LD blocks of each page as (page_id, pos, block)."""
    found = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "block")).withColumn("block", strip(F.col("block")))
    return rows.filter((F.col("block") != "") & V.parse(F.col("block")).isNotNull())


def dedupe_blocks(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Keep the first of equal blocks per page; key order does not matter."""
    canonical = blocks.withColumn("canonical", F.to_json(V.parse(F.col("block"))))
    return (canonical.filter(F.col("canonical").isNotNull()).groupBy(key, "canonical")
            .agg(F.min("pos").alias("pos"), F.min_by("block", "pos").alias("block")))


# ---------------------------------------------------------------- types

def _own_types(v: Column) -> Column:
    t = V.field(v, "@type")
    single = F.when(V.as_text(t) != "", F.array(V.as_text(t)))
    many = F.transform(V.as_list(t), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(single, F.array_compact(many), F.array().cast("array<string>"))


def top_level_types(v: Column) -> Column:
    """Types of the block itself, or of the items of a list block."""
    return F.coalesce(F.flatten(F.transform(V.as_list(v), _own_types)), _own_types(v))


def with_types(blocks: DataFrame, column: str = "block") -> DataFrame:
    """Add ``types``: every schema type of a block, through lists and ``@graph``."""
    def inside(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda v: F.coalesce(V.as_list(v), V.as_list(V.field(v, "@graph")), V.nothing())))

    def step(s: Column) -> Column:
        return F.struct(inside(s["open"]).alias("open"), F.array_union(s["types"], F.flatten(F.transform(s["open"], _own_types))).alias("types"))

    v = V.parse(F.col(column))
    start = F.struct(_opened(v).alias("open"), F.array().cast("array<string>").alias("types"))
    return blocks.withColumn("types", V.descend(V.depth(F.col(column)), start, step, lambda s: s["types"]))


def _opened(v: Column) -> Column:
    return F.when(v.isNotNull(), F.array(v)).otherwise(V.nothing())


def schema_types(blocks: DataFrame, key: str = "page_id", column: str = "block") -> DataFrame:
    """Distinct (page_id, type)."""
    return with_types(blocks, column).select(key, F.explode("types").alias("type")).distinct()


def with_same_as(blocks: DataFrame, column: str = "block") -> DataFrame:
    """Add ``same_as``: number of sameAs links at any depth; nothing below a sameAs is entered."""
    def own(v: Column) -> Column:
        s = V.field(v, "sameAs")
        return F.when(V.as_list(s).isNotNull(), F.size(V.as_list(s))).when(V.as_text(s).isNotNull(), 1).otherwise(0)

    def inside(nodes: Column) -> Column:
        others = lambda v: F.map_values(F.map_filter(V.as_object(v), lambda k, _: k != "sameAs"))
        return F.flatten(F.transform(nodes, lambda v: F.coalesce(others(v), V.as_list(v), V.nothing())))

    def step(s: Column) -> Column:
        return F.struct(inside(s["open"]).alias("open"), (s["links"] + _total(F.transform(s["open"], own))).alias("links"))

    start = F.struct(_opened(V.parse(F.col(column))).alias("open"), F.lit(0).alias("links"))
    return blocks.withColumn("same_as", V.descend(V.depth(F.col(column)), start, step, lambda s: s["links"]))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def schema_hits(block: Column) -> Column:
    """Known types that occur as text in a block holding ``@type``."""
    hits = F.array_compact(F.array(*[F.when(block.contains(t), F.lit(t)) for t in KNOWN_TYPES]))
    return F.when(block.contains("@type"), hits).otherwise(F.array().cast("array<string>"))


def structured_footprint(pages: DataFrame, blocks: DataFrame, site: str = "site", key: str = "page_id") -> DataFrame:
    """Per site: pages, pages with JSON-LD, their share, distinct types, Organization, sameAs links.

    Blocks are first reduced to one row per page, so a hot site is pre-aggregated before its shuffle.
    """
    facts = with_same_as(with_types(blocks))
    per_page = facts.groupBy(key).agg(F.sum("same_as").alias("same_as"),
                                      F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))
    joined = pages.select(site, key).join(per_page, key, "left")
    sums = joined.groupBy(site).agg(
        F.count("*").alias("pages_analyzed"), F.count("types").alias("pages_with_jsonld"),
        F.sum(F.coalesce("same_as", F.lit(0))).alias("same_as_count"),
        F.max(F.coalesce(F.array_contains("types", "Organization"), F.lit(False))).alias("has_organization"))
    types = (joined.select(site, F.explode("types").alias("type")).distinct()
             .groupBy(site).agg(F.count("*").alias("nb_types"), F.array_sort(F.collect_list("type")).alias("schema_types")))
    share = round_to(F.col("pages_with_jsonld") / F.col("pages_analyzed") * 100, 1)
    return (sums.join(types, site, "left")
            .withColumn("nb_types", F.coalesce("nb_types", F.lit(0)))
            .withColumn("schema_types", F.coalesce("schema_types", F.array().cast("array<string>")))
            .withColumn("jsonld_percentage", share))


# ---------------------------------------------------------------- validation and quality

def validate_jsonld(docs: DataFrame, key: str = "doc_id", column: str = "doc") -> DataFrame:
    """(doc_id, valid, errors, warnings, message) by the local schema rules."""
    # The French result texts below.
    d = docs.select(key, V.parse(F.col(column)).alias("_v")).withColumn("_o", V.as_object(F.col("_v")))
    o = F.col("_o")
    broken = o.isNull() | (F.size(o) == 0)
    context, typ = F.try_element_at(o, F.lit("@context")), F.try_element_at(o, F.lit("@type"))
    has = lambda name: F.coalesce(F.map_contains_key(o, name), F.lit(False))
    first_type = F.coalesce(V.as_text(typ), F.try_variant_get(F.try_element_at(V.as_list(typ), F.lit(1)), "$", "string"))
    table = F.create_map(*[x for t, fs in REQUIRED_FIELDS.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))])
    needed = F.coalesce(F.try_element_at(table, first_type), F.array().cast("array<string>"))
    absent = F.array_except(needed, F.map_keys(o))
    errors = F.concat(
        F.array_compact(F.array(F.when(~has("@context"), F.lit("Champ @context manquant")),
                                F.when(~has("@type"), F.lit("Champ @type manquant")))),
        F.transform(absent, lambda f: F.concat(F.lit("Champ obligatoire manquant : "), f)))
    foreign = V.as_text(context).isNotNull() & ~V.as_text(context).contains("schema.org")
    warnings = F.concat(
        F.array_compact(F.array(F.when(foreign, F.lit("@context devrait être 'https://schema.org'")))),
        F.flatten(F.transform(F.map_entries(o), _value_warnings)))
    d = d.select(
        key,
        F.when(broken, F.array(F.lit("JSON-LD vide ou invalide"))).otherwise(errors).alias("errors"),
        F.when(broken, F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
        broken.alias("_broken"))
    n_err, n_warn = F.size("errors"), F.size("warnings")
    message = (F.when(F.col("_broken"), F.lit(" JSON-LD invalide"))
               .when((n_err == 0) & (n_warn == 0), F.lit(" JSON-LD valide sans erreur ni warning"))
               .when(n_err == 0, F.concat(F.lit(" JSON-LD valide avec "), n_warn.cast("string"), F.lit(" warning(s)")))
               .otherwise(F.concat(F.lit(" JSON-LD invalide : "), n_err.cast("string"), F.lit(" erreur(s)"))))
    return d.select(key, (n_err == 0).alias("valid"), "errors", "warnings", message.alias("message"))


def _value_warnings(entry: Column) -> Column:
    key, value = entry["key"], V.as_text(entry["value"])
    low = F.lower(key)
    checked = (value != "") & ~value.startswith("{{")
    is_link = low.contains("url") | (key == "sameAs")
    bad_link = checked & is_link & ~value.rlike("^(?:https?://|/)")
    is_date = low.contains("date") | key.isin(DATE_KEYS)
    bad_date = checked & is_date & ~value.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.array_compact(F.array(
        F.when(bad_link, F.concat(F.lit("URL potentiellement invalide dans "), key, F.lit(" : "),
                                  F.substring(value, 1, 50), F.lit("..."))),
        F.when(bad_date, F.concat(F.lit("Format de date suspect dans "), key, F.lit(" : "),
                                  F.substring(value, 1, 30), F.lit(" (attendu YYYY-MM-DD)")))))


def jsonld_quality(doc: Column, optimized: Column) -> Column:
    """Share of filled fields of an object; 0.6 for a list, 0.4 for anything else, at least 0.85 once optimised."""
    v = V.parse(doc)
    o = V.as_object(v)
    filled = F.size(F.filter(F.map_values(o), V.is_truthy)).cast("double")
    base = (F.when(~V.is_truthy(v), F.lit(0.0)).when(o.isNotNull(), round_to(filled / F.size(o), 2))
            .when(V.as_list(v).isNotNull(), F.lit(0.6)).otherwise(F.lit(0.4)))
    base = F.coalesce(base, F.lit(0.0))
    return F.when(F.coalesce(optimized, F.lit(False)), F.greatest(base, F.lit(0.85))).otherwise(base)


def block_label(block: Column) -> Column:
    v = V.parse(block)
    t = V.field(v, "@type")
    return (F.when(V.as_object(v).isNotNull(), F.coalesce(V.as_text(t), F.to_json(t), F.lit("Unknown")))
            .when(V.as_list(v).isNotNull(), F.concat(F.lit("Array["), F.size(V.as_list(v)).cast("string"), F.lit("]")))
            .otherwise(F.lit("N/A")))


def light_jsonld(block: Column) -> Column:
    """Short form of a block: type, and name, url and identifier cut to 200 characters."""
    v = V.parse(block)
    items = F.coalesce(V.as_list(v), F.array(v))

    def one(item: Column) -> Column:
        short = lambda name: F.substring(F.try_variant_get(item, f"$['{name}']", "string"), 1, 200)
        t = V.field(item, "@type")
        return F.struct(F.coalesce(V.as_text(t), F.to_json(t), F.lit("Unknown")).alias("@type"),
                        short("name").alias("name"), short("url").alias("url"), short("@id").alias("@id"))

    objects = F.filter(items, lambda i: V.as_object(i).isNotNull())
    return F.when(F.size(objects) > 0, F.transform(objects, one))


# ---------------------------------------------------------------- diff

FIELDS = "array<struct<path: string, ordinal: array<int>, o: variant, n: variant>>"
PAIRS = "array<struct<at: array<string>, o: variant, n: variant>>"
TEXTS = "array<struct<at: array<string>, json: string>>"


def jsonld_diff(docs: DataFrame, key: str = "doc_id", original: str = "original", optimized: str = "optimized") -> DataFrame:
    """Field-level differences as (doc_id, path, status, original_value, optimized_value, ordinal).

    Both sides are walked together inside the row, from one array of unequal containers to the next. ``ordinal``
    gives the depth-first position of a field. Documents are dealt by their key first, so that sums per document need no further shuffle.
    """
    o, n = V.parse(F.col(original)), V.parse(F.col(optimized))
    root = F.struct(F.lit("").alias("path"), F.array().cast("array<int>").alias("ordinal"), o.alias("o"), n.alias("n"))
    start = F.when(V.is_truthy(n), F.array(root))

    def compare(pair: Column) -> Column:
        sides = F.struct(V.as_object(pair["o"]).alias("po"), V.as_object(pair["n"]).alias("pn"), V.as_list(pair["o"]).alias("lo"), V.as_list(pair["n"]).alias("ln"))
        return let(sides, lambda s: fields(pair, s["po"], s["pn"], s["lo"], s["ln"]))

    def fields(pair: Column, po: Column, pn: Column, lo: Column, ln: Column) -> Column:
        prefix, no_keys = pair["path"], F.array().cast("array<string>")
        keys = F.array_union(F.map_keys(pn), F.coalesce(F.map_keys(po), no_keys))

        def named(k: Column, i: Column) -> Column:
            label = F.when(prefix == "", k).otherwise(F.concat(prefix, F.lit("."), k))
            return entry(label, i, pair["ordinal"], F.try_element_at(po, k), F.try_element_at(pn, k))

        longest = F.greatest(F.size(ln), F.coalesce(F.size(lo), F.lit(0)))
        spots = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))

        def placed(i: Column) -> Column:
            label = F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]"))
            return entry(label, i, pair["ordinal"], F.get(lo, i), F.get(ln, i))

        return F.when(pn.isNotNull(), F.transform(keys, named)).otherwise(F.transform(spots, placed))

    def entry(label: Column, i: Column, above: Column, ov: Column, nv: Column) -> Column:
        return F.struct(label.alias("path"), F.concat(above, F.array(i)).alias("ordinal"), ov.alias("o"), nv.alias("n"))

    def unequal_containers(fields: Column) -> Column:
        return F.filter(fields, lambda f: f["o"].isNotNull() & (F.to_json(f["o"]) != F.to_json(f["n"]))
                        & (V.as_object(f["n"]).isNotNull() | V.as_list(f["n"]).isNotNull()))

    spread = dealt(docs.select(key, original, optimized), key)
    df = spread.select(key, F.coalesce(F.flatten(F.transform(start, compare)), F.array().cast(FIELDS)).alias("_open"),
                     F.greatest(V.depth(F.col(original)), V.depth(F.col(optimized))).alias("_depth"))

    def step(s: Column) -> Column:
        return F.struct(F.flatten(F.transform(unequal_containers(s["open"]), compare)).alias("open"), F.concat(s["all"], s["open"]).alias("all"))

    walked = V.descend(F.col("_depth"), F.struct(F.col("_open").alias("open"), F.array().cast(FIELDS).alias("all")), step, lambda s: s["all"])
    rows = df.select(key, F.explode(walked).alias("f"))
    ov, nv = F.to_json("f.o"), F.to_json("f.n")
    container = V.as_object(F.col("f.n")).isNotNull() | V.as_list(F.col("f.n")).isNotNull()
    status = (F.when(F.col("f.o").isNull(), "added").when(F.col("f.n").isNull(), "removed")
              .when(ov == nv, "same").when(~container, "enriched"))
    return (rows.select(key, F.col("f.path").alias("path"), status.alias("status"), ov.alias("original_value"),
                        nv.alias("optimized_value"), F.col("f.ordinal").alias("ordinal"))
            .filter(F.col("status").isNotNull()))


def jsonld_delta(docs: DataFrame, key: str = "doc_id", original: str = "original", optimized: str = "optimized") -> DataFrame:
    """Only the added or changed fields of the optimised document, as one JSON text per document.

    Objects are entered, lists are taken whole. Changed fields are gathered inside the row on the
    way down and folded into their parents on the way up, the longest paths first.
    """
    o, n = V.parse(F.col(original)), V.parse(F.col(optimized))
    root = F.struct(F.array().cast("array<string>").alias("at"), o.alias("o"), n.alias("n"))

    def fields(pair: Column) -> Column:
        po, pn = V.as_object(pair["o"]), V.as_object(pair["n"])
        return F.transform(F.map_keys(pn), lambda k: F.struct(
            F.concat(pair["at"], F.array(k)).alias("at"), F.try_element_at(po, k).alias("o"), F.try_element_at(pn, k).alias("n")))

    both_objects = lambda f: V.as_object(f["o"]).isNotNull() & V.as_object(f["n"]).isNotNull()
    enter = lambda c: F.flatten(F.transform(F.filter(c, both_objects), fields))
    changed = lambda f: ~both_objects(f) & (f["o"].isNull() | (F.to_json(f["o"]) != F.to_json(f["n"])))

    def written(level: Column) -> Column:
        return F.transform(F.filter(level, changed), lambda f: F.struct(f["at"].alias("at"), F.to_json(f["n"]).alias("json")))

    parent = lambda e: F.slice(e["at"], F.lit(1), F.size(e["at"]) - 1)

    def folded(entries: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(entries, parent)), lambda p: F.struct(
            p.alias("at"), object_text(F.filter(entries, lambda e: parent(e) == p)).alias("json")))

    def object_text(entries: Column) -> Column:
        name = lambda e: F.regexp_replace(F.to_json(F.array(F.element_at(e["at"], -1))), r"^\[|\]$", "")
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(name(e), F.lit(":"), e["json"])), ","), F.lit("}"))

    df = docs.select(key, n.alias("_n"), o.alias("_o"), F.coalesce(F.flatten(F.transform(F.array(root), fields)), F.array().cast(PAIRS)).alias("_open"),
                     F.greatest(V.depth(F.col(original)), V.depth(F.col(optimized))).alias("_depth"))
    down = lambda s: F.struct(enter(s["open"]).alias("open"), F.concat(s["out"], written(s["open"])).alias("out"))
    df = df.withColumn("_out", V.descend(F.col("_depth"), F.struct(F.col("_open").alias("open"), F.array().cast(TEXTS).alias("out")), down, lambda s: s["out"]))

    def up(entries: Column, size: Column) -> Column:
        return F.concat(F.filter(entries, lambda e: F.size(e["at"]) != size), folded(F.filter(entries, lambda e: F.size(e["at"]) == size)))

    longest = F.coalesce(F.array_max(F.transform("_out", lambda e: F.size(e["at"]))), F.lit(0))
    sizes = F.when(longest >= 2, F.sequence(longest, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_up", F.aggregate(sizes, F.col("_out"), up))
    delta = (F.when(~V.is_truthy(F.col("_n")), F.lit("{}")).when(~V.is_truthy(F.col("_o")), F.to_json("_n"))
             .otherwise(object_text(F.col("_up"))))
    # Parsed once more for the canonical key order.
    return df.select(key, F.to_json(V.parse(delta)).alias("delta"))


def diff_summary(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of fields per status and in total."""
    return diff.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "enriched", "same", "removed")],
                                 F.count("*").alias("total"))


def top_level_status(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """One status per top-level field: the last added or enriched, else removed, else same."""
    top = F.regexp_extract("path", r"^([^.\[]*)", 1)
    strong = F.col("status").isin("added", "enriched")
    weight = F.when(strong, 2).when(F.col("status") == "removed", 1).otherwise(0)
    rank = F.struct(weight, F.when(strong, F.col("ordinal")))
    return diff.groupBy(key, top.alias("field")).agg(F.max_by("status", rank).alias("status"))


# ---------------------------------------------------------------- organisation

def org_node(docs: DataFrame, key: str = "doc_id", column: str = "doc") -> DataFrame:
    """The first organisation node of each document in depth-first order, as (doc_id, node)."""
    v = V.parse(F.col(column))
    root = F.array(F.struct(F.array().cast("array<int>").alias("at"), v.alias("v")))

    def inside(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda x: F.transform(
            V.children(x["v"]), lambda ch, i: F.struct(F.concat(x["at"], F.array(i)).alias("at"), ch.alias("v")))))

    hit = lambda x: F.arrays_overlap(_own_types(x["v"]), F.array(*map(F.lit, ORG_TYPES)))
    first = lambda nodes: F.array_min(F.transform(F.filter(nodes, hit), lambda x: F.struct(x["at"].alias("at"), F.to_json(x["v"]).alias("node"))))

    def step(s: Column) -> Column:
        return F.struct(inside(s["open"]).alias("open"), F.array_min(F.array_compact(F.array(s["best"], first(s["open"])))).alias("best"))

    start = F.struct(F.when(v.isNotNull(), root).otherwise(F.array().cast("array<struct<at: array<int>, v: variant>>")).alias("open"),
                     F.lit(None).cast("struct<at: array<int>, node: string>").alias("best"))
    found = docs.select(key, V.descend(V.depth(F.col(column)), start, step, lambda s: s["best"]["node"]).alias("node"))
    return found.filter(F.col("node").isNotNull())


def org_fields(nodes: DataFrame, key: str = "doc_id", column: str = "node") -> DataFrame:
    """Flat master-data fields of an organisation node; absent parts are empty."""
    v = V.parse(F.col(column))
    get = lambda path: strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    logo, country = V.field(v, "logo"), F.try_variant_get(v, "$.address.addressCountry", "variant")
    same_as = V.field(v, "sameAs")
    links = F.coalesce(F.transform(V.as_list(same_as), lambda x: F.try_variant_get(x, "$", "string")),
                       F.array_compact(F.array(V.as_text(same_as))))

    # One pass over the links; each goes to the first platform it names that has no link yet.
    unset = F.struct(*[F.lit(None).cast("string").alias(k) for k, _ in SOCIAL_MARKS])

    def assign(acc: Column, u: Column) -> Column:
        low, taken, cells = F.lower(u), F.lit(False), []
        for name, marks in SOCIAL_MARKS:
            mine = ~taken & acc[name].isNull() & contains_any(low, marks)
            cells.append(F.when(mine, u).otherwise(acc[name]).alias(name))
            taken = taken | mine
        return F.struct(*cells)

    profiles = F.aggregate(links, unset, assign)
    flat = {
        "brand_name": get("$.name"), "legal_name": get("$.legalName"), "description": get("$.description"),
        "site_url": get("$.url"),
        "logo_url": F.coalesce(V.as_text(logo), F.when(V.as_object(logo).isNotNull(), get("$.logo.url")), F.lit("")),
        "phone": get("$.telephone"), "email": get("$.email"), "street": get("$.address.streetAddress"),
        "city": get("$.address.addressLocality"), "zip_code": get("$.address.postalCode"),
        "region": get("$.address.addressRegion"),
        "country": F.when(V.as_object(country).isNotNull(), get("$.address.addressCountry.name"))
        .otherwise(get("$.address.addressCountry")),
    }
    return nodes.select(key, *[c.alias(k) for k, c in flat.items()],
                        *[F.coalesce(profiles[k], F.lit("")).alias(k) for k, _ in SOCIAL_MARKS])


# ---------------------------------------------------------------- builders

def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _typed(kind: str, guard: Column, **parts: Column) -> Column:
    return F.when(guard, F.struct(F.lit(kind).alias("@type"), *[c.alias(k) for k, c in parts.items()]))


def build_org_jsonld(masters: DataFrame, key: str = "entity_id", page_url: str | None = None) -> DataFrame:
    """Organization JSON-LD of every master row; empty parts are left out."""
    p = _present
    ids = F.array_compact(F.array(*[
        _typed("PropertyValue", p(c).isNotNull(), propertyID=F.lit(label), value=p(c))
        for label, c in (("SIREN", "siren"), ("SIRET", "siret"), ("LEI", "lei"))]))
    address = F.struct(p("street").alias("streetAddress"), p("city").alias("addressLocality"), p("region").alias("addressRegion"),
                       p("zip_code").alias("postalCode"), p("country").alias("addressCountry"),
                       F.lit("PostalAddress").alias("@type"))
    any_address = F.coalesce(*[p(c) for c in ("street", "city", "region", "zip_code", "country")]).isNotNull()
    wikidata = F.concat(F.lit("https://www.wikidata.org/wiki/"), p("qid"))
    profiles = F.array_compact(F.array(*[p(c) for c in PROFILE_COLUMNS], wikidata))
    page = F.nullif(F.col(page_url), F.lit("")) if page_url else F.lit(None).cast("string")
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.coalesce(p("org_type"), F.lit("Organization")).alias("@type"),
        p("brand_name").alias("name"), p("legal_name").alias("legalName"), p("description").alias("description"),
        p("slogan").alias("slogan"), p("site_url").alias("url"),
        _typed("ImageObject", p("logo_url").isNotNull(), url=p("logo_url"), width=F.col("logo_width"),
               height=F.col("logo_height")).alias("logo"),
        F.when(F.size(ids) > 0, ids).alias("identifier"),
        p("phone").alias("telephone"), p("email").alias("email"), p("fax").alias("faxNumber"),
        F.when(any_address, address).alias("address"),
        _typed("GeoCoordinates", p("latitude").isNotNull() & p("longitude").isNotNull(), latitude=p("latitude"),
               longitude=p("longitude")).alias("geo"),
        F.when(F.size(profiles) > 0, profiles).alias("sameAs"),
        p("founding_date").alias("foundingDate"),
        _typed("Person", p("founder_name").isNotNull(), name=p("founder_name")).alias("founder"),
        _typed("QuantitativeValue", p("num_employees").isNotNull(), value=p("num_employees")).alias("numberOfEmployees"),
        _typed("Organization", p("parent_org").isNotNull(), name=p("parent_org")).alias("parentOrganization"),
        p("ticker_symbol").alias("tickerSymbol"),
        F.when(page.isNotNull(), F.struct(F.lit("WebPage").alias("@type"), page.alias("@id"))).alias("mainEntityOfPage"))
    return masters.select(key, F.to_json(doc).alias("jsonld"))


def build_webpage_jsonld(pages: DataFrame, masters: DataFrame, as_of: str, on: str = "entity_id") -> DataFrame:
    """WebPage JSON-LD per page with the publisher of the page's entity."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    m = masters.select(on, "brand_name", "site_url", "logo_url")
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("WebPage").alias("@type"), blank("url").alias("url"),
        blank("title").alias("name"), blank("description").alias("description"), F.lit(as_of).alias("dateModified"),
        F.struct(F.lit("Organization").alias("@type"), blank("brand_name").alias("name"), blank("site_url").alias("url"),
                 F.when(~falsy(F.col("logo_url")), F.struct(F.lit("ImageObject").alias("@type"), F.col("logo_url").alias("url")))
                 .alias("logo")).alias("publisher"))
    return pages.join(m, on, "left").select(*pages.columns, F.to_json(doc).alias("jsonld"))


def parse_model_json(content: Column) -> Column:
    """JSON found in a model answer: script tags and fences removed, else the outermost braces; null if invalid."""
    bare = lambda c: strip(F.regexp_replace(F.regexp_replace(c, "(?i)<script[^>]*>", ""), "(?i)</script>", ""))
    text = bare(F.coalesce(content, F.lit("")))
    fenced = bare(F.regexp_extract(text, r"(?s)```(?:json|jsonld|ld\+json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.to_json(F.coalesce(V.parse(F.nullif(fenced, F.lit(""))), V.parse(F.nullif(braces, F.lit("")))))


def is_jsonld_document(json: Column) -> Column:
    """True where a parsed answer is an object holding ``@context`` and ``@type``."""
    o = V.as_object(V.parse(json))
    return F.coalesce(F.map_contains_key(o, "@context") & F.map_contains_key(o, "@type"), F.lit(False))


