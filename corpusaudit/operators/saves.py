"""Versioned audit snapshots, workspaces and who may see them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text_or, trimmed_or
from ..functions.urls import site_name
from ..plans.shapes import last_rows, latest, top_k
from .pages import light_pages
from .sitemap import DEFAULT_WORKSPACE

# Names of the default workspace, the registry user and placeholder saves.
SAME_AS_DEFAULT = ["Non classé", "Uncategorized"]
REGISTRY_USER = "__workspace_registry__"
PLACEHOLDER = "__ws_placeholder_"

# Longest texts kept in model rows.
LIMITS = {"site_url": 500, "model_id": 100, "model_name": 200, "url_pattern": 300, "recommended_schema": 100, "workspace": 200}


def email(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def workspace(c: Column) -> Column:
    return trimmed_or(c, DEFAULT_WORKSPACE)


def visible_workspace(c: Column) -> Column:
    w = workspace(c)
    return F.when(w.isin(SAME_AS_DEFAULT), DEFAULT_WORKSPACE).otherwise(w)


def _filled(name: str) -> Column:
    return F.length(strip(F.coalesce(F.col(name), F.lit("")))) > 0


def save_flags(saves: DataFrame) -> DataFrame:
    """Listing columns of saves: normalised workspace and which parts are filled."""
    extra = [c for c in ("user_email",) if c in saves.columns]
    return saves.select("save_id", *[email(F.col(c)).alias(c) for c in extra], "site_url", "created_at",
                        workspace(F.col("workspace")).alias("workspace"), _filled("geo_data").alias("has_geo"),
                        _filled("jsonld_data").alias("has_jsonld"), _filled("master_json").alias("has_master"))


def list_saves(saves: DataFrame, user: str, ws: str | None = None) -> DataFrame:
    """A user's saves, newest first; the workspace filter sees stored names."""
    mine = saves.filter(email(F.col("user_email")) == (user or "").strip().lower())
    if ws and ws.strip():
        mine = mine.filter(F.col("workspace") == ws.strip())
    return save_flags(mine).orderBy(F.desc("created_at"), "save_id")


def load_saves(saves: DataFrame, requests: DataFrame) -> DataFrame:
    """Saves asked for by (save_id, user_email), one row per request key."""
    r = requests.select(F.trim(F.col("save_id").cast("string")).alias("save_id"), email(F.col("user_email")).alias("_user")).distinct()
    s = saves.withColumn("_user", email(F.col("user_email")))
    hit = s.join(r, ["save_id", "_user"]).withColumn("workspace", workspace(F.col("workspace")))
    return latest(hit, ["save_id", "_user"], [F.desc("created_at")]).select(*saves.columns)


def overwrite_saves(saves: DataFrame, rows: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace saves by rows of the same (save_id, user), the last of several by ``order``; rows without such a save are rejected."""
    on = ["save_id", "_user"]
    old = saves.withColumn("_user", email(F.col("user_email")))
    new = rows.withColumn("_user", email(F.col("user_email"))).withColumn("workspace", workspace(F.col("workspace"))) \
        .withColumn("site_url", F.substring("site_url", 1, 500))
    keys = old.select(*on).distinct()
    accepted, rejects = new.join(keys, on, "left_semi"), new.join(keys, on, "left_anti")
    accepted = last_rows(accepted, on, order)
    kept = old.join(accepted.select(*on), on, "left_anti")
    return kept.select(*saves.columns).unionByName(accepted.select(*saves.columns)), rejects.select(*rows.columns)


def attach_masters(saves: DataFrame, masters: DataFrame, created_at: str, order: str | None = None) -> DataFrame:
    """Write master documents to the newest save of their (user, workspace, site); others become saves of their own.

    ``masters`` holds (save_id, user_email, workspace, site_url, master_json); the last of several rows of a site, by ``order``, wins.
    """
    key = ["_user", "_ws", "_site"]
    norm = lambda df: df.withColumn("_user", email(F.col("user_email"))).withColumn("_ws", workspace(F.col("workspace"))) \
        .withColumn("_site", strip(F.coalesce("site_url", F.lit(""))))
    s, m = norm(saves), last_rows(norm(masters), key, order)
    newest = latest(s, key, [F.desc("created_at"), F.desc("save_id")]).select("save_id", *key)
    target = m.select(*key, strip(F.coalesce("master_json", F.lit(""))).alias("_new")).join(newest, key).select("save_id", "_new")
    updated = s.join(target, "save_id", "left").withColumn("master_json", F.coalesce("_new", "master_json")).select(*saves.columns)
    alone = m.join(s.select(*key).distinct(), key, "left_anti")
    filled = {"user_email": F.col("_user"), "workspace": F.col("_ws"), "site_url": F.substring("_site", 1, 500), "save_id": F.col("save_id"),
              "created_at": F.lit(created_at), "master_json": strip(F.coalesce("master_json", F.lit("")))}
    added = alone.select(*[filled.get(c, F.lit(None).cast("string")).alias(c) for c in saves.columns])
    return updated.unionByName(added)


def visible_saves(saves: DataFrame, access: DataFrame, admins: DataFrame | None = None) -> DataFrame:
    """Saves each user may see: all of theirs without an access list or as administrator, else those of listed workspaces."""
    s = saves.withColumn("_user", email(F.col("user_email"))).withColumn("_ws", visible_workspace(F.col("workspace")))
    a = access.filter(strip(F.col("workspace_name")) != "").select(
        email(F.col("user_email")).alias("_user"), visible_workspace(F.col("workspace_name")).alias("_ws")).distinct()
    listed = a.select("_user").distinct()
    if admins is not None:
        listed = listed.join(admins.select(email(F.col("user_email")).alias("_user")).distinct(), "_user", "left_anti")
    free = s.join(listed, "_user", "left_anti")
    bound = s.join(listed, "_user", "left_semi").join(a, ["_user", "_ws"], "left_semi")
    return free.unionByName(bound).select(*saves.columns)


def all_workspaces(saves: DataFrame, access: DataFrame) -> DataFrame:
    """Distinct workspace names of both tables, sorted."""
    s = saves.select(workspace(F.col("workspace")).alias("workspace"))
    a = access.select(strip(F.col("workspace_name")).alias("workspace")).filter("workspace <> ''")
    return s.unionByName(a).distinct().orderBy("workspace")


def register_workspaces(saves: DataFrame, access: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add new workspace names to the registry; blank and known names are rejected."""
    n = names.select(strip(F.coalesce("name", F.lit(""))).alias("workspace"))
    known = all_workspaces(saves, access)
    fresh = n.filter("workspace <> ''").join(known, "workspace", "left_anti").distinct()
    rows = fresh.select(F.lit(REGISTRY_USER).alias("user_email"), F.col("workspace").alias("workspace_name"))
    blank = n.filter("workspace = ''")
    return access.unionByName(rows.select(*access.columns)), blank.unionByName(n.join(known, "workspace", "left_semi"))


def remap_workspaces(tables: dict[str, tuple[DataFrame, str]], mapping: DataFrame) -> dict[str, DataFrame]:
    """Rename workspaces by (old, new) in every table given as (table, column)."""
    pairs = mapping.select(strip(F.col("old")).alias("_old"), strip(F.col("new")).alias("_new")) \
        .filter("_old <> '' AND _new <> '' AND _old <> _new")
    pairs = pairs.groupBy("_old").agg(F.min("_new").alias("_new"))
    out = {}
    for name, (df, col) in tables.items():
        renamed = df.join(pairs, df[col] == pairs["_old"], "left").withColumn(col, F.coalesce("_new", col))
        out[name] = renamed.select(*df.columns)
    return out


def retire_workspaces(saves: DataFrame, access: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move the saves of retired workspaces (old, new), drop their access rows, count moved saves."""
    m = mapping.select(strip(F.col("old")).alias("old"), workspace(F.col("new")).alias("new")).filter("old <> ''")
    real = saves.join(m.select(F.col("old").alias("workspace")), "workspace", "left_semi").groupBy("workspace").agg(F.count("*").alias("saves_moved"))
    moved = remap_workspaces({"saves": (saves, "workspace")}, m)["saves"]
    rest = access.join(m.select(F.col("old").alias("workspace_name")).distinct(), "workspace_name", "left_anti")
    counts = m.join(real, m["old"] == real["workspace"], "left").select(
        F.col("old").alias("workspace"), F.coalesce("saves_moved", F.lit(0)).alias("saves_moved"))
    return moved, rest.select(*access.columns), counts


def move_saves(saves: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """Move listed saves to another workspace."""
    picked = ids.select(F.trim(F.col("save_id").cast("string")).alias("save_id"), F.lit(True).alias("_hit")).distinct()
    j = saves.join(picked, "save_id", "left")
    ws = F.when(F.col("_hit"), (target or "").strip() or DEFAULT_WORKSPACE).otherwise(F.col("workspace"))
    return j.withColumn("workspace", ws).select(*saves.columns)


def delete_saves(saves: DataFrame, ids: DataFrame) -> DataFrame:
    picked = ids.select(F.trim(F.col("save_id").cast("string")).alias("save_id")).distinct()
    return saves.join(picked, "save_id", "left_anti").select(*saves.columns)


def model_sites(models: DataFrame, user: str | None = None) -> DataFrame:
    """Newest date per site and workspace of stored cluster models."""
    if user is not None:
        models = models.filter(email(F.col("user_email")) == user.strip().lower())
    return models.groupBy("site_url", text_or(F.col("workspace"), DEFAULT_WORKSPACE).alias("workspace")).agg(
        F.max("created_at").alias("created_at"))


def user_audits(audits: DataFrame, user: str) -> DataFrame:
    """A user's audits with defaults for missing columns."""
    mine = audits.filter(F.col("user_email") == (user or "").strip().lower())
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return mine.select("audit_id", blank("user_email"), workspace(F.col("workspace")).alias("workspace"), blank("date"), blank("site_url"),
                       F.coalesce("nb_pages", F.lit(0)).alias("nb_pages"), F.coalesce("nom_site", F.lit("Site Inconnu")).alias("nom_site"),
                       blank("master_json"))


def load_models(models: DataFrame, user: str, site_url: str | None = None) -> DataFrame:
    """A user's cluster models, of one site if given."""
    mine = models.filter(F.col("user_email") == (user or "").strip().lower())
    if site_url and site_url.strip():
        mine = mine.filter(F.col("site_url") == site_url.strip())
    return mine.withColumn("page_count", F.coalesce(F.col("page_count").try_cast("int"), F.lit(0)))


def admin_saves(saves: DataFrame, ws: str) -> DataFrame:
    """All saves of a workspace, placeholders left out, newest first."""
    hit = saves.filter((F.col("workspace") == ws.strip()) & ~F.col("save_id").startswith(PLACEHOLDER) & F.lit(ws.strip() != ""))
    return hit.select("save_id", "user_email", "site_url", "created_at", workspace(F.col("workspace")).alias("workspace")) \
        .orderBy(F.desc("created_at"), "save_id")


def replace_access(access: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace the access lists of the users in ``new_rows``; a blank name only clears the list."""
    n = new_rows.select(email(F.col("user_email")).alias("user_email"), strip(F.coalesce("workspace_name", F.lit(""))).alias("workspace_name"))
    kept = access.join(n.select("user_email").distinct(), "user_email", "left_anti")
    return kept.select("user_email", "workspace_name").unionByName(n.filter("workspace_name <> ''").distinct())


def build_payload(facts: DataFrame, groups: DataFrame, models: DataFrame, max_pages: int = 180, max_samples: int = 50,
                  counters: DataFrame | None = None) -> dict[str, DataFrame]:
    """Snapshot of every site as three tables: ``sites`` with the first light pages and all counts, ``groups``
    with light samples per url group, and ``models`` per cluster.

    ``groups`` holds (site, group, page_id), ``models`` (site, cluster_id, model_name, schema_type,
    page_count, delta, validated), ``counters`` (site and any figures of the crawl, such as link counters and files found). Lists are cut to their
    size before they are gathered; groups and models, of which a site may have any number, stay rows.
    """
    light = light_pages(facts)
    page = F.to_json(F.struct(*[c for c in light.columns if c not in ("page_id", "site")]))

    def first_pages(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
        chosen = top_k(rows.select(*by, "page_id"), by, [F.col("page_id")], n)
        shown = light.select("page_id", page.alias("json")).join(chosen, "page_id")
        listed = F.array_sort(F.collect_list(F.struct("page_id", "json")))
        return shown.groupBy(*by).agg(F.transform(listed, lambda s: s["json"]).alias(name))

    sizes = groups.groupBy("site", "group").agg(F.count("*").alias("count"))
    samples = first_pages(groups, ["site", "group"], max_samples, "samples")
    grouped = sizes.join(samples, ["site", "group"]).withColumn("group", F.substring("group", 1, 80))
    named = models.withColumn("model_name", F.coalesce("model_name", F.lit("Cluster"))) \
        .withColumn("schema_type", F.coalesce("schema_type", F.lit("WebPage")))
    crawl = first_pages(facts, ["site"], max_pages, "crawl_pages")
    n_groups = sizes.groupBy("site").agg(F.count("*").alias("geo_clusters_count"))
    n_models = models.groupBy("site").agg(F.count("*").alias("jsonld_models_count"))
    sites = crawl.join(n_groups, "site", "left").join(n_models, "site", "left").select(
        "site", site_name(F.col("site")).alias("nom_site"), "crawl_pages", F.size("crawl_pages").cast("long").alias("crawl_pages_count"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("geo_clusters_count", "jsonld_models_count")])
    if counters is not None:
        sites = sites.join(counters, "site", "left")
    return {"sites": sites, "groups": grouped, "models": named}


def append_save(saves: DataFrame, payload: DataFrame, user: str, ws: str, created_at: str) -> DataFrame:
    """Add a new version per site of a payload's ``sites`` to the list of saves, which holds counts; ``append_snapshot`` stores the contents."""
    version = F.concat(F.lit(created_at.replace("-", "").replace(" ", "").replace(":", "")), F.lit("-"), F.col("site"))
    cells = {
        "save_id": version, "user_email": F.lit((user or "").strip().lower()), "workspace": F.lit((ws or "").strip() or DEFAULT_WORKSPACE),
        "site_url": F.substring(F.concat(F.lit("https://"), F.col("site")), 1, 500), "created_at": F.lit(created_at),
        "geo_data": F.to_json(F.struct("crawl_pages_count", "geo_clusters_count")), "master_json": F.lit(""),
        "jsonld_data": F.when(F.col("jsonld_models_count") > 0, F.to_json(F.struct("jsonld_models_count"))),
    }
    return saves.unionByName(payload.select(*[cells[c].alias(c) if c in cells else F.lit(None).cast("string").alias(c) for c in saves.columns]))


#: Tables of a stored snapshot; ``sites`` is written last, so a version that is listed there is whole.
SNAPSHOT = ["pages", "groups", "models", "sites"]


def snapshot_tables(payload: dict[str, DataFrame], user: str, ws: str, created_at: str) -> dict[str, DataFrame]:
    """A payload as rows of the four snapshot tables, each with the version it belongs to (``save_id``) and its workspace.

    A version is one site, user and time of saving. ``pages`` has a row per saved page with its place and its JSON, ``groups`` and ``models`` all theirs with
    samples and deltas, ``sites`` counts, counters and who saved what when.
    """
    who, space = (user or "").strip().lower(), (ws or "").strip() or DEFAULT_WORKSPACE
    stamp = created_at.replace("-", "").replace(" ", "").replace(":", "")
    version = F.concat(F.lit(stamp + "-"), F.col("site"), F.lit("-"), F.substring(F.md5(F.lit(f"{who}\n{space}").cast("binary")), 1, 8))
    mark = [version.alias("save_id"), F.lit(space).alias("workspace")]
    sites = payload["sites"]
    pages = sites.select(*mark, "site", F.posexplode("crawl_pages").alias("position", "page"))
    site_url = F.substring(F.concat(F.lit("https://"), F.col("site")), 1, 500).alias("site_url")
    own = lambda df: df.select(*mark, *df.columns)
    listed = sites.drop("crawl_pages")
    return {"pages": pages, "groups": own(payload["groups"]), "models": own(payload["models"]),
            "sites": listed.select(*mark, F.lit(who).alias("user_email"), F.lit(created_at).alias("created_at"), site_url, *listed.columns)}


def append_snapshot(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Add versions to the snapshot tables under ``path`` (Parquet, a folder per workspace). Saving a version again, whole or after a broken run, adds nothing twice.

    Every table takes only versions it doesn't hold yet; a table's own append is one Spark write, and the tables are written one after the other.
    """
    for name in SNAPSHOT:
        rows = tables[name]
        held = _stored(spark, f"{path}/{name}")
        if held is not None:
            known = held.join(rows.select("workspace").distinct(), "workspace", "left_semi").select("save_id").distinct()
            rows = rows.join(known, "save_id", "left_anti")
        rows.write.mode("append").partitionBy("workspace").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, ws: str | None = None) -> dict[str, DataFrame]:
    """The stored tables, of one workspace if given (other folders are not read); versions not listed in ``sites`` are left out."""
    out = {name: spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{path}/{name}") for name in SNAPSHOT}
    if ws is not None:
        out = {name: df.filter(F.col("workspace") == ws) for name, df in out.items()}
    whole = out["sites"].select("save_id").distinct()
    return {name: df if name == "sites" else df.join(whole, "save_id", "left_semi") for name, df in out.items()}


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save_counters(saves: DataFrame) -> DataFrame:
    """Saves, sites and filled parts per workspace."""
    f = save_flags(saves).groupBy("workspace", "site_url").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("has_geo", "has_jsonld", "has_master")])
    return f.groupBy("workspace").agg(F.sum("n").alias("saves"), F.count("*").alias("sites"),
                                      *[F.sum(c).alias(c) for c in ("has_geo", "has_jsonld", "has_master")])


def models_to_rows(models: DataFrame, site_url: str, ws: str, user: str, created_at: str) -> DataFrame:
    """Rows of the stored model table: slug identifier, capped names, whole JSON texts, defaults, at most five sample urls.

    ``models`` holds (cluster_id, model_name, schema_type, page_count, url_pattern, sample_urls array, dom_structure,
    existing_jsonld, optimized_jsonld); the last three are JSON text.
    """
    name = strip(F.coalesce("model_name", F.lit("")))
    name = F.when(name == "", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).otherwise(name)
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")
    cap = lambda c, n: F.substring(c, 1, LIMITS[n]).alias(n)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return models.select(
        F.lit(site_url[:500]).alias("site_url"), cap(slug, "model_id"), cap(name, "model_name"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"), cap(text("url_pattern"), "url_pattern"),
        F.to_json(F.slice(F.coalesce("sample_urls", F.array().cast("array<string>")), 1, 5)).alias("sample_urls"),
        text("dom_structure").alias("dom_structure"), text("existing_jsonld").alias("existing_jsonld"),
        text_or(F.substring(strip(text("schema_type")), 1, 100), "WebPage").alias("recommended_schema"),
        text("optimized_jsonld").alias("optimized_jsonld"), F.lit(created_at).alias("created_at"),
        F.lit(((ws or "").strip() or DEFAULT_WORKSPACE)[:200]).alias("workspace"), F.lit((user or "").strip().lower()).alias("user_email"))


