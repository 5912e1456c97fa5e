"""Queries over names, URLs, dates, maps, listings and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, geo, text
from palimpsest.operators import folds, identity, listing, maps, places, validate
from palimpsest.plans.registry import query
from palimpsest.sources import testbed as T
from palimpsest.sources.testbed import sql



_X, _Y = "greatest(0.0, least(1 - pow(2.0, -53), (lon + 180.0) / 360.0))", f"greatest(0.0, least(1 - pow(2.0, -53), (1.0 - ln(tan(radians(greatest(-{geo.LAT_LIMIT}, least({geo.LAT_LIMIT}, lat)))) + 1.0 / cos(radians(greatest(-{geo.LAT_LIMIT}, least({geo.LAT_LIMIT}, lat))))) / pi()) / 2.0))"


def _keyed_sql(view: str) -> str:
    """CTEs that give ``located``: the rows of a view with quadkey, spread bit by bit."""
    return f"""tiles_ as (select *, least(floor({_X} * 16777216), 16777215)::bigint as tx, least(floor({_Y} * 16777216), 16777215)::bigint as ty from {view}),
located as (select *, cast(list_sum(list_transform(range(0, 24), lambda b: (((tx >> b) & 1) << (2 * b)) + (((ty >> b) & 1) << (2 * b + 1)))) as bigint) as quadkey from tiles_)"""


def located(spark, d):
    return T.points(spark, d).withColumn("quadkey", geo.quadkey(F.col("lat"), F.col("lon")))


@query(sql("points", f", {_keyed_sql('points')} select fact_id, round(lon_x, 9) as x, round(lat_y, 9) as y, quadkey, quadkey >> 28 as tile10 from (select *, {_X} as lon_x, {_Y} as lat_y from located)").replace("\n, tiles_", ",\ntiles_"))
def sca5_7_quadkeys(spark, d):
    p = located(spark, d)
    return p.select("fact_id", F.round(geo.mercator_x(F.col("lon")), 9).alias("x"), F.round(geo.mercator_y(F.col("lat")), 9).alias("y"), "quadkey", geo.tile_prefix(F.col("quadkey"), 10).alias("tile10"))


@query(sql("viewports", f""", halves as (select box, south, north, west, east from viewports where west <= east union all select box, south, north, west, 180.0 from viewports where west > east union all select box, south, north, -180.0, east from viewports where west > east),
ends as (select box, least(floor({_X.replace('lon', 'west')} * 16), 15)::bigint as x0, least(floor({_X.replace('lon', 'east')} * 16), 15)::bigint as x1, least(floor({_Y.replace('lat', 'north')} * 16), 15)::bigint as y0, least(floor({_Y.replace('lat', 'south')} * 16), 15)::bigint as y1 from halves),
cells as (select box, unnest(range(x0, x1 + 1)) as tx, y0, y1 from ends), cells2 as (select box, tx, unnest(range(y0, y1 + 1)) as ty from cells)
select distinct box, cast(list_sum(list_transform(range(0, 4), lambda b: (((tx >> b) & 1) << (2 * b)) + (((ty >> b) & 1) << (2 * b + 1)))) as bigint) as tile from cells2""").replace("\n, halves", ",\nhalves"))  # fmt: skip
def sca8_viewport_tiles(spark, d):
    return geo.viewport_tiles(T.viewports(spark, d), 4, geo.CLUSTER_TILES)


@query(sql("points viewports", "select box, fact_id from viewports, points where lat between south and north and ((west <= east and lon between west and east) or (west > east and (lon >= west or lon <= east)))"))
def jn9_viewport_join(spark, d):
    return maps.viewport_join(T.viewports(spark, d), located(spark, d))


@query(sql("points viewports", "select distinct fact_id from viewports, points where box < 5 and lat between south and north and ((west <= east and lon between west and east) or (west > east and (lon >= west or lon <= east)))"))
def flt5_in_viewport(spark, d):
    return maps.viewport_join(T.viewports(spark, d).where("box < 5"), located(spark, d)).select("fact_id").distinct()


def circles(spark, d):
    """Points with radii from 0 to 980 km."""
    return T.points(spark, d).withColumn("radius_m", F.col("fact_id") % 50 * 20_000.0)


@query()
def flt5_circles_in_viewport(spark, d):
    return maps.circles_in_viewport(T.viewports(spark, d), circles(spark, d))


@query(sql("members viewports", """, inside as (select box, location, shape, j, lat between south and north and ((west <= east and lon between west and east) or (west > east and (lon >= west or lon <= east))) as ok from viewports, members)
select box, location from inside group by box, location, shape having case shape when 0 then bool_or(ok) when 1 then bool_and(ok) when 2 then bool_and(ok or j >= 2) when 3 then bool_or(ok and j < 2) else location % 2 = 1 and bool_and(ok or j >= 3) end""").replace("\n, inside", ",\ninside"))
def flt5_trees_in_viewport(spark, d):
    """Location trees of points against all boxes."""
    return places.in_viewport(T.viewports(spark, d), T.place_trees(spark, d))


@query()
def flt5_wide_trees_in_viewport(spark, d):
    """Location trees of wide circles against all boxes."""
    return places.in_viewport(T.viewports(spark, d), T.place_trees(spark, d, radius=True))


_COVERS = """, cand as (select distinct location // {n} as key, lat, lon from members),
held as (select key, c.lat, c.lon, location, shape, case shape when 0 then bool_or(same) when 1 then bool_and(same) when 2 then true when 3 then bool_or(same and j < 2) else location % 2 = 1 and bool_and(same or j >= 3) end as ok
 from (select key, c.lat, c.lon, m.location, shape, j, m.lat = c.lat and m.lon = c.lon as same from cand c join members m on m.location // {n} = key) c group by key, c.lat, c.lon, location, shape),
met as (select key, lat, lon, bool_and(ok) as ok from held group by key, lat, lon),
seen as (select key, bool_or(ok) as ok from met group by key),
trees as (select location // {n} as key, bool_or(shape in (2, 3)) as open, count(*) filter (shape < 2 or (shape < 4 and j < 2) or (shape = 4 and j < 3)) as n_circles from members group by 1)
select {key}, n_circles, case when not ok then 'conflict' when open then 'pending' else 'consistent' end as verdict from seen join trees using (key)"""


@query(sql("members", _COVERS.format(n=3, key="key as site")).replace("\n, cand", ",\ncand"))
def agg4_tree_bracket(spark, d):
    """What the trees of every three locations say of one site."""
    return places.bracket(T.place_trees(spark, d).withColumn("site", F.expr("location div 3")), "site")


@query(sql("members", _COVERS.format(n=1, key="key as location") + "").replace("\n, cand", ",\ncand").replace("select key as location, n_circles, case when not ok then 'conflict' when open then 'pending' else 'consistent' end as verdict from", "select key as location, 'empty' as fault from") + " where not ok")
def val7_tree_faults(spark, d):
    """Submitted trees that no resolution can save."""
    return places.faults(T.place_trees(spark, d))


@query(sql("points", f", {_keyed_sql('points')} select tile, fact_id from (select quadkey >> 42 as tile, fact_id, row_number() over (partition by quadkey >> 42 order by quadkey, fact_id) as rn from located) where rn <= 32").replace("\n, tiles_", ",\ntiles_"))
def win1_tile_top_n(spark, d):
    return maps.tile_top_n(located(spark, d), 3).select("tile", "fact_id")


@query(sql("points", f""", {_keyed_sql('points')}, coarse as (select fact_id, fact_id // 2 as rep, (quadkey >> 36) << 36 as quadkey from located),
top as (select * from (select *, quadkey >> 38 as tile, row_number() over (partition by quadkey >> 38 order by quadkey, fact_id) as rn from coarse) where rn <= 32),
live_ as (select * from top where fact_id % 13 <> 0),
cells as (select tile, arg_min(rep, (quadkey, fact_id)) as rep, list_sort(list(distinct rep)) as members, min(quadkey) as lo, max(quadkey) as hi from live_ group by tile)
select tile, rep, case when len(members) = 1 then 'singleton' when lo = hi then 'co_located' else 'cluster' end as kind, case when len(members) > 1 and lo = hi then array_to_string(members, ',') end as members,
case when len(members) > 1 and lo <> hi then least(24, (48 - length(ltrim(bin(xor(lo, hi)), '0'))) // 2 + 1)::int end as split_level from cells""").replace("\n, tiles_", ",\ntiles_"))  # fmt: skip
def agg16_cluster_cells(spark, d):
    coarse = located(spark, d).select("fact_id", F.expr("fact_id div 2").alias("rep"), F.shiftleft(F.shiftright("quadkey", 36), 36).alias("quadkey"))
    cells = maps.cluster_cells(maps.tile_top_n(coarse, 5).where("fact_id % 13 <> 0"))
    return cells.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(sql("names", "select fact_id, lower(trim(name)) as name_norm, lang from names"))
def sca1_normalize_name(spark, d):
    return T.names(spark, d).select("fact_id", text.normalize_name(F.col("name")).alias("name_norm"), "lang")


@query(sql("names", "select fact_id, entity from names where lower(trim(name)) = (select min(lower(trim(name))) from names where lang = 'fr') and lang = 'fr'"))
def flt2_by_name(spark, d):
    n = T.names(spark, d).withColumn("name_norm", text.normalize_name(F.col("name"))).where("lang = 'fr'")
    return n.join(F.broadcast(n.agg(F.min("name_norm").alias("name_norm"))), "name_norm").select("fact_id", "entity")


_SNAP = """select event_id, p, case p when 0 then d::date when 1 then date_trunc('month', d)::date when 2 then date_trunc('year', d)::date when 3 then make_date((year(d) // 10) * 10, 1, 1) when 4 then make_date(((year(d) - 1) // 100) * 100 + 1, 1, 1) else make_date(((year(d) - 1) // 1000) * 1000 + 1, 1, 1) end as s,
case p when 0 then d::date when 1 then (date_trunc('month', d) + interval 1 month)::date - 1 when 2 then (date_trunc('year', d) + interval 1 year)::date - 1 when 3 then make_date((year(d) // 10) * 10 + 10, 1, 1) - 1 when 4 then make_date(((year(d) - 1) // 100) * 100 + 101, 1, 1) - 1 else make_date(((year(d) - 1) // 1000) * 1000 + 1001, 1, 1) - 1 end as e
from (select event_id, event_id % 6 as p, date '0001-01-01' + cast(event_id * 73 as int) as d from events)"""


@query(f"select event_id, p::int as precision, date_diff('day', date '0001-01-01', s) + 1 as first_day, date_diff('day', date '0001-01-01', e) + 1 as last_day from ({_SNAP})")
def sca2_snap_dates(spark, d):
    e = T.table(spark, d, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("precision"), (F.col("event_id") * 73 + 1).alias("day"))
    return e.select("event_id", "precision", dates.snap_date(F.col("day"), F.col("precision")).alias("first_day"), dates.period_end(F.col("day"), F.col("precision")).alias("last_day"))


@query(sql("dated", """select fact_id, case when coalesce(greatest(lo, 10), 10) <= coalesce(least(hi, 40), 40) then greatest(lo, 10) end as meet_lo, case when coalesce(greatest(lo, 10), 10) <= coalesce(least(hi, 40), 40) then least(hi, 40) end as meet_hi,
coalesce(lo, -1000) <= 40 and coalesce(hi, 1000) >= 10 as overlaps, case when coalesce(lo, -1000) <= 41 and coalesce(hi, 1000) >= 9 then 1 else 2 end as n_join from dated"""))
def sca3_interval_algebra(spark, d):
    one = F.array(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
    other = F.array(F.struct(F.lit(10).cast("long").alias("lo"), F.lit(40).cast("long").alias("hi")))
    met = F.get(dates.date_meet(one, other), F.lit(0))
    return T.dated(spark, d).select("fact_id", met["lo"].alias("meet_lo"), met["hi"].alias("meet_hi"), dates.date_overlaps(F.col("lo"), F.col("hi"), F.lit(10), F.lit(40)).alias("overlaps"), F.size(dates.date_join(one, other)).alias("n_join"))


_NORM = r"""(select page_id, u, sch || '://' || h || case when port = '' or (sch = 'http' and port = '80') or (sch = 'https' and port = '443') then '' else ':' || port end || case when path = '' then '/' when length(path) > 1 and path like '%%/' then regexp_replace(path, '/$', '') else path end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as norm, sch, h, path
from (select page_id, u, lower(regexp_extract(u, '^(?i)(https?)://', 1)) as sch, coalesce(map {%s}[lower(regexp_extract(u, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))], lower(regexp_extract(u, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))) as h,
 regexp_extract(u, '^(?i)https?://(?:[^/?#@]*@)?[^/?#:]+:(\d*)', 1) as port, regexp_extract(u, '^(?i)https?://(?:[^/?#@]*@)?[^/?#:]+(?::\d*)?([^?#]*)', 1) as path,
 list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(lower(split_part(p, '=', 1)), 'utm_') and lower(split_part(p, '=', 1)) not in (%s)) as kept
 from (select page_id, url || case page_id %% 6 when 0 then '/' when 1 then '?utm_source=a&x=1' when 2 then '?fbclid=z#top' when 3 then '#frag' when 4 then '?b=2&gclid=1&a=1' else '' end as u from pages)) where sch <> '')""" % (
    ", ".join(f"'{k}': '{v}'" for k, v in text.HOST_ALIASES.items()), ", ".join(f"'{k}'" for k in text.TRACKING))


def urls(spark, d):
    p = T.table(spark, d, "pages")
    tail = F.element_at(F.array(*map(F.lit, ("/", "?utm_source=a&x=1", "?fbclid=z#top", "#frag", "?b=2&gclid=1&a=1", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    return p.select("page_id", F.concat("url", tail).alias("u"))


@query(f"select page_id, norm from {_NORM}")
def sca11_normalize_url(spark, d):
    return urls(spark, d).select("page_id", text.normalize_url(F.col("u")).alias("norm")).where("norm is not null")


@query(f"select norm, min(page_id) as page_id from {_NORM} where page_id % 2 = 1 and norm not in (select norm from {_NORM} where page_id % 2 = 0) group by norm")
def set3_insert_new_urls(spark, d):
    u = urls(spark, d).select("page_id", text.normalize_url(F.col("u")).alias("norm")).where("norm is not null")
    new = u.where("page_id % 2 = 1").groupBy("norm").agg(F.min("page_id").alias("page_id"))
    return validate.insert_new(new, u.where("page_id % 2 = 0").distinct(), "norm").select("norm", "page_id")


@query(f"select h as host, count(*) as n, count(distinct norm) as n_urls from {_NORM} group by h")
def flt3_by_reference_host(spark, d):
    u = urls(spark, d).select(text.host(F.col("u")).alias("host"), text.normalize_url(F.col("u")).alias("norm")).where("norm is not null")
    return u.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("n_urls"))


_REF_URL = """case event_id % 7 when 0 then 'https://www.wikidata.org/wiki/Q' || (event_id + 1) when 1 then 'https://www.openstreetmap.org/way/' || event_id when 2 then 'https://en.wikipedia.org/wiki/Old_Town_' || event_id when 3 then 'https://www.geonames.org/' || event_id || '/x.html' when 4 then 'https://pleiades.stoa.org/places/' || event_id when 5 then 'https://commons.wikimedia.org/wiki/Category:Old_' || event_id else 'https://example.org/' || event_id end"""


@query(f"""select event_id, case event_id % 7 when 0 then 'wikidata' when 1 then 'osm' when 2 then 'wikipedia' when 3 then 'geonames' when 4 then 'pleiades' when 5 then 'commons_category' else 'url' end as system,
case event_id % 7 when 0 then 'Q' || (event_id + 1) when 1 then 'way/' || event_id when 2 then 'en:Old Town ' || event_id when 3 then event_id::varchar when 4 then event_id::varchar when 5 then 'Old ' || event_id else {_REF_URL} end as key,
case event_id % 7 when 3 then 'https://www.geonames.org/' || event_id else {_REF_URL} end as canonical from events""")
def sca13_references(spark, d):
    ref = text.reference_from_url(F.expr(_REF_URL))
    e = T.table(spark, d, "events").select("event_id", ref.alias("r")).select("event_id", "r.system", "r.key")
    return e.withColumn("canonical", text.reference_to_url(F.col("system"), F.col("key")))


@query("""select page_id, 'web/' || sha256(lower(regexp_extract(u, '^(https?)://', 1)) || '://' || lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) || regexp_extract(u, '^https?://[^/?#:]+([^?#]*)', 1) || case when regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) <> '' then '?' || regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) else '' end) as key,
lower(regexp_extract(regexp_extract(u, '^https?://[^/?#:]+([^?#]*)', 1), '\\.([^./]*)$', 1)) in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'avif', 'svg') as shown
from (select page_id, url || case page_id % 4 when 0 then '/a.JPG?x=1#f' when 1 then '/b.tif' when 2 then '/c.png' else '/d' end as u from pages) where u like 'http%'""")
def sca12_media_keys(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ("/a.JPG?x=1#f", "/b.tif", "/c.png", "/d"))), (F.col("page_id") % 4 + 1).cast("int"))
    u = F.concat("url", tail)
    return T.table(spark, d, "pages").where(u.startswith("http")).select("page_id", text.media_key(u).alias("key"), text.displayable(u).alias("shown"))


@query("select doc_id, sha256(text) as hash from documents")
def sca14_content_hash(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""select event_id, y as year, case when y < 0 then (-y)::varchar || ' BCE' when y < 1500 then y::varchar || ' CE' else y::varchar end as label,
case when y <= -2000 then 0 when y >= 2026 then 526 when y <= 1500 then (y + 2010) // 20 when y <= 1850 then 175 + (y - 1499) // 2 else y - 1500 end::int as unit from (select event_id, event_id * 7 % 4600 - 2300 as y from events) where y <> 0""")
def sca15_16_eras(spark, d):
    e = T.table(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 4600 - 2300).alias("year")).where("year <> 0")
    return e.select("event_id", "year", text.era_label(F.col("year")).alias("label"), text.timeline_unit(F.col("year"), 2026).alias("unit"))


@query("""select p_partkey, isbn, (list_sum(list_transform(range(1, 14), lambda i: cast(substr(isbn, i, 1) as int) * case when i % 2 = 1 then 1 else 3 end)) % 10 = 0) as ok from (select p_partkey, '978' || lpad((p_partkey * 7919 % 10000000000)::varchar, 10, '0') as isbn from part)""")
def sca17_isbn(spark, d):
    isbn = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 10000000000).cast("string"), 10, "0"))
    return T.table(spark, d, "part").select("p_partkey", isbn.alias("isbn"), text.isbn_ok(isbn).alias("ok"))


@query("""select event_id, case event_id % 3 when 2 then null else ts end as published from (select event_id, date_trunc('second', ts) as ts from events)""")
def sca19_parse_published(spark, d):
    t = F.date_trunc("second", "ts")
    spelled = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit("last spring"))
    return T.table(spark, d, "events").select("event_id", text.parse_published(spelled).alias("published"))


@query(sql("owned_events", """select event, 'started' as role, started as day from owned_events where started is not null or completed is null union all select event, 'completed', completed from owned_events where completed is not null"""))
def sca10_moments(spark, d):
    return listing.moments(T.owned_events(spark, d))


@query(sql("owned_events", "select event, owner, kind from owned_events"))
def jn5_event_owners(spark, d):
    e = T.owned_events(spark, d)
    older = e.select("event", (F.col("owner") + 1).alias("owner"), "kind", F.col("event").alias("fact_id"))
    return folds.event_owners(e.select("event", "owner", "kind", (F.col("event") + 1_000_000_000).alias("fact_id")).unionByName(older))


@query(sql("owned_events", "select event, owner + 1 as owner, kind from owned_events"))
def win4_event_pin(spark, d):
    e = T.owned_events(spark, d)
    older = e.select("event", (F.col("owner") + 1).alias("owner"), "kind", F.col("event").alias("fact_id"))
    return listing.event_pin(e.select("event", "owner", "kind", (F.col("event") + 1_000_000_000).alias("fact_id")).unionByName(older))


@query(sql("owned_events", """select owner as rep, kind, count(*) as n, min(started) as first_started, max(completed) as last_completed from owned_events group by owner, kind"""))
def agg21_event_records(spark, d):
    e = T.owned_events(spark, d)
    return e.groupBy(F.col("owner").alias("rep"), "kind").agg(F.count("*").alias("n"), F.min("started").alias("first_started"), F.max("completed").alias("last_completed"))


@query(sql("owned_events points", f", {_keyed_sql('points')} select l.fact_id, coalesce(owner, l.fact_id) as rep, quadkey from located l left join owned_events on event = l.fact_id where fact_id % 2 = 0 or owner is not null").replace("\n, tiles_", ",\ntiles_"))
def jn7_attribute(spark, d):
    p = located(spark, d).select("fact_id", F.col("fact_id").alias("event"), F.when(F.col("fact_id") % 2 == 0, F.lit(None).cast("long")).alias("_none"), "quadkey")
    owners = T.owned_events(spark, d).select("event", "owner")
    placed = p.join(owners.select("event", F.lit(True).alias("_owned")), "event", "left").withColumn("entity", F.when(F.col("_owned").isNull() & (F.col("fact_id") % 2 == 0), F.col("fact_id"))).drop("_owned", "_none")
    return folds.attribute(placed, owners, spark.createDataFrame([], "member long, rep long"))


@query("""select c_custkey as subject_id, case when c_custkey % 3 = 0 then 'entity' when c_custkey % 3 = 1 then 'event' else 'image' end as subject_kind, c_custkey % 3 as n from customer""")
def prj4_located(spark, d):
    c = T.table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "entity").when(F.col("c_custkey") % 3 == 1, "event").otherwise("image")
    return c.select(F.col("c_custkey").alias("subject_id"), kind.alias("subject_kind"), (F.col("c_custkey") % 3).alias("n"))


@query(sql("depicts", "select entity, arg_min(image, (not exterior, image)) as image from depicts group by entity"))
def win6_representative_image(spark, d):
    return listing.representative_image(T.depicts(spark, d))


@query(sql("depicts", "select entity, count(distinct image) as n_images, bool_or(exterior) as any_exterior, min(subject_day) as first_day from depicts group by entity"))
def jn8_depictions(spark, d):
    return T.depicts(spark, d).groupBy("entity").agg(F.countDistinct("image").alias("n_images"), F.bool_or("exterior").alias("any_exterior"), F.min("subject_day").alias("first_day"))


@query(sql("depicts", "select image, array_to_string(list_sort(list(distinct entity)), ',') as entities, min(subject_day) as lo, max(subject_day) as hi, count(*) as n from depicts group by image"))
def agg22_image_records(spark, d):
    return T.depicts(spark, d).groupBy("image").agg(F.array_join(F.sort_array(F.collect_set("entity")).cast("array<string>"), ",").alias("entities"), F.min("subject_day").alias("lo"), F.max("subject_day").alias("hi"), F.count("*").alias("n"))


@query(sql("names", "select entity, name, lang from (select *, row_number() over (partition by entity order by case lang when 'de' then 1 when 'es' then 2 when 'en' then 3 else 4 end, fact_id) as rn from names) where rn = 1"))
def win7_negotiate_name(spark, d):
    return listing.negotiate_name(T.names(spark, d), ["de", "es"])


@query(sql("facts", "select distinct entity as rep, fact_id from facts where (entity, fact_id) > ((select max(entity) // 2 from facts), 50) order by 1, 2 limit 256"))
def win2_class_walk(spark, d):
    """A page that begins in the middle of the log's entities."""
    f = T.facts(spark, d)
    middle = f.agg(F.expr("max(entity) div 2")).first()[0]
    return listing.class_walk(f.select(F.col("entity").alias("rep"), "fact_id"), (middle, 50), 256)


@query("select event_id, ts from events where (ts, event_id) < ((select ts from events where event_id = 500), 500) order by ts desc, event_id desc limit 50")
def win3_keyset_page(spark, d):
    e = T.table(spark, d, "events").select("event_id", "ts")
    at = e.where("event_id = 500").first()
    return listing.keyset_page(e, "ts", "event_id", (at["ts"], at["event_id"]), 50)


@query(sql("facts", """, c as (select fact_id, entity, coalesce(lo, hi) as "at", case kind when 'construction_started' then 'construction' when 'demolition_completed' then 'demolition' else 'other' end as kind from facts where kind in ('construction_started', 'demolition_completed', 'event') and coalesce(lo, hi) is not null),
d as (select entity, "at", kind, min(fact_id) as fact_id from c group by all),
t as (select *, sum(case when kind = 'demolition' then 1 else 0 end) over w as torn from d window w as (partition by entity order by "at", case when kind = 'construction' then 0 else 1 end, kind rows unbounded preceding)),
n as (select *, case when kind = 'construction' and torn > coalesce(last_value(case when kind = 'construction' then torn end ignore nulls) over (partition by entity order by "at", case when kind = 'construction' then 0 else 1 end, kind rows between unbounded preceding and 1 preceding), 0) then 1 else 0 end as new from t)
select entity, "at", kind, sum(new) over (partition by entity order by "at", case when kind = 'construction' then 0 else 1 end, kind rows unbounded preceding)::bigint as part from n""").replace("\n, c as", ",\nc as"))  # fmt: skip
def win5_split_on_rebuild(spark, d):
    f = T.facts(spark, d).where("kind in ('construction_started', 'demolition_completed', 'event')")
    kind = F.when(F.col("kind") == "construction_started", "construction").when(F.col("kind") == "demolition_completed", "demolition").otherwise("other")
    c = f.select("entity", F.coalesce("lo", "hi").alias("at"), kind.alias("kind")).where("at is not null").distinct()
    return listing.split_on_rebuild(c)


@query(sql("points owned_events", """select c.fact_id as entity, coalesce(m.lat, c.lat) as lat, coalesce(m.lon, c.lon) as lon from points c left join (
select owner, arg_max(p.lat, (landed is not null, coalesce(landed, -1), event)) as lat, arg_max(p.lon, (landed is not null, coalesce(landed, -1), event)) as lon from (select event, owner, coalesce(completed, started) as landed from owned_events where kind = 'moved') join points p on p.fact_id = event group by owner) m on m.owner = c.fact_id"""))
def win11_current_location(spark, d):
    p = T.points(spark, d)
    sites = p.select(F.col("fact_id").alias("entity"), "fact_id", "lat", "lon")
    moves = T.owned_events(spark, d).where("kind = 'moved'").join(p, F.col("event") == F.col("fact_id")).select(F.col("owner").alias("entity"), F.col("event").alias("fact_id"), "lat", "lon", F.coalesce("completed", "started").alias("landed"))
    return listing.current_location(sites, moves)


@query(sql("owned_events", "select owner // 25 as pin, owner as entity, row_number() over (partition by owner // 25 order by m nulls last, owner) - 1 as place from (select c_custkey as owner, m from customer left join (select owner, min(started) as m from owned_events group by owner) on owner = c_custkey)"))
def win12_picker(spark, d):
    first = T.owned_events(spark, d).groupBy("owner").agg(F.min("started").alias("earliest"))
    m = T.table(spark, d, "customer").select(F.col("c_custkey").alias("owner")).join(first, "owner", "left").select(F.expr("owner div 25").alias("pin"), F.col("owner").alias("entity"), "earliest")
    return listing.picker(m)


@query(sql("points owned_events", "select entity, n from (select fact_id as entity, n from points left join (select owner, count(*) as n from owned_events group by owner) on owner = fact_id where lat between -30 and 30 and lon between -60 and 60) order by entity limit 40"))
def win10_list_entities(spark, d):
    n = T.owned_events(spark, d).groupBy(F.col("owner").alias("entity")).agg(F.count("*").alias("n"))
    box = spark.range(1).select(F.col("id").alias("box"), *[F.lit(v).alias(k) for k, v in (("south", -30.0), ("north", 30.0), ("west", -60.0), ("east", 60.0))])
    inside = maps.viewport_join(box, located(spark, d)).select(F.col("fact_id").alias("entity"))
    return inside.join(n, "entity", "left").select("entity", "n").orderBy("entity").limit(40)


@query(sql("facts", "select kind, array_to_string(list_sort(list(distinct lo % 3)), ',') as values, case when count(distinct lo % 3) = 1 then min(lo % 3) end as agreed, count(distinct lo % 3) > 1 as conflict from (select entity // 2 as kind, lo from facts where lo is not null and kind = 'construction_started') group by kind"))
def agg3_value_bracket(spark, d):
    c = T.facts(spark, d).where("lo is not null and kind = 'construction_started'").select(F.expr("entity div 2").alias("kind"), (F.col("lo") % 3).cast("long").alias("v"))
    return folds.value_bracket(c, "kind", "v").withColumn("values", F.array_join(F.col("values").cast("array<string>"), ","))


@query(sql("names", "select entity, lang, lower(trim(name)) as name_norm, array_to_string(list_sort(list(distinct fact_id)), ',') as support from names group by all"))
def agg5_keyed_names(spark, d):
    n = T.names(spark, d).withColumn("name_norm", text.normalize_name(F.col("name")))
    return folds.keyed_support(n, "entity", "lang", "name_norm").withColumn("support", F.array_join(F.col("support").cast("array<string>"), ","))


@query("""select c_custkey as fact_id, c_custkey - c_custkey % 5 as rep, (c_custkey + c_nationkey) - (c_custkey + c_nationkey) % 5 as far_rep from customer where c_custkey - c_custkey % 5 <> (c_custkey + c_nationkey) - (c_custkey + c_nationkey) % 5""")
def agg6_outgoing_edges(spark, d):
    c = T.table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("fact_id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.col("c_nationkey")).alias("b"))
    members = edges.select(F.col("a").alias("member")).unionByName(edges.select(F.col("b").alias("member"))).distinct()
    return folds.outgoing_edges(edges, members.withColumn("rep", F.col("member") - F.col("member") % 5))


@query(sql("names", """, decls as (select fact_id as decl, lower(trim(name)) as name_norm, lang, entity from names where fact_id % 5 = 0),
cand as (select decl, n.entity from decls join names n on n.fact_id % 5 <> 0 and lower(trim(n.name)) = name_norm and n.lang = decls.lang where decl % 10 <> 0 union all select decl, n.entity from decls join names n on n.fact_id % 5 <> 0 and n.fact_id = decl + 1 where decl % 10 = 0)
select decl, count(distinct c.entity // 2) as n_candidates, case when count(distinct c.entity // 2) = 1 then min(c.entity // 2) end as rep, case count(distinct c.entity // 2) when 0 then 'new' when 1 then 'matched' else 'ambiguous' end as outcome from decls left join cand c using (decl) group by decl""").replace("\n, decls", ",\ndecls"))  # fmt: skip
def jn11_match_entities(spark, d):
    return identity.match_entities(*_declared(spark, d))


def _declared(spark, d):
    """Declarations, their references, known names and references with fact_id, and classes of two, from ``names``."""
    n = T.names(spark, d).withColumn("name_norm", text.normalize_name(F.col("name")))
    decls, known = n.where("fact_id % 5 = 0").withColumnRenamed("fact_id", "decl"), n.where("fact_id % 5 <> 0")
    refs = decls.where("decl % 10 = 0").select("decl", (F.col("decl") + 1).alias("ref"))
    reps = known.select(F.col("entity").alias("member")).distinct().withColumn("rep", F.expr("member div 2"))
    return decls.select("decl", "name_norm", "lang"), refs, known.select("entity", "name_norm", "lang", "fact_id"), known.select("entity", F.col("fact_id").alias("ref"), "fact_id"), reps


@query(sql("names", """, decls as (select fact_id as decl, lower(trim(name)) as name_norm, lang from names where fact_id % 5 = 0),
cand as (select decl, n.entity // 2 as rep, fact_id from decls join names n on n.fact_id % 5 <> 0 and lower(trim(n.name)) = name_norm and n.lang = decls.lang where decl % 10 <> 0 union select decl, n.entity // 2, fact_id from decls join names n on n.fact_id % 5 <> 0 and n.fact_id = decl + 1 where decl % 10 = 0)
select decl, rep, fact_id from cand where decl in (select decl from cand group by 1 having count(distinct rep) = 1)""").replace("\n, decls", ",\ndecls"))  # fmt: skip
def jn11_match_basis(spark, d):
    """The facts that each matched declaration's identity rests on."""
    return identity.match_basis(*_declared(spark, d))


@query(f"""select page_id as decl, coalesce(n, 0) as n_candidates, case when n = 1 then image end as image from {_NORM} left join (select norm, count(distinct page_id) as n, min(page_id) as image from {_NORM} where page_id % 2 = 0 group by norm) using (norm) where page_id % 2 = 1""")
def jn12_match_images(spark, d):
    u = urls(spark, d).select("page_id", text.normalize_url(F.col("u")).alias("source_url")).where("source_url is not null")
    return identity.match_images(u.where("page_id % 2 = 1").withColumnRenamed("page_id", "decl"), u.where("page_id % 2 = 0").withColumnRenamed("page_id", "image"))


@query("""select o_orderkey as url_id, o_orderdate as created_at from orders join (select distinct c_custkey from customer where c_nationkey = 3) on o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 100""")
def jn15_followed(spark, d):
    follows = T.table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    items = T.table(spark, d, "orders").join(follows, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("url_id"), F.col("o_orderdate").alias("created_at"))
    return listing.keyset_page(items, "created_at", "url_id", None, 100)


@query(sql("facts", "select fact_id from facts union select fact_id from facts where kind = 'event'"))
def set1_union_dedup(spark, d):
    f = T.facts(spark, d).select("fact_id", "kind")
    return f.unionByName(f.where("kind = 'event'")).dropDuplicates(["fact_id"]).select("fact_id")


@query("select sha256(text) as commit_id, count(*) as n from documents where doc_id % 4 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 4 <> 1) group by 1")
def set2_dedup_commits(spark, d):
    x = T.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("commit_id"))
    new = x.where("doc_id % 4 = 1")
    kept = validate.dedup_commits(new, x.where("doc_id % 4 <> 1"))
    return kept.select("commit_id").join(new, "commit_id").groupBy("commit_id").agg(F.count("*").alias("n"))


@query("select sha256(text) as hash, coalesce(min(case when doc_id % 3 = 0 then doc_id end), min(case when doc_id % 3 <> 0 then doc_id end)) as id, min(case when doc_id % 3 = 0 then doc_id end) is null as is_new from documents group by 1 having bool_or(doc_id % 3 <> 0)")
def set4_upsert_media(spark, d):
    x = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return validate.upsert_media(x.where("id % 3 <> 0"), x.where("id % 3 = 0"))


_EDGES = "(select o_orderkey // 2 as event, o_custkey % 7 as owner, substr(o_orderpriority, 1, 1) as kind, o_orderkey as fact_id from orders where o_orderkey % 3 <> 0)"


def ownership(spark, d):
    """One or two ownership edges of each event; later orders' numbers are events without any."""
    return T.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.expr("o_orderkey div 2").alias("event"), (F.col("o_custkey") % 7).alias("owner"), F.substring("o_orderpriority", 1, 1).alias("kind"), F.col("o_orderkey").alias("fact_id"))


@query(f"select e as event, coalesce(n, 0) as n, case when n is null then 'missing' else 'multiple' end as fault from (select distinct l_orderkey as e from lineitem) left join (select event, count(distinct (owner, kind)) as n from {_EDGES} group by event) on event = e where coalesce(n, 0) <> 1")
def val1_event_one_kind(spark, d):
    return validate.event_one_kind(ownership(spark, d), T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event")))


@query(sql("owned_events", "select event, kind, case when event % 2 = 0 then 'span' else 'point' end as payload from owned_events where (event % 2 = 0 and kind = 'usage_changed') or (event % 2 = 1 and kind <> 'usage_changed')"))
def val2_kind_consistency(spark, d):
    e = T.owned_events(spark, d)
    payload = F.when(F.col("event") % 2 == 0, "span").otherwise("point")
    return validate.kind_consistency(e.select("event", payload.alias("payload")), e.select("event", "kind")).select("event", "kind", "payload")


@query(f"select e.event, e.fact_id from {_EDGES} e join (select event, arg_min(owner, fact_id) as o, arg_min(kind, fact_id) as k from {_EDGES} group by event) p on e.event = p.event where owner <> o or kind <> k")
def val3_ownership_changed(spark, d):
    e = ownership(spark, d)
    return validate.ownership_changed(e, listing.event_pin(e))


@query("select event_id as fact_id from events where event_id % 41 = 0")
def val4_same_event(spark, d):
    k = F.when(F.col("event_id") % 41 == 0, "same_event").otherwise("name")
    return validate.same_event(T.table(spark, d, "events").select(F.col("event_id").alias("fact_id"), k.alias("kind"))).select("fact_id")


@query("select l_orderkey, l_linenumber from lineitem where l_tax * 100 < l_quantity - 40")
def val5_inverted_window(spark, d):
    x = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 40).alias("valid_from"), (F.col("l_tax") * 100).alias("valid_to"))
    return validate.inverted_window(x).select("l_orderkey", "l_linenumber")


@query(sql("dated", "select fact_id from dated where fact_id % 5 in (0, 2)"))
def val6_not_one_interval(spark, d):
    one = F.struct("lo", "hi")
    x = T.dated(spark, d).withColumn("date", F.when(F.col("fact_id") % 5 == 0, F.array(one).cast("array<struct<lo:int,hi:int>>")).when(F.col("fact_id") % 5 == 2, F.array(one, one)).otherwise(F.array(one)))
    x = x.withColumn("date", F.when(F.col("fact_id") % 5 == 0, F.slice("date", 1, 0)).otherwise(F.col("date")))
    return validate.not_one_interval(x).select("fact_id")


@query("select l_orderkey as image, count(*) as n from lineitem group by 1 having count(*) > 5")
def val7_bad_location(spark, d):
    x = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_list("l_linenumber").alias("_l"))
    x = x.withColumn("circles", F.when(F.size("_l") > 5, F.sequence(F.lit(0), F.lit(100))).otherwise(F.col("_l")))
    return validate.bad_location(x).select("image", F.size("_l").cast("long").alias("n"))


@query(sql("depicts", "select p_partkey as entity, p_partkey * 2 as image from part where not exists (select 1 from depicts where entity = p_partkey and image = p_partkey * 2)"))
def val8_observation_without_depiction(spark, d):
    o = T.table(spark, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_partkey") * 2).alias("image"))
    return validate.observation_without_depiction(o, T.depicts(spark, d)).select("entity", "image")


_COMP = "(select c_custkey as child, case when c_custkey % 10 = 0 then c_custkey else c_custkey * 3 % 1500 end as parent from customer where c_custkey % 4 = 0 union select c_custkey, c_custkey + 1 from customer where c_custkey % 20 = 0)"


@query(f"""with e as {_COMP} select child, 'self_parent' as fault from e where child = parent union select child, 'several_parents' from e group by child having count(distinct parent) > 1 union select child, 'chain' from e where child <> parent and parent in (select child from e)""")
def val9_composite_faults(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("child"))
    a = c.where("child % 4 = 0").withColumn("parent", F.when(F.col("child") % 10 == 0, F.col("child")).otherwise(F.col("child") * 3 % 1500))
    return validate.composite_faults(a.unionByName(c.where("child % 20 = 0").withColumn("parent", F.col("child") + 1)).distinct())


@query(sql("facts", """select f.fact_id, case when t.fact_id is null then 'unknown_target' when r >= f.fact_id then 'not_older' else 'same_commit' end as fault from (select *, case when fact_id % 13 = 0 then retracts_fact_id + 100000000 when fact_id % 7 = 0 then fact_id else retracts_fact_id end as r from facts where retracts_fact_id is not null) f left join facts t on t.fact_id = r
where t.fact_id is null or r >= f.fact_id or t.commit_seq = f.commit_seq"""))
def val10_retraction_targets(spark, d):
    f = T.facts(spark, d)
    r = F.when(F.col("fact_id") % 13 == 0, F.col("retracts_fact_id") + 100_000_000).when((F.col("fact_id") % 7 == 0) & F.col("retracts_fact_id").isNotNull(), F.col("fact_id")).otherwise(F.col("retracts_fact_id"))
    return validate.retraction_targets(f.withColumn("retracts_fact_id", r))


_DECL = "(select l_orderkey as bundle, l_partkey % 50 as subject, l_linenumber = 1 as existing from lineitem)"
_USED = "(select distinct l_orderkey as bundle, l_partkey % 50 as subject from lineitem where l_quantity > 10 union select l_orderkey, 60 from lineitem where l_orderkey % 97 = 0)"


@query(f"""with d as {_DECL}, u as {_USED} select bundle, subject, 'duplicated' as fault from d group by 1, 2 having count(*) > 1
union all select distinct bundle, subject, 'unused' from d where (bundle, subject) not in (select (bundle, subject) from u) union all select distinct bundle, subject, 'undeclared' from u where (bundle, subject) not in (select (bundle, subject) from d)
union all select distinct bundle, subject, 'unknown' from d where existing and subject % 6 = 0""")
def val11_declaration_faults(spark, d):
    x = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bundle"), (F.col("l_partkey") % 50).alias("subject"), (F.col("l_linenumber") == 1).alias("existing"), "l_quantity")
    used = x.where("l_quantity > 10").select("bundle", "subject").unionByName(x.where("bundle % 97 = 0").select("bundle", F.lit(60).cast("long").alias("subject"))).distinct()
    return validate.declaration_faults(x.drop("l_quantity"), used, spark.range(50).where("id % 6 <> 0").withColumnRenamed("id", "subject"))


@query("""select bundle from (select l_orderkey as bundle, bool_or(l_tax > 0.07) as a, max(l_linenumber) > 6 as b from lineitem group by 1) where not a and not b""")
def val12_accepted_bundles(spark, d):
    x = T.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "bundle")
    ok, _ = validate.validate(x.select("bundle").distinct(), {"tax": x.where("l_tax > 0.07"), "lines": x.where("l_linenumber > 6")})
    return ok


_SUPERSEDED = """x as (select fact_id, commit_seq, case when kind = 'name' then case fact_id % 4 when 0 then fact_id + 100000000 when 1 then fact_id - 40 when 2 then fact_id else fact_id // 2 end end as target, case when kind = 'name' then case fact_id % 3 when 0 then fact_id + 1000000000 when 1 then fact_id - 40 else fact_id end end as replacement from facts)"""


@query(sql("facts", f""", {_SUPERSEDED}
select fact_id, 'same_as_replacement' as fault from x where target = replacement
union all select x.fact_id, case when t.fact_id is null or t.commit_seq > x.commit_seq then 'unknown_target' else 'same_commit' end from x left join facts t on t.fact_id = target where target is not null and target <> replacement and (t.fact_id is null or t.commit_seq >= x.commit_seq)
union all select x.fact_id, 'unknown_replacement' from x left join facts t on t.fact_id = replacement where target is not null and target <> replacement and (t.fact_id is null or t.commit_seq > x.commit_seq)""").replace("\n, x as", ",\nx as"))  # fmt: skip
def val10_supersede_targets(spark, d):
    f, i = T.facts(spark, d), F.col("fact_id")
    target = F.when(i % 4 == 0, i + 100_000_000).when(i % 4 == 1, i - 40).when(i % 4 == 2, i).otherwise(F.expr("fact_id div 2"))
    other = F.when(i % 3 == 0, i + 1_000_000_000).when(i % 3 == 1, i - 40).otherwise(i)
    named = F.col("kind") == "name"
    return validate.supersede_targets(f.withColumns({"supersedes_fact_id": F.when(named, target), "replacement_fact_id": F.when(named, other)}))


@query(sql("facts", """, x as (select fact_id, commit_seq, case when fact_id % 9 = 0 then commit_seq when fact_id % 9 = 1 then commit_seq + 3 else retracts_commit_seq end as r from facts where retracts_commit_seq is not null)
select fact_id, 'unknown_commit' as fault from x where r >= commit_seq or r not in (select commit_seq from facts)""").replace("\n, x as", ",\nx as"))
def val10_commit_targets(spark, d):
    i, c = F.col("fact_id"), F.col("commit_seq")
    r = F.when(F.col("retracts_commit_seq").isNotNull(), F.when(i % 9 == 0, c).when(i % 9 == 1, c + 3).otherwise(F.col("retracts_commit_seq")))
    return validate.commit_targets(T.facts(spark, d).withColumn("retracts_commit_seq", r))
