"""Queries over dumps, captures, images, provenance and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, text
from palimpsest.operators import capture, conflicts, graph, identity, ingest, labels, listing, vectors
from palimpsest.plans.claim_queries import _BOUNDS, _LIFE, _VERDICT, _bag_sql, bag
from palimpsest.plans.registry import query
from palimpsest.scratch import drop, scratch, stored
from palimpsest.sources import dumps
from palimpsest.sources import testbed as T
from palimpsest.sources.testbed import sql
from palimpsest.streaming import jobs


#: Items that one task makes, writes or parses.
ITEMS = 10_000


def dealt(rows, key):
    """``rows`` in partitions that follow their number: a table of few columns is one split, however many lines are made of it."""
    return rows.repartition(max(1, -(-rows.count() // ITEMS)), key)


def dump(spark, d):
    """A dump written from ``part``: brackets, trailing commas, and a cut-off line for every 50th item."""
    snak = lambda value, kind: f'{{"mainsnak":{{"snaktype":"value","datavalue":{{"type":"{kind}","value":{value}}}}},"rank":"%s"'
    time = '{"time":"+%d-00-00T00:00:00Z","precision":9}'
    form = '{"id":"Q%d","type":"item","lastrevid":1,"labels":{"en":{"language":"en","value":"%s"}},"claims":{'
    form += '"P31":[' + snak('{"id":"Q%d"}', "wikibase-entityid") + '}],"P279":[' + snak('{"id":"Q%d"}', "wikibase-entityid") + '}],'
    form += '"P571":[' + snak(time, "time") + '}],"P793":[' + snak('{"id":"%s"}', "wikibase-entityid") + ',"qualifiers":{"P585":[{"snaktype":"value","datavalue":{"type":"time","value":' + time + "}}]}}],"
    form += '"P18":[' + snak('"File %d.jpg"', "string") + '}]},"sitelinks":{"enwiki":{"title":"Old %d"}}}'
    p, k, n = dealt(T.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), F.col("p_partkey"), F.lit("normal")
    rank = F.when(k % 11 == 0, "deprecated").otherwise("normal")
    event = F.element_at(F.array(*map(F.lit, ("Q168983", "Q217102", "Q999999"))), (k % 3 + 1).cast("int"))
    line = F.format_string(form, k + 1, F.col("p_name"), k % 20 + 1, rank, F.expr("p_partkey div 4"), n, k % 500 + 1500, n, event, n, k % 500 + 1600, k, n, k)
    lines = p.select(F.when(k % 50 == 0, F.substring(line, 1, 100)).otherwise(F.concat(line, F.lit(","))).alias("value"))
    path = scratch(spark, "dump")
    lines.unionByName(spark.range(2).select(F.when(F.col("id") == 0, "[").otherwise("]").alias("value"))).write.option("compression", "bzip2").text(path)
    return dumps.read_entity_dump(spark, path)


def items(spark, d):
    return dumps.parse_entities(dump(spark, d))[0]


_GOOD = "(select *, p_partkey as k from part where p_partkey % 50 <> 0)"


@query("select count(*) as n_items, count(*) filter (p_partkey % 50 = 0) as n_malformed from part")
def src1_2_dump_lines(spark, d):
    lines = stored(dump(spark, d), "lines")
    good, bad = dumps.parse_entities(lines)
    return lines.agg(F.count("*").alias("n_items")).crossJoin(bad.agg(F.count("*").alias("n_malformed")))


@query("select count(*) as n_items, count(*) filter (p_partkey % 50 = 0) as n_malformed from part")
def src1_gzip_members(spark, d):
    """The dump written as gzip files and read by their members."""
    path = scratch(spark, "gzip")
    dump(spark, d).select("value").write.option("compression", "gzip").text(path)
    lines = stored(dumps.read_entity_dump(spark, path, members=True), "lines")
    good, bad = dumps.parse_entities(lines)
    return lines.agg(F.count("*").alias("n_items")).crossJoin(bad.agg(F.count("*").alias("n_malformed")))


@query(f"select 'Q' || (k + 1) as child, 'Q' || (k // 4) as parent from {_GOOD}")
def src3_subclass_view(spark, d):
    return dumps.subclass_view(dump(spark, d))


@query(f"select 'Q' || (k + 1) as item, 'Q' || (k % 20 + 1) as type from {_GOOD} where k % 11 <> 0")
def flt1_asserted_instances(spark, d):
    return dumps.instance_view(dump(spark, d)).select("item", F.explode("types").alias("type"))


@query(f"select 'Q' || (k + 1) as item from {_GOOD} where k % 11 <> 0 and k % 20 < 5")
def snk1_filtered_dump(spark, d):
    lines = stored(dump(spark, d), "lines")
    types = spark.range(1, 6).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("type"))
    path = scratch(spark, "filtered")
    dumps.write_filtered(lines, graph.filter_instances(dumps.instance_view(lines), types), path)
    return spark.read.text(path).select(F.get_json_object(F.regexp_replace("value", ",$", ""), "$.id").alias("item"))


@query(f"""with y as (select k, unnest([1500 + k % 500]) as a, 1600 + k % 500 as b from {_GOOD})
select 'Q' || (k + 1) as id, 'construction_started' as kind, date_diff('day', date '0001-01-01', make_date(a, 1, 1)) + 1 as started from y
union all select 'Q' || (k + 1), case k % 3 when 0 then 'damaged' else 'repaired' end, case when k % 3 = 0 then date_diff('day', date '0001-01-01', make_date(b, 1, 1)) + 1 end from y where k % 3 < 2""")
def job2_contributions(spark, d):
    return ingest.contributions(ingest.claim_rows(items(spark, d)))[0].select("id", "kind", "started")


@query(f"select kind, n from (select unnest(['name', 'reference', 'image', 'construction_started']) as kind, unnest([count(*), 2 * count(*), count(*), count(*)]) as n from {_GOOD}) union all select 'damaged', count(*) from {_GOOD} where k % 3 = 0 union all select 'repaired', count(*) from {_GOOD} where k % 3 = 1")
def job1_build_bundles(spark, d):
    return ingest.build_bundles(items(spark, d))[0].groupBy("kind").agg(F.count("*").alias("n"))


def rebuilt_items(spark, d):
    """Items from ``part`` that were begun, torn down (two thirds) and built anew, at a site (three quarters)."""
    snak = lambda value, kind: f'{{"mainsnak":{{"snaktype":"value","datavalue":{{"type":"{kind}","value":{value}}}}},"rank":"%s"'
    time = '{"time":"+%d-00-00T00:00:00Z","precision":9}'
    form = '{"id":"Q%d","type":"item","lastrevid":1,"labels":{"en":{"language":"en","value":"N %d"}},"claims":{"P571":[' + snak(time, "time") + '}],"P576":[' + snak(time, "time") + '}],'
    form += '"P793":[' + snak('{"id":"Q385378"}', "wikibase-entityid") + ',"qualifiers":{"P580":[{"snaktype":"value","datavalue":{"type":"time","value":' + time + "}}]}}],"
    form += '"P625":[' + snak('{"latitude":%d,"longitude":%d,"precision":0.01}', "globecoordinate") + '}],"P18":[' + snak('"File %d.jpg"', "string") + '}]},"sitelinks":{}}'
    k, normal = F.col("p_partkey"), F.lit("normal")
    rank = lambda n: F.when(k % n == 0, "deprecated").otherwise("normal")
    line = F.format_string(form, k + 1, k, k % 300 + 1500, normal, k % 300 + 1600, rank(3), normal, k % 300 + 1700, k % 90, k % 180, rank(4), k, normal)
    return dumps.parse_entities(dealt(T.table(spark, d, "part").select("p_partkey"), "p_partkey").select(line.alias("value"), line.alias("item")))[0]


@query("""with p as (select p_partkey as k, 'Q' || (p_partkey + 1) as id, case when p_partkey % 3 = 0 then 0 else 1 end as last from part), q as (select *, unnest(range(0, last + 1))::int as part from p),
y as (select *, (date_diff('day', date '0001-01-01', make_date((k % 300 + 1500)::int, 1, 1)) + 1) as a, (date_diff('day', date '0001-01-01', make_date((k % 300 + 1600)::int, 1, 1)) + 1) as b, (date_diff('day', date '0001-01-01', make_date((k % 300 + 1700)::int, 1, 1)) + 1) as c from p)
select id, part, 'name' as kind, 'common' as key, 'N ' || k as value, 'en' as lang, null::bigint as day, null::double as lat, null::double as lon from q
union all select id, part, 'reference', 'wikidata', id, null, null, null, null from q
union all select id, last, 'image', 'photograph', 'File ' || k || '.jpg', null, null, null, null from p
union all select id, 0, 'construction_started', null, null, null, a, null, null from y
union all select id, 0, 'demolition_completed', null, null, null, b, null, null from y where k % 3 <> 0
union all select id, last, 'construction', null, null, null, c, null, null from y
union all select id, part, 'construction_location', null, null, null, null, k % 90, k % 180 from q where k % 4 <> 0
union all select id, 1, 'replaces', null, '0', null, null, null, null from p where last = 1""")
def job1_bundle_facts(spark, d):
    """All facts of items that were rebuilt: splits, their common site, and what replaces what."""
    return ingest.build_bundles(rebuilt_items(spark, d))[0].drop("radius_m")


@query(f"select 'Q' || (k + 1) as id, 'File ' || k || '.jpg' as file, 'photograph' as medium, 'exterior' as perspective from {_GOOD}")
def job3_image_facts(spark, d):
    return ingest.image_facts(ingest.claim_rows(items(spark, d)))


@query(f"select n as n_items, (select count(*) from part where p_partkey % 50 = 0) as n_malformed, (select 5 * count(*) + count(*) filter (k % 3 < 2) from {_GOOD}) as n_facts, (select count(*) filter (k % 3 = 2) from {_GOOD}) as n_warnings, n as n_commits, n as n_entities, 0::bigint as n_skipped, 0::bigint as n_failed from (select count(*) as n from {_GOOD})")
def agg19_ingest_stats(spark, d):
    good, bad = dumps.parse_entities(stored(dump(spark, d), "lines"))
    good = stored(good.drop("value"), "items")
    facts, warnings = ingest.build_bundles(good)
    return ingest.ingest_stats(good, bad, facts, warnings)


@query("""select event_id, p::int as precision, case when p in (9, 11) then date_diff('day', date '0001-01-01', case p when 9 then make_date(y, 1, 1) else make_date(y, 3, 7) end) + 1 when p = 10 then date_diff('day', date '0001-01-01', make_date(y, 3, 1)) + 1 end as day
from (select event_id, 1000 + event_id % 900 as y, 9 + event_id % 4 as p from events)""")
def sca4_parse_item_time(spark, d):
    e = T.table(spark, d, "events").select("event_id", (F.col("event_id") % 4 + 9).cast("int").alias("precision"), F.format_string("+%d-03-07T00:00:00Z", F.col("event_id") % 900 + 1000).alias("t"))
    return e.select("event_id", "precision", dates.parse_item_time(F.col("t"), F.col("precision"))["day"].alias("day"))


@query("select p_partkey as item, case when p_size % 4 = 0 then 'religious' when p_partkey % 3 = 0 then 'residential' else 'unknown' end as usage from part")
def sca18_infer_usage(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.array(F.lit("?"), F.concat(F.lit("u"), (F.col("p_size") % 4).cast("string"))).alias("uses"), F.array(F.concat(F.lit("t"), (F.col("p_partkey") % 3).cast("string"))).alias("types"))
    one = lambda k, u: spark.range(1).select(F.lit(k).alias("key"), F.lit(u).alias("usage"))
    return ingest.infer_usage(p, one("u0", "religious"), one("t0", "residential"))


@query("select page_id, url, length(html) as n_chars from pages")
def src4_read_pages(spark, d):
    return T.table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


_LINKS = """(select page_id, generate_subscripts(l, 1) - 1 as place, unnest(l) as link from (select page_id, regexp_extract_all(html, '<a\\b[^>]*?\\shref="([^"]*)"', 1) as l from pages))"""


@query(f"select page_id, place::int as place, link, case when length(link) % 2 = 0 then length(link)::bigint end as media_id, case when length(link) % 2 = 0 then 'resolved' else 'pending' end as state from {_LINKS} where not starts_with(lower(link), 'data:')")
def jn14_page_media(spark, d):
    links = capture.links(T.table(spark, d, "pages"), "a", "href")
    urls = links.select("link").distinct().where(F.length("link") % 2 == 0).withColumn("media_id", F.length("link").cast("long"))
    return capture.page_media(links, urls)


@query()
def job4_extract_pages(spark, d):
    p = capture.extract_pages(T.table(spark, d, "pages"))
    return p.select("page_id", "title", "author", F.length("text").alias("n_text"), F.size("images").alias("n_images"))


@query("""select page_id as image, 'web/' || sha256('https://img.example.org/' || page_id || '/a.jpg') as key, 'https://img.example.org/' || page_id || '/a.jpg' as url, 'image/*' as accept, 1000000 as max_bytes from pages""")
def snk3_mirror_requests(spark, d):
    base = F.concat(F.lit("https://img.example.org/"), F.col("page_id").cast("string"))
    images = T.table(spark, d, "pages").select(F.col("page_id").alias("image"), F.array(F.concat(base, F.lit("/a.jpg")), F.concat(base, F.lit("/a.tif"))).alias("urls"))
    return capture.mirror_requests(images, text.media_key(F.col("url")), text.displayable(F.col("url")), "image/*", 1_000_000)


@query("select conv_id::varchar as id, string_agg(case when rn = 1 then text else role || ': ' || text end, chr(10) order by rn) as text from (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from conversations where text <> '') group by conv_id")
def job5_normalize_posts(spark, d):
    turns = T.table(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    replies = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: F.struct(x["role"].alias("author"), x["text"].alias("body")))
    raw = turns.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("t")[0]["text"].alias("body"), F.to_json(replies).alias("replies"))).alias("json"))
    return capture.normalize_posts(raw)[0]


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as first from documents")
def job6_exact_dups(spark, d):
    return capture.exact_dups(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


_HASH = "xor(cast('0x' || substr(md5(text), 1, 15) as bigint), cast(1 as bigint) << (doc_id % 60)::int)"


@query(f"""with h as (select hash, min(doc_id) as id from (select doc_id, {_HASH} as hash from documents) group by hash)
select a.id as a, b.id as b, bit_count(xor(a.hash, b.hash))::int as bits from h a join h b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= 3""")
def job6_near_dups(spark, d):
    h = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")
    bit = F.expr("shiftleft(1L, cast(doc_id % 60 as int))")
    return capture.near_dups(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), h.bitwiseXOR(bit).alias("hash")), 3)


@query()
def job6_near_contents(spark, d):
    hashes = stored(capture.content_hashes(T.table(spark, d, "documents"), "doc_id", "text"), "hashes")
    return capture.near_dups_wide(hashes, 6)


@query()
def job7_clean_detections(spark, d):
    x = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mask"), (F.col("l_discount") + F.col("l_tax")).alias("score"), F.lit(64).alias("width"), (F.col("l_partkey") % 4000).alias("_s"), F.col("l_quantity").cast("int").alias("_q"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: F.struct((F.col("_s") + r * 64).alias("start"), (F.col("_s") + r * 64 + F.col("_q")).alias("end")))
    return capture.clean_detections(x.select("image", "mask", "score", "width", runs.alias("runs")), 20)


@query("""select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id where list_inner_product(a.embedding::double[], b.embedding::double[]) >= 0.3""")
def job8_similar_pairs(spark, d):
    v = T.table(spark, d, "embeddings")
    return capture.similar_pairs(v.where("vec_id % 50 = 0"), v, 0.3).withColumn("cosine", F.round("cosine", 4))


@query("""with r as (select embedding::double[] as e, min(vec_id) as id from embeddings group by embedding)
select a.id as a, b.id as b, round(list_cosine_similarity(a.e, b.e), 4) as cosine from r a join r b on a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.3""")
def job8_similar_within(spark, d):
    """All pairs of distinct vectors, from cells around centroids."""
    distinct = stored(vectors.representatives(T.table(spark, d, "embeddings")), "distinct")
    index = vectors.build(distinct)
    drop(distinct)
    pairs = vectors.similar_within(index, 0.3).withColumn("cosine", F.round("cosine", 4))
    drop(index.rows)  # the pairs read blocks of their own
    return pairs


@query()
def job8_nearest(spark, d):
    """The ten nearest of the stated queries, from three quarters of the cells."""
    v = vectors.representatives(T.table(spark, d, "embeddings"))
    index = vectors.build(v)
    return vectors.nearest(T.table(spark, d, "embeddings").where("vec_id % 50 = 0").join(v.select("vec_id"), "vec_id", "left_semi"), index, 10, max(1, 3 * len(index.centroids) // 4))


@query("select vec_id, abs(list_inner_product(embedding::double[], embedding::double[]) - 1) <= 1e-6 as ok from embeddings")
def job8_unit_norms(spark, d):
    return capture.unit_norms(T.table(spark, d, "embeddings"))


@query("""select image, panel::int as panel, l::int as "left", t::int as "top", least(greatest(l + 1, ceil(x1 * w)), w)::int as "right", least(greatest(t + 1, ceil(y1 * h)), h)::int as bottom from
(select image, panel, w, h, least(greatest(floor(x0 * w), 0), w - 1) as l, least(greatest(floor(y0 * h), 0), h - 1) as t, x0 + 0.25 as x1, y0 + 0.5 as y1 from
(select o_orderkey as image, 64 + o_custkey % 300 as w, 48 + o_custkey % 200 as h, panel, panel * 0.25 as x0, (o_orderkey % 4) * 0.25 as y0 from orders, (select unnest([0, 1, 2, 3]) as panel)))""")
def job9_panels(spark, d):
    y = F.col("o_orderkey") % 4 * 0.25
    boxes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.struct((p * 0.25).alias("x0"), y.alias("y0"), (p * 0.25 + 0.25).alias("x1"), (y + 0.5).alias("y1")))
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_custkey") % 300 + 64).alias("width"), (F.col("o_custkey") % 200 + 48).alias("height"), boxes.alias("boxes"))
    return capture.panels(o)


@query("""select event_id as image, ts::date as day, round((event_id % 90 + event_id % 60 / 60.0::double + event_id % 50 / 3600.0::double) * case when event_id % 2 = 0 then -1 else 1 end, 6) as lat, round((event_id % 170 + 0.5) * case when event_id % 3 = 0 then -1 else 1 end, 6) as lon from events""")
def job10_capture_facts(spark, d):
    i = F.col("event_id")
    dms = lambda *v: F.array(*[x.cast("double") for x in v])
    exif = T.table(spark, d, "events").select(i.alias("image"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("taken"), dms(i % 90, i % 60, i % 50).alias("lat_dms"), F.when(i % 2 == 0, "S").otherwise("N").alias("lat_ref"), dms(i % 170, F.lit(30), F.lit(0)).alias("lon_dms"), F.when(i % 3 == 0, "W").otherwise("E").alias("lon_ref"))
    return capture.capture_facts(exif).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query()
def agg4_location_bracket(spark, d):
    p = T.points(spark, d)
    return labels.location_bracket(p.select(F.expr("fact_id div 4").alias("rep"), "lat", "lon", (F.col("fact_id") % 7 * 2_000_000.0).alias("radius_m")), "rep")


@query("select n_nationkey as rep, array_to_string(list_sort(list_distinct(list('a' || s_suppkey % 5))), ' ') as label from supplier join nation on s_nationkey = n_nationkey group by 1")
def agg20_provenance_label(spark, d):
    s = T.table(spark, d, "supplier")
    atom = F.concat(F.lit("a"), (F.col("s_suppkey") % 5).cast("string"))
    rows = s.select(F.col("s_nationkey").alias("rep"), F.array(F.array(atom), F.array(atom, F.lit("b"))).alias("label"))
    return labels.label_sum(rows, "rep", "label").select("rep", F.array_join(F.transform("label", lambda e: F.array_join(e, "+")), " ").alias("label"))


@query(sql("names", """, said as (select distinct lang, entity from names), edges as (select entity as a, entity - 1 as b from (select distinct entity from names) where entity % 5 <> 0)
select x.lang as value, a as edge_id from edges join said x on x.entity = a join said y on y.entity = b and y.lang = x.lang""").replace("\n, said", ",\nsaid"))
def jn16_connecting_glue(spark, d):
    """Which of the edges inside classes of five connect the entities that have a name in one language."""
    n = T.names(spark, d)
    edges = n.select("entity").distinct().where("entity % 5 <> 0").select(F.col("entity").alias("edge_id"), F.col("entity").alias("a"), (F.col("entity") - 1).alias("b"))
    return labels.connecting_glue(n.select(F.col("lang").alias("value"), F.col("entity").alias("member")), edges, "value").select("value", "edge_id")


_EDGE_ATOM = "case when entity % 10 in (1, 2) then ['e' || entity] else [] end"


@query(_bag_sql("""w as (select * from bag where kind in ('existence', 'event') and hi is not null and rep not in (select rep from bag where kind = 'construction_started')),
tied as (select w.* from w join (select rep, min(hi) as m from w group by rep) using (rep) where hi = m),
envs as (select distinct rep, list_sort(list_concat(['f' || fact_id, 'built_by'], """ + _EDGE_ATOM + """)) as env from tied)""",
"select rep, array_to_string(env, '+') as env from envs x where not exists (select 1 from envs y where y.rep = x.rep and len(y.env) < len(x.env) and list_has_all(x.env, y.env))"))
def agg20_woven_labels(spark, d):
    """Why a class is held to have been built by a day: the tied witnesses, each with the edge that brings it into the class, under the rule's stamp."""
    b = bag(spark, d)
    facts = conflicts.built_by(b).select("rep", F.explode("evidence").alias("fact_id")).join(b.select("fact_id", "entity"), "fact_id")
    said = facts.select("fact_id", F.array(F.concat(F.lit("f"), F.col("fact_id").cast("string"))).alias("env"))
    joins = F.when(F.col("entity") % 10 < 1, F.array().cast("array<string>")).when(F.col("entity") % 10 < 3, F.array(F.concat(F.lit("e"), F.col("entity").cast("string")))).otherwise(F.array().cast("array<string>"))
    woven = labels.stamped(labels.times(said, facts.select("fact_id", joins.alias("env")), "fact_id"), "built_by")
    summed = labels.minimal_environments(woven.join(facts.select("fact_id", "rep"), "fact_id"), "rep")
    return summed.select("rep", F.array_join("env", "+").alias("env"))


@query(sql("owned_events", """, m as (select owner as rep, event, role, day, case event % 3 when 0 then 'construction' when 1 then 'other' else 'demolition' end as stage, event % 3 as s, case when role = 'started' then 0 else 1 end as r from owned_events join
(select event, 'started' as role, case when event % 4 <> 0 then started end as day from owned_events union all select event, 'completed', completed from owned_events where event % 5 <> 0 and completed is not null) using (event)),
k as (select *, case when day is not null then day when r = 0 then least(case s when 0 then -1e9 when 1 then coalesce(built, -1e9) else 1e9 end, coalesce(done, 1e9)) else greatest(case s when 0 then -1e9 when 1 then coalesce(built, -1e9) else 1e9 end, coalesce(begun, -1e9)) end as pos
 from (select *, max(case when s = 0 then day end) over (partition by rep) as built, max(case when r = 0 then day end) over (partition by rep, event) as begun, min(case when r = 1 then day end) over (partition by rep, event) as done from m))
select rep, event, role, stage, day::double as day, (row_number() over (partition by rep order by pos, s, r, day is null, event) - 1)::int as place from k""").replace("\n, m as", ",\nm as"))  # fmt: skip
def win8_timeline_order(spark, d):
    e = T.owned_events(spark, d)
    started = e.select("event", F.lit("started").alias("role"), F.when(F.col("event") % 4 != 0, F.col("started")).alias("day"))
    ended = e.where("event % 5 <> 0 and completed is not null").select("event", F.lit("completed").alias("role"), F.col("completed").alias("day"))
    stage = F.when(F.col("event") % 3 == 0, "construction").when(F.col("event") % 3 == 1, "other").otherwise("demolition")
    return listing.timeline_order(started.unionByName(ended).join(e.select("event", F.col("owner").alias("rep")), "event").withColumn("stage", stage))


@query("select event_id as fact, sha256((event_id // 10)::varchar) as commit_id, true as dense from events")
def str1_continuous_append(spark, d):
    e = T.table(spark, d, "events").withColumn("_c", F.expr("event_id div 10"))
    ts = e.groupBy("_c").agg(F.min("ts").alias("_ts"))
    b = e.join(ts, "_c").select(F.sha2(F.col("_c").cast("string"), 256).alias("commit_id"), F.col("_ts").alias("ts"), F.col("event_id").alias("fact"))
    again = b.where("fact % 100 < 10").withColumn("ts", F.col("ts") + F.expr("interval 1000 days"))
    out = jobs.continuous_append(jobs.log_stream(spark, b.unionByName(again), 3, "ts"))
    ids = out.agg((F.max("fact_id") + 1 == F.countDistinct("fact_id")).alias("dense"))
    return out.select("fact", "commit_id").crossJoin(F.broadcast(ids))


def class_reps(spark, d, f):
    return stored(identity.representatives(f.select(F.col("entity").alias("member")), T.same_edges(spark, d)), "reps")


@query(_bag_sql(_LIFE, "select rep, earliest, affirmed, reached, floor, denies_after, claimed_through, unbounded, claimed from life"))
def str2_streaming_lifespan(spark, d):
    """Facts and retractions in the order of the log; late retractions take back what earlier batches folded."""
    f = T.facts(spark, d)
    return jobs.streaming_lifespan(jobs.log_stream(spark, f, 3), class_reps(spark, d, f))


@query(_bag_sql(f"{_LIFE},\n{_VERDICT}", "select rep, verdict from verdicts where day = 25 and verdict <> 'unknown'"))
def str2_verdict_changes(spark, d):
    """The last of each class's changes leads to the verdict of the whole log."""
    f = T.facts(spark, d)
    changes = jobs.verdict_changes(jobs.lifespan_log(jobs.log_stream(spark, f, 3), class_reps(spark, d, f)), 25)
    return changes.groupBy("rep").agg(F.max_by("after", "batch").alias("verdict")).where("verdict <> 'unknown'")


@query(_bag_sql(_BOUNDS, """select rep, bound, case when bound = 'floor' then arg_min(fact_id, (-hi, fact_id)) else arg_min(fact_id, (lo, fact_id)) end as witness
 from viol group by rep, bound, case when kind = 'event' then 'e' || event else coalesce(lo::varchar, '-') || ',' || coalesce(hi::varchar, '-') end"""))
def str3_conflict_alerts(spark, d):
    f = T.facts(spark, d)
    reps = stored(identity.representatives(f.select(F.col("entity").alias("member")), T.same_edges(spark, d)), "reps")
    return jobs.conflict_alerts(jobs.log_stream(spark, T.events_of(f), 2), reps).select("rep", "bound", "witness")


@query("""with recursive e(a, b) as (select c_custkey, c_custkey - 1 from customer where c_custkey % 5 <> 0),
both_(a, b) as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a)
select a as member, least(a, min(b)) as rep from reach group by a having least(a, min(b)) <> a""")
def str4_rep_log_upkeep(spark, d):
    c = T.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("edge_id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") - 1).alias("b"))
    log = jobs.rep_log_upkeep(jobs.log_stream(spark, c, 2, "edge_id"))
    return log.groupBy("member").agg(F.max_by("rep", "as_of").alias("rep"))


@query("select distinct 'https://example.org/' || user_id as url from events")
def str5_seen_urls(spark, d):
    raw = F.concat(F.lit("https://EXAMPLE.org/"), F.col("user_id").cast("string"), F.lit("?utm_source=x#"), F.col("event_id").cast("string"))
    e = T.table(spark, d, "events").select(text.normalize_url(raw).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.seen_urls(jobs.log_stream(spark, e, 3, "ts"), "url", "ts", "3650 days").select("url")
