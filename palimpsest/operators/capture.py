"""Web captures and images: page extraction, posts, duplicates, detections and similarity."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Page(HTMLParser):
    """Title, author, published time, visible text and image links of one page."""

    HIDDEN = {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.text, self.images, self.inside = [], {}, [], [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()):
            self.meta.setdefault(name, a.get("content", ""))
        elif tag == "img" and a.get("src") and not a["src"].lower().startswith("data:"):
            self.images.append(a["src"])
        if tag in self.HIDDEN or tag == "title":
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if self.inside and self.inside[-1] == "title":
            self.title.append(data)
        elif not self.inside and data.strip():
            self.text.append(data.strip())


def page_fields(url: str | None, html: str | None) -> tuple:
    """(title, author, published, text, images) of one page."""
    p = _Page()
    p.feed(html or "")
    p.close()
    title = " ".join("".join(p.title).split()) or p.meta.get("og:title") or None
    return title, p.meta.get("author"), p.meta.get("article:published_time"), " ".join(p.text), [urljoin(url or "", s) for s in p.images]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, author, published, text, images (absolute, in order, without data: links) of html pages."""

    def run(parts):
        for pdf in parts:
            rows = [(page_id, *page_fields(url, html)) for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "title", "author", "published", "text", "images"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, author string, published string, text string, images array<string>")


def links(pages: DataFrame, tag: str = "img", attribute: str = "src") -> DataFrame:
    """page_id, place, link: one attribute of a tag in page order, by expressions alone (double-quoted values)."""
    found = F.regexp_extract_all("html", F.lit(rf'<{tag}\b[^>]*?\s{attribute}="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("place", "link")).where(~F.lower("link").startswith("data:"))


def page_media(links: DataFrame, urls: DataFrame) -> DataFrame:
    """page_id, place, link, media_id, state: links in order with resolved media, or pending."""
    out = links.join(urls.select("link", "media_id"), "link", "left")
    return out.select("page_id", "place", "link", "media_id", F.when(F.col("media_id").isNull(), "pending").otherwise("resolved").alias("state"))


def mirror_requests(images: DataFrame, key: Column, shown: Column, accept: str, max_bytes: int) -> DataFrame:
    """key, url, accept, max_bytes for every image URL that a browser can show; no dedup across images."""
    return images.select("image", F.explode("urls").alias("url")).where(shown).select("image", key.alias("key"), "url", F.lit(accept).alias("accept"), F.lit(max_bytes).alias("max_bytes"))


#: A captured post; replies nest, so they stay JSON text here.
POST = "id string, author string, title string, body string, media array<struct<url:string>>, replies string"


def post_text(title: str | None, body: str | None, replies: list | None) -> str:
    """Title, body and all nested replies in reading order, a line each."""
    lines, todo = [x for x in (title, body) if x], (replies or [])[::-1]
    while todo:
        c = todo.pop()
        if c.get("body"):
            lines.append(f"{c.get('author') or '?'}: {c['body']}")
        todo += (c.get("replies") or [])[::-1]
    return "\n".join(lines)


def normalize_posts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text with all nested comments in reading order; id, place, url of media) of post JSON (id, json)."""
    posts = raw.select(F.from_json("json", POST).alias("p")).select("p.*")

    def run(parts):
        for pdf in parts:
            out = [(i, post_text(title, body, json.loads(replies) if replies else None)) for i, title, body, replies in zip(pdf["id"], pdf["title"], pdf["body"], pdf["replies"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "text"])

    return posts.select("id", "title", "body", "replies").mapInPandas(run, "id string, text string"), posts.select("id", F.posexplode("media").alias("place", "_m")).select("id", "place", "_m.url")


def exact_dups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, first: each row with the least key of its content."""
    return rows.select(key, F.sha2(content, 256).alias("_h")).join(rows.groupBy(F.sha2(content, 256).alias("_h")).agg(F.min(key).alias("first")), "_h").select(key, "first")


def near_dups(hashes: DataFrame, max_bits: int, blocks: int = 6) -> DataFrame:
    """a, b, bits: pairs of different 64-bit hashes (id, hash) at most ``max_bits`` apart.

    The bits are cut into ``blocks`` and keyed by every choice of all but ``max_bits`` of them: so many flipped
    bits touch at most so many blocks, so some key is equal, and it is half of the hash or more, so that
    only near hashes share one.  Equal hashes are one class: only the least id of each stands for it.
    """
    if max_bits >= blocks:
        raise ValueError("max_bits must be less than blocks")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = lambda chosen: sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(i).alias("k"), F.col("hash").bitwiseAND(F.lit(signed(mask(c))).cast("long")).alias("v")) for i, c in enumerate(itertools.combinations(range(blocks), blocks - max_bits))]
    keyed = hashes.groupBy("hash").agg(F.min("id").alias("id")).select("id", "hash", F.explode(F.array(*keys)).alias("_key"))
    other = keyed.select(F.col("id").alias("b"), F.col("hash").alias("_h"), "_key")
    bits = F.bit_count(F.col("hash").bitwiseXOR(F.col("_h")))
    return keyed.join(other, "_key").where("id < b").select(F.col("id").alias("a"), "b", bits.alias("bits")).where(F.col("bits") <= max_bits).distinct()


#: Words of a text whose hashes are held at once.
WORDS = 1024


def content_hashes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """id, hash (array of four longs): 256-bit similarity hash of the whole content; no row for content without a word.

    Each bit is the majority of that bit over the content's words, so a changed word changes few bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from collections import Counter

        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("content"), strict=True):  # one text at a time, not a column of them
                words = Counter(text.as_py().split())
                if not words:
                    continue
                total, votes = sum(words.values()), np.zeros(256, np.int64)
                items = iter(words.items())
                while some := list(itertools.islice(items, WORDS)):
                    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=32).digest() for w, _ in some)
                    votes += np.array([n for _, n in some]) @ np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 32), axis=1).astype(np.int64)
                ids.append(i)
                out.append(np.packbits(2 * votes > total).view(">i8").astype(np.int64).tolist())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["id", "hash"])

    texts = rows.select(F.col(key).cast("long").alias("id"), F.col(content).alias("content")).where("content is not null")
    return texts.mapInArrow(run, "id long, hash array<long>")


def near_dups_wide(hashes: DataFrame, max_bits: int, blocks: int = 8) -> DataFrame:
    """a, b, bits: pairs of different 256-bit hashes (id, hash of four longs) at most ``max_bits`` apart.

    The bits are cut into ``blocks`` (8 or 16) and keyed by every choice of all but ``max_bits`` of them: as so many
    flipped bits touch at most so many blocks, some key is equal, and a key is wide, so only near hashes share one.
    Equal hashes are one class: only the least id of each stands for it.
    """
    if max_bits >= blocks or blocks not in (8, 16):
        raise ValueError("blocks must be 8 or 16 and more than max_bits")
    width = 256 // blocks
    rows = hashes.groupBy("hash").agg(F.min("id").alias("id"))
    part = lambda k: F.shiftrightunsigned(F.col("hash")[k * width // 64], k * width % 64).bitwiseAND(F.lit((1 << width) - 1))
    bands = [F.struct(F.lit(i).alias("k"), F.array(*[part(k) for k in chosen]).alias("v")) for i, chosen in enumerate(itertools.combinations(range(blocks), blocks - max_bits))]
    keyed = rows.select("id", "hash", F.explode(F.array(*bands)).alias("_band"))
    other = keyed.select(F.col("id").alias("b"), F.col("hash").alias("_h"), "_band")
    bits = sum((F.bit_count(F.col("hash")[i].bitwiseXOR(F.col("_h")[i])) for i in range(1, 4)), F.bit_count(F.col("hash")[0].bitwiseXOR(F.col("_h")[0])))
    return keyed.join(other, "_band").where("id < b").select(F.col("id").alias("a"), "b", bits.alias("bits")).where(F.col("bits") <= max_bits).distinct()


def _mask(starts: list[int], ends: list[int]) -> int:
    """The pixels of some runs (end exclusive) as the bits of a number."""
    if not starts:
        return 0
    bits, low = 0, min(starts)
    for a, b in zip(starts, ends, strict=True):
        if b > a:
            bits |= ((1 << (b - a)) - 1) << (a - low)
    return bits << low


def _mean_columns(masks: list[tuple[int, int, int]]) -> list[float]:
    """The mean column of each of some masks (pixels, their number above 0, width)."""
    lows = [(pixels & -pixels).bit_length() - 1 for pixels, _, _ in masks]
    packed = [(m >> low).to_bytes(((m >> low).bit_length() + 7) // 8, "little") for (m, _, _), low in zip(masks, lows, strict=True)]
    begin = np.cumsum([0, *map(len, packed[:-1])]) * 8
    counts = np.array([n for _, n, _ in masks])
    places = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(packed), np.uint8), bitorder="little")) + np.repeat(np.array(lows) - begin, counts)
    sums = np.add.reduceat(places % np.repeat([w for _, _, w in masks], counts), np.cumsum([0, *counts[:-1]]))
    return (sums / counts).tolist()


def clean_detections(masks: DataFrame, k: int, overlap: float = 0.7, survive: float = 0.1) -> DataFrame:
    """image, mask, score, pixels, column, place: detections of each image after clean-up.

    ``masks`` has image, mask, score, width, runs (array of start, end pixels, end exclusive).  In score
    order a mask goes when it overlaps a kept one by more than ``overlap``; pixels belong to the first mask
    that has them; masks with less than ``survive`` of their pixels left go; the best k are placed from left to right by ``column``, the mean
    column of their pixels (the smaller mask on ties).

    Images lie one after the other in sorted partitions and batches of rows, so no image is a group of its own; what is
    held is one image's kept masks, and none once its best k are known.
    """
    columns = [("image", pa.int64()), ("mask", pa.int64()), ("score", pa.float64()), ("pixels", pa.int64()), ("column", pa.float64()), ("place", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, kept, taken, n_best, best, bits = (), [], 0, 0, [], 0

        def placed() -> pa.RecordBatch:
            found = [(*x, at) for x, at in zip(best, _mean_columns([x[3:] for x in best]), strict=True)]
            out = [(i, mask, score, n, at, place) for _, group in itertools.groupby(found, lambda x: x[0]) for place, (i, mask, score, _, n, _, at) in enumerate(sorted(group, key=lambda x: (x[6], x[1])))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out, strict=True), columns, strict=True)], [n for n, _ in columns])

        for b in batches:
            runs = b.column("runs")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = runs.flatten()
            starts, stops = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in (0, 1))
            at = 0
            for i, mask, score, width, end in zip(*(b.column(c).to_pylist() for c in ("image", "mask", "score", "width")), ends, strict=True):
                begin, at = at, end
                if image != (i,):
                    if len(best) >= 4096 or bits > 1 << 26:
                        yield placed()
                        best, bits = [], 0
                    image, kept, taken, n_best = (i,), [], 0, 0
                if n_best == k:
                    continue
                mine = _mask(starts[begin:end], stops[begin:end])
                total = mine.bit_count()
                if not total or any((both := (m & mine).bit_count()) / (n + total - both) > overlap for m, n in kept):
                    continue
                kept.append((mine, total))
                left = mine & ~taken
                n = left.bit_count()
                if n and n >= survive * total:
                    taken |= mine
                    best.append((i, mask, score, left, n, width))
                    bits += left.bit_length()
                    n_best += 1
                    if n_best == k:
                        kept = []
        if best:
            yield placed()

    rows = masks.select(F.col("image").cast("long"), F.col("mask").cast("long"), F.col("score").cast("double"), F.col("width").cast("long"), F.transform("runs", lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"))).alias("runs"))
    order = rows.repartition("image").sortWithinPartitions("image", F.nanvl("score", F.lit(None)).desc_nulls_last(), "mask")
    return order.mapInArrow(run, "image long, mask long, score double, pixels long, column double, place int")


def panels(images: DataFrame) -> DataFrame:
    """image, panel, left, top, right, bottom: proportional boxes as pixel crops inside the image, never empty."""
    x = images.select("image", "width", "height", F.posexplode("boxes").alias("panel", "_b"))
    low = lambda v, size: F.least(F.greatest(F.floor(v * F.col(size)), F.lit(0)), F.col(size) - 1).cast("int")
    left, top = low(F.col("_b.x0"), "width"), low(F.col("_b.y0"), "height")
    high = lambda v, size, least: F.least(F.greatest(F.ceil(v * F.col(size)).cast("int"), least + 1), F.col(size).cast("int"))
    return x.select("image", "panel", left.alias("left"), top.alias("top"), high(F.col("_b.x1"), "width", left).alias("right"), high(F.col("_b.y1"), "height", top).alias("bottom"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_norms(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """vec_id, ok: whether each embedding's squared norm is one."""
    return vectors.select("vec_id", (F.abs(dot(F.col("embedding"), F.col("embedding")) - 1.0) <= tolerance).alias("ok"))


#: Vectors of one side of a comparison.
VECTORS = 4096


def similar_pairs(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """a, b, cosine for a stated query set against all vectors: unit vectors, so the cosine is the dot product.

    Both sides are dealt into blocks of about VECTORS by a hash of the id, and every two blocks meet in one
    group, so memory is bounded and nothing passes through the driver.
    """
    schema = "a long, b long, cosine double"
    blocks = [max(1, -(-x.count() // VECTORS)) for x in (queries, vectors)]
    side = lambda x, k: F.pmod(F.xxhash64("vec_id"), F.lit(blocks[k])).cast("int").alias(x)
    every = lambda x, k: F.explode(F.sequence(F.lit(0), F.lit(blocks[k] - 1))).alias(x)
    asked = queries.select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"), side("_i", 0), every("_j", 1))
    given = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"), every("_k", 0), side("_l", 1))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        at = np.stack(q["q"].to_numpy()).astype(np.float64) @ np.stack(v["v"].to_numpy()).astype(np.float64).T
        i, j = np.nonzero(at >= least)
        out = pd.DataFrame({"a": q["a"].to_numpy()[i], "b": v["b"].to_numpy()[j], "cosine": at[i, j]})
        return out[out["a"] != out["b"]]

    return asked.groupBy("_i", "_j").cogroup(given.groupBy("_k", "_l")).applyInPandas(run, schema)


def capture_facts(exif: DataFrame) -> DataFrame:
    """image, day, lat, lon from decoded tags: date text, degree/minute/second rationals and hemisphere letters."""
    day = F.to_date(F.try_to_timestamp(F.regexp_replace(F.substring("taken", 1, 10), ":", "-"), F.lit("yyyy-MM-dd")))
    degrees = lambda c: F.col(c)[0] + F.col(c)[1] / 60.0 + F.col(c)[2] / 3600.0
    lat = degrees("lat_dms") * F.when(F.col("lat_ref") == "S", -1).otherwise(1)
    lon = degrees("lon_dms") * F.when(F.col("lon_ref") == "W", -1).otherwise(1)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return exif.select("image", day.alias("day"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))
