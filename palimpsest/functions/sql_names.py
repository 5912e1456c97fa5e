"""Names under which SQL finds the library's vectorised functions and table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions.geo import geodesic_m
from palimpsest.functions.text import normalize_nfc
from palimpsest.operators import capture


@udtf(returnType="title string, author string, published string, text string, images array<string>", useArrow=True)
class ExtractPage:
    """extract_page(url, html): one row of what a page shows; a null page shows nothing."""

    def eval(self, url: str, html: str) -> Iterator[tuple]:
        yield capture.page_fields(url, html)


@udtf(returnType="id string, text string, place int, url string", useArrow=True)
class NormalizePost:
    """normalize_post(json): a row for each medium of a captured post, or one without a medium; nothing for what is no post."""

    def eval(self, raw: str) -> Iterator[tuple]:
        try:
            post = json.loads(raw) if raw else None
        except ValueError:
            post = None
        if not isinstance(post, dict):
            return
        text = capture.post_text(post.get("title"), post.get("body"), post.get("replies"))
        media = [m.get("url") for m in post.get("media") or ()]
        for place, url in enumerate(media) if media else [(None, None)]:
            yield post.get("id"), text, place, url


def register(spark: SparkSession) -> None:
    """Register normalize_nfc, geodesic_m, extract_page and normalize_post with a session."""
    spark.udf.register("normalize_nfc", normalize_nfc)
    spark.udf.register("geodesic_m", geodesic_m)
    spark.udtf.register("extract_page", ExtractPage)
    spark.udtf.register("normalize_post", NormalizePost)
