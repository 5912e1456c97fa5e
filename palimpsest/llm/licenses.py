"""License scans: normalised lines, or windows of words, compared with licence templates by the Dice coefficient of word bigrams.

DataFrame functions only.  A line is compared with a template only if their bigram counts allow the
wanted coefficient, which most lines fail by their number of words alone.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices by identifier.  Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
#: Whole licence texts by identifier, without their copyright lines.  Fixed values.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
#: Least Dice coefficient of a match.
THRESHOLD = 0.75


def normal_words(text: str) -> list[str]:
    """The words of a template, by the rule that ``words`` applies to lines."""
    import re

    return re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def words(line: Column) -> Column:
    """Words of a line: ASCII lower case, runs of a-z and 0-9; anything else separates."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is a pair with nothing."""
    return F.array_distinct(F.when(F.size(words) == 1, words).otherwise(_pairs(words)))


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest bigram count of a line whose coefficient with n bigrams can reach the threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, license, template_no, n_shared, n_line, dice: every line that matches a template.

    Lines are split at line feeds and numbered from 1 over the whole text; of the templates that reach
    ``threshold`` for a line each gives a row.  Null and empty texts have no lines.  Repeated rows give
    repeated matches.  Only doc_id and text of the input are used.
    """
    known = [(k, name, template_bigrams(text)) for k, (name, text) in enumerate(templates)]
    bounds = [size_bounds(len(b), threshold) for *_, b in known]
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
    lines = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    # A repeated pair counts once, so only the least number of bigrams bounds the words of a line.
    lines = lines.where(F.col("_line").rlike(r"[A-Za-z0-9]")).withColumn("_words", words(F.col("_line"))).where(F.size("_words") >= least)
    lines = lines.select("doc_id", (F.col("_at") + 1).alias("line_no"), bigrams(F.col("_words")).alias("_pairs")).withColumn("n_line", F.size("_pairs")).where(F.col("n_line").between(least, most))
    tries = []
    for (k, name, pairs), (lo, hi) in zip(known, bounds, strict=True):
        shared = F.size(F.array_intersect("_pairs", F.array(*[F.lit(p) for p in pairs])))
        tries.append(F.when(F.col("n_line").between(lo, hi), F.struct(F.lit(name).alias("license"), F.lit(k).alias("template_no"), shared.alias("n_shared"), F.lit(len(pairs)).alias("_n"))))
    found = lines.select("doc_id", "line_no", "n_line", F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("_t"))
    dice = 2.0 * F.col("n_shared") / (F.col("n_line") + F.col("_n"))
    return found.select("doc_id", "line_no", "_t.license", "_t.template_no", "_t.n_shared", "n_line", "_t._n").withColumn("dice", dice).where(2 * F.col("n_shared") >= threshold * (F.col("n_line") + F.col("_n"))).drop("_n")


def gate(pairs: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which any window that reaches the threshold holds one: all but the greatest count that it can lack, the longest ones."""
    lo = size_bounds(len(pairs), threshold)[0]
    return sorted(pairs, key=lambda p: (-len(p), p))[: len(pairs) - lo + 1]


def _best_windows(pairs: Column, known: list[str], threshold: float) -> Column:
    """array of (first, n_words, n_shared, n_window, dice): the best windows of one template that don't overlap, by place."""
    lo, hi = size_bounds(len(known), threshold)
    mine = F.array(*[F.lit(p) for p in known])
    starts = F.filter(F.transform(pairs, lambda p, i: F.when(p.isin(known), i)), lambda i: i.isNotNull())
    local = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(hi), F.size(pairs) - i) - 1), lambda q: F.get(pairs, i + q))

    def tries(x: Column) -> Column:
        def measure(n: Column) -> Column:
            some = F.slice(x["_near"], F.lit(1), n)
            shared, size = F.size(F.array_intersect(some, mine)), F.size(F.array_distinct(some))
            return F.struct((2.0 * shared / (size + len(known))).alias("dice"), (-x["_at"]).alias("_at"), (-n).alias("_n"), shared.alias("n_shared"), size.alias("n_window"))

        return F.array_max(F.transform(F.sequence(F.lit(lo), F.size(x["_near"])), measure))

    near = F.filter(F.transform(starts, lambda i: F.struct(i.alias("_at"), local(i).alias("_near"))), lambda x: F.size(F.array_intersect(x["_near"], mine)) >= lo)
    found = F.filter(F.transform(near, tries), lambda t: 2 * t["n_shared"] >= threshold * (t["n_window"] + len(known)))
    # Greatest dice first, then the earliest, then the shortest; a window stands if it shares no word with one that stands.
    order = F.reverse(F.array_sort(found))
    none = F.array().cast("array<struct<dice:double,_at:int,_n:int,n_shared:int,n_window:int>>")
    apart = lambda a, b: (-a["_at"] > -b["_at"] - b["_n"]) | (-b["_at"] > -a["_at"] - a["_n"])
    kept = F.aggregate(order, none, lambda out, t: F.when(F.forall(out, lambda o: apart(o, t)), F.concat(out, F.array(t))).otherwise(out))
    return F.transform(kept, lambda t: F.struct((1 - t["_at"]).alias("first_word"), (1 - t["_n"]).alias("n_words"), t["n_shared"].alias("n_shared"), t["n_window"].alias("n_window"), t["dice"].alias("dice")))


def passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, template_no, first_word, n_words, n_shared, n_window, dice: every passage that matches a template.

    The whole text is one run of words, in which line feeds separate like any other sign, so wrapped notices
    and notices inside longer lines are found.  Windows of consecutive words whose count of bigrams is
    within ``size_bounds`` are compared; of windows that share words the best stands (greatest Dice, then the first,
    then the shortest), for each template by itself.  Words are numbered from 1.  Templates have two words at least.
    """
    known = [(k, name, template_bigrams(text)) for k, (name, text) in enumerate(templates)]
    if any(" " not in p for *_, pairs in known for p in pairs):
        raise ValueError("a template needs two words at least")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = F.concat(F.lit(" "), F.regexp_replace(lower, "[^a-z0-9]+", " "), F.lit(" "))
    # Exploded, so that no later expression takes the rewriting of the text into itself, once for each use.
    rows = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.array(flat)).alias("_flat"))
    # No window can match without a bigram of the gate: a search for plain strings leaves few documents.
    either = lambda x: functools.reduce(lambda a, b: a | b, x)
    may = [either([F.col("_flat").contains(f" {p} ") for p in gate(pairs, threshold)]) for *_, pairs in known]
    rows = rows.where(either(may)).withColumn("_pairs", _pairs(F.filter(F.split("_flat", " "), lambda w: w != "")))

    def named(k: int, name: str, pairs: list[str]) -> Column:
        best = F.transform(_best_windows(F.col("_pairs"), pairs, threshold), lambda t: F.struct(F.lit(name).alias("license"), F.lit(k).alias("template_no"), t.alias("_t")))
        return F.when(may[k], best)

    tries = [named(*x) for x in known]
    found = rows.select("doc_id", F.explode(F.flatten(F.filter(F.array(*tries), lambda t: t.isNotNull()))).alias("_m"))
    return found.select("doc_id", "_m.license", "_m.template_no", "_m._t.*")


def whole_texts(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """As ``passages`` for documents that as a whole are a licence text: all their words against whole templates.

    ``first_word`` is 1 and ``n_words`` the document's words; ``template_no`` counts on after TEMPLATES.  A document
    is compared with a template only if its number of different bigrams allows the threshold.
    """
    known = [(len(TEMPLATES) + k, name, template_bigrams(text)) for k, (name, text) in enumerate(texts)]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = F.concat(F.lit(" "), F.regexp_replace(lower, "[^a-z0-9]+", " "), F.lit(" "))
    least = min(size_bounds(len(p), threshold)[0] for *_, p in known)
    rows = docs.where(F.length("text") > 2 * least).select("doc_id", F.explode(F.array(flat)).alias("_flat"))
    either = functools.reduce(lambda a, b: a | b, [F.col("_flat").contains(f" {p} ") for *_, pairs in known for p in gate(pairs, threshold)])
    rows = rows.where(either).withColumn("_words", F.filter(F.split("_flat", " "), lambda w: w != ""))
    rows = rows.select("doc_id", F.size("_words").alias("n_words"), F.explode(F.array(F.array_distinct(_pairs(F.col("_words"))))).alias("_pairs")).withColumn("n_window", F.size("_pairs"))
    tries = []
    for k, name, pairs in known:
        shared = F.size(F.array_intersect("_pairs", F.array(*[F.lit(p) for p in pairs])))
        tries.append(F.when(F.col("n_window").between(*size_bounds(len(pairs), threshold)), F.struct(F.lit(name).alias("license"), F.lit(k).alias("template_no"), shared.alias("n_shared"), F.lit(len(pairs)).alias("n"))))
    found = rows.select("doc_id", "n_words", "n_window", F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("_t"))
    dice = 2.0 * F.col("_t.n_shared") / (F.col("n_window") + F.col("_t.n"))
    return found.where(2 * F.col("_t.n_shared") >= threshold * (F.col("n_window") + F.col("_t.n"))).select("doc_id", "_t.license", "_t.template_no", F.lit(1).alias("first_word"), "n_words", "_t.n_shared", "n_window", dice.alias("dice"))


def notices(docs: DataFrame) -> DataFrame:
    """All matches of ``passages`` and of ``whole_texts``: notices inside documents, and documents that are a licence."""
    return passages(docs).unionByName(whole_texts(docs))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB over the view ``documents``, without pruning."""
    rows = ", ".join("(%d, '%s', [%s])" % (k, name, ", ".join("'%s'" % p for p in template_bigrams(text))) for k, (name, text) in enumerate(templates))
    return f"""
with t(template_no, license, pairs) as (values {rows}),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where length(text) > 0),
w as (select doc_id, line_no, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as words from l),
b as (select doc_id, line_no, list_distinct(case when len(words) = 1 then words else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) end) as pairs from w where len(words) > 0),
m as (select doc_id, line_no, license, template_no, len(list_intersect(b.pairs, t.pairs)) as n_shared, len(b.pairs) as n_line, len(t.pairs) as n from b, t)
select doc_id, cast(line_no as int) as line_no, license, template_no, cast(n_shared as int) as n_shared, cast(n_line as int) as n_line, 2.0::double * n_shared / (n_line + n) as dice
from m where 2 * n_shared >= {threshold} * (n_line + n)"""
