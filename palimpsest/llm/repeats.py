"""Suffix-array dedup: byte strings of a threshold length that stand more than once are found and removed.

Suffixes are ordered only through the threshold depth, digit by digit from the most significant one, and a
group that has become single is dropped after each pass; the groups left at full depth are exactly the
repeated windows.  The first digit of a window is an anchor, the block of ANCHOR bytes with the least hash
inside it, which equal windows share at the same place; neighbouring windows with one anchor travel as one
record.  The second digit is all that such a record covers.  Only records whose second digit differs inside
one group of the first are opened, and their windows compared at full depth.  Digits are hashes, so what they
take for equal is then compared by 256-bit digests of its bytes, and what differs is grouped anew by its bytes.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from palimpsest.llm import buffers
from palimpsest.llm.common import unused
from palimpsest.scratch import drop, free_driver, stored

#: Bytes of a repeated window, and of the anchor block that is its first digit.
DEPTH, ANCHOR = 200, 100
#: Bits of the hashes that stand for digits; tests take few, so that different strings collide.
BITS = 64
#: Members of a group of equal digits that are put in order together; larger groups are ordered in parts.
PART = 500
#: Bytes of a text whose records of one group stay in one part, so that its periodic stretches are linked in place.
STRETCH = 1 << 14
#: Bytes of texts whose records a worker makes at once: some twenty arrays of eight bytes each for every one of them.
AT_ONCE = 1 << 18
_U = np.uint64


def _low_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes if bits >= 64 else hashes & np.int64((1 << bits) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for every i, by block-wise running minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of values[i : i + width] stands first, for every i.

    The upper bits of the values, with the place in the lower ones, tell it for nearly all; the others are looked through.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    mask = _U((1 << int(len(values)).bit_length()) - 1)
    least = sliding_least(values, width)
    at = (sliding_least((values & ~mask) | np.arange(len(values), dtype=np.uint64), width) & mask).astype(np.int64)
    wrong = np.flatnonzero(values[at] != least)
    for part in np.array_split(wrong, -(-len(wrong) // 10_000)) if len(wrong) else ():
        ahead = np.lib.stride_tricks.sliding_window_view(values, width)[part]
        at[part] = part + (ahead == least[part, None]).argmax(axis=1)
    return at


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int, anchor: int, bits: int = BITS):
    """(document, anchor hash, record hash, first window, last window) of each run of windows with one anchor.

    Windows are counted inside their document.  An anchor is the first of the blocks of least hash in a window: the
    window alone decides it, so equal windows have equal anchors at equal places, whatever stands around them.  Two
    records with both hashes alike cover equal bytes, unless the hashes collide.
    """
    none = np.zeros(0, np.int64)
    if len(data) < depth:
        return none, none, none, none, none
    rolling = buffers.Rolling(data)
    blocks = rolling.windows(anchor)
    if bits < 64:
        blocks = blocks & ~_U((1 << (64 - bits)) - 1)
    at = least_places(blocks, depth - anchor + 1)
    room = np.maximum(0, np.diff(offsets) - depth + 1)
    starts = buffers.ragged_positions(offsets[:-1], room)
    if not len(starts):
        return none, none, none, none, none
    own = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a = starts[first], starts[last], own[first]
    whole = buffers.mix(rolling.range(lo, hi + depth) + (a - lo).astype(np.uint64) * _U(0x9FB21C651E98DF25))
    doc = np.searchsorted(offsets, lo, "right") - 1
    return doc, blocks[a].view(np.int64), whole.view(np.int64), lo - offsets[doc], hi - offsets[doc]


def _base(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` written once with a row number and the compressed text in place of the text; the two columns' names.

    The number is fixed by the writing, so rows alike in id and text stay two rows.
    """
    row, packed = unused(docs, "_row"), unused(docs, "_packed")
    kept = docs.select(*columns, "text").withColumn(row, F.monotonically_increasing_id())
    schema = StructType([f for f in kept.schema.fields if f.name != "text"] + [StructField(packed, BinaryType())])
    place = kept.columns.index("text")

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in buffers.slices(batches):
            column = pa.array([press.compress(x.as_py().encode()) if x.is_valid else None for x in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != place), column], names=schema.names)

    return stored(kept.mapInArrow(buffers.tidy(run), schema), "base", "none"), row, packed


def unpacked(batch: pa.RecordBatch, column: int) -> pa.Array:
    """The texts of a column of compressed ones; null stays null."""
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_py()) if x.is_valid else None for x in batch.column(column)], pa.binary()).cast(pa.string())


def records(texts: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, bits: int = BITS) -> DataFrame:
    """r, anchor, whole, lo, hi: the records of all ``texts`` (r, packed) of at least ``depth`` bytes (see ``anchors``)."""
    names = ["r", "anchor", "whole", "lo", "hi"]

    def run(batches):
        for batch in buffers.slices(batches):
            data, offsets = buffers.utf8(unpacked(batch, 1))
            r = batch.column(0).to_numpy()
            for first, last in buffers.runs_of_documents(offsets, AT_ONCE):
                part = offsets[first : last + 1]
                doc, a, whole, lo, hi = anchors(data[part[0] : part[-1]], part - part[0], depth, anchor, bits)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r[first:last][doc], a, _low_bits(whole, bits), lo.astype(np.int32), hi.astype(np.int32))], names=names)

    return texts.mapInArrow(buffers.tidy(run), "r long, anchor long, whole long, lo int, hi int")


def _windows(opened: DataFrame, depth: int, bits: int) -> DataFrame:
    """code, r, at: every window of the records of ``opened`` (r, packed, runs)."""
    names = ["code", "r", "at"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in buffers.slices(batches):
            runs = batch.column(2)
            spans = runs.flatten()
            ends = runs.offsets.to_numpy()
            lo, hi, a = (spans.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k in range(batch.num_rows):
                data = np.frombuffer(unpack.decompress(batch.column(1)[k].as_py()), np.uint8)
                x = slice(ends[k] - ends[0], ends[k + 1] - ends[0])
                count = hi[x].astype(np.int64) - lo[x] + 1
                at = buffers.ragged_positions(lo[x].astype(np.int64), count)
                code = buffers.mix(buffers.Rolling(data).range(at, at + depth) ^ np.repeat(a[x].view(np.uint64), count))
                yield pa.RecordBatch.from_arrays([pa.array(_low_bits(code.view(np.int64), bits)), pa.array(np.full(len(at), batch.column(0)[k].as_py())), pa.array(at.astype(np.int32))], names=names)

    return opened.select("r", "packed", "runs").mapInArrow(buffers.tidy(run), "code long, r long, at int")


def _ways(n: str) -> Column:
    """In how many parts a group of ``n`` is put in order."""
    return (F.expr(f"{n} div {PART}") + 1).cast("int").alias("ways")


def _linked(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (keys, ways, r, lo, hi) with the one before each in its part of the group: its row ``other``, and how far on in that it
    lies (``shift``).  Both are null for the first of a part; ``more`` tells whether one comes after.

    A part has whole stretches of rows: what is periodic in one, and passages that go through many groups of the same rows, then
    have one ``other`` and ``shift`` from record to record, and ``_runs`` joins them."""
    stretch = F.hash("r", F.expr(f"lo div {STRETCH}"))
    split = members.withColumn("part", F.pmod(stretch, "ways")).repartition(*keys, "part")
    w = Window.partitionBy(*keys, "part").orderBy("r", "lo")
    before = [F.lag("r").over(w).alias("other"), (F.lag("lo").over(w) - F.col("lo")).alias("shift")]
    return stored(split.select(*keys, "ways", "r", "lo", "hi", *before, F.lead("r").over(w).isNotNull().alias("more")), "linked")


def _heads(linked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ways, r, lo, hi, more: the first of each group, and whether it has other members."""
    firsts = linked.where("other is null")
    whole = firsts.where("ways = 1").select(*keys, "ways", "r", "lo", "hi", "more")
    split = firsts.where("ways > 1").groupBy(*keys, "ways").agg(F.min(F.struct("r", "lo", "hi")).alias("x"), (F.bool_or("more") | (F.count("*") > 1)).alias("more"))
    return whole.unionByName(split.select(*keys, "ways", "x.*", "more"))


def _runs(linked: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """r, lo, stop, other, shift: byte ranges of rows, and how far on in which other row the digits say that the same bytes stand.

    The first of a part meets the first of its group, and that itself, at shift 0.  Neighbouring ranges with one
    ``other`` and ``shift`` are joined.
    """
    heads, names = _heads(linked, keys).where("more"), ["r", "lo", "hi", "other", "shift"]
    alone = heads.where("ways = 1").select("r", "lo", "hi", F.col("r").alias("other"), F.lit(0).alias("shift"))
    above = heads.where("ways > 1").select(*keys, F.col("r").alias("_r"), F.col("lo").alias("_lo"))
    firsts = linked.where("other is null and ways > 1").join(above, keys).select("r", "lo", "hi", F.col("_r").alias("other"), (F.col("_lo") - F.col("lo")).alias("shift"))
    pairs = linked.where("other is not null").select(names).union(firsts).union(alone)
    w = Window.partitionBy("r", "other", "shift").orderBy("lo")
    fresh = F.coalesce((F.col("lo") > F.lag("hi").over(w) + depth).cast("int"), F.lit(0))
    numbered = pairs.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("r", "other", "shift", "_g").agg(F.min("lo").alias("lo"), (F.max("hi") + depth).cast("int").alias("stop"))
    return stored(runs.select("r", "lo", "stop", "other", "shift"), "runs")


def _raw(texts: DataFrame) -> DataFrame:
    """r, bytes of ``texts`` (r, packed), null ones left out."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in buffers.slices(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpack.decompress(x.as_py()) for x in batch.column(1)], pa.binary())], names=["r", "bytes"])

    r, packed = texts.columns
    return texts.where(F.col(packed).isNotNull()).mapInArrow(buffers.tidy(run), "r long, bytes binary")


_ITSELF = "r = other and shift = 0"


def _digests(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """claim, digest: 256 bits of BLAKE2 over the bytes of each of ``ranges`` (r, claim, lo, stop) of ``texts``.

    Texts without a range stay where they are, the others travel compressed, once, to their ranges.  A row has as many of
    these as its text is long at most; the head of a large group also has one for each of the group's parts.
    """
    asked = ranges.groupBy("r").agg(F.collect_list(F.struct("claim", "lo", "stop")).alias("asked"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in buffers.slices(batches, 200):
            for packed, spans in zip(*batch.columns, strict=True):
                view, known = memoryview(unpack.decompress(packed.as_py())), {}
                claim, lo, stop = (spans.values.field(k) for k in range(3))
                places = list(zip(lo.to_pylist(), stop.to_pylist(), strict=True))
                for a, b in set(places):
                    known[a, b] = blake2b(view[a:b], digest_size=32).digest()
                yield pa.RecordBatch.from_arrays([claim, pa.array([known[x] for x in places], pa.binary())], names=["claim", "digest"])

    return texts.join(asked, "r").select("packed", "asked").mapInArrow(buffers.tidy(run), "claim long, digest binary")


def _refuted(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Those of ``runs`` whose bytes are not the ones they were taken for, by digests of both sides' bytes.

    A run is known by a hash; two runs that share one are both taken for refuted unless all their bytes are equal, which
    only means that they are formed again by bytes.
    """
    claim = F.xxhash64("r", "lo", "stop", "other", "shift").alias("claim")
    claims = runs.where(f"not ({_ITSELF})")
    here = claims.select("r", claim, "lo", "stop")
    there = claims.select(F.col("other").alias("r"), claim, (F.col("lo") + F.col("shift")).alias("lo"), (F.col("stop") + F.col("shift")).alias("stop"))
    differ = _digests(texts, here.unionByName(there)).groupBy("claim").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).where("_a <> _b").select("claim")
    return stored(claims.withColumn("claim", claim).join(stored(differ, "differ"), "claim", "left_semi").select(*runs.columns), "refuted")


def _mended(texts: DataFrame, runs: DataFrame, refuted: DataFrame, depth: int, anchor: int, bits: int) -> DataFrame:
    """r, lo, stop: what is repeated, where some of ``runs`` are refuted.

    Firsts that a refuted run leads to are dropped too.  All windows with an anchor that stands in a dropped
    range are compared by their bytes: windows that are equal have one anchor, so none is left out.
    """
    sides = refuted.select("r", "lo", "stop").union(refuted.select("other", F.col("lo") + F.col("shift"), F.col("stop") + F.col("shift"))).distinct()
    meets = lambda x: (F.col("x.r") == F.col("s.r")) & (F.col("x.lo") < F.col("s.stop")) & (x > F.col("s.lo"))
    sole = runs.where(_ITSELF).select("r", "lo", "stop")
    doubted = stored(sole.alias("x").join(sides.alias("s"), meets(F.col("x.stop")), "left_semi").union(sides).distinct(), "doubted")
    firsts = sole.alias("x").join(doubted.alias("s"), meets(F.col("x.stop")), "left_anti")
    proven = runs.where(f"not ({_ITSELF})").join(refuted, runs.columns, "left_anti").select("r", "lo", "stop")
    all_records = records(texts, depth, anchor, bits)
    open_anchors = all_records.alias("x").join(doubted.alias("s"), meets(F.col("x.hi") + depth), "left_semi").select("anchor").distinct()
    windows = F.explode(F.expr(f"transform(sequence(lo, hi), x -> struct(x as at, substring(bytes, x + 1, {depth}) as window))"))
    opened = all_records.join(open_anchors, "anchor").join(_raw(texts), "r").select("r", windows.alias("w")).select("r", "w.*")
    found = opened.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    exact = opened.join(found, "window").select("r", F.col("at").alias("lo"), (F.col("at") + depth).alias("stop"))
    return firsts.union(proven).union(exact)


def repeated_ranges(texts: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, bits: int = BITS) -> DataFrame:
    """r, spans: maximal byte ranges (begin, end) of each of ``texts`` (r, packed) that repeated windows cover.

    Pass 1 counts records by their first digit and drops the single ones.  Pass 2 compares the second digit:
    records that share it are repeated.  In groups of the first digit that don't agree, each different second
    digit sends one record on; pass 3 opens these and compares windows at full depth.  Each member of a group
    is then compared with another by a digest of its bytes (``_refuted``), and groups that a hash brought together by
    chance are formed again by bytes (``_mended``): the result doesn't depend on the hashes.  Groups are
    counted before each shuffle and split in parts, so a very frequent string is never in one task.
    """
    texts = texts.toDF("r", "packed")
    all_records = records(texts, depth, anchor, bits)
    seen = all_records.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("whole").alias("_a"), F.max("whole").alias("_b")).where("_n > 1")
    seen = stored(seen.select("anchor", _ways("_n"), (F.col("_a") != F.col("_b")).alias("mixed")), "anchors")
    keys = ["anchor", "whole", "mixed"]
    linked = _linked(all_records.join(seen, "anchor"), keys)
    by_records = _runs(linked, keys, depth)
    heads = _heads(linked, keys).where("mixed").groupBy("r").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("runs"))
    opened = stored(texts.join(heads, "r"), "opened", "none")
    drop(seen, linked)
    windows = _windows(opened, depth, bits)
    found = windows.groupBy("code").agg(F.count("*").alias("_n")).where("_n > 1").select("code", _ways("_n"))
    linked = _linked(windows.join(found, "code").select("code", "ways", "r", F.col("at").alias("lo"), F.col("at").alias("hi")), ["code"])
    drop(opened)
    by_windows = _runs(linked, ["code"], depth)
    drop(linked)
    runs = by_records.unionByName(by_windows)
    refuted = _refuted(texts, runs)
    covered = runs.select("r", "lo", "stop") if refuted.isEmpty() else _mended(texts, runs, refuted, depth, anchor, bits)
    # Ranges that meet become one before a row's are gathered.
    w = Window.partitionBy("r").orderBy("lo", "stop")
    fresh = F.coalesce((F.col("lo") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    numbered = covered.distinct().withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("r", "_g").agg(F.min("lo").alias("begin"), F.max("stop").alias("end"))
    out = stored(spans.groupBy("r").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    drop(by_records, by_windows, refuted)
    free_driver(texts.sparkSession)
    return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the given ranges cover."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(new[1:], True)]


def _kept(data: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed runs, remaining bytes)."""
    begin, end = merged(np.array([s["begin"] for s in spans or ()], np.int64), np.array([s["end"] for s in spans or ()], np.int64))
    runs = list(zip(begin.tolist(), end.tolist(), strict=True))
    edges = [0, *(x for run in runs for x in run), len(data)]
    return runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def measure(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text).

    Removed is each byte that a string of ``depth`` bytes covers which also starts anywhere else, in the same
    or another row; overlaps count, matches never cross rows, and all is judged on the input.  Null texts
    count as empty; texts shorter than ``depth`` lose nothing; repeated rows lose all windows.  Strings are
    compared by 256-bit digests or by their bytes in the end, whatever ``bits`` of hashes say.  Other columns are left out.
    """
    base, row, packed = _base(docs.select("doc_id", "text"), ["doc_id"])

    def run(batches):
        for batch in buffers.slices(batches):
            rows = []
            data, offsets = buffers.utf8(unpacked(batch, 1))
            for k, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                runs, kept = _kept(text, spans.as_py())
                rows.append((doc, len(text), len(text) - len(kept), len(runs), sha256(kept).hexdigest()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_ranges(base.select(row, packed), depth, anchor, bits).withColumnRenamed("r", row)
    return base.join(spans, row, "left").select("doc_id", packed, "spans").mapInArrow(buffers.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: bytes, begin: int, end: int) -> tuple[int, int]:
    """The part of a byte range that covers whole UTF-8 characters."""
    while begin < end and data[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def remove_repeats(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` and n_chars counted anew, all columns kept.

    The cuts are those of ``measure``, drawn in to whole characters.  A null text stays null.
    """
    names = docs.columns
    others = [c for c in names if c != "text"]
    base, row, packed = _base(docs, others)
    span = unused(docs, "_spans")

    def run(batches):
        for batch in buffers.slices(batches):
            out = []
            for data, spans in zip(unpacked(batch, len(others)), batch.column(len(others) + 1), strict=True):
                text = data.as_py()
                if text and spans.is_valid:
                    raw = text.encode()
                    cuts = [whole_characters(raw, a, b) for a, b in _kept(raw, spans.as_py())[0]]
                    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                out.append(text)
            columns = dict(zip(others, batch.columns, strict=False)) | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    spans = repeated_ranges(base.select(row, packed), depth, anchor).withColumnRenamed("r", row).withColumnRenamed("spans", span)
    out = base.join(spans, row, "left").select(*others, packed, span).mapInArrow(buffers.tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
