"""Benchmark decontamination: short test items are found inside long documents.

Items are partitioned by the size of their shingle sets.  Each size has a bottom-k MinHash sketch long
enough that a document which holds the wanted share of an item must hold a sketched shingle, whatever the
document's own size; a document's shingles are probed against the sketches, and candidates are verified
by exact shingle containment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import keyed_text, without
from palimpsest.scratch import stored

#: Words of a shingle, and the least share of an item's shingles that contaminates a document.
WORDS, THRESHOLD = 5, 0.75
#: Item shingles that one block of items may hold; more items make more blocks, each one pass.
BLOCK_SHINGLES = 1 << 21
_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(buffers._LOWER)


def shingle_texts(text: str | None, k: int = WORDS) -> set[bytes]:
    """The shingles of a text as byte strings: k words in ASCII lower case, or all words if there are fewer."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def size_class(n: int) -> int:
    """The partition of items with n shingles: the exponent of the next power of two."""
    return max(0, (n - 1).bit_length())


def sketch_size(n: int, threshold: float) -> int:
    """Bottom hashes kept for items of n shingles: at the upper size of n's partition one more than may be
    missing, so that at least one kept shingle is in any document that reaches the threshold."""
    upper = 1 << size_class(n)
    return min(n, upper - math.ceil(threshold * upper - 1e-9) + 1)


@dataclass
class SizePartition:
    """The sketches of the items of one size class: hashes in rising order, their items, and a bit table over them."""

    keys: np.ndarray
    owners: np.ndarray
    shift: np.uint64
    seen: np.ndarray

    @classmethod
    def of(cls, members: list[int], sets: list[np.ndarray], threshold: float) -> SizePartition:
        low = [sets[j][: sketch_size(len(sets[j]), threshold)] for j in members]
        keys, owners = np.concatenate(low), np.repeat(members, [len(x) for x in low])
        order = np.argsort(keys, kind="stable")
        bits = min(26, max(12, int(len(keys) * 16).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[keys >> np.uint64(64 - bits)] = True
        return cls(keys[order], owners[order], np.uint64(64 - bits), seen)

    def candidates(self, hashes: np.ndarray, to: np.ndarray, n_items: int) -> np.ndarray:
        """document * n_items + item of all documents that hold a sketched hash of an item."""
        maybe = np.flatnonzero(self.seen[hashes >> self.shift])
        lo, hi = (np.searchsorted(self.keys, hashes[maybe], side) for side in ("left", "right"))
        items = self.owners[buffers.ragged_positions(lo, hi - lo)]
        docs = np.repeat(np.searchsorted(to, maybe, "right") - 1, hi - lo)
        return np.unique(docs * n_items + items)


@dataclass
class Block:
    """Item texts, their shingle hashes, and by size of a shingle the sketched hashes of each size partition."""

    texts: list[str]
    threshold: float
    k: int

    def __post_init__(self):
        column = pa.array(self.texts, pa.string())
        self.keys_of = [md5(t.encode()).digest() for t in self.texts]
        self.sets = [np.zeros(0, np.uint64)] * len(self.texts)
        for first, hashes, offsets in buffers.shingle_sets(column, self.k):
            for j, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
                self.sets[first + j] = hashes[a:b].copy()
        #: Items shorter than a shingle are probed with windows of their own length.
        self.sizes = np.array([min(self.k, len(_WORD.findall(t.encode()))) for t in self.texts], np.int64)
        #: (words of a shingle, size class): the class's sketches as one index of its own
        self.parts: dict[tuple[int, int], SizePartition] = {}
        classes: dict[tuple[int, int], list[int]] = {}
        for j, s in enumerate(self.sets):
            if len(s):
                classes.setdefault((int(self.sizes[j]), size_class(len(s))), []).append(j)
        for key, members in classes.items():
            self.parts[key] = SizePartition.of(members, self.sets, self.threshold)

    def probe(self, data: np.ndarray, offsets: np.ndarray):
        """Yield (document, item, shared shingle count) of all pairs that reach the threshold by hashes."""
        words, at = buffers.word_hashes(data, offsets)
        for size in sorted({k for k, _ in self.parts}):
            hashes, to = buffers.shingle_hashes(words, at, size)
            found = [part.candidates(hashes, to, len(self.texts)) for (k, _), part in self.parts.items() if k == size]
            last, own = -1, None
            for pair in np.unique(np.concatenate(found)):
                doc, item = divmod(int(pair), len(self.texts))
                if doc != last:
                    last, own = doc, np.unique(hashes[to[doc] : to[doc + 1]])
                shared = int(np.isin(self.sets[item], own, assume_unique=True).sum())
                if shared >= self.threshold * len(self.sets[item]) - 1e-9:
                    yield doc, item, shared

    def verify(self, text: bytes, item: int) -> tuple[int, int]:
        """(item shingles, those that the text holds), by comparing the words themselves."""
        wanted = shingle_texts(self.texts[item], self.k)
        return len(wanted), len(wanted & shingle_texts(text.decode(), int(self.sizes[item])))


PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double, text_key binary"
_FOUND = "doc_id long, text_key binary, item_key binary, n_item long, n_shared long, containment double"


def _blocks(items: DataFrame):
    """Yield (distinct item texts sent to tasks, item_id and item_key of their rows) in blocks of bounded size.

    Each text is in a block once, however many items have it, and blocks deal out texts by hash.
    """
    rows = items.where(F.length("text") > 0).select("item_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("item_key"))
    texts = rows.groupBy("item_key").agg(F.first("text").alias("text"))
    total = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (4 * BLOCK_SHINGLES)))
    block = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
    if blocks > 1:
        texts = stored(texts, "items")
    for b in range(blocks):
        found = [r["text"] for r in texts.where(block == b).orderBy("item_key").collect()]
        if found:
            yield items.sparkSession.sparkContext.broadcast(found), rows.where(block == b).select("item_id", "item_key")


def pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """``contaminated`` with text_key, which tells the texts of one doc_id apart."""
    out = None
    for sent, ids in _blocks(items):
        found = _pass(keyed_text(docs), sent, threshold, k).join(ids, "item_key").select("doc_id", "item_id", "n_item", "n_shared", "containment", "text_key")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every document that holds enough of an item.

    Words are runs without ASCII white space, in ASCII lower case; a set has the distinct k-word shingles,
    or the whole sequence of an item with fewer words, which must then stand in the document as it is.
    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  Null or empty texts
    hold nothing and are found nowhere.  Repeated document rows or items give repeated pairs.  Items go
    through in blocks of bounded size, each block to every task; any number of items gives whole results.
    """
    return pairs(docs, items, threshold, k).drop("text_key")


def _pass(docs: DataFrame, sent, threshold: float, k: int) -> DataFrame:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches):
        block = None
        for batch in buffers.slices(batches):
            block = block or Block(sent.value, threshold, k)
            data, offsets = buffers.utf8(batch.column(1))
            rows = []
            for first, last in buffers.runs_of_documents(offsets):
                part = offsets[first : last + 1]
                for doc, item, _ in block.probe(data[part[0] : part[-1]], part - part[0]):
                    at = first + doc
                    n, shared = block.verify(bytes(data[offsets[at] : offsets[at + 1]]), item)
                    if shared >= threshold * n - 1e-9:
                        rows.append((batch.column(0)[at].as_py(), batch.column(2)[at].as_py(), block.keys_of[item], n, shared, shared / n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.mapInArrow(buffers.tidy(run), _FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """``docs`` without the documents that hold an item; a null id is kept.  All columns stay as they are.

    Rows that share an id but not the text are judged each by its own text.
    """
    return without(docs, pairs(docs, items, threshold, k).select("doc_id", "text_key"))
