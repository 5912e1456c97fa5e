"""The corpus pipeline on a small corpus against a plain version of all its stages."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_bytes import plain_shingles
from tests.llm.test_operators import DOCS, plain_components, sentence


def plain_cut(texts, depth=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        text, at = "", 0
        for ch in d.decode():
            size = len(ch.encode())
            if not all(gone[at : at + size]):
                text += ch
            at += size
        out.append(text)
    return out


def test_pipeline(spark, tmp_path):
    pick = random.Random(11)
    rows = [(i, sentence(pick, pick.randrange(5, 120), lang), lang, "web", 1) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    base, passage, item = sentence(pick, 120), sentence(pick, 70), sentence(pick, 30)
    near = base.split()
    near[40] = "changed"
    rows += [(100, base, "en", "w", 1), (101, base, "en", "w", 1), (99, " ".join(near), "en", "w", 1)]
    rows += [(110 + k, f"{sentence(pick, 40)} {passage} {sentence(pick, 30)}", "en", "w", 1) for k in range(3)]
    rows += [(120, f"{sentence(pick, 50)} {item} {sentence(pick, 50)}", "en", "w", 1), (130, None, None, None, None), (131, "", "en", "w", 0), (132, "12 34", "en", "w", 5)]
    items = [(1, item), (2, sentence(pick, 25))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    gone = {i for i, _, low in plain_components(kept) if i != low}
    kept = [r for r in kept if r[0] not in gone]
    assert gone == {100, 101}
    texts = list(zip([r[0] for r in kept], plain_cut([r[1] for r in kept]), strict=True))
    assert all(passage not in t for _, t in texts)
    sets = [plain_shingles(t) for _, t in items]
    texts = [(i, t) for i, t in texts if not any(len(s & plain_shingles(t)) >= 0.75 * len(s) for s in sets)]
    assert 120 not in dict(texts)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = own.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
