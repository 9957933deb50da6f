"""The whole pipeline against a plain version of its five stages."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from grainmill.llm import quality
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def good(text):
    raw = (text or "").encode()
    if brute.quality(text)[-1]:
        return False
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(x))
    low, high = quality.CHUNK_BAND
    full = [raw[i : i + quality.CHUNK] for i in range(0, len(raw) - quality.CHUNK + 1, quality.CHUNK)]
    bad = sum(not low <= ratio(x) <= high for x in full)
    bands = [b for b in quality.WHOLE_BANDS if len(raw) >= b[0]]
    inside = not bands or bands[-1][1] <= ratio(raw) <= bands[-1][2]
    return inside and bad <= quality.CHUNK_SHARE * len(full)


def mixed(texts, source):
    size = {i: len(brute.WORD.findall(t)) for i, t in texts.items()}
    names = sorted({source[i] for i in texts}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    words = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    target, open_ = {}, set(names)
    while open_:
        left = 1.5 * sum(words.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * words[s]}
        target |= {s: 2 * words[s] for s in full} or {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    out = Counter()
    for s in names:
        own = sorted((i for i in texts if source[i] == s), key=lambda i: (hashlib.md5(f"mix{i}".encode()).hexdigest()[:15], i))
        budget = math.floor(target[s])
        while budget > 0 and words[s]:
            for i in own:
                n = min(size[i], budget)
                if n:
                    out[i, texts[i] if n == size[i] else re.match(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){{{n}}}", texts[i])[0]] += 1
                budget -= n
    return out


def with_near_copies(table):
    """The documents, and those of more than 100 words again in one line with one word changed."""
    rows = table.to_pylist()
    for row in table.to_pylist():
        words = brute.WORD.findall(row["text"] or "")
        if len(words) > 100 and row["doc_id"] % 3 == 0:
            words[50] = "changed"
            rows.append(row | {"doc_id": row["doc_id"] + 1_000_000, "text": " ".join(words)})
    return pa.Table.from_pylist(rows, table.schema)


def test_pipeline_is_its_five_stages(spark, tmp_path):
    table = with_near_copies(pq.read_table(f"{FOLDER}/documents.parquet"))
    pq.write_table(table, tmp_path / "documents.parquet")
    table = table.to_pydict()
    source = dict(zip(table["doc_id"], table["source"]))
    rows = [(i, t) for i, t in zip(table["doc_id"], table["text"]) if good(t)]
    texts = brute.line_dedup(rows)
    near = brute.near_duplicates(list(texts.items()), 5)
    kept = {i: t for i, t in texts.items() if near[i][1] == i}
    assert 0 < len(kept) < len(rows) < len(source)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (i, text), copies in mixed(kept, source).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            want[i, piece, start, np.array(ids[start : start + 2048], "<u4").tobytes()] += copies
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got)
    assert sum(found.values()) == sum(want.values())
    assert found == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those of the operators, null and equal ids, repeated rows, an empty table."""
    names = ["kept", "ratio", "n_words", "n_dropped", "__left", "__gone", "doc", "size", "taken", "a.b", "extra0"]
    rng = np.random.default_rng(2)
    parts = ["ba", "lo", "min", "ter", "so", "ka", "ri", "ven", "du", "fel", "to", "gra"]
    prose = lambda: "\n".join(" ".join("".join(rng.choice(parts, 3)) for _ in range(14)) for _ in range(9))
    text = prose()
    rows = [(None, text), (1, text), (1, text), (2, text + " more."), (3, None), (4, ""), (5, prose())]
    fields = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    odd = spark.createDataFrame([(*r, "s", *names) for r in rows], fields)
    for docs, n in ((odd, 1), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), odd.schema)
            assert all(r[x] == x for r in docs.collect() for x in names)
            assert docs.count() >= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= n
