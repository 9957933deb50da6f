"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import html
from collections import Counter
from pathlib import Path
from urllib import parse

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from grainmill.llm import coder, components, lines, mixing, neardup, packing, pii, quality, substring, text, tokens, topk, urls
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, kept string, `n lines` string"
BASE = " ".join(f"w{i}" for i in range(80))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    BASE,
    BASE,
    BASE.replace("w7 ", "x "),
    BASE.upper() + " tail",
    "A line of some length\nshort\n  a LINE of some length \nend",
    "zz\na line of some length\nunlike anything else here\n",
    "mail a@b.co_c@d.org, 10.0.0.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111 or +1 (017) 555-7713.",
    "é à\x1c b  c \n\nd " * 30,
    "long " * 3000 + "1." * 3000 + "a.b@" * 500,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_empty_tables(spark, empty, tmp_path):
    for df in (
        packing.pack(empty), mixing.mix_sources(empty), mixing.mixed_documents(empty), pii.find_pii(empty), quality.quality(empty),
        substring.repeated_spans(empty), neardup.near_duplicates(empty), lines.drop_repeated_lines(empty),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 50),
        urls.judge(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


ODD_NAMES = ["__doc", "__body", "__gone", "__left", "__hash", "__id", "__key", "doc", "body", "gone", "row", "hash", "t", "words", "GONE_", "rows", "label", "rep", "seen", "h1", "a.b"]


def test_names_and_rows_out_of_the_ordinary(spark, empty, tmp_path):
    """Columns named like those the operators work with, null and equal ids, repeated rows: all come out as they went in."""
    near = BASE.replace("w9 ", "y ")
    rows = [(None, BASE), (None, BASE), (None, None), (3, BASE), (3, BASE), (3, near), (4, near), (5, TEXTS[8]), (6, TEXTS[9]), (6, ""), (7, None)]
    kinds = ", ".join(f"`{n}` string" for n in ODD_NAMES)
    df = spark.createDataFrame([(*r, "s", *ODD_NAMES) for r in rows], f"doc_id long, text string, source string, {kinds}")
    plain = df.select("doc_id", "text", "source")
    bag = lambda found: Counter((r.doc_id, r.text) for r in found.collect())
    for fn in (substring.cut_repeats, mixing.mixed_documents, quality.quality, lambda x: lines.drop_repeated_lines(x, 2)):
        found = fn(df)
        assert found.columns[: len(df.columns)] == df.columns
        assert all(r[n] == n for r in found.collect() for n in ODD_NAMES)
        assert bag(found) == bag(fn(plain))
        assert fn(empty).count() == 0
    lost = bag(lines.drop_repeated_lines(df, 2))
    assert lost[3, BASE] == 2 and lost[4, near] == 0 and lost[4, ""] == 1 and lost[None, BASE] == 2
    alone = neardup.drop_near_duplicates(df, 2)
    assert alone.columns == df.columns and bag(alone) == Counter([r[:2] for r in rows if r[0] != 4])
    assert neardup.drop_near_duplicates(empty, 2).count() == 0
    for fn in (packing.pack, mixing.mix_sources, pii.find_pii):
        assert fn(df).count() == len(rows)
    for name, table in (("odd", df), ("none", empty)):
        coder.write_tokens(table, str(tmp_path / name))
    assert [coder.read_tokens(spark, str(tmp_path / name)).count() for name in ("odd", "none")] == [len(rows), 0]


def test_quality_counts(docs):
    for r in quality.quality(docs).collect():
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert got == brute.quality(TEXTS[r.doc_id])


def test_compression_bands(spark):
    noise = "".join(chr(33 + x) for x in np.random.default_rng(0).integers(0, 90, 9000)).replace("<", " ")
    rows = [(0, " ".join(f"{a}{b}" for a in "abcdefgh" for b in range(200))), (1, "\n".join(f"Row {i}: nothing new." for i in range(3000)))]
    kept = {r.doc_id: r.ratio for r in quality.quality(spark.createDataFrame([*rows, (2, noise)], "doc_id long, text string")).collect()}
    assert kept[1] > 8 and kept[2] < 1.25


def test_noise_is_not_kept_and_prose_is():
    rng = np.random.default_rng(1)
    pick = lambda signs, n, width: " ".join("".join(rng.choice(signs, width)) for _ in range(n))
    alnum = [chr(c) for c in range(128) if chr(c).isalnum()]
    base64 = [*alnum, "+", "/"]
    cjk = [chr(c) for c in range(0x4E00, 0x9FA5)]
    noise = [pick(base64, n, 76) for n in (51, 60, 900)] + [pick(base64, 55, 20)]
    noise += [pick(alnum, n, 6) for n in (160, 700, 10000)] + [pick(cjk, n, 4) for n in (60, 90, 400, 6000)]
    prose = (Path(__file__).parents[2] / "README.md").read_text()
    prose = [prose[:n] for n in (1100, 5000)]
    settings = quality.LEVEL, quality.WHOLE_BANDS, quality.CHUNK, quality.CHUNK_BAND, quality.CHUNK_SHARE
    *_, failed, kept = quality._measure(pa.array(noise + prose), settings)
    assert not any(failed.to_pylist())
    assert kept.to_pylist() == [False] * len(noise) + [True] * len(prose)


def test_lines(docs):
    want = brute.line_dedup(list(enumerate(TEXTS)))
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs, batches=3).collect()}
    assert got == want


def test_lines_do_not_depend_on_batches(spark):
    rows = [(i, "\n".join(f"line number {(i * j) % 17}" for j in range(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.line_dedup(rows)
    for batches in (1, 4, 7):
        assert {r.doc_id: r.text for r in lines.drop_repeated_lines(df, batches).collect()} == want


def test_near_duplicates(docs):
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width).collect()}
        assert got == brute.near_duplicates(list(enumerate(TEXTS)), width)


def test_near_duplicates_in_a_chain(spark):
    """Each text is near the next one only, so a leader's links do not reach."""
    rows = [(i, " ".join(f"v{j}" for j in range(2 * i, 2 * i + 40))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows, 2).items()}


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 50, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert (neardup.sketch(keys) != neardup._NONE).all()


def test_mixing_reaches_every_target(docs):
    rows = mixing.mix_sources(docs).collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    for target in {r.target for r in rows}:
        assert sum(r.taken for r in rows if r.target == target) == int(target)
    total = sum(r.size for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(1.5 * total)
    words = mixing.mixed_documents(docs).selectExpr("sum(regexp_count(text, '[^ \t\n\x0b\f\r]+')) n").first().n
    assert words == sum(r.taken for r in rows)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, bins = {}, {}
    for r in packing.pack(docs, size=64).collect():
        found.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(x for _, x in sorted(found[i])), "<u4").tolist() == ids
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64


def test_the_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n)[0] for n in (6, 8, 9, 4, 1)] == [0, 1, 2, 0, 2]


def test_token_files(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.write_tokens(docs, str(tmp_path / "t"))
    got = {r.doc_id: r for r in coder.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, np.frombuffer(got[i].ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)


def test_damaged_blocks_are_found():
    data = bytearray(coder.to_segment([1], [9000], np.arange(9000, dtype=np.uint32) % 700))
    assert coder.from_segment(bytes(data))[2].tolist() == [i % 700 for i in range(9000)]
    data[-5] ^= 1
    with pytest.raises(ValueError, match="damaged block"):
        coder.from_segment(bytes(data))


def test_base_pii(docs):
    for r in pii.find_pii(docs).withColumn("s", pii.spelled("base_spans")).collect():
        assert r.s == ",".join(brute.pii(TEXTS[r.doc_id]))


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1 and 127.0.0.1", "0.0.0.0", "1.2.3.00", "00.000.0000.1", "192.168.0.1:80", "1.2.3.004 0.0.0.256", "1.0.0255.00256"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_ip, r.s) for r in pii.find_pii(df).withColumn("s", pii.spelled("base_spans")).collect()}
    want = {i: ",".join(brute.pii(t)) for i, t in enumerate(texts)}
    assert got == {i: (s.count("ip:"), s) for i, s in want.items()} and got[0][0] == 2 and got[6][0] == 0


def test_contextual_pii(spark):
    good = [x for x in range(1000, 9999) if brute.luhn(f"411111111111{x}")][:8]
    rows = [(i, f"Filler {i} words. Account reads: 411111111111{x} and more") for i, x in enumerate(good)]
    rows += [(100, "Account reads: 411111111111999 ok"), (101, "the amount of 411111111111999 is clean")]
    got = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("s", pii.spelled("spans")).collect()}
    assert got[100] == "card:15:30" and got[0].count("card") == 1


def test_contextual_pii_behind_marks_and_in_lists(spark):
    """Brackets, labels, one word behind another identifier or at the start, list items."""
    card = [f"411111111111{x}" for x in range(1000, 9999) if brute.luhn(f"411111111111{x}")][:8]
    mail = [f"jo{c}@site{c}.org" for c in "abcdefgh"]
    phone = [f"+1 555 010 77{i}3" for i in range(8)]
    unknown = "411111111111999"
    shapes = [
        ("Filler {n} reply to <{x}> soon", mail, "jo(at)site.org", "email"),
        ("Filler {n} contact address:{x} thanks", mail, "jo(at)site.org", "email"),
        ("Filler {n} charge card:{x} thanks", card, unknown, "card"),
        ("Paid {x} yesterday {n}", card, unknown, "card"),
        ("Filler {n} both +49 171 5550{n}23, visa {x} yesterday", card, unknown, "card"),
        ("Filler {n} lines +49 171 5550{n}23, {x} open", phone, "555 010 7793", "phone"),
    ]
    rows, want = [], {}
    for k, (shape, seeds, new, kind) in enumerate(shapes):
        rows += [(100 * k + i, shape.format(n=i + 10, x=x)) for i, x in enumerate(seeds)]
        text = shape.format(n=99, x=new)
        rows.append((100 * k + 50, text))
        want[100 * k + 50] = f"{kind}:{text.index(new)}:{text.index(new) + len(new)}"
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("s", pii.spelled("spans"))
    got = {r.doc_id: r.s.split(",") for r in found.collect()}
    assert {i: w for i, w in want.items() if w not in got[i]} == {}


def test_substring(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, f"{'x' * i} intro {i} " + " ".join(f"u{i}q{j}" for j in range(200)) + (passage if i < 3 else "") + f" end {i}") for i in range(6)]
    df = spark.createDataFrame([*rows, (9, None), (10, "")], "doc_id long, text string")
    spans = substring.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {1, 2} and {r.first_doc_id for r in spans} == {0}
    for r in spans:
        assert rows[r.doc_id][1][r.start : r.end] in passage
    assert {r.doc_id: len(r.text or "") for r in substring.cut_repeats(df).collect()}[1] < len(rows[1][1]) - 300


def test_substring_finds_short_passages(spark):
    """Passages of 51 words, each in two hosts: how many are found, and how much of them."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(n))
    rows, planted = [], {}
    for i in range(300):
        front, passage = words(rng.integers(5, 80)), words(51) if i % 10 else " ".join(["over", "lord"] + [words(1)] * 49)
        rows += [(i, f"{words(60)} {passage} {words(40)}"), (1000 + i, f"{front} {passage} {words(30)}")]
        planted[1000 + i] = (len(front) + 1, len(front) + 1 + len(passage))
    covered = dict.fromkeys(planted, 0)
    for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id in planted:
            a, b = planted[r.doc_id]
            assert r.start >= a - 1 and r.end <= b + 1 or r.doc_id % 10 == 0
            covered[r.doc_id] += max(0, min(b, r.end) - max(a, r.start))
    shares = [covered[i] / (b - a) for i, (a, b) in planted.items()]
    assert sum(x > 0 for x in shares) >= 299 and np.mean(shares) > 0.78


def test_substring_against_brute_force(spark, route):
    """Rows that share a doc_id, a text or both, null ids, runs of one byte, long characters, a passage in many rows."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(n))
    shared, kanji = words(70), "".join(chr(0x4E00 + c) for c in rng.integers(0, 900, 150))
    texts = [f"{words(int(rng.integers(3, 60)))} {shared} {words(20)}" for _ in range(40)]
    texts += [f"{words(9)}{kanji}{words(9)}{kanji}", "x" * 700, f"{words(5)} {'x' * 900}", shared, shared + shared, "", "short"]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[5]), (3, texts[40]), (None, shared), (None, None), (77, None), (-4, texts[40])]
    rows += [(90 + i, texts[0]) for i in range(30)] + [(90, texts[0])] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(text)", "text").collect()]
    cut = lambda raw: brute.cuts(raw, substring.GEAR, substring.SHORTEST, substring.LONGEST, substring.REACH, substring.SHIFT)
    want = brute.repeated_spans(named, cut, substring.MIN_SPAN)
    got = {}
    for r in substring.repeated_spans(df).orderBy("doc_id", "body", "start").collect():
        got.setdefault((r.doc_id, r.body), []).append((r.start, r.end, r.n_chunks, r.first_doc_id))
    assert len(want) > 60 and got == want
    left = []
    for doc, body, text in named:
        for start, end, *_ in reversed(want.get((doc, body), [])):
            text = text[:start] + text[end:]
        left.append((doc, text))
    assert Counter((r.doc_id, r.text) for r in substring.cut_repeats(df).collect()) == Counter(left)


def test_cuts_of_odd_texts():
    for text in ("a", "ab", "é", "x" * 20, "日本" * 200, "abc" * 500, *["".join(map(chr, range(97, 98 + k))) for k in range(26)]):
        raw = text.encode()
        ends = substring.cuts(np.frombuffer(raw, np.uint8), substring.SHORTEST, substring.LONGEST)
        sizes = np.diff(ends, prepend=0)
        assert ends.dtype.kind == "i" and ends[-1] == len(raw) and 0 < sizes.min() and sizes.max() <= substring.LONGEST
        assert all(raw[:e].decode() for e in ends)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(400)]
    odd = [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (None, [1.0] * 6)]
    same = [(7, [2.0] * 6), (7, [2.0] * 6), (7, [-2.0] * 6), (50, [1.0, 0.0, 2.0, 0.0, 2.0, -1.0]), vectors[3]]
    df = spark.createDataFrame(vectors + odd + same, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 50, shard=90, leaf=8).collect())
    units = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors + same]
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(u @ v), i) for j, u in units if j == q for i, v in units if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want and sum(x[2] == 7 for x in got) > 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 35), (35, 50), (60, 60), (None, 3), (40, 35)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute.components([e for e in edges if None not in e])


def test_urls(spark):
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="https://Q.com/de/1">'),
        (2, "http://b.net/y#t", "<meta http-equiv='refresh' content='0; url=/z'>"),
        (3, "http://b.net/z", "<LINK href=http://a.net/x rel=canonical>"),
        (4, None, None),
        (5, "http://c.net/", ""),
        (6, "http://d.net/p", '<link rel=canonical href="http://x.example.org/es/1">'),
        (7, "http://d.net/q", '<link rel=canonical href="http://e.org/">'),
        (8, "http://d.net/q", '<link rel=canonical href="http://x.example.org/es/1">'),
        (9, "nothing", '<link rel=canonical href="http://x.example.org/es/1">'),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}




def test_urls_spelled_as_html_does(spark):
    """Edges against the standard library's joining and decoding; a block reaches the page a link names."""
    here = "http://a.net/d/e/page?page=1"
    forms = [
        ("?page=2&amp;ref=x", None), ("?a=1&#38;b=2&#x26;c=%C3&#233;", None), ("x?a=&amp;lt;&quot", None), ("../x", None), ("./x/./y/..", None),
        ("../../../../z", None), ("/q/../r", None), ("?q=1", None), ("y", "/base/dir/"), ("?q=2", "/base/file"), ("../y", "http://B.net/s/t/u"),
        ("http://c.net/k/../m?u=../n", None), ("//c.net/./n", None),
    ]
    pages, want = [], {}
    for i, (target, base) in enumerate(forms):
        url = f"{here}&n={i}"
        front = f"<base target=_top><base href='{base}'>" if base else ""
        tag = f'<link rel="canonical" href="{target}">' if i % 2 else f'<meta http-equiv="refresh" content="0; url={target}">'
        pages.append((i, url, front + tag.replace("&quot", "&amp;") if "&quot" in target else front + tag))
        target = html.unescape(target.replace("&quot", "&amp;"))
        want[f"a.net/d/e/page?page=1&n={i}"] = parse.urljoin(parse.urljoin(url, base or ""), target).split("://")[1].replace("B.net", "b.net")
    # urljoin leaves the dots of addresses with a host of their own
    want |= {"a.net/d/e/page?page=1&n=11": "c.net/m?u=../n", "a.net/d/e/page?page=1&n=12": "c.net/n"}
    pages.append((90, "http://f.net/", "<base href='http://g.net/'><meta http-equiv=refresh content=5><link rel=canonical href=''>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.a: r.b for r in urls.alias_edges(df).collect()} == want
    pair = [(1, "http://h.net/s/x?b=1&c=2", ""), (2, "http://h.net/s/t/y", '<link rel=canonical href="../x?b=1&amp;c=2">')]
    pair.append((3, "http://h.net/s/x?b=1&c=2#f", '<link rel=canonical href="http://Q.com/de/1">'))
    df = spark.createDataFrame(pair, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "block"}


BITS = (
    "a|B|the|\u0130|\u00c9|\u00df|\u03a3|\u03c2|,|.|, |. | |  |\n|\t|\u00a0|\u3000|1|'s|don't|<#endoftext#>|<#ENDOFTEXT#>|<#startoftext#>|<#|#>|\u6f22"
    "|\u00e9|e\u0301|-|_|\ufb01|\x1c|\u0307|\u200d|...|,,,|I|K\u212a|evI\u0307,|BI\u0307R"
)


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_those_of_the_library(name, spaced):
    rng = np.random.default_rng(8)
    bits = [x.replace("#", "|") for x in BITS.split("|")]
    found = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(20000)] + ["Ankara'daki ev\u0130, g\u00fczel", "T\u00dcRK\u0130YE'DEK\u0130. B\u0130R"]
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokens.Encoder(path, spaced)
    for i in range(0, len(found), 400):
        for text, ids in zip(found[i : i + 400], own.encode(found[i : i + 400])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_at_line_ends_and_before_punctuation_are_learnt_once(name, spaced):
    """Pairs of words around a full stop and a line end are no pieces of their own, which few texts would share."""
    words = [a + b + c for a in "bdfgklmn" for b in ("a", "\u00e9") for c in "rstz"]
    rng = np.random.default_rng(4)
    marks = np.array([" ", ".\n", "!?\n", ", ", ")\n", "\n"])
    texts = ["".join(f"{rng.choice(words)}{rng.choice(marks)}" for _ in range(300)) + "end" for _ in range(40)]
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokens.Encoder(path, spaced)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) + len(own.older) <= 4 * len(words)


def test_hashing_many_texts_leaves_small_tables(monkeypatch):
    """What a worker keeps for hashes follows the longest text beyond a stretch, not the batch."""
    monkeypatch.setattr(text, "_tables", [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in text._PRIMES])
    texts = pa.array([f"{i} " + "one two three four five six " * 200 for i in range(600)])
    sets = dict(neardup.shingle_sets(texts, 5))
    assert [len(sets[i]) for i in range(600)] == [7] * 600
    assert sum(y.nbytes for x in text._tables for y in x) <= 16 << 20


def test_words_of_two_letters_in_the_order_of_thue_and_morse_differ(spark):
    """Hashes modulo a power of two agree on such words, whatever their base."""
    rows = []
    for i, n in enumerate((10, 11, 12, 13)):
        one = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << n))
        rows += [(2 * i, one), (2 * i + 1, one.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame([*rows, (99, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {i: 0 if i == 99 else i for i in got}
    both = spark.createDataFrame([(0, f"{rows[0][1]}\n{rows[1][1]}"), (1, f"{rows[0][1]}\n{rows[0][1]}")], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(both).collect()} == {0: 0, 1: 1}
