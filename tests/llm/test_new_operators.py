"""Hard negatives, license scans and the Merkle manifest against brute force on small tables of odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import hardneg, licenses, manifest
from tests.llm.brute import UPPER

VECTORS = "vec_id long, embedding array<float>, label int, shard string, `n w` string"


def brute_negatives(rows, every, most=5, least=10):
    """Plain loops over all rows that take part."""
    sound = [
        (i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        for i, v, label, *_ in rows
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, label, v) in enumerate(sound):
        if i % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), j, other)
            for b, (j, other, w) in enumerate(sound)
            if a != b and len(v) == len(w)
        ]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:most]:
            fits = sorted(x for x in scored if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)[:least]
            out += [(i, positive, k, j, -p, -s) for k, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (6, 8))
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 40))
        rows.append((i, [float(x) for x in middles[label % 6] + rng.normal(0, 0.15, 8)], label, "x", "y"))
    return rows


@pytest.mark.parametrize("size", [16, 64, 8192])
def test_hard_negatives(spark, size):
    rows = clustered(400, size)
    rows += [(i, rows[0][1], 0, "x", "y") for i in range(1000, 1100)]  # a group of copies
    rows += [rows[20], (20, rows[21][1], 5, "x", "y"), (20, None, 1, "x", "y"), (None, rows[1][1], 1, "x", "y")]
    rows += [(2000, [float("nan")] * 8, 1, "x", "y"), (2020, [None] * 8, 1, "x", "y"), (2040, rows[3][1], None, "x", "y")]
    rows += [(2060, [0.0] * 8, 0, "x", "y"), (2080, [0.5, 0.5], 0, "x", "y"), (2081, [0.5, 0.25], 0, "x", "y"), (2082, [0.25, 0.25], 1, "x", "y")]
    rows += [(2100, [-float(x) for x in rows[0][1]], 77, "x", "y"), (2101, rows[0][1], 77, "x", "y")]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = hardneg.hard_negatives(df, 20, shard=size, least=size)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 20)


def test_cover_tree_covers_and_finds():
    rng = np.random.default_rng(3)
    near = np.floor(rng.normal(0, 40, (30, 16)))[rng.integers(0, 30, 3000)] + rng.integers(-3, 4, (3000, 16))
    for rows in (near, np.repeat(near[:3], 900, 0), rng.integers(-99, 99, (2000, 16)).astype(float), near[:1]):
        tree = hardneg.CoverTree(rows)
        assert sorted(tree.order) == list(range(len(rows)))
        for c, radius, inner, _, _, a, b in tree.nodes:
            away = np.linalg.norm(tree.vectors[tree.order[int(a) : int(b)]] - tree.vectors[int(c)], axis=1)
            assert (away <= radius + 1e-6).all() and b - a <= hardneg.LEAF


def test_few_nodes_are_visited_where_rows_are_clustered():
    """Windows leave most leaves unscored."""
    rng = np.random.default_rng(5)
    middles = np.floor(rng.normal(0, 60, (40, 16)))
    rows = middles[np.arange(8000) % 40] + rng.integers(-2, 3, (8000, 16))
    tree = hardneg.CoverTree(rows)
    back = np.empty(len(rows), int)
    back[tree.order] = np.arange(len(rows))
    tree.vectors = rows[tree.order]
    tree.nodes[:, 0] = back[tree.nodes[:, 0].astype(int)]
    query = rows[:1]
    own = query @ query.T
    seen = np.zeros(len(tree.nodes), bool)
    bounds = tree.bounds

    def counted(nodes, queries, norms):
        low, high = bounds(nodes, queries, norms)
        seen[nodes[((high >= 0.3 * own) & (low <= 0.9 * own))[0]]] = True
        return low, high

    tree.bounds = counted
    tree.search(np.arange(8000), np.zeros(8000, int), query, np.ones(1), np.full(1, -1), 0.3 * own, 0.9 * own, 10, False)
    leaves = tree.nodes[:, 6] > tree.nodes[:, 5]
    assert (seen & leaves).sum() < 0.5 * leaves.sum()


def test_hard_negatives_of_nothing(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS), 20).count() == 0


ROWS = "doc_id long, text string, source string, lang string, n_chars long, tree string, `n part` string"


def odd_rows():
    rows = [(i, f"text {i}\nand more", f"s{i % 3}" if i % 3 else None, "en", i, "t", "p") for i in range(100)]
    rows += [(None, "no id", "s1", None, None, "t", "p"), (None, "no id", "s1", None, None, "t", "p"), (7, None, None, "de", 3, "t", "p")]
    rows += [(7, "", None, "de", 3, "t", "p"), (500, "é" * 9000 + "\n", "ünï", "x", 0, "t", "p"), (501, "lone", "", None, 1, "t", "p")]
    rows += [(600, "copy", "s2", "en", 4, "t", "p")] * 40
    return rows


def brute_manifest(rows, fan=3):
    digest = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i - i % fan : i - i % fan + fan]
            out.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            i //= fan
        return out

    groups = {}
    for doc, text, source, lang, n, *_ in rows:
        leaf = digest(*[spell(v) for v in (doc, source, lang, n, text)])
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            out.append((x[3], x[2], trees[s][-1][0], top[-1][0], path(trees[s], i) + path(top, k)))
    return out


@pytest.mark.parametrize("levels, part", [(1, 4), (2, 20), (6, 4096)])
def test_manifest(spark, levels, part):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    extra = {"leaf2": F.upper("source")}
    found = manifest.manifest(df, levels=levels, part=part, carry=extra)
    assert found.columns == ["doc_id", "leaf2", "leaf", "subroot", "root", "proof"]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(x.left.hex(), x.right.hex()) for x in r.proof]) for r in found.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], str(x[4]))
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert found.where(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.where(manifest.folded(F.sha2(F.lit("x"), 256), F.col("proof")) == F.col("root")).count() == 0


def test_partitions_ask_for_each_missing_node_once():
    for n in (1, 2, 9, 28, 100):
        for known in ({0}, {0, 1, 2}, set(range(n)), {0, n - 1}, set(range(n // 2, n))):
            known = {x for x in known if x < n}
            asked = list(manifest.missing(known, n, 3))
            assert len(asked) == len(set(asked))
            whole = [[str(j).encode().rjust(32) for j in range(n)]]
            while len(whole[-1]) > 1:
                step = [b"".join(x.hex().encode() for x in whole[-1][i : i + 3]) for i in range(0, len(whole[-1]), 3)]
                whole.append([hashlib.sha256(x).digest() for x in step])
            fetched = {(level, j): whole[level][j] for level, j in asked}
            assert manifest.climb({j: whole[0][j] for j in known}, n, 3, fetched)[0] == whole[-1][0]


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame(odd_rows(), ROWS)
    assert manifest.manifest(df.where("false")).count() == 0
    (one,) = manifest.manifest(df.where("doc_id = 501")).collect()
    assert one.leaf == one.subroot == one.root and one.proof == []


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall((text or "").translate(UPPER))


def brute_base(text):
    words = words_of(text)
    found = {}
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        if at:
            found[label] = at
    return len(words), found


def brute_spans(text, k=licenses.GRAM):
    """Spans by plain loops: template runs in the text, close diagonals together, the best of what overlaps."""
    words = words_of(text)
    spans = []
    listed = [(label, x) for label, texts in licenses.TEMPLATES.items() for x in texts]
    for number, (label, template) in enumerate(listed):
        known = words_of(template)
        lines = {}
        for p in range(len(known) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == known[p : p + k]:
                    lines.setdefault(i - p, set()).add(p)
        groups = []
        for d in sorted(lines):
            if not groups or d - groups[-1][-1] > licenses.SLACK:
                groups.append([])
            groups[-1].append(d)
        for group in groups:
            at = set().union(*[lines[d] for d in group])
            places = {p + d for d in group for p in lines[d]}
            inside = lambda x: len({y + i for y in x for i in range(k)})
            first, end = min(places), max(places) + k
            share, dense = inside(at) / len(known), inside(places) / (end - first)
            sure = share >= licenses.SHARE and dense >= licenses.SHARE
            spans.append((first, end, number, label, share, sure, len(at) / (len(known) - k + 1), len(at)))
    best, reach = [], None
    for s in sorted(spans):
        if reach is None or s[0] >= reach:
            best.append([])
        best[-1].append(s)
        reach = max(reach or 0, s[1])
    chosen = [min(x, key=lambda s: (not s[5], -s[6], -s[7], s[2])) for x in best]
    return sorted((s[0], s[1], s[3], s[4], s[5]) for s in chosen)


def license_texts():
    mit, apache = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["apache"][0]
    filler = " ".join(f"filler{i}" for i in range(5000))
    changed = mit.replace("free of charge", "without any charge").replace("modify, merge", "modify, adapt, merge")
    return [
        None, "", "\n .", "mit", "MIT License", "cc by", "CC-BY-NC 4.0 or CC BY", mit, filler + " " + mit + "\n" + filler, changed,
        mit[:200], mit + apache, apache.upper() + " " + apache, licenses.TEMPLATES["lgpl"][0], licenses.TEMPLATES["gpl"][0] * 30,
        "gnu general public license gnu general public license", "the mit-license\u00e9 mit licenses m\u0130t l\u212aicense \u212a",
        "licensed under the apache license, version 2.0.", "this work is licensed under something of no name at all",
        "permission is hereby granted " * 400, " ".join(reversed(mit.split())), "x" * 100000, "a " * 30000 + "apache license",
    ]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, x, "h", "r") for i, x in enumerate(license_texts())]
    rows += [(None, "mit license", "h", "r"), (None, "no words of note", "h", "r"), (7, "apache license", "h", "r")]
    rows += [(1, "", "h", "r"), (8, rows[8][1], "h", "r")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, hash string, run string"))
    return rows, found.collect()


def test_licenses_against_brute_force(scanned):
    rows, found = scanned
    told = lambda i, n, base, spans: (str(i), n, sorted(base.items()), spans)
    got = [told(r.doc_id, r.n_words, {b.label: b.words for b in r.base}, [tuple(s) for s in r.spans]) for r in found]
    want = [told(i, *brute_base(text), brute_spans(text)) for i, text, *_ in rows]
    assert sorted(got) == sorted(want)
    for r in found:
        assert r.score == (1.0 if r.base else max([s.share for s in r.spans], default=0.0))


def test_licenses_are_found_changed_and_in_long_texts(scanned):
    rows, found = scanned
    labels = {r.doc_id: {s.label for s in r.spans if s.sure} for r in found if r.doc_id not in (None, 7)}
    assert labels[8] == labels[9] == {"mit"} and labels[11] == {"mit", "apache"} and labels[12] == {"apache"}
    assert labels[13] == {"lgpl"} and labels[14] == {"gpl"} and labels[17] == {"apache"}
    assert not any(labels[i] for i in (1, 2, 3, 10, 18, 20, 21))


def test_licenses_of_nothing(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
