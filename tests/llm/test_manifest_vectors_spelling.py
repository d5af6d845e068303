"""Merkle manifest, embedding near-duplicates and spelling variants against brute force, and their defined results on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from varuvakt.llm import merkle, multi_index, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """All levels, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        start = at - at % 16
        yield nodes[start:at], nodes[at + 1 : start + 16]
        at //= 16


def expected(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = [*way(trees[s], at), *way(over, k)]
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf(*row[:4], row[4] and row[4].translate(LOWER)) if altered else own
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in path for x in (*before, *after)])
            out.append((row[0], own, trees[s][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return sorted(out, key=repr)


def test_merkle_equals_brute_force(spark):
    rng = random.Random(5)
    some = lambda k: (k, f"s{k % 3}" if k % 7 else None, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Åäö Text", f"Text {k}", "no capitals"]))
    rows = [some(k) for k in range(-20, 330)] + [(1000 + k, "hot", "en", 1, f"Hot {k}") for k in range(300)]
    rows += [(9_000_000_000, "one", "en", 1, "A" * 200_000), (None, "s1", None, None, None), (None, "s1", None, None, "X")] + [(7, "s1", "en", 2, "twice")] * 3 + [(k, f"Å{k}", "sv", 3, "y") for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, node string")
    got = merkle.digests(df.repartition(5))
    want = expected(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 5
    assert sorted(map(tuple, merkle.digests(df.limit(1).select("doc_id", "source", "lang", "n_chars", "text")).collect()), key=repr) == expected([r[:5] for r in df.limit(1).collect()])
    assert merkle.digests(df.limit(0)).count() == 0
    # A wrong text, wrongly placed proof or foreign root never verifies.
    audited = merkle.audit(df.where("source = 'hot'"))
    swapped = audited.select("doc_id", "leaf", "root").join(audited.selectExpr("doc_id - 1 AS doc_id", "path"), "doc_id")
    assert swapped.count() == 299
    assert swapped.where(merkle.folded(swapped["leaf"], swapped["path"]) == swapped["root"]).count() == 0


def test_merkle_keeps_every_second_level_only(spark):
    rows = [(k, "a", "en", 1, str(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    levels, subroots, root = merkle.manifest(df)
    whole = tree([leaf(*r) for r in rows])
    assert [sorted(r["node"] for r in level.collect()) for level in levels] == [sorted(whole[0]), sorted(whole[2]), whole[3]]
    assert root == whole[3][0] == subroots.first()["subroot"]


def cosine_links(vectors):
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def planted(rng, n, dims):
    base = rng.normal(size=(n, dims))
    near = []
    for k in range(n // 2):
        aside = rng.normal(size=dims)
        unit = base[k] / np.linalg.norm(base[k])
        aside -= aside @ unit * unit
        cosine = rng.uniform(0.951, 0.99)
        near.append(3 * (cosine * unit + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)))
    group = base[0] + 0.02 * rng.normal(size=(150, dims))
    return np.vstack([base, near, group])


@pytest.mark.parametrize("tile", [4096, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(multi_index, "TILE", tile)
    vectors = planted(np.random.default_rng(tile), 600, 24)
    ids = random.Random(3).sample(range(10_000), len(vectors))
    near = cosine_links(vectors)
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, kept string").repartition(4)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(df).collect()}
    found, there = sum(got[i]["n_links"] for i in ids), int(near.sum())
    assert 0.96 * there <= found <= there
    for k, i in enumerate(ids):
        assert got[i]["n_links"] <= near[k].sum()
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    # The components of the dense group and of vectors without links are whole.
    assert len({got[ids[0]]["component_id"], *(got[i]["component_id"] for i in ids[-150:])}) == 1
    alone = [i for k, i in enumerate(ids) if not near[k].any()]
    assert alone and all(got[i]["component_id"] == i for i in alone)


def test_vectors_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2e-200, 0.0, 0.0]), (4, [0.0, 1e300, 1e299]), (5, [0.0, 1e300, 0.0]), (6, None), (7, []), (8, [0.0] * 3),
        (9, [1.0, None, 0.0]), (10, [nan, 1.0, 1.0]), (11, [inf, 1.0, 1.0]), (12, [1.0, 0.0]), (12, [0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (13, [1.0]), (14, [4.0]), (15, [-4.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df).collect())
    want = [(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (5, 1, 4), *[(k, 0, k) for k in range(6, 12)], (12, 0, 12), (12, 0, 12), (13, 1, 13), (14, 1, 13), (15, 0, 15)]
    assert got == want
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_traversal_visits_cells_in_order(spark):
    rng = np.random.default_rng(1)
    grid = multi_index.Grid(multi_index.unit(rng.normal(size=(400, 6))), 12, 0.95, 0.98)
    for v in multi_index.unit(rng.normal(size=(50, 6))):
        a, b = (d[0] for d in grid.distances(v[None]))
        sums = (a[:, None] + b[None, :]).ravel()
        cells = grid.traverse(a, b)
        assert cells == sorted(cells, key=lambda c: (sums[c], cells.index(c))) and set(cells) == set(np.flatnonzero(sums <= sums.min() + grid.slack))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def grouped(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def table_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_spelling_equals_brute_force(spark):
    rng = random.Random(6)
    letters = "aabcdÉéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"]

    def mutated(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])

    long = "".join(rng.choice(letters) for _ in range(3000))
    edge = ["x" * 31, "x" * 32, "x" * 33, "x" * 34, "y" + "x" * 31, "y" + "x" * 32, long, long[:-1], long[:1500] + "q" + long[1500:], "z" + long[1:], long[:700] + "qq" + long[700:]]
    rows = [(k, " ".join(mutated(w) for w in rng.choices(base, k=40)) + rng.choice([".", "1X", "", "\U0001f600Tail"])) for k in range(150)]
    rows += [(1000 + k, "-".join(edge).upper() if k % 2 else "-".join(edge)) for k in range(5)] + [(None, "aaaaa Aaaaa aaaaaa"), (3, None), (4, ""), (5, " 12 ")] + [(77, "aaaaa bbbbb bbbbb bbbbb")] * 3
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    n = counted(rows)
    assert sum(len(w) > spelling.DEEPEST for w in n) >= 6
    assert table_of(spelling.variants(df)) == grouped(n)
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.where("doc_id IN (3, 4, 5) AND coalesce(text, '') NOT LIKE '%a%'")).count() == 0


def test_spelling_follows_forms_to_the_last(spark):
    chain = [("a" * (5 + k), 2**k * 3) for k in range(12)] + [("bbbbbb", 9), ("bbbbbc", 4), ("bbbbbd", 9)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain[:11], chain[1:12])], "word string, form string")
    assert {tuple(r) for r in spelling.followed(forms).collect()} == {(w, chain[11][0]) for w, _ in chain[:11]}
    df = spark.createDataFrame([(10_000 + k, w) for k, (w, n) in enumerate(chain[:6]) for _ in range(n)], "doc_id long, text string")
    assert table_of(spelling.variants(df)) == grouped(counted([tuple(r) for r in df.collect()]))
