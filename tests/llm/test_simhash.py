from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import simhash

from . import brute
from .corpora import clashing, docs, random_texts

ODD = [None, "", "  \n", "One", "one", "one two", "ÉCOLE été", "a b c", "A  B\tC", "w " * 70000, "x\x00y z \x85 q"]


def test_fingerprints_are_brute_force(spark):
    texts = ODD + random_texts(3, 60)
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: brute.fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [8, simhash.MOST])
def test_links_are_all_pairs(spark, most):
    """Fingerprints around few centres, so keys are crowded and chains occur. A key's star may name the least
    fingerprint that another reaches in steps, so classes are compared, not single links."""
    r = random.Random(11)
    fps = {0}
    for _ in range(12):
        centre = r.getrandbits(64)
        fps.add(centre)
        for _ in range(40):
            x = centre
            for _ in range(r.randint(1, 7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps |= {0xFFFFFFFF << 32 | r.getrandbits(8) for _ in range(80)}  # one half in common
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [(x["u"] & (1 << 64) - 1, x["v"] & (1 << 64) - 1) for x in simhash.links(df, most=most).collect()]
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in found:
        a, b = find(place[u]), find(place[v])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute.linked(fps)


def test_digest(spark):
    base = [f"w{i}" for i in range(300)]
    near = list(base)
    near[7] = "changed"
    texts = ODD + [" ".join(base), " ".join(base), " ".join(near), "quite another text of some words"] + random_texts(4, 40)
    rows = {r["doc_id"]: r for r in simhash.digest(docs(spark, texts)).collect()}
    fps = [brute.fingerprint(t) for t in texts]
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{x:016x}" for i, x in enumerate(fps)}
    assert [rows[i]["component_id"] for i in range(len(texts))] == brute.linked(fps)


def test_one_of_each_group_stays(spark):
    rows = [(5, "the same text here"), (3, "The same  text here"), (3, "The same  text here"), (None, None), (None, ""), (9, "other words stand in this one"), (None, "words without a number stand here")]
    df = clashing(docs(spark, rows))
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == 4
    assert (3, "The same  text here") in kept and (9, "other words stand in this one") in kept and (None, "words without a number stand here") in kept


def _shingles(t):
    ws = brute.words(brute.lower(t))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _near_classes(texts, met=lambda i, j: True):
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or sets[i] and met(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_near_copies_of_five_words_and_eight_tenths_go(spark):
    """Fingerprints of these lie more than three bits apart; two texts of 0.72 are a candidate that isn't verified."""
    base = [f"w{i}" for i in range(304)]
    changed = lambda places: " ".join("other" if i in places else w for i, w in enumerate(base))
    near, far = changed({50, 150, 250}), changed({10, 40, 70, 100, 130, 160, 190, 220, 250})
    texts = [" ".join(base), near, far, "quite another text of some words"]
    assert _near_classes(texts) == [0, 0, 2, 3]
    assert (brute.fingerprint(texts[0]) ^ brute.fingerprint(near)).bit_count() > 3
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs(spark, texts)).collect()) == [0, 2, 3]


@pytest.mark.parametrize("ahead", [2, simhash.AHEAD])
def test_near_copies_are_brute_force(spark, ahead):
    """Many near copies of few texts, at many distances, so keys are crowded; all pairs whose fingerprints are near count."""
    r = random.Random(8)
    texts = [None, "", " \n", "one", "One ", "one two"]
    for c in range(4):
        base = [f"c{c}w{i}" for i in range(400)]
        for _ in range(25):
            gone = set(r.sample(range(400), r.choice([1, 3, 5, 8, 12, 20])))
            texts.append(" ".join("x" if i in gone else w for i, w in enumerate(base)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "hash": list(range(len(texts))), "text": texts})
    fps = [(x["f"] & (1 << 64) - 1) << 64 | x["g"] & (1 << 64) - 1 for b in simhash._sets(iter([batch])) for x in b.to_pylist()]
    want = _near_classes(texts, lambda i, j: (fps[i] ^ fps[j]).bit_count() < 2 * simhash.SEGMENTS)
    got = {x["doc_id"]: x["root"] for x in simhash.near_copies(docs(spark, texts), ahead=ahead).collect()}
    first = {}
    assert [first.setdefault(got[i], i) for i in range(len(texts))] == want


def _crowd(seed, groups=4, size=60):
    """Near copies of a few texts: doc_ids and texts."""
    r = random.Random(seed)
    texts = []
    for c in range(groups):
        base = [f"c{c}w{i}" for i in range(400)]
        for _ in range(size):
            gone = set(r.sample(range(400), r.choice([1, 2, 3, 5, 8])))
            texts.append(" ".join("x" if i in gone else w for i, w in enumerate(base)))
    return texts


def test_a_pair_that_meets_in_many_keys_comes_once():
    import numpy as np

    texts = _crowd(5, 1, 120)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "hash": list(range(len(texts))), "text": texts})
    sets = pa.Table.from_batches(simhash._sets(iter([batch]))).rename_columns(["doc_id", "node", "set", "n", "f", "g"]).combine_chunks()
    keyed = pa.Table.from_batches(simhash._segment_keys(simhash.SEGMENTS)(iter(sets.to_batches())))
    keyed = keyed.take(np.lexsort((keyed["node"].to_numpy(), keyed["at"].to_numpy())))
    for ahead in (2, simhash.AHEAD):
        met = pa.Table.from_batches(simhash._ahead(2 * simhash.SEGMENTS - 1, ahead, simhash.SEGMENTS, simhash.LOOKED)(iter(keyed.to_batches()))).to_pylist()
        pairs, again = ([(x["a"], x["b"], x["at"]) for x in met if x["hot"] == hot] for hot in (False, True))
        assert pairs and len(pairs) == len(set(pairs)) and len(again) == len(set(again))


@pytest.mark.parametrize("ahead, looked", [(1, 1), (2, 5), (1000, 3), (1000, 1000)])
def test_classes_do_not_depend_on_when_pairs_are_compared(spark, ahead, looked):
    texts = _crowd(9, 3, 25)
    root = {x["doc_id"]: x["root"] for x in simhash.near_copies(docs(spark, texts), ahead=ahead, looked=looked).collect()}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "hash": list(range(len(texts))), "text": texts})
    fps = [(x["f"] & (1 << 64) - 1) << 64 | x["g"] & (1 << 64) - 1 for b in simhash._sets(iter([batch])) for x in b.to_pylist()]
    first = {}
    assert [first.setdefault(root[i], i) for i in range(len(texts))] == _near_classes(texts, lambda i, j: (fps[i] ^ fps[j]).bit_count() < 2 * simhash.SEGMENTS)


def test_empty_table(spark):
    df = docs(spark, ["x"]).filter(F.lit(False))
    assert simhash.digest(df).collect() == []
    assert simhash.near_dedup(df).collect() == []


def test_components_of_long_chains_and_stars(spark):
    from spanloom.llm.components import components

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (-5, -9)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400)) and got[-5] == got[-9] == -9


def test_query_over_whole_table(spark, sf):
    from spanloom.llm.queries import op6_simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute.fingerprint(texts[i]) for i in ids]
    roots = brute.linked(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[k]:016x}", ids[roots[k]]) for k, i in enumerate(ids)}


def test_a_pair_has_one_first_shared_key():
    import numpy as np

    from spanloom.llm.simhash import SEGMENTS, _first_shared

    edges = [int(x) for x in np.linspace(0, 128, SEGMENTS + 1)]
    rng = np.random.default_rng(5)
    for count in (0, 1, 5, 14, 20, 23):
        for _ in range(50):
            apart = {int(x) for x in rng.choice(128, count, replace=False)}
            shared = [k for lo, hi in zip(edges[:-1], edges[1:], strict=True) for k in range(lo, hi) if not (apart & set(range(lo, hi))) - {k}]
            bits = sum(1 << x for x in apart)
            f, g = (np.array([x], np.uint64) for x in (bits & (1 << 64) - 1, bits >> 64))
            assert [k for k in shared if _first_shared(k, f, g, SEGMENTS)[0]] == shared[:1]
