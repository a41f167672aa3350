"""Near copies in families of more than a small group, against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np

from matchflow.llm import near_dedup


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def plain_classes(texts):
    sets, df = [], np.zeros(1 << near_dedup.DF_BITS, np.int64)
    for t in texts:
        a, c, _ = near_dedup.shingle_sets([t])
        sets.append((a, c))
        df[np.unique(near_dedup._bucket(a))] += 1
    idf = near_dedup.idf_of(df, len(texts)).astype(float)
    weighted = [(a, c * idf[near_dedup._bucket(a)]) for a, c in sets]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, (a, wa)), (j, (b, wb)) in itertools.combinations(enumerate(weighted), 2):
        if near_dedup.weighted_jaccard(a, wa, b, wb) >= near_dedup.SIMILARITY:
            i, j = sorted((root(i), root(j)))
            label[j] = i
    return {i: root(i) for i in range(len(texts))}


def found_classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}


def test_excerpts_with_own_footers(spark):
    """Excerpts of a hub, each with an own footer, are alike only through shingles of the hub."""
    rnd = random.Random(6)
    base = words(rnd, 184)
    docs = [base[:180] + words(rnd, 4) for _ in range(150)]
    docs += [base[:104] + words(rnd, rnd.randint(7, 10)) for _ in range(80)]
    texts = [" ".join(d) for d in docs]
    want = plain_classes(texts)
    assert len(set(want.values())) == 2
    assert found_classes(spark, texts) == want


def test_samples_agree_as_often_as_texts_are_alike():
    """Texts of far more shingles than the table has slots: nearly no agreement of unrelated texts, 0.8 of texts alike."""
    rng = np.random.default_rng(7)
    sampler = near_dedup.Sampler()
    for n in (200, 50_000, 200_000):
        common, own = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, (3, n // 8), dtype=np.uint64)
        other = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.concatenate([common, own[0]]), np.concatenate([common, own[1]]), np.concatenate([other, own[2]])]
        a, b, c = (sampler.samples(np.sort(x), np.full(len(x), 0.3, np.float32), np.array([len(x)]))[0] for x in sets)
        assert (a == c).sum() <= 1 and (near_dedup.band_keys(a[None]) == near_dedup.band_keys(c[None])).sum() == 0
        assert 36 <= (a == b).sum() <= 58


def test_links_across_half_of_the_hub(spark):
    """Excerpts of a little less and a little more than half of the hub are one class."""
    rnd = random.Random(8)
    base = words(rnd, 184)
    docs = [base[:180] + words(rnd, 4) for _ in range(150)]
    docs += [base[:m] + words(rnd, 4) for m in (95, 103) for _ in range(50)]
    texts = [" ".join(d) for d in docs]
    want = plain_classes(texts)
    assert len(set(want.values())) == 2
    assert found_classes(spark, texts) == want


def test_heads_of_texts_alike_meet():
    """Whatever the hub: two texts of similarity 0.8 have a common shingle in their heads, in a group that is not left out."""
    rng = np.random.default_rng(9)
    idf = near_dedup.idf_of(rng.integers(1, 1000, 1 << near_dedup.DF_BITS), 1000)
    alike = 0
    for _ in range(4000):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        pool, kept, counts = np.sort(pool), rng.random(60), rng.integers(1, 3, 60)
        sets = []
        for low in (rng.random() * 0.25, rng.random() * 0.25, rng.random()):
            own = (kept > low) & (rng.random(60) > rng.random() * 0.15)
            more = rng.random(own.sum()) < 0.03
            sets.append((pool[own], idf[near_dedup._bucket(pool[own])].astype(float) * (counts[own] + more)))
        (a, wa), (b, wb), (hub, _) = sets
        if near_dedup.weighted_jaccard(a, wa, b, wb) < near_dedup.SIMILARITY:
            continue
        alike += 1
        (ha, own_a, few_a), (hb, own_b, few_b) = (near_dedup.head(x, w, hub, idf) for x, w in sets[:2])
        assert set(ha[:own_a].tolist()) & set(hb[:own_b].tolist()) or set(ha.tolist()) & set(hb.tolist()) and (few_a or few_b)
    assert alike > 100


def test_listed_of_texts_alike_meet():
    """Whatever the hub: two texts of similarity 0.8, not both linked to it, have in common a listed shingle it lacks, a change, or a rest of the head."""
    rng = np.random.default_rng(10)
    idf = near_dedup.idf_of(rng.integers(1, 1000, 1 << near_dedup.DF_BITS), 1000)
    met = {"own": 0, "change": 0, "rest": 0}
    for _ in range(20000):
        pool, counts = np.sort(rng.integers(0, 1 << 62, 60, dtype=np.uint64)), rng.integers(1, 3, 60)
        core = rng.random(60) > rng.random() * 0.3
        part = core & (rng.random(60) > rng.random() * rng.choice([0.2, 0.8]))
        sets = []
        for low in (part, part, core):
            own = (low ^ (rng.random(60) < rng.random() * 0.12)) | (np.arange(60) == 7)
            sets.append((pool[own], idf[near_dedup._bucket(pool[own])].astype(float) * (counts[own] + (rng.random(own.sum()) < 0.03))))
        (a, wa), (b, wb), (hub, wh) = sets
        sims = [near_dedup.weighted_jaccard(x, w, hub, wh) for x, w in sets[:2]]
        if near_dedup.weighted_jaccard(a, wa, b, wb) < near_dedup.SIMILARITY or min(sims) >= near_dedup.SIMILARITY:
            continue
        kinds = []
        for (x, w), sim in zip(sets, sims):
            more, own, changed, front, few = near_dedup._listed(x, w, hub, wh, idf, sim)
            near = sim >= near_dedup.SIMILARITY
            kinds.append({"own": set(more[:own].tolist()), "change": set(more[own:own + changed].tolist()), "front": set(more[own:own + front].tolist()),
                          "rest": set(more[own + changed:].tolist()), "few": few, "near": near})
        x, y = kinds
        changes = x["change"] & y["change"] if x["near"] or y["near"] else x["front"] & y["front"]
        few = x["few"] or y["few"]
        found = {"own": x["own"] & y["own"], "change": few and changes, "rest": few and x["rest"] & y["rest"]}
        assert any(found.values())
        for kind, common in found.items():
            met[kind] += bool(common) and not found["own"]
    assert met["change"] > 50 and met["rest"] > 5


def test_pairs_of_one_part_are_not_made(spark):
    """Pairs of texts that are known to be of one class are not listed, in groups of any mixture."""
    rows = [("k", True, a, 0 if a < 9 else a) for a in range(10)] + [("l", True, a, 0) for a in range(9)] + [("m", False, a, a) for a in range(9)]
    near = spark.createDataFrame(rows, "key string, whole boolean, a long, part long")
    assert sorted(map(tuple, near_dedup._among(near).collect())) == [(a, 9) for a in range(9)]


def test_groups_that_can_hold_no_link_are_left_out(spark):
    """Groups of one part, of linked texts, of changes without a text of which the hub lacks little, or in which only one text has the change in front."""
    rows = [(a, a, False, [1, 2, 3, 4, 5], 1, 3, 2 if a else 1, a == 0) for a in range(3)]  # 1: own, 2: front of all, 3: front of two, 4: of none, 5: rest
    rows += [(a, 9, False, [11, 12], 1, 1, 1, True) for a in (3, 4)] + [(a, a, True, [21], 0, 1, 0, True) for a in (5, 6)]
    rows += [(a, a, False, [31, 32], 1, 1, 1, False) for a in (7, 8)]
    rest = spark.createDataFrame([(100, *r) for r in rows], "hub long, a long, part long, linked boolean, more array<long>, own int, changed int, front int, few boolean")
    found = {}
    for r in near_dedup._regrouped(rest).collect():
        found.setdefault(r["key"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == [[0, 1, 2], [0, 1, 2], [0, 1, 2], [1, 2], [7, 8]]


def excerpts(seed):
    rnd = random.Random(seed)
    base = words(rnd, 184)
    docs = [base[:180] + words(rnd, 4) for _ in range(60)]
    docs += [base[:m] + words(rnd, 4) for m in (95, 103) for _ in range(25)]
    docs += [base[:104] + words(rnd, rnd.randint(7, 10)) for _ in range(30)]
    return [" ".join(d) for d in docs]


def test_a_family_is_compared_without_regrouping(spark, monkeypatch):
    """Copies without their original: no lists of shingles are grouped, and no pair of a large group is a row."""
    rnd = random.Random(12)
    base = words(rnd, 120)
    docs = []
    for _ in range(80):
        docs.append(list(base))
        for at in rnd.sample(range(120), 2):
            docs[-1][at] = words(rnd, 1)[0]
    texts = [" ".join(d) for d in docs] + excerpts(13)
    pairs = []

    def counted(near):
        out = among(near)
        pairs.append(out.count())
        return out

    among = near_dedup._among
    monkeypatch.setattr(near_dedup, "_among", counted)
    monkeypatch.setattr(near_dedup, "_regrouped", None)
    assert found_classes(spark, texts) == plain_classes(texts)
    assert max(pairs) < 10 * len(texts)


def test_blocks_and_regrouping_find_the_same(spark, monkeypatch):
    """A family of many blocks, and one of more blocks than are compared, against all pairs."""
    texts = excerpts(14)
    want = plain_classes(texts)
    assert 1 < len(set(want.values())) < 10
    monkeypatch.setattr(near_dedup, "BLOCK", 3000)
    assert found_classes(spark, texts) == want
    monkeypatch.setattr(near_dedup, "MOST_BLOCKS", 0)
    assert found_classes(spark, texts) == want


def test_joining_links_join_as_all_links():
    """Few links, of texts alike, with the classes of all pairs; between two blocks, those of the pairs of different blocks and of the hub."""
    rng = np.random.default_rng(15)
    idf = near_dedup.idf_of(rng.integers(1, 1000, 1 << near_dedup.DF_BITS), 1000)
    sampler, several = near_dedup.Sampler(), 0
    for _ in range(40):
        pool, counts = np.sort(rng.integers(0, 1 << 62, 80, dtype=np.uint64)), rng.integers(1, 3, 80)
        cores = [rng.random(80) > rng.random() * 0.5 for _ in range(3)]
        kept = [cores[rng.integers(3)] ^ (rng.random(80) < rng.random() * 0.12) for _ in range(25)]
        sets = [pool[k | (np.arange(80) == 3)] for k in kept]
        weights = [idf[near_dedup._bucket(a)].astype(float) * counts[np.searchsorted(pool, a)] for a in sets]
        marks = near_dedup.signs(np.concatenate([sampler.samples(a, np.log(w).astype(np.float32), np.array([len(a)])) for a, w in zip(sets, weights)]))
        blocks = rng.integers(0, 2, len(sets))
        for block in (None, blocks):
            classes, fewest = ({i: {i} for i in range(len(sets))} for _ in range(2))
            links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if block is None or 7 in (i, j) or block[i] != block[j]]
            links = [(i, j) for i, j in links if near_dedup.weighted_jaccard(sets[i], weights[i], sets[j], weights[j]) >= near_dedup.SIMILARITY]
            found = near_dedup.joining_links(sets, weights, marks, 7, block)
            assert {tuple(sorted(p)) for p in found} <= set(links) and len(found) < len(sets)
            for into, some in ((classes, links), (fewest, found)):
                for i, j in some:
                    both = into[i] | into[j]
                    into.update(dict.fromkeys(both, both))
            assert classes == fewest
            several += 1 < len({min(c) for c in classes.values()}) < len(sets)
    assert several > 20
