import random
import re

import numpy as np
import pytest

from verdigris.llm.components import components
from verdigris.llm.near_join import DEPTH, TARGET, TREES, chosen_depths, deduplicate, least_agreement, near_groups, near_join, prefix_depth, tree_keys
from verdigris.llm.shingles import shingle_set, word_hashes


def shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((d, least[find(i)] if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(groups=60, seed=1):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdefé") for _ in range(6)) for _ in range(3000)]
    rows, k = [], 0
    for g in range(groups):
        base = [random.choice(vocabulary) for _ in range(random.choice([3, 30, 120, 400]))]
        for _ in range(random.choice([1, 1, 2, 5]) if g else 80):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 2, len(base) // 40])):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((k, random.choice([" ", "  ", "\n"]).join(words)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, "!?"), (None, rows[5][1]), (3, rows[3][1]), (k + 3, "one two"), (k + 4, "One, two!")]


def test_parameters():
    assert prefix_depth() == 3 and 1 - (1 - 0.8**3) ** 12 >= 0.999
    assert 30 < least_agreement(60) < 40


def test_low_thresholds_are_refused():
    assert prefix_depth(0.9) == DEPTH and prefix_depth(0.5) == 1
    with pytest.raises(ValueError, match="recall"):
        prefix_depth(0.3)


def test_depths_reach_the_target_and_leave_crowded_nodes_alone():
    least, rng = prefix_depth(), np.random.default_rng(4)
    counts = -np.sort(-rng.integers(1, 50, (200, TREES, DEPTH - least + 1)), axis=2)
    counts[0, :3, :] = (900_000, 20_000, 10_000)  # crowded trees
    counts[0, 3:, :] = 1
    depths = chosen_depths(counts)
    recall = 1 - np.prod(1 - 0.8**depths.astype(float), axis=1)
    assert (recall >= TARGET).all() and (depths >= least).all() and (depths <= DEPTH).all()
    assert (depths[0, :3] > least).any() and (depths > least).any(axis=1).all()
    # from either side alone: the chance that a pair at the threshold is met, over drawn signatures
    met = (rng.random((20_000, TREES, DEPTH)) < 0.8).cumprod(axis=2).sum(axis=2) >= depths[0]
    assert met.any(axis=1).mean() >= TARGET - 0.001


def test_tree_keys_take_every_level():
    signatures = np.zeros((2, TREES * DEPTH), np.uint16)
    signatures[1, DEPTH - 1] = 1
    same = [(tree_keys(signatures, d)[0] == tree_keys(signatures, d)[1]).all() for d in range(1, DEPTH + 1)]
    assert same == [True] * (DEPTH - 1) + [False]


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0
    text = "ab é" * 700000
    parts = word_hashes(text)
    assert len(parts) == len(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode())) and len(np.unique(parts)) <= 3
    assert word_hashes("Ab cd")[0] == word_hashes("xx, ab")[1]


@pytest.mark.parametrize(("block", "shingles", "threshold"), [(1000, 10**6, 0.8), (12, 900, 0.8), (1000, 10**6, 0.9)])
def test_links_and_classes(spark, block, shingles, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_groups(df, threshold=threshold, block=block, block_shingles=shingles)[1].collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows, threshold)
    lead = [r.class_id for r in got if r.kept and r.class_id is not None]
    assert len(lead) == len(set(lead)) == len({r.class_id for r in got if r.class_id is not None})


def test_deduplicate(spark):
    rows = corpus(12)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, rid int")
    out = deduplicate(df)
    assert out.columns == df.columns
    assert len(out.collect()) == len({c for d, c, _ in brute(rows) if c is not None})
    assert near_join(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 70 + i) for i in range(20)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{70 + i: 70 for i in range(20)}, 100: 70, 200: 200, 201: 200}
