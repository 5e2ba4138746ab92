"""The tree of merges against labelling each threshold anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import chunks, runs, tree

from .test_chunks import K, as_chunks


def labels(mask, eight):
    """Components as sets of pixels."""
    left, out = set(map(tuple, np.argwhere(mask))), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if q in left and (eight or abs(dy) + abs(dx) == 1):
                        left.remove(q)
                        own.add(q)
                        todo.append(q)
        out.append(own)
    return out


@pytest.mark.parametrize("size,eight,seed,least", [(64, True, 1, 1), (8, True, 2, 1), (5, False, 3, 2), (3, True, 4, 1), (1, True, 5, 1)])
def test_curves_match_labelling_each_threshold(spark, size, eight, seed, least):
    rng = np.random.default_rng(seed)
    smooth = lambda a: sum(np.roll(np.roll(a, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
    scenes = []
    for h, w in ((17, 22), (9, 9), (1, 1)):
        a = np.round(smooth(rng.normal(size=(h, w))), 1)
        a[rng.random((h, w)) < 0.03] = np.nan
        scenes.append((a, rng.random((h, w)) >= 0.03))
    grid = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 50.0]
    c = as_chunks(spark, scenes, size)
    target = runs.components(chunks.band_runs(c, K, "v", 0.7), K, 22, 8 if eight else 4)
    got = {(r.scene_id, r.threshold): (r.objects, r.hits) for r in tree.component_curves(c, K, "v", grid, target, 0.5, least, 8 if eight else 4, size).collect()}
    for i, (a, there) in enumerate(scenes):
        true = labels(there & (np.nan_to_num(a, nan=-99) >= 0.7), eight)
        for t in grid:
            pred = [p for p in labels(there & (np.nan_to_num(a, nan=-99) >= t), eight) if len(p) >= least]
            hits = sum(len(p & q) / len(p | q) >= 0.5 for p in pred for q in true)
            assert got.get((i, t), (0, 0)) == (len(pred), hits), (i, t)


def test_tree_of_links():
    level = np.array([3, 2, 3, 1, 5])
    node, parent, of = tree.merge_tree(level, np.array([0, 1, 3]), np.array([1, 2, 0]))
    assert of[node].tolist() == level.tolist() and node[0] != node[2] and parent[node[0]] == parent[node[2]] == node[1]
    assert parent[node[1]] == node[3] and parent[node[3]] == parent[node[4]] == -1


def test_empty(spark):
    c = as_chunks(spark, [(np.zeros((2, 2)), np.ones((2, 2), bool))], 2)
    assert tree.component_curves(c.where(F.lit(False)), K, "v", [0.5]).count() == 0
    assert [(r.objects, r.hits) for r in tree.component_curves(c, K, "v", [0.5]).collect()] == [(0, 0)]
