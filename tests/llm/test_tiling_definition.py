"""Greedy string tiling against its definition, on random texts."""

import random

import numpy as np

from riskrules.llm import tiling

DOCS = "doc_id long, text string"


def tiles_by_definition(item, text, shortest):
    """Mark the longest common run of unmarked words (ties: earliest in item, then in
    text), again and again."""
    free_i, free_t, found = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n] and item[p + n] == text[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        p, q, n = best
        if n < shortest:
            return found
        found.append(best)
        free_i[p : p + n], free_t[q : q + n] = [False] * n, [False] * n


def test_tiles_equal_the_definition():
    rng = random.Random(11)
    for case in range(400):
        few = rng.choice([2, 3, 6])
        item = [rng.randrange(1, few + 1) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(1, few + 1) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):  # parts of the item, out of order
            at = rng.randrange(len(item))
            text[rng.randrange(len(text) + 1) :] = item[at : at + rng.randrange(3, 20)] + text[:5]
        got = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert sorted(got) == sorted(tiles_by_definition(item, text, 3)), (case, item, text)


def test_judged_equals_the_definition(spark):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(40)]
    items = [[rng.choice(words) for _ in range(rng.randrange(5, 25))] for _ in range(12)]
    docs = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if i % 2:
            item = rng.choice(items)
            cut = rng.randrange(len(item) + 1)
            parts = [item[cut:], item[:cut]]
            if i % 3 == 0:  # one word changed
                parts[0] = [*parts[0][:4], "new", *parts[0][5:]]
            rng.shuffle(parts)
            text = text[:7] + parts[0] + text[7:9] + parts[1] + text[9:]
        docs.append((i, " ".join(text)))
    want = {}
    for i, text in docs:
        cover = {j: sum(n for _, _, n in tiles_by_definition(it, text.split(), 5)) / len(it) for j, it in enumerate(items)}
        want[i] = [j for j in sorted(cover) if cover[j] >= 0.8]
    bench = spark.createDataFrame([(j, " ".join(it)) for j, it in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in tiling.judged(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == want and 20 < sum(map(bool, want.values())) < 150
