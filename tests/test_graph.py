"""Forests, contraction and arriving edges against union-find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corrmail.operators import graph, threads


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def some_edges(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(100, 101 + k) for k in range(60)]  # a hub
    edges += [(200 + k, 201 + k) for k in range(70)]  # a chain in order
    edges += [(300, 300), edges[0], edges[0][::-1]]
    rng.shuffle(edges)
    return [(a, b, k) for k, (a, b) in enumerate(edges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_union_find(spark, seed):
    edges, sets = some_edges(seed), Sets()
    want = [e for e in sorted(edges, key=lambda e: e[2]) if sets.join(e[0], e[1])]
    df = spark.createDataFrame([(a, b, w, f"m{w}") for a, b, w in edges], "a long, b long, weight long, method string").repartition(5)
    forest, labels = graph.spanning_forest(df)
    assert sorted((r.a, r.b, r.weight) for r in forest.collect()) == sorted(want)
    assert all(r.method == f"m{r.weight}" for r in forest.collect())
    assert {r.id: r.label for r in labels.collect()} == {x: sets.find(x) for a, b, _ in edges for x in (a, b) if a != b}


def test_contraction_equals_union_find_and_shrinks(spark):
    edges, sets = some_edges(3), Sets()
    for a, b, _ in edges:
        sets.join(a, b)
    df, rounds = spark.createDataFrame(edges, "a long, b long, k long"), []
    got = {r.id: r.label for r in graph.contracted_components(df, rounds).collect()}
    assert got == {x: sets.find(x) for a, b, _ in edges for x in (a, b)} == {r.id: r.label for r in graph.components(df).collect()}
    assert all(2 * b <= a for a, b in zip(rounds, rounds[1:])) and rounds[-1] == 0
    forest, labels = graph.spanning_forest(spark.createDataFrame([], "a long, b long, weight long"))
    assert forest.count() == labels.count() == graph.contracted_components(df.limit(0)).count() == 0


def test_arriving_edges_change_only_touched_components(spark):
    rng, sets, stored = random.Random(4), Sets(), {}
    for _ in range(4):
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(12)]
        labels = spark.createDataFrame(list(stored.items()), "id long, label long")
        changed = {r.id: r.label for r in graph.changed_labels(labels, spark.createDataFrame(edges, "a long, b long")).collect()}
        for a, b in edges:
            sets.join(a, b)
        assert all(stored.get(x) != y for x, y in changed.items())
        stored |= changed
        assert stored == {x: sets.find(x) for x in stored} and {x for e in edges for x in e} <= stored.keys()


def test_threads_of_arriving_mail_equal_the_full_run(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        cited = [f"<{rng.randrange(60)}@x>" for _ in range(rng.randrange(0, 3))] if rng.random() < 0.4 else []
        rows.append((k, f"<{k}@x>", cited[0] if cited else "", cited[1:], f"2024-01-{1 + k % 28:02d}", rng.choice(["", "a", "b", "c"]), f"p{rng.randrange(12)}@x.org", f"<q{rng.randrange(12)}@x.org>", ""))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, message_id string, in_reply_to string, `references` array<string>, date string, subject_normalized string, from_email string, to_text string, cc_text string")
    want = {r.id: r.thread_id for r in threads.build_threads(df).collect()}
    order, known = [r[0] for r in rows], {}
    for k in range(0, 60, 20):
        old, new = df.filter(F.col("id").isin(order[:k])), df.filter(F.col("id").isin(order[k : k + 20]))
        tree = spark.createDataFrame(list(known.items()), "id long, thread_id long")
        known |= {r.id: r.thread_id for r in threads.extended_threads(tree, old, new).collect()}
    assert known == want


def test_match_method_is_that_of_the_first_union(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        cited = [f"<{rng.randrange(40)}@x>" for _ in range(rng.randrange(1, 4))] if rng.random() < 0.5 else [""]
        rows.append((k, f"<{k}@x>", cited[0], cited[1:], f"2024-01-{1 + rng.randrange(28):02d}", rng.choice(["", "a", "b"]), f"p{rng.randrange(8)}@x.org", f"<q{rng.randrange(8)}@x.org>", ""))
    df = spark.createDataFrame(rows, "id long, message_id string, in_reply_to string, `references` array<string>, date string, subject_normalized string, from_email string, to_text string, cc_text string")
    sets, method = Sets(), {}
    inorder = sorted(rows, key=lambda r: (r[4], r[0]))

    def union(a, b, how):
        if sets.join(a, b):
            for x in (a, b):
                method.setdefault(x, how)

    for r in inorder:
        for slot, m in enumerate([r[2], *r[3]]):
            if m:
                union(r[0], int(m[1:-3]), threads.METHODS[slot > 0])
    for subject in dict.fromkeys(r[5] for r in inorder if r[5]):
        group = [r for r in inorder if r[5] == subject]
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if {a[6], a[7][1:-1]} & {b[6], b[7][1:-1]}:
                    union(a[0], b[0], threads.METHODS[2])
    got = {r.id: (r.thread_id, r.match_method) for r in threads.build_threads(df).collect()}
    assert got == {r[0]: (sets.find(r[0]), method.get(r[0], "")) for r in rows}
