import random

import pytest

from lattix.llm import neardup
from lattix.llm.components import connected_components


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    ids = sorted({i for i, _ in rows if i is not None})
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets}


def near_copies(n=140, seed=3):
    """A base, copies with more and more edits (a star's centre misses some links), shared passages and short texts."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i * 3 + 1, " ".join(w)))
        rows.append((i * 3 + 2, " ".join([*passage, *(f"u{i}_{k}" for k in range(40 + i % 7))])))
        rows.append((i * 3 + 3, " ".join(f"s{k % 3}" for k in range(i % 9))))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = near_copies()
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    truth, sizes = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == truth
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == truth[i]) for i, r in got.items())


@pytest.mark.parametrize("max_group", [2, 8, 4096])
def test_the_size_of_groups_changes_nothing(spark, max_group):
    rows = near_copies(60)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), max_group=max_group).collect()}
    assert got == brute(rows)[0]


def test_sets_of_more_documents_than_a_bitmap_marks(spark, monkeypatch):
    rows = near_copies(30)
    monkeypatch.setattr(neardup, "MAX_ASKED", 3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)[0]


def test_a_centre_of_many_lots(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOT_MEMBERS", 3)
    rows = near_copies(40)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)[0]


def test_a_template_in_every_text(spark):
    """Thousands of texts share three quarters of their words with all others, and only planted pairs are near."""
    rng = random.Random(21)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(2_000):
        own = [f"u{i}_{k}" for k in range(50)]
        rows.append((2 * i, " ".join([*template, *own])))
        if i % 100 == 0:
            own[rng.randrange(50)] = "edited"
            rows.append((2 * i + 1, " ".join([*template, *own])))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_large_buckets_lose_no_pair(spark):
    """Components hold all pairs that share a band and reach the threshold, and no pair below it, whatever the groups' sizes."""
    rng = random.Random(11)
    passages = [[f"p{k}_{i}" for i in range(20)] for k in range(10)]
    rows = [(i, " ".join(w for k in sorted(rng.sample(range(10), rng.randrange(2, 6))) for w in passages[k]) + f" u{i} v{i}") for i in range(150)]
    sets = {i: neardup.shingles(t) for i, t in rows}
    keys = {i: set(neardup.bands(s).tolist()) for i, s in sets.items()}
    elements = {i: set(s.tolist()) for i, s in sets.items()}
    def components(percent, every):
        at = {i: i for i in sets}

        def find(x):
            while at[x] != x:
                x = at[x]
            return x

        for i in sets:
            for j in range(i):
                a, b = elements[i], elements[j]
                if (every or keys[i] & keys[j]) and 100 * len(a & b) >= percent * len(a | b):
                    x, y = find(i), find(j)
                    at[max(x, y)] = min(x, y)
        return {i: find(i) for i in sets}

    for percent, max_group in ((45, 2), (60, 4096), (70, 2)):
        least, most = components(percent, False), components(percent, True)
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, percent=percent, max_group=max_group).collect()}
        assert all(got[i] == got[least[i]] and most[i] == most[got[i]] for i in sets), (percent, max_group)


def test_odd_rows(odd_documents, no_documents):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd_documents).collect()]
    assert len(got) == 12
    by = {i: (n, c, k) for i, n, c, k in got}
    assert by[1] == (56, 1, True) and by[2] == (56, 1, False) and by[3] == (56, 1, False)
    assert by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[6] == (0, 6, True) and by[8][0] == 1
    assert by[None] == (57, None, True)
    assert neardup.near_duplicates(no_documents).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 100)]
    got = dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int")).collect() == []
