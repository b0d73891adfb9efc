"""Line dedup against all pairs compared, and its edge cases."""

from __future__ import annotations

import random

import pytest
from conftest import DATA

from factorloom.llm import components, lines


def brute(rows, min_words=5, least=0.8):
    """Texts left, by comparing every line with every other by edit similarity alone."""
    found = []
    for k, (i, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            if line.split():
                found.append(((i is None, i if i is not None else 0, k, p), lines.normalised(line).split(" ")))
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            fuzzy = min(len(x), len(y)) >= min_words and 5 * abs(len(x) - len(y)) <= max(len(x), len(y))
            if x == y or fuzzy and top(a) != top(b) and lines.similar(" ".join(x), " ".join(y), least):
                root[top(a)] = top(b)
    first = {}
    for a, x in enumerate(found):
        first[top(a)] = min(first.get(top(a), x[0]), x[0])
    gone = {}
    for a, x in enumerate(found):
        if x[0] != first[top(a)]:
            gone.setdefault(x[0][2], set()).add(x[0][3])
    out = []
    for k, (i, text) in enumerate(rows):
        drop = gone.get(k, set())
        out.append((i, text if not drop else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in drop), len(drop)))
    return out


def test_edits_are_levenshtein_distances():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
        assert lines.edits(a, b, 100) == table[-1], (a, b)


def some_rows(rng, base, words, count, edits_of):
    rows = []
    for k in range(count):
        text = []
        for _ in range(rng.randrange(0, 5)):
            own = list(rng.choice(base))
            for _ in range(rng.randrange(edits_of(len(own)) + 1)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(1, 2) if len(own) < 6 else rng.randrange(2))
            line = " ".join(own)
            text.append(rng.choice(["", "  "]) + line.upper() if rng.random() < 0.2 else line)
        rows.append((k if k % 10 else None, "\n".join(text) if k % 17 else None))
    return rows


@pytest.mark.parametrize("paired", [8, 4])
def test_same_as_all_pairs(spark, paired, monkeypatch):
    monkeypatch.setattr(components, "PAIRED", paired)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    base = [rng.choices(words, k=rng.randrange(1, 60)) for _ in range(40)]
    rows = some_rows(rng, base, words, 150, lambda n: n // 12 + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in lines.dedup_lines(df).select("doc_id", "text", "n_removed").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert any(n for _, _, n in got)


def test_links_of_pairs_at_the_least_similarity():
    """Pairs with as many random edits as similarity 0.8 allows share a key; of any number of words at least 0.9 of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 2, 3, 3, 5, 7, 9])))
    for n, least in ((5, 1.0), (7, 1.0), (9, 1.0), (10, 0.9), (14, 0.9), (16, 0.9), (20, 0.9), (25, 0.9), (30, 0.9), (40, 0.9), (60, 0.9), (100, 0.9), (250, 0.9)):
        pairs = []
        for _ in range(400):
            own = [word() for _ in range(n)]
            other = list(own)
            for at in rng.sample(range(n), n // 5):
                other[at] = word()
            if rng.random() < 0.3:
                at = rng.randrange(n)
                other = own[:at] + own[at + 1 :] if n > 5 else other
            pairs += [own, other]
        at, keys, _ = lines.line_blocks(pairs, 0.8)
        own = [set() for _ in pairs]
        for a, k in zip(at.tolist(), keys.tolist(), strict=True):
            own[a].add(k)
        found = [bool(own[k] & own[k + 1]) for k in range(0, len(pairs), 2)]
        assert sum(found) / len(found) >= least, (n, sum(found) / len(found))


def test_all_similar_lines_of_a_table_are_linked(spark):
    """What stays of the small documents is what stays when every line is compared with every other."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"word{k}" for k in range(30)]
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(30)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own) + "\nthe very same line in all of them\nshort"))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in got) == 3 * 299 and {r["text"] for r in got if r["doc_id"]} == {""}


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).collect() == []
    one = "one two three four five"
    rows = [(1, one, 9), (1, one, 9), (None, one, 8), (2, "", 7), (3, None, 6), (4, "a b\na b", 5), (5, one + "\nx\n\n\n" + one, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_removed long").coalesce(1)
    got = sorted(map(tuple, lines.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, one, 0), (1, "", 1), (None, "", 1), (2, "", 0), (3, None, 0), (4, "a b", 1), (5, "x\n\n", 2)], key=repr)
    with pytest.raises(ValueError):
        lines.dedup_lines(df, least=0.5)


def test_very_long_lines(spark):
    line = " ".join(f"w{k}" for k in range(30_000))
    other = line.replace("w17 ", "v17 ")
    df = spark.createDataFrame([(1, line), (2, other), (3, "x" * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0}
