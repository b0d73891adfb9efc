"""What line dedup's search costs: cells dealt out in arrays, blocks compared by sizes, words hashed in place."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from factorloom.llm import components, lines


def test_shared_cells_are_those_of_several_nodes(spark):
    rng = random.Random(2)
    nodes = [(u, [rng.randrange(-(2**63), 2**63) for _ in range(3)] + [rng.randrange(400), 7 if u % 2 else 8]) for u in range(1000)]
    nodes += nodes[:100] + [(5000, [])]
    rows = [(u, np.array(c, dtype=np.int64).tobytes()) for u, c in nodes]
    found = components.shared_cells(spark.createDataFrame(rows, "u long, cells binary").repartition(3)).collect()
    members = {}
    for u, own in nodes:
        for c in own:
            members.setdefault(c, set()).add(u)
    expected = {(c, u) for c, us in members.items() if len(us) > 1 for u in us}
    got = [(r["cell"], r["u"]) for r in found if len(members[r["cell"]]) > 1]
    assert len(got) == len(set(got)) and set(got) == expected
    sizes = {}
    for r in found:
        sizes.setdefault(r["cell"], set()).add(r["n"])
    assert all(len(n) == 1 and n != {1} for n in sizes.values())


def test_pairs_of_unlike_sizes_are_not_compared():
    compared = []

    class Counted(components.Nearness):
        def far(self, a, b):
            compared.append(np.broadcast(a, b).size)
            return super().far(a, b)

    rng = np.random.default_rng(1)
    size = rng.permutation(np.repeat([10, 40, 160, 640], 250))
    s = rng.integers(0, 2**63, (1000, 1), dtype=np.int64)
    nearness = Counted(lambda a, b: np.where(a == b, 26, -1))
    members = components.Members(pa.table({"size": size, "s": pa.array(list(s))}), nearness)
    found = {(min(p), max(p)) for i, j, _ in members.pairs(0, 1000, np.zeros(1000, dtype=int)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    every = np.bitwise_count(s[:, 0][:, None] ^ s[:, 0][None, :])
    i, j = np.nonzero((every <= 26) & (size[:, None] == size[None, :]) & (np.arange(1000)[:, None] < np.arange(1000)[None, :]))
    assert found == set(zip(i.tolist(), j.tolist(), strict=True)) and len(found) > 1000
    assert sum(compared) < 600_000


def test_words_have_the_same_hash_anywhere():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdéß中") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)] + ["x" * 300_000, "abc", "x" * 300_000]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)
    hashes = lines.word_hashes(data, np.append(0, spaces + 1), np.append(spaces, len(data))).tolist()
    known = dict(zip(words, hashes, strict=True))
    assert [known[w] for w in words] == hashes and len(set(hashes)) == len(known)


def test_lines_are_normalised_as_before():
    for text in ("a b\n c d \n\n e", "a  b\nc", "a\tb", "a b c", "　a b", " ", "é f\n ", "a\x1fb"):
        marks = lines.line_marks([text], 1, 0.8, [set(), set()])[0].to_pylist()[0]
        expected = [(k, lines.normalised(x)) for k, x in enumerate(text.split("\n")) if x.split()]
        own = [lines.xxhash.xxh3_128_digest(x.encode()) for _, x in expected]
        assert [m["pos"] for m in marks] == [k for k, _ in expected]
        assert [m["u"] for m in marks] == [int.from_bytes(h[:8], "little", signed=True) for h in own]
