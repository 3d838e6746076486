"""SimHash against fingerprints and components by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.conftest import SMALL
from threadmill.llm import queries, simhash


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=2):
    """Component number of each fingerprint, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(got, rows):
    """rows: (doc_id, text); got: rows of near_duplicates."""
    fps = [fingerprint(t) for _, t in rows]
    member = groups(fps)
    least = {}
    for (d, _), m in zip(rows, member):
        if d is not None:
            least[m] = min(least.get(m, d), d)
    want = sorted(((d, f"{f:016x}", least.get(m)) for (d, _), f, m in zip(rows, fps, member)), key=repr)
    assert sorted((tuple(r)[:3] for r in got), key=repr) == want
    roots = {}
    for r in got:
        roots.setdefault(r["root"], set()).add(r["component_id"]) if "root" in r else None
    assert all(len(c) == 1 for c in roots.values())


def test_query_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op3_simhash(spark, SMALL).collect(), rows)


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (5, None), (4, ""), (9, " \n\t"), (3, "One"), (8, "one"), (7, "one two"), (6, "one two three"), (2, "A b c d " * 20_000), (1, "a B c d " * 20_000),
        (20, base), (21, base + " x"), (22, base + " y"), (22, base + " y"), (None, base), (None, None), (None, "nothing like it"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    check(simhash.near_duplicates(df).collect(), rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 8])
def test_links_are_complete(spark, blocks):
    """Chains and a large group of fingerprints: the same components as by all pairs."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for _ in range(3):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(f)
    hub = rng.getrandbits(64)
    fps = sorted({*fps, *(hub ^ (1 << a) for a in range(64)), *(hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, a, 7)), 0, 1, 3, 2**64 - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2, blocks)).collect()}
    member = groups(fps)
    own = {}
    for s, m in zip(signed, member):
        own.setdefault(m, set()).add(got.get(s, s))
    assert all(len(roots) == 1 for roots in own.values())
    assert len({next(iter(r)) for r in own.values()}) == len(own)


def test_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def test_near_copies_send_few_links():
    """A tile pair gives a spanning forest, not all its links."""
    hub = np.uint64(0x123456789ABCDEF0)
    tile = np.array([hub ^ np.uint64(1 << a) for a in range(64)], np.uint64)
    a, b = simhash.tile_links(tile, tile, 2)
    assert len(a) == 64 * 64
    assert len(simhash.forest(a.view(np.int64), b.view(np.int64))) == 63


def test_lanes_spread_over_the_parts(spark, monkeypatch):
    """A cell of many tiles is split into lanes: the same links, in as many tasks as there are parts."""
    monkeypatch.setattr(simhash, "TILE", 2)
    monkeypatch.setattr(simhash, "LANE", 2)
    fps = [1 << i for i in range(16)] + [(1 << 40) + 3, (1 << 40) + 1, 7 << 50, 0]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert found.rdd.getNumPartitions() >= simhash.work_parts(spark)
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    near = {f: {g for g in fps if (f ^ g).bit_count() <= 2} for f in fps}
    for f in fps:
        seen, todo = {f}, [f]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert roots.get(f, f) == min(seen)
