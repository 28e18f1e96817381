"""Near copies against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.llm import nearcopies


def shingles(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def head(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    tried = set()
    for members in by_shingle.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        parent[head(a)] = head(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[head(i)] = min(least.get(head(i), key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        own = key if not sets[i] else least.get(head(i))
        out.append((key, len(sets[i]), own, key == own))
    return sorted(out, key=repr)


def found(df, k, percent=80):
    rows = nearcopies.find_near_copies(df, words=k, percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=repr)


def families(seed, count=60):
    draw = random.Random(seed)
    rows, key = [], 0
    for _ in range(count):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([1, 3, 4, 5, 8, 20, 60, 300]))]
        for _ in range(draw.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(draw.randrange(0, max(1, len(words) // 18) + 1)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
            if draw.random() < 0.2:
                words = [w.upper() for w in words]
            rows.append((key, draw.choice([" ", "\n", " \t "]).join(words)))
            key += 1
    draw.shuffle(rows)
    return rows


def chains(seed):
    """Each differs a little from the one before, the ends a lot."""
    draw = random.Random(seed)
    rows = []
    words = [f"c{i}" for i in range(120)]
    for key in range(60):
        rows.append((1000 - key, " ".join(words)))
        at = draw.randrange(len(words) - 3)
        words[at : at + 3] = [f"n{key}{j}" for j in range(3)]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_families_against_all_pairs(spark, k):
    rows = families(k) + chains(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, k) == brute(rows, k, 80)


def test_buckets_left_open_by_stars(spark, monkeypatch):
    """Coarse bands and few centres: large mixed buckets that take many rounds."""
    monkeypatch.setattr(nearcopies, "CENTRES", 4)
    draw = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for key in range(90):
        words = list(base)
        for _ in range(draw.choice([4, 5, 6])):
            words[draw.randrange(100)] = f"y{draw.randrange(30)}"
        rows.append((key, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 4) == brute(rows, 4, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (5, "one"), (None, "one"), (None, "alone here")]
    rows += [(None, "alone here"), (9, "a b c d " * 30_000), (8, "A B C D " * 30_000), (10, "é É"), (11, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("id", "digest", "key", "component", "owner", "text_hash")}
    )
    assert found(df, 4) == brute(rows, 4, 80)


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty, 4) == []
    assert nearcopies.drop_near_copies(empty).count() == 0
    assert found(spark.createDataFrame([(1, None)], "doc_id long, text string"), 4) == [(1, 0, 1, True)]


def test_drop_keeps_the_smallest(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text + " end", 0), (2, text, 1), (2, text, 1), (9, "other words here", 2), (4, None, 3), (4, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    left = nearcopies.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r["digest"] for r in left.collect()) == [1, 2, 3, 3]


def test_densified_bins_agree_with_similarity():
    draw = np.random.default_rng(2)
    for size in (3, 40, 2000):
        common = draw.integers(0, 2**63, size).astype(np.uint64)
        sets = [np.unique(np.r_[common, draw.integers(0, 2**63, size // 3).astype(np.uint64)]) for _ in range(40)]
        bins = nearcopies.bin_values([x * np.uint64(2) for x in sets])
        same = [(bins[i] == bins[i + 1]).mean() for i in range(0, 40, 2)]
        real = [len(np.intersect1d(sets[i], sets[i + 1])) / len(np.union1d(sets[i], sets[i + 1])) for i in range(0, 40, 2)]
        assert abs(np.mean(same) - np.mean(real)) < 0.08


def test_hashes_do_not_depend_on_the_batch():
    texts = [b"a b c d e f", b"", b"One two", b"a b c d e f", b"\t x\n"]
    together = nearcopies.Shingler(4).sets(texts)
    for text, own in zip(texts, together):
        assert (nearcopies.Shingler(4).sets([text])[0] == own).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    found_ = {r["node"]: r["component"] for r in nearcopies.components(links).collect()}
    assert found_ == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_looked_up_draws_are_the_draws_made(monkeypatch):
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (5, 30, 64, 65, 80, 400)]
    for size in (nearcopies.BINS, nearcopies.BITS):
        one = nearcopies.bin_values(sets, size)
        monkeypatch.setattr(nearcopies, "FEW", 0)
        assert (one == nearcopies.bin_values(sets, size)).all()
        monkeypatch.undo()


def test_sketches_of_links_stay_alike():
    draw = np.random.default_rng(7)
    worst = 0
    for size in (4, 20, 100, 900, 5000):
        for _ in range(60):
            own = np.unique(draw.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            part = np.sort(draw.choice(own, -(-4 * len(own) // 5), replace=False))
            a, b = nearcopies.sketches([own, part])
            worst = max(worst, int(np.unpackbits((a ^ b).view(np.uint8)).sum()))
    assert worst <= nearcopies.DIFFERENT - 10


def test_links_of_short_texts_are_not_dropped(spark):
    """Texts of eight and seven words whose one-bit sketches are too far apart for a link."""
    rows = []
    for at in (886, 2207, 2553, 4379, 4867, 8568):
        words = [f"p{at}w{i}" for i in range(8)]
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[:7]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 4, 80)
    assert sum(kept for *_, kept in expected) == 6
    assert found(df, 4) == expected


def test_odd_places_never_exceed_what_differs():
    draw = np.random.default_rng(8)
    for size in (1, 5, 8, 60, 500, nearcopies.ODD):
        for share in (0, 0.1, 0.5, 1):
            own = np.unique(draw.integers(0, 2**64, size, np.uint64))
            other = np.unique(np.r_[own[int(share * size) :], draw.integers(0, 2**64, int(share * size), np.uint64)])
            a, b = nearcopies.odd_places([own, other])
            apart = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
            assert apart <= len(np.setxor1d(own, other))


@pytest.mark.parametrize("percent", [50, 70])
def test_links_of_a_lower_percent(spark, monkeypatch, percent):
    """Pairs just similar enough, in both kinds of sketch."""
    monkeypatch.setattr(nearcopies, "ODD", 300)
    rows = []
    for at, size in enumerate([40, 60, 100, 200, 250, 400, 600, 900] * 5):
        words = [f"l{at}v{i}" for i in range(size)]
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[: -(-size * percent // 100)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 1, percent)
    assert sum(kept for *_, kept in expected) == 40
    assert found(df, 1, percent) == expected


def test_bands_of_a_percent():
    assert nearcopies.bands_for(80) == nearcopies.bands_for(95) == (nearcopies.BANDS, nearcopies.ROWS)
    for percent in range(1, 80):
        bands, rows = nearcopies.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 2.5e-7
    with pytest.raises(PrepareError):
        nearcopies.bands_for(0)


def test_links_around_the_sketch_limit(spark, monkeypatch):
    """Pairs of small, of large, and of one small and one large set."""
    monkeypatch.setattr(nearcopies, "ODD", 100)
    draw = random.Random(9)
    rows = []
    for size in (90, 98, 100, 103, 104, 110, 120, 140):
        words = [f"z{size}v{i}" for i in range(size)]
        for _ in range(8):
            changed = list(words)
            for _ in range(draw.randrange(0, 6)):
                changed[draw.randrange(size)] = f"q{draw.randrange(99)}"
            rows.append((len(rows), " ".join(changed[: size - draw.randrange(0, 8)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 4) == brute(rows, 4, 80)
