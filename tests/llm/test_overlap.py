import random

from tasselworks.llm.overlap import _LINES, coverage, cross_split_matches, row_pairs
from tasselworks.session import Workspace

SCHEMA = "row_id long, image_path string, phash string, cover string, split string"


def test_any_four_bands_miss_a_line():
    from itertools import combinations

    assert len(_LINES) == 12
    for four in combinations(range(9), 4):
        assert any(not set(four) & set(line) for line in _LINES)


def rows_of(rng, first, n, pool):
    out = []
    for k in range(n):
        h = rng.choice(pool)
        for b in rng.sample(range(64), rng.randrange(0, 8)):
            h ^= 1 << b
        text = f"{h:016x}"
        out.append((first + k, f"clean/x/real/x_cropdg_real_{10_000_000 + rng.randrange(40_000)}.jpg", text.upper() if k % 2 else text, None, "val"))
    return out


def brute(train, evaluation, number):
    out = set()
    for t in train:
        for e in evaluation:
            same = number(t) is not None and number(t) == number(e)
            near = t[2] and e[2] and len(t[2].strip()) == 16 and len(e[2].strip()) == 16 and (int(t[2], 16) ^ int(e[2], 16)).bit_count() <= 4
            if same or near:
                out.add((min(t[0], e[0]), max(t[0], e[0])))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [rng.getrandbits(64) for _ in range(60)]
    train, evaluation = rows_of(rng, 1, 400, pool), rows_of(rng, 1001, 150, pool)
    n = 12345678
    spellings = [f"clean/x/real/x_maize_field_real_{n}.jpg", f"file:///a/maize%20field%20000{n}.PNG", f"a\\b\\X-Maize-Field-real-0{n} (1).jpg?rev=2", f"x__maize__field_real_{n}.orig.jpg"]
    number = lambda r: r[1] and (n if str(n) in r[1] and r[0] % 1000 >= 900 else (r[1].split("_")[-1] if "cropdg" in r[1] else None))
    train += [(900 + k, p, None, None, "train") for k, p in enumerate(spellings)] + [(950, None, None, None, None), (951, "clean/odd.jpg", "zz", None, None), (952, None, f"{pool[0]:016x}", None, None)]
    evaluation += [(1900 + k, p, "", None, "test") for k, p in enumerate(spellings)] + [(1950, None, None, None, "test"), (1951, f"x_maize_africa_{n}.jpg", None, None, "test")]
    want = brute(train, evaluation, lambda r: None if "africa" in (r[1] or "") or "odd" in (r[1] or "") else number(r))
    t, e = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(evaluation, SCHEMA)
    matches = cross_split_matches(t, e, Workspace(spark, "t"))
    got = [(r.row_id_a, r.row_id_b) for r in row_pairs(matches).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    report = coverage(matches, e).collect()
    assert sum(r.n_records for r in report) == len(evaluation)
    assert sum(r.n_leaked for r in report) == len({y for _, y in want})


def test_hot_copies_and_empty_sides(spark):
    hot = [(k, "clean/x/real/x_cropdg_real_99999999.jpg", "00000000000000ff", None, "val") for k in range(60)]
    t, e = spark.createDataFrame(hot[:40], SCHEMA), spark.createDataFrame(hot[40:], SCHEMA)
    assert row_pairs(cross_split_matches(t, e, Workspace(spark, "t"))).count() == 40 * 20
    assert row_pairs(cross_split_matches(t, e.limit(0), Workspace(spark, "t"))).count() == 0
    assert row_pairs(cross_split_matches(t.limit(0), e, Workspace(spark, "t"))).count() == 0


def test_near_blank_hashes_are_cut_into_parts(spark, monkeypatch):
    from tasselworks.llm import overlap

    monkeypatch.setattr(overlap, "HOT_VALUES", 40)
    monkeypatch.setattr(overlap, "HOT_SALTS", 3)
    monkeypatch.setattr(overlap, "SLICE_PAIRS", 500)
    rng = random.Random(9)
    near_blank = lambda: sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
    train = [(k, None, f"{near_blank():016x}", None, "train") for k in range(500)]
    evaluation = [(1000 + k, None, f"{near_blank():016x}", None, "val") for k in range(300)]
    got = [(r.row_id_a, r.row_id_b) for r in row_pairs(cross_split_matches(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(evaluation, SCHEMA), Workspace(spark, "t"))).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(train, evaluation, lambda r: None)
