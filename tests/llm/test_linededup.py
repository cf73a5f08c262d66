import random
from collections import defaultdict

from cloudloom.llm import linededup


def brute(rows, min_sites=5):
    sites, first = defaultdict(set), {}
    for d, text, s in rows:
        for p, line in enumerate(text.split("\n") if text is not None else ()):
            if len(line.split()) >= 3:
                sites[line].add(s or "")
                first[line] = min(first.get(line, (d, p)), (d, p))
    out = []
    for d, text, _ in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        parts = text.split("\n")
        keep = [x for p, x in enumerate(parts) if not (len(sites[x]) >= min_sites and first[x] != (d, p))]
        out.append((d, "\n".join(keep), len(parts), len(parts) - len(keep)))
    return out


def test_equals_brute_force(spark):
    random.seed(4)
    pool = [f"boiler plate line {k}" for k in range(30)] + ["a b", "", " ", "x"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 6)) + [f"own words of {i}"] * random.randint(0, 2)), random.choice([None, *[f"s{k}" for k in range(random.randint(1, 9))]])) for i in range(300)]
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "\n", "s2"), (903, "very long " * 40_000 + "\nboiler plate line 1", "s3"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_removed int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_many_sites_by_sketch(spark):
    """Far over the threshold the sketch decides alone; near it exact counts do."""
    rows = [(i, "wide spread line", f"s{i}") for i in range(4000)] + [(10_000 + i, "near the threshold", f"t{i}") for i in range(49)] + [(20_000 + i, "at the threshold", f"t{i}") for i in range(50)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=50).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {0, 20_000, *range(10_000, 10_049)}
