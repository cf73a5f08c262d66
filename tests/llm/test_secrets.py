import math
import re
from itertools import groupby

from pyspark.sql import functions as F

from cloudloom.llm import secrets
from cloudloom.llm.common import Workspace

TEXTS = [
    (1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more'), (2, "call 4785380592391139 now\nsecond password: Abcdef123456789ghi end"), (3, None), (4, ""), (5, "no candidates here at all, really"),
    (6, "see https://www.example.com/file/v1.2.3/index-00 for it"), (7, "word " * 50_000 + 'secret="AAAA1111bbbb2222CCCC"'), (1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more'), (8, "a" * 30 + " " + "1" * 11), (9, "(abc123def456,abc123def456)"),
]


def brute(text):
    out = []
    for n, line in enumerate((text or "").split("\n")):
        for k, word in enumerate(re.split("[\x20\x09-\x0d]+", line)):
            out += [(n, k, m) for m in re.findall("[A-Za-z0-9+/_=.\\-]+", word) if len(m) >= 12 and re.search("[0-9]", m)]
    return out


def test_candidates_and_features(spark):
    docs = spark.createDataFrame([(*t, 1) for t in TEXTS], "doc_id long, text string, score int")
    known = secrets.Statistics(["candidate", "file"], {"ab": 2.0, "bc": 3.0})
    rows = secrets.features(secrets.candidates(docs), known).collect()
    assert sorted((r.id, r.line, r.word, r.candidate) for r in rows) == sorted((d, *x) for d, t in TEXTS for x in brute(t))
    for r in rows:
        kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in r.candidate]
        assert r.transitions == (len(list(groupby(kinds))) - 1) / len(kinds) and r.length == len(kinds)
        pairs = [known.surprise.get(r.candidate[i : i + 2].lower(), math.log2(28)) for i in range(len(kinds) - 1)]
        assert abs(r.surprise - sum(pairs) / len(pairs)) < 1e-9
    assert {r.id for r in rows if r.keyword_before and r.assigned} == {1, 2, 7}
    assert [round(r.covered, 6) for r in rows if r.id == 6] == [round(22 / 38, 6)]  # www, example, com, file, index
    assert secrets.scan(docs.limit(0)).count() == 0
    found = secrets.scan(docs.where("doc_id = 2").unionAll(docs.where("doc_id = 2")).withColumn("doc_id", F.lit(None).cast("long")))
    assert found.count() == 4 and found.where("doc_id IS NULL").count() == 4


def test_counts_of_words_and_letters(spark):
    docs = spark.createDataFrame([(1, "This this, THAT\nthing's x"), (2, None), (3, "")], "doc_id long, text string")
    known = secrets.statistics(docs, most_words=2)
    assert known.dictionary == ["this", "that"]  # of equal counts the first
    firsts = {"t": 4, "h": 4, "i": 3, "a": 1, "n": 1}
    counts = {"th": 4, "hi": 3, "is": 2, "ha": 1, "at": 1, "in": 1, "ng": 1}
    assert known.surprise == {p: -math.log2((n + 1) / (firsts[p[0]] + 28)) for p, n in counts.items()}
    assert secrets.statistics(docs.limit(0)) == secrets.Statistics()


def test_passwords_of_any_characters(spark):
    texts = ['password = "correct-horse-battery"', "password: P@ssw0rd!2024xyz.", "--secret 'x7#k9$m2&q'", "pwd=short"]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_digit=False).collect()
    assert {(r.id, r.candidate) for r in found} == {(0, "correct-horse-battery"), (1, "P@ssw0rd!2024xyz"), (2, "x7#k9$m2&q")}


def test_held_out_planted_findings(spark):
    """Fitted on strings planted in one half of the documents, held against others planted in the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = secrets.statistics(docs)
    half = lambda k: docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k)
    with Workspace(spark) as work:
        score = secrets.fit(work.keep(secrets.labelled_findings(half(0), known, work).select("id", "line", "word", "place", *secrets.FEATURES, "secret")))
        rated = secrets.labelled_findings(half(1), known, work, seed=77).withColumn("found", score >= 0.5)
        counts = {(r.secret, r.found): r["count"] for r in rated.groupBy("secret", "found").count().collect()}
    good, missed, wrong = (counts.get(k, 0) for k in ((True, True), (True, False), (False, True)))
    print("precision", good / (good + wrong), "recall", good / (good + missed))
    assert good > 3000 and good / (good + wrong) > 0.97 and good / (good + missed) > 0.97


def test_kinds_that_were_left_out(spark):
    """Neither kind is among the strings that the forest is fitted on; no word names these secrets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = secrets.statistics(docs)
    half = lambda k: docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k)
    unseen, harmless = ["AKIA", "ghp", "xoxb", "sk_live", "connection"], ["serial", "port", "path"]
    with Workspace(spark) as work:
        fitted = work.keep(secrets.labelled_findings(half(0), known, work, without=[*unseen, *harmless]))
        assert not {r.kind for r in fitted.select("kind").distinct().collect()} & {*unseen, *harmless}
        rated = secrets.labelled_findings(half(1), known, work, seed=77).withColumn("found", secrets.fit(fitted) >= 0.5)
        found = {r.kind: (r.n, r.found) for r in rated.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("int")).alias("found")).collect()}
    print({k: found[k] for k in [*unseen, *harmless]})
    assert all(found[k][0] > 150 and found[k][1] > 0.9 for k in unseen)
    assert all(found[k][0] > 150 and found[k][1] < 0.05 for k in harmless)


def test_secrets_that_no_word_names(spark):
    letters = lambda n, k: "".join("aZ3kQ9xWm7RtB2yLp5DfH8vJ"[(i * i * 5 + i * k + k) % 24] for i in range(n))
    texts, want = [], {}
    for i in range(40):
        made = [f"AKIA{letters(16, i + 1).upper()}", f"ghp_{letters(36, i)}", f"sk_live_{letters(24, i)}", f"xoxb-{i * 7919 + 10**10}-{i * 104729 + 10**11}-{letters(24, i)}", letters(16, i)]
        texts.append((i, f"we keep {made[0]} here and {made[1]} there\nSTRIPE={made[2]}\nsend it with {made[3]} today\npostgres://reader:{made[4]}@db.internal.net:5432/main\nsee /usr/share/documentation/index.html and 4785380592391139"))
        want[i] = set(made)
    rows = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), known=secrets.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).collect()
    flagged = {(r.doc_id, r.candidate) for r in rows if r.secret}
    asked = {(i, x) for i, xs in want.items() for x in xs}
    assert len(flagged & asked) > 0.9 * len(asked) and flagged <= asked


def test_copies_are_drawn_as_one(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, F.lit("the same words in every copy of it")).otherwise(F.concat(F.lit("other words of row "), F.col("id").cast("string"))).alias("text"))
    lines = secrets.planted(docs, most_planted=8000)
    n, ids = lines.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    assert n == ids and 4000 < n < 12_000
    assert secrets.planted(docs.limit(0)).count() == 0 == secrets.planted(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).count()
    # Nor do repeated findings outweigh the others in the fit.
    with Workspace(spark) as work:
        once = secrets.labelled_findings(docs, secrets.Statistics(), work, most_planted=500)
        often = once.unionByName(once).unionByName(once)
        rated = [secrets.features(secrets.candidates(lines.limit(50), "id"), secrets.Statistics()).select("id", "candidate", secrets.fit(f).alias("score")).orderBy("id", "candidate").collect() for f in (once, often)]
    assert rated[0] == rated[1]


def test_compiled_forest_votes_like_its_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with Workspace(spark) as work:
        found = secrets.labelled_findings(docs, secrets.Statistics(), work, most_planted=2000).withColumn("label", F.col("secret").cast("double")).cache()
        rows = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(found)
        model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=3).fit(rows)
        both = rows.withColumn("score", secrets.compiled(model)).select("features", "score").limit(200).collect()
    assert len(both) > 50
    for r in both:
        votes = sum(t.predict(r.features) for t in model.trees) / len(model.trees)
        assert abs(votes - r.score) < 1e-12


def test_false_positives_go(spark):
    rows = secrets.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    hexes = [r.secret for r in rows if re.fullmatch("[0-9a-f]{40}", r.candidate)]
    numbers = [r.secret for r in rows if r.candidate.isdigit() or "example.com" in r.candidate]
    assert len(hexes) > 50 and all(hexes) and len(numbers) > 100 and not any(numbers)


def test_unquoted_values_and_letters_only(spark):
    cases = [
        ("API_TOKEN=24be64439e3e49cf46b2d7c9", ["24be64439e3e49cf46b2d7c9"]), ("password=Abcdef1234567890XYZ", ["Abcdef1234567890XYZ"]), ("export AWS_SECRET_ACCESS_KEY=AbCdEfGhIjKlMnOpQrStUvWx", ["AWS_SECRET_ACCESS_KEY", "AbCdEfGhIjKlMnOpQrStUvWx"]),
        ("key YWJjZGVmZ2g1= and YWJjZGVmZ2hpamtsbW5v==", ["YWJjZGVmZ2g1=", "YWJjZGVmZ2hpamtsbW5v=="]), ("YWJjZGVmZ1= YWJjZGVmZ1==", ["YWJjZGVmZ1=="]), ("ACCESS_KEYS='x' a=b=c 123456789== ============ ------------", []), ("?access_token=abcdefghijkl&b=1", ["access_token", "abcdefghijkl"]),
    ]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string"), with_digit=False).collect()
    assert sorted((r.id, r.candidate) for r in found) == sorted((i, c) for i, (_, cs) in enumerate(cases) for c in cs)
    values = {}
    for i in range(300):
        letters = "".join(chr((97, 65)[(i + j) % 2] + (i * 7 + j * j * 3) % 26) for j in range(24))
        values[i] = {f"{i * 7919 + 10**30:x}" + "9e" * 8, f"Abcdef{i}1234567XYZ", letters}
    docs = [(i, "\n".join(f"{name}={v}" for name, v in zip(["API_TOKEN", "export password", "DB_SECRET"], sorted(vs), strict=True)) + "\nincomprehensible characteristics of /usr/share/documentation/index.html 4785380592391139") for i, vs in values.items()]
    rows = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.candidate) for r in rows if r.secret} == {(i, v) for i, vs in values.items() for v in vs}
    assert len(rows) == 300 * 7
    # Where secrets are few among the findings, a bounded sample still learns them.
    few = secrets.scan(spark.createDataFrame([*docs[:5], *[(1000 + i, "characteristics " * 200) for i in range(20)]], "doc_id long, text string"), most_findings=100).collect()
    assert {(i, v) for i in range(5) for v in values[i]} <= {(r.doc_id, r.candidate) for r in few if r.secret}
    assert not any(r.secret for r in few if r.candidate == "characteristics")
