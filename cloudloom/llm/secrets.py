"""Secret scan: pattern candidates, and a random forest that removes the false positives among them.

A candidate is a run of 12 or more key characters ('=' belongs to it only as padding at its end, so in NAME=value the name stays outside, as
what is beside the value), or the password in an address, or what is quoted or assigned and has 8 or more printable characters of any kind. Its features are its length, its
character classes, how likely its character transitions are in the corpus's words, the share of it that dictionary words cover, whether it
looks like a path, and the words beside it. Dictionary and transitions are counted over all words of the corpus.

The forest is fitted by Spark's own classifier on labelled findings, a bounded sample of ``most_findings`` (where there are more, half of them secrets,
or all secrets there are), and then compiled into one SQL expression, so scanning is a projection of built-in functions. Where nobody has
labelled findings, ``planted`` makes them: keys, tokens and passwords, with a word that names them and without, and harmless strings that look like them (numbers,
addresses, paths, identifiers, digests, placeholders), each of known kind, about ``most_planted`` in all, set between words of different texts of the corpus.

Defined results: null and empty texts, and empty tables, give no row. A null secret label isn't learned from. If the labelled findings are all of one kind, or none,
the score is the share of secrets among them (0 without any); a score of 0.5, a tie of the trees, counts as a secret. Each place of a candidate is a finding of its own,
so repeated rows give repeated findings. Whole texts are scanned. Ids are passed through, null ones too. Extra columns of the documents are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field
from math import log2

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import Workspace

KEY = "[A-Za-z0-9+/_.\\-]"
_PADDING = "={1,6}+(?![A-Za-z0-9+/_=.\"'\\-])"
#: What stands in quotes, or after = or :, less the punctuation that ends a sentence.
_QUOTED = "(?<=[\"'`])[!-~&&[^\"'`]]{8,}+(?=[\"'`])"
_ASSIGNED = "(?<=[=:])(?!//)[!-~&&[^\"'`=:,;&<>]]{8,}(?<![.!?)\\]}#$%])(?:={1,2}(?![!-~]))?"
#: The password in scheme://name:password@host.
_CREDENTIAL = "(?<=//[!-~&&[^/:@]]{0,64}:)[!-~&&[^/:@\"'`]]{6,}+(?=@)"
#: Else 12 characters or more, its padding among them.
CANDIDATE = f"{_CREDENTIAL}|{_QUOTED}|{_ASSIGNED}|(?<!{KEY})(?:{KEY}{{12,}}+(?:{_PADDING})?|(?=[A-Za-z0-9+/_=.\\-]{{12}}){KEY}{{6,11}}+{_PADDING})"
#: What a line must hold to have a candidate.
_LIKELY = f"{KEY}{{12}}|[=:\"'`][ ]?[\"'`]?[!-~]{{8}}|{KEY}{{6,11}}="
#: Words that stand beside secrets, and words that file names, addresses and identifiers are made of beside those of the corpus.
KEYWORDS = "token secret password passwd pwd api_key apikey access_key auth bearer credential private".split()
NAMES = "http https www com org net example test sample user name file data main index page image version release default config local host server admin html mail".split()
DIGESTS = "sha[0-9]+ md5 commit checksum digest integrity base64 etag revision uuid".split()
FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "transitions", "surprise", "distinct_share", "covered", "slashes", "dots", "hex", "dashes_apart",
    "prefixed", "in_address", "digest_before", "keyword_before", "name_before", "assigned", "quoted", "words_after", "words_before",
]


@dataclass
class Statistics:
    """Of the corpus's words: the commonest ones, and the mean of -log2 of the probability of each letter after each other."""

    dictionary: list[str] = field(default_factory=list)
    surprise: dict[str, float] = field(default_factory=dict)


def statistics(docs: DataFrame, text: str = "text", most_words: int = 600) -> Statistics:
    """Counted over all words (runs of a-z, of 2 letters or more) of all texts; what comes to the driver is most_words words and 26 x 26 counts."""
    with Workspace(docs.sparkSession) as work:
        words = work.keep(docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).where(F.length("word") > 1).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        common = words.where(F.length("word") > 3).orderBy(F.desc("n"), "word").limit(most_words).collect()
        letters = F.split("word", "")
        pairs = words.select("n", F.explode(F.zip_with(F.slice(letters, 1, F.length("word") - 1), F.slice(letters, 2, F.length("word") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
        counts = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    firsts: dict[str, int] = {}
    for pair, n in counts.items():
        firsts[pair[0]] = firsts.get(pair[0], 0) + n
    return Statistics([r["word"] for r in common], {pair: -log2((n + 1) / (firsts[pair[0]] + 28)) for pair, n in counts.items()})


def candidates(docs: DataFrame, id_: str = "doc_id", text: str = "text", with_digit: bool = True) -> DataFrame:
    """A row for each candidate: id, line and word it is in (from 0), the candidate, the word it stands in and its neighbours.

    with_digit: only those that hold a digit; else all that hold a letter or digit.
    """
    lines = docs.where(F.col(text).rlike(_LIKELY)).select(F.col(id_).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    words = lines.where(F.col("content").rlike(_LIKELY)).select("id", "line", F.split("content", "[\\x20\\x09-\\x0D]+").alias("words"))
    near = words.select("id", "line", "words", F.posexplode("words").alias("word", "own")).where(F.length("own") >= 8)
    word = lambda k: F.coalesce(F.get("words", F.col("word") + k), F.lit(""))
    # A word after one that ends in = or : is assigned by it.
    shown = F.concat(F.when(word(-1).rlike("[=:]$"), F.lit("=")).otherwise(""), F.col("own"))
    kept = near.select("id", "line", "word", "own", word(-2).alias("before2"), word(-1).alias("before"), word(1).alias("after"), F.posexplode(F.regexp_extract_all(shown, F.lit(CANDIDATE), F.lit(0))).alias("place", "candidate"))
    return kept.where(F.col("candidate").rlike("[0-9]" if with_digit else "[A-Za-z0-9]"))


def features(found: DataFrame, known: Statistics) -> DataFrame:
    """found with the columns of FEATURES (double)."""
    c = F.col("candidate")
    count = lambda kind: F.length(c) - F.length(F.regexp_replace(c, kind, ""))
    # Classes as one letter each; runs of a class become one letter, so their number less one is that of the transitions.
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    runs = F.regexp_replace(classes, "(.)\\1+", "$1")
    beside = F.lower(F.concat_ws(" ", "before2", "before", F.split_part("own", F.col("candidate"), F.lit(1))))
    # a to z, { for digits and | for the rest have codes from 97 on; a transition that no word has costs as much as one of 28 equal ones.
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "{"), "[^a-z{]", "|")
    table = F.array(*[F.lit(known.surprise.get(chr(97 + i) + chr(97 + j), log2(28))) for i in range(28) for j in range(28)])
    coded = found.withColumn("_codes", F.transform(F.split(plain, ""), lambda x: F.ascii(x) - 97))
    n = F.size("_codes") - 1
    steps = F.zip_with(F.slice("_codes", 1, n), F.slice("_codes", 2, n), lambda a, b: F.get(table, a * 28 + b))
    words = "|".join(sorted({*known.dictionary, *NAMES, *KEYWORDS}, key=lambda w: (-len(w), w)))
    values = {
        "length": F.length(c), "digits": count("[0-9]") / F.length(c), "uppers": count("[A-Z]") / F.length(c), "lowers": count("[a-z]") / F.length(c), "marks": count("[^A-Za-z0-9]") / F.length(c),
        "transitions": (F.length(runs) - 1) / F.length(c), "surprise": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / n, "distinct_share": F.size(F.array_distinct("_codes")) / F.least(F.length(c), F.lit(28)),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / F.length(c), "slashes": count("/"), "dots": count("\\."), "hex": c.rlike("^[0-9a-fA-F]+$"), "dashes_apart": c.rlike("^[A-Za-z]+([_-][A-Za-z]+)+$"),
        "prefixed": c.rlike("^[A-Za-z]{2,5}([_.-][A-Za-z]{3,5})?[_.-][A-Za-z0-9]{16,}"), "in_address": F.col("own").contains(F.concat(F.lit(":"), c, F.lit("@"))) & F.col("own").contains("//"), "digest_before": beside.rlike("|".join(DIGESTS)),
        "keyword_before": beside.rlike("|".join(KEYWORDS)), "name_before": beside.rlike("[a-z_]+[\"']?\\s*[=:]\\s*[\"']?$"), "assigned": beside.rlike("[=:]\\s*[\"']?$") | F.col("before").isin("=", ":", ":="),
        "quoted": F.col("own").rlike("^[\"'].*[\"']"), "words_after": F.length("after") > 0, "words_before": F.length("before2") > 0,
    }
    return coded.withColumns({k: v.cast("double") for k, v in values.items()}).drop("_codes")


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1, fine enough for any share of any table."""
    return hashed / float(1 << 64) + 0.5


def fit(labelled: DataFrame, label: str = "secret", most_findings: int = 20_000, trees: int = 15, depth: int = 6, seed: int = 11) -> Column:
    """The score (0 to 1: the share of the trees that vote for a secret) as an expression over FEATURES."""
    known = labelled.where(F.col(label).isNotNull())
    n, good = known.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("int"))).first()
    if not n or good in (0, n):
        return F.lit(float(good or 0) / max(n, 1))
    # Chosen by a hash of the finding, so the sample is bounded and the same in each run. Harmless strings are far more than secrets, so each kind has its half.
    # Repeated rows are drawn as one. Dealt and ordered by their hashes, they give one forest on any cluster.
    part = 1.0 if n <= most_findings else F.when(F.col(label), most_findings / 2 / good).otherwise(most_findings / 2 / (n - good))
    named = known.select(F.xxhash64("id", "line", "word", "place", *FEATURES, label).alias("hash"), F.col(label).cast("double").alias("label"), *FEATURES)
    sampled = named.where(_unit(F.col("hash")) < part).dropDuplicates(["hash"]).repartition(8, "hash").sortWithinPartitions("hash")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sampled).select("features", "label")
    if rows.select("label").distinct().count() < 2:
        return F.lit(float(good) / n)
    return compiled(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows))


def compiled(model: RandomForestClassificationModel) -> Column:
    """The votes of a fitted forest as one expression, read from its description."""

    def branch(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = branch(lines)
        lines.pop(0)  # Else
        return F.when(F.col(FEATURES[int(m[1])]) <= float(m[2]), low).otherwise(branch(lines))

    votes = [branch(tree.toDebugString.strip().splitlines()[1:]) for tree in model.trees]
    return sum(votes[1:], votes[0]) / len(votes)


def _drawn(seed: int) -> dict[str, Column]:
    """Strings that a row's hash draws: digests in several alphabets, numbers, and words of the row's own text."""
    sha = lambda what: F.sha2(F.concat_ws("/", F.lit(f"{seed}/{what}"), F.col("_at").cast("string")), 256)
    pick = lambda what, n: F.pmod(F.xxhash64(F.lit(f"{seed}/{what}"), "_at"), F.lit(n)).cast("int")
    one_of = lambda what, *values: F.element_at(F.array(*map(F.lit, values)), pick(what, len(values)) + 1)
    word = lambda k: F.coalesce(F.nullif(F.regexp_replace(F.lower(F.get("_words", pick(f"word{k}", 1 << 30) % F.greatest(F.size("_words"), F.lit(1)))), "[^a-z]", ""), F.lit("")), F.lit(f"item{k}"))
    number = lambda what, n: pick(what, n).cast("string")
    alnum = lambda what: F.regexp_replace(F.base64(F.unhex(sha(what))), "[+/=]", "x")
    return {
        "hex": F.substring(sha("hex"), 1, 40), "hex32": F.substring(sha("hex32"), 1, 32), "hex64": sha("hex64"),
        "b64": F.base64(F.unhex(F.substring(sha("b64"), 1, 48))), "b64pad": F.base64(F.unhex(F.substring(sha("b64pad"), 1, 44))), "b64long": F.concat(F.base64(F.unhex(F.substring(sha("long"), 1, 60))), F.base64(F.unhex(F.substring(sha("er"), 1, 60)))),
        "alnum": alnum("alnum"), "second": alnum("second"), "caps": F.upper(alnum("caps")), "digits": F.substring(F.translate(sha("digits"), "abcdef", "123456"), 1, 16), "figures": F.translate(sha("figures"), "abcdef", "789012"),
        "one": word(1), "two": word(2), "three": word(3), "number": number("number", 100_000), "year": F.concat(F.lit("20"), F.lpad(number("year", 30), 2, "0")), "byte": number("byte", 256), "other": number("other", 256), "month": F.lpad((pick("month", 12) + 1).cast("string"), 2, "0"),
        "mark": one_of("mark", *"!@#$%^*-_+"), "key": one_of("key", "token", "secret", "password", "api_key", "API_KEY", "auth_token", "DB_PASSWORD", "aws_secret_access_key", "private_key", "pwd"),
        "name": one_of("name", "version", "path", "url", "title", "commit", "checksum", "id", "image", "label", "ref"), "plain": one_of("plain", "STRIPE", "SENTRY", "conn", "REDIS", "MAPS", "cfg", "client", "webhook", "value", "k"),
        "scheme": one_of("scheme", "postgres", "postgresql", "mysql", "redis", "amqp", "mongodb"), "kind": pick("kind", 1 << 20),
    }


def _kinds(v: dict[str, Column]) -> dict[str, tuple]:
    """Of each kind of planted string: whether it is a secret, what stands before it, the string, what stands behind it."""
    upper = lambda x: F.initcap(x)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    cut = lambda name, start, n: F.substring(v[name], start, n)
    placeholder = F.element_at(F.array(F.lit("xxxxxxxxxxxxxxxx"), F.lit("********"), F.lit("changeme-changeme"), join("${", F.upper(v["key"]), "}")), F.pmod(v["kind"], F.lit(4)) + 1)
    return {
        # Secrets that a word names.
        "quoted_hex": (True, join(v["key"], ' = "'), v["hex"], '"'), "assigned_base64": (True, join(upper(v["key"]), "="), v["b64"], ""), "after_colon": (True, join(v["key"], ": "), cut("alnum", 1, 24), ""),
        "json_value": (True, join('{"', v["key"], '": "'), cut("alnum", 3, 32), '"}'), "bearer": (True, "Authorization: Bearer ", join("eyJ", cut("alnum", 1, 20), ".", cut("alnum", 9, 30), ".", cut("b64", 1, 24)), ""),
        "password": (True, "password: ", join(upper(v["one"]), v["mark"], v["year"], v["two"]), ""), "passphrase": (True, 'password = "', join(v["one"], "-", v["two"], "-", v["three"]), '"'), "in_query": (True, "?access_token=", cut("alnum", 2, 28), "&x=1"),
        "exported": (True, join("export ", F.upper(v["key"]), "="), v["hex32"], ""), "padded": (True, join(v["key"], "='"), v["b64pad"], "'"), "compound": (True, "secret: ", join(upper(v["one"]), upper(v["two"]), v["number"], v["mark"], "x"), ""),
        "option": (True, join("--", v["key"], " "), cut("alnum", 5, 22), ""),
        # Secrets that no word names: keys with an issuer's prefix, passwords in addresses, bare keys.
        "AKIA": (True, "", join("AKIA", cut("caps", 1, 16)), ""), "ghp": (True, "", join("ghp_", cut("alnum", 1, 36)), ""), "xoxb": (True, "", join("xoxb-", cut("figures", 1, 11), "-", cut("figures", 20, 12), "-", cut("alnum", 1, 24)), ""),
        "sk_live": (True, join(v["plain"], "="), join("sk_live_", cut("alnum", 1, 24)), ""), "connection": (True, join(v["scheme"], "://", v["one"], ":"), cut("second", 1, 16), join("@db.", v["two"], ".net:5432/", v["three"])),
        "AIza": (True, "", join("AIza", cut("alnum", 1, 17), "_", cut("second", 1, 17)), ""), "glpat": (True, "", join("glpat-", cut("alnum", 4, 20)), ""), "SG": (True, join(v["plain"], ": "), join("SG.", cut("alnum", 1, 22), ".", cut("second", 1, 43)), ""),
        "npm": (True, join(v["plain"], "="), join("npm_", cut("second", 1, 36)), ""), "remote": (True, join("https://", v["one"], ":"), cut("alnum", 1, 20), join("@", v["two"], ".org/", v["three"], ".git")),
        "remote_password": (True, join("ftp://", v["one"], ":"), join(upper(v["two"]), v["number"], "!"), join("@", v["three"], ".org/")), "bare_mixed": (True, "", cut("second", 2, 40), ""), "plain_name": (True, join(v["plain"], ' = "'), cut("second", 3, 28), '"'),
        "bare_base32": (True, "", cut("caps", 3, 32), ""), "access_id": (True, join(v["plain"], ": "), join("LTAI", cut("caps", 5, 20)), ""), "dckr": (True, "", join("dckr_pat_", cut("alnum", 6, 27)), ""), "bot": (True, join(v["plain"], " "), join(cut("figures", 3, 10), ":AA", cut("second", 4, 33)), ""),
        "numbered": (True, "", join("xapp-1-", cut("caps", 1, 11), "-", cut("figures", 1, 13), "-", v["hex32"]), ""), "bare_jwt": (True, "", join("eyJ", cut("alnum", 1, 33), ".eyJ", cut("second", 1, 40), ".", cut("alnum", 2, 40)), ""),
        # Harmless strings.
        "number": (False, "", v["digits"], ""), "address": (False, "", join(v["byte"], ".", v["other"], ".", v["byte"], ".", v["other"], ".", v["number"]), ""), "path": (False, "", join("/", v["one"], "/", v["two"], "/", v["three"], "/index.html"), ""),
        "url": (False, "see https:", join("//www.", v["one"], ".example.com/", v["two"], "-", v["three"]), ""), "dashed": (False, "", join(v["one"], "-", v["two"], "-", v["three"]), ""), "named": (False, join(v["name"], ' = "'), join(v["one"], "_", v["two"], "_", v["three"]), '"'),
        "release": (False, join(v["name"], ": "), join(v["one"], ".", v["two"], "-", v["number"]), ""), "commit": (False, "commit ", v["hex"], ""), "digest": (False, "sha256:", v["hex64"], ""), "your_here": (False, join(v["key"], ' = "'), join("your_", v["one"], "_", v["key"], "_here"), '"'),
        "placeholder": (False, join(v["key"], "="), placeholder, ""), "long_word": (False, "", join(v["one"], v["two"], v["three"], "ation"), ""),
        "uuid": (False, "", join(cut("hex", 1, 8), "-", cut("hex", 9, 4), "-4", cut("hex", 13, 3), "-", cut("hex", 16, 4), "-", cut("hex32", 1, 12)), ""), "bare_hex": (False, "", v["hex"], ""), "integrity": (False, 'integrity: "', join("sha512-", v["b64long"]), '"'),
        "data_uri": (False, "data:image/png;base64,", v["b64long"], ""), "camel_case": (False, "", join(upper(v["one"]), upper(v["two"]), v["number"]), ""), "constant": (False, "", join(F.upper(v["one"]), "_", F.upper(v["two"]), "_", v["number"]), ""),
        "serial": (False, "", join("SN-", v["number"], "-", F.upper(v["one"]), "-", v["year"]), ""), "moment": (False, "", join(v["year"], "-", v["month"], "-11T10:22:", v["month"], ".", v["number"], "Z"), ""), "port": (False, join("http://", v["one"], ".", v["two"], ":"), join("8080/", v["three"], "/", v["number"]), ""),
        "mailto": (False, "mailto:", join(v["one"], ".", v["two"], "@", v["three"], ".org"), ""), "assigned_words": (False, join(v["plain"], "="), join(v["one"], "/", v["two"], "-", v["number"]), ""),
    }


def planted(docs: DataFrame, text: str = "text", most_planted: int = 12_000, seed: int = 5, without: Collection[str] = ()) -> DataFrame:
    """(id, text, secret, value, kind): lines of the corpus's own words with one planted string each, of known kind (those of _kinds but for without); about most_planted of them, drawn by a
    hash from all different texts, so copies of one text are drawn as one."""
    kinds = {k: x for k, x in _kinds(_drawn(seed)).items() if k not in without}
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.lit(seed), text).alias("_hash"), text)
    share = most_planted / len(kinds) / max(1, texts.agg(F.approx_count_distinct("_hash")).first()[0])
    here = texts.where(_unit(F.col("_hash")) < share).select("_hash", F.split(F.translate(text, "\n\t", "  "), " +").alias("_all"))
    # A text gives as many lines as there are kinds; its words from a drawn place on stand around the string.
    some = here.select("_hash", F.slice("_all", F.pmod("_hash", F.size("_all")).cast("int") + 1, 12).alias("_words")).dropDuplicates(["_hash"])
    rows = some.select(F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))).alias("_line"), "_hash", "_words").withColumn("_at", F.xxhash64("_hash", "_line"))
    before, after = F.array_join(F.slice("_words", 1, 4), " "), F.array_join(F.slice("_words", 5, F.pmod(_drawn(seed)["kind"], F.lit(5))), " ")
    choose = lambda values: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in values]), F.col("_line") + 1)
    secret, lead, value, tail = map(choose, zip(*kinds.values(), strict=True))
    made = rows.select(F.col("_at").alias("id"), secret.alias("secret"), lead.alias("lead"), value.alias("value"), tail.alias("tail"), choose(kinds).alias("kind"), before.alias("before"), after.alias("after"))
    return made.select("id", F.concat("before", F.lit(" "), "lead", "value", "tail", F.lit(" "), "after").alias("text"), "secret", "value", "kind")


def labelled_findings(docs: DataFrame, known: Statistics, work: Workspace, text: str = "text", **options) -> DataFrame:
    """Findings with FEATURES, secret and kind in planted lines, which work keeps: what holds or lies in the planted string has its label, the words around it none."""
    lines = work.keep(planted(docs, text, **options)).withColumn("id", F.struct("id", "secret", "value", "kind"))
    found = features(candidates(lines, "id", "text", with_digit=False), known)
    about = F.col("id.value").contains(F.col("candidate")) | F.col("candidate").contains(F.col("id.value"))
    return found.where(about).withColumns({"secret": F.col("id.secret"), "kind": F.col("id.kind")}).withColumn("id", F.col("id.id"))


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, known: Statistics | None = None, **options) -> DataFrame:
    """Findings (id_, line, word, place, candidate, score, secret); labelled: findings with FEATURES and the column secret, else those in planted lines."""
    known = known or statistics(docs, text)
    if labelled is None:
        with Workspace(docs.sparkSession) as work:
            score = fit(work.keep(labelled_findings(docs, known, work, text).select("id", "line", "word", "place", *FEATURES, "secret")), **options)
    else:
        score = fit(labelled, **options)
    rated = features(candidates(docs, id_, text, with_digit=False), known).withColumn("score", score)
    return rated.select(F.col("id").alias(id_), "line", "word", "place", "candidate", "score", (F.col("score") >= 0.5).alias("secret"))
