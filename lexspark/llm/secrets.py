"""Secret scan with DataFrame functions only: candidates, features, and a random forest that removes false positives.

A candidate is the value after a secret word or an assignment, of any length and characters; a run of at least 16
characters of letters, digits and / + = _ -; or what begins like a known kind of key. All are scored. Its features are
length, character transitions, kinds of characters, dictionary coverage, path signs and the neighbouring words. The
forest is grown by DataFrame aggregates: each level counts weights by tree, node, feature and bin over the labelled
findings, and the driver, which sees at most TREES * 2 ** DEPTH * features * BINS sums, picks the splits. It is applied
as nested conditions. labelled_findings() makes labelled findings from rules; others may be given.

Everything about a candidate comes from its own document, so there is no shuffle in a scan. Null and empty texts: no
findings. Repeated rows: findings of each. Very long texts: work in proportion to their length, whatever the number of
their candidates. Ties: a score of THRESHOLD is a secret. Other columns stay in redact() and are not looked at in
scan(). Empty table: no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import cut

SECRET_WORDS = "token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
PREFIXES = "AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|glpat-"
_RUN, _NAME = r"[A-Za-z0-9/+=_\-]{16}", r"[A-Za-z_][A-Za-z0-9_\-]{0,40}"
_SIGN = r"[\"'\]]{0,2}\s{0,3}(?:=>|:=|=|:(?!//))\s{0,3}"
# where a value without quotes ends: before another assignment, or before closing signs and space
_ENDS = rf"(?=[,;&]{_NAME}[\"']?[=:]|[\"'`.,;:)\]}}>]*(?:\s|\z))"
#: Group 1: what leads to the value of a secret word; group 2: what leads to that of another name.
CANDIDATE = (
    rf"(?<![A-Za-z0-9])([A-Za-z0-9_.\-]{{0,40}}?(?i:{SECRET_WORDS})[A-Za-z0-9_\-]{{0,24}}(?:{_SIGN}|\s{{1,3}}(?!{_NAME}\s{{0,3}}[\"']?[=:]))(?:(?i:bearer|basic|is)\s{{1,3}})?[\"'`]?)"
    rf"(?:(?<=\")[^\"\n]{{1,100}}(?=\")|(?<=')[^'\n]{{1,100}}(?=')|[^\s\"'`]\S{{0,511}}?{_ENDS})"
    rf"|(?<![A-Za-z0-9])({_NAME}{_SIGN}[\"'`]?)(?!\S{{0,100}}?{_RUN})[^\s\"'`]\S{{0,99}}?{_ENDS}"
    rf"|{_RUN}[A-Za-z0-9/+=_\-]*+"
    rf"|(?<![A-Za-z0-9])(?:{PREFIXES})[A-Za-z0-9_\-]{{4,}}+"
)
TREES, DEPTH, BINS = 12, 6, 16
FINDINGS = 150 * 42
THRESHOLD = 0.4
LEFT_CHARS, RIGHT_CHARS = 40, 16
#: Candidates of a text whose places are summed together.
BLOCK = 256
#: Words whose letters speak against a secret.
DICTIONARY = "example|sample|test|dummy|placeholder|your|null|none|todo|changeme|redacted|insert|here|user|name|file|path|page|index|image|version|release|build|http|https|www|html|content|static|assets|query"
FEATURES = ("length", "transitions", "digits", "capitals", "hex", "distinct", "dictionary", "path", "secret_word", "assigned", "plain_word", "prefix", "number", "closed")


def features(text: Column, left: Column, right: Column) -> list[Column]:
    """FEATURES of a candidate with what stands left and right of it, each a bin from 0 to 15."""
    n = F.length(text)
    share = lambda removed: F.least(F.lit(15), F.floor(F.lit(16) * (n - F.length(F.regexp_replace(text, removed, ""))) / n))
    flag = lambda c: F.when(c, 1).otherwise(0)
    body = F.regexp_replace(text, r"^[A-Za-z_\-]{1,12}=", "")
    changes = F.length(F.regexp_replace(body, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", "#")) - F.length(body)
    near = F.lower(left)
    return [c.cast("int") for c in (
        F.least(F.lit(15), F.floor(n / 4)),
        F.least(F.lit(15), F.floor(F.lit(16) * changes / F.greatest(F.length(body), F.lit(1)))),
        share("[0-9]"),
        share("[A-Z]"),
        flag(body.rlike(r"^[0-9a-f]+$")),
        F.least(F.lit(15), F.size(F.array_distinct(F.split(body, ""))) / 2),
        share(f"(?i){DICTIONARY}"),
        F.least(F.lit(15), n - F.length(F.regexp_replace(text, "/", "")) + flag(left.rlike(r"[/.@:]$"))),
        flag(near.rlike(f"({SECRET_WORDS})[^\\n]{{0,24}}$") | F.lower(text).rlike(r"(token|secret|passw|pwd|key)[a-z_\-]{0,8}=")),
        flag(left.rlike(r"[=:]\s*[\"']?$") | text.rlike(r"^[A-Za-z_\-]{2,20}=.")),
        flag(near.rlike(r"(sha|commit|checksum|digest|md5|uuid|isbn|version|revision|phone|card|iban|order|serial|etag|blob)[^\n]{0,20}$")),
        flag(body.rlike(f"^({PREFIXES})")),
        flag(body.rlike(r"^[0-9\-]+$")),
        # right: 3 a closing quote, 2 a sign of assignment (the candidate is a name), 1 another sign, 0 space or the end
        F.when(right.rlike("^[\"'`]"), 3).when(right.rlike(r"^\s{0,3}(=|:|=>)"), 2).when(right.rlike(r"^\S"), 1).otherwise(0),
    )]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """text, left, right, label: made from rules, secrets and what looks like them."""
    i = F.col("id")
    hexes = lambda k, salt: F.substring(F.concat(F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256), F.sha2(F.concat(i.cast("string"), F.lit(salt + "x")), 256)), 1, k)
    b64 = lambda k, salt: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(hexes(64, salt), hexes(64, salt + "y")))), r"\s", ""), 1, k)
    upper = lambda k, salt: F.translate(F.upper(b64(k, salt)), "+/=018", "KQZ234")
    word = lambda salt: F.translate(hexes(3, salt), "0123456789abcdef", "etaoinshrdlucmfw")
    prose = F.concat(word("a"), F.lit(" "), word("b"), F.lit(". "), word("c"), F.lit(" "))
    after = F.concat(F.lit(" "), word("d"))
    lit = F.lit
    letters = lambda c: F.translate(c, "0123456789", "ghijklmnop")
    long_word = F.concat(word("l1"), word("l2"), word("l3"), word("l4"), word("l5"), word("l6"))
    kinds = [
        (hexes(40, "1"), 'token = "', '"', 1),
        (F.concat(lit("password="), hexes(18, "2")), "", "", 1),
        (F.concat(lit("AKIA"), upper(16, "3")), "", "", 1),
        (b64(40, "4"), "secret_key: ", "", 1),
        (F.concat(lit("ghp_"), F.regexp_replace(b64(36, "5"), "[+/=]", "x")), "", "", 1),
        (F.concat(lit("sk_live_"), hexes(24, "6")), "", "", 1),
        (hexes(32, "7"), "api_key='", "'", 1),
        (F.regexp_replace(b64(43, "8"), "[+/=]", "-"), "Authorization: Bearer ", "", 1),
        (F.translate(hexes(16, "9"), "abcdef", "123456"), "", "", 0),
        (F.translate(hexes(16, "10"), "abcdef", "123456"), "card ", ".", 0),
        (F.upper(hexes(40, "22")), 'TOKEN = "', '"', 1),
        (hexes(40, "11"), "commit ", "", 0),
        (hexes(64, "12"), "sha256:", "", 0),
        (F.concat(hexes(8, "13"), lit("-"), hexes(4, "14"), lit("-"), hexes(4, "15"), lit("-"), hexes(4, "16"), lit("-"), hexes(12, "17")), "uuid ", "", 0),
        (F.concat(lit("/static/"), word("e"), lit("/"), word("f"), lit("/page2/index")), "http://www", ".html", 0),
        (F.concat(lit("YOUR_API_KEY_HERE_"), hexes(2, "18")), 'token = "', '"', 0),
        (F.concat(word("g"), lit("-"), word("h"), lit("-"), word("i"), lit("-2024-release")), "", "", 0),
        (F.concat(lit("2024"), F.translate(hexes(4, "19"), "abcdef", "123456"), lit("T"), F.translate(hexes(6, "20"), "abcdef", "123456"), lit("00")), "", "", 0),
        (F.concat(lit("DE"), F.translate(hexes(20, "21"), "abcdef", "123456")), "iban ", "", 0),
        (F.concat(lit("test_example_"), word("j"), lit("1234")), "password: ", "", 0),
        (F.concat(word("k"), word("l"), word("m"), word("n"), word("o"), word("p"), lit("1")), "", "", 0),
        (F.concat(word("q"), word("r"), hexes(4, "30")), "password: ", "", 1),
        (F.concat(word("s"), lit("7"), word("t"), F.translate(hexes(2, "31"), "abcdef", "123456")), 'pwd = "', '"', 1),
        (F.concat(lit("P@"), b64(7, "32"), lit("!")), "password: ", "", 1),
        (F.concat(b64(4, "33"), lit("#"), b64(5, "34"), lit("$")), 'db_password = "', '"', 1),
        (F.concat(word("u"), lit("#"), hexes(5, "35"), lit("!")), "the password is ", "", 1),
        (F.concat(lit("AKIA"), F.translate(upper(16, "36"), "0123456789", "ABCDEFGHIJ")), "", "", 1),
        (letters(F.regexp_replace(b64(40, "37"), "[+/=]", "x")), 'secret_key = "', '"', 1),
        (letters(hexes(24, "38")), "api_key=", "", 1),
        (F.concat(lit("ghp_"), F.regexp_replace(b64(9, "39"), "[+/=]", "x")), "", "", 1),
        (hexes(10, "40"), "api_token=", "", 1),
        (F.regexp_replace(b64(40, "41"), "[+=]", "/"), 'aws_secret_access_key = "', '"', 1),
        (F.concat(word("v"), word("w")), "password: ", "", 0),
        (F.concat(word("x"), word("y")), "the token ", "", 0),
        (F.concat(F.initcap(word("z")), word("z2")), "author: ", "", 0),
        (long_word, "", "", 0),
        (F.initcap(long_word), "", "", 0),
        (F.upper(long_word), "", "", 0),
        (F.when(F.pmod(i, lit(2)) == 0, F.repeat(lit("-"), 20)).otherwise(F.repeat(lit("="), 24)), "", "", 0),
        (F.concat(word("m1"), F.initcap(word("m2")), F.initcap(word("m3")), F.initcap(word("m4")), F.initcap(word("m5")), lit("Name")), "", "", 0),
        (F.concat(word("n1"), lit("_secret_"), word("n2"), lit("_access_key")), "", ' = "', 0),
        (F.translate(hexes(3, "42"), "abcdef", "123456"), "count = ", "", 0),
    ]
    case = lambda k: reduce(lambda c, x: c.when(F.pmod(i, lit(len(kinds))) == x[0], x[1][k] if isinstance(x[1][k], Column) else lit(x[1][k])), list(enumerate(kinds))[1:], F.when(F.pmod(i, lit(len(kinds))) == 0, kinds[0][k] if isinstance(kinds[0][k], Column) else lit(kinds[0][k])))
    return spark.range(n).select(case(0).alias("text"), F.concat(prose, case(1)).alias("left"), F.concat(case(2), after).alias("right"), case(3).alias("label"))


def grow(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> list[dict[int, tuple]]:
    """Trees as {node: (feature, bin, ) or (share of secrets, )}; node 1 is the root, 2 n and 2 n + 1 its children."""
    spark = findings.sparkSession
    f = findings.select("label", F.array(*features(F.col("text"), F.col("left"), F.col("right"))).alias("f"), F.xxhash64("text", "left").alias("key"))
    drawn = F.pmod(F.xxhash64("key", "tree"), F.lit(1000))
    # how often a row is drawn with replacement, by the Poisson distribution of mean 1
    weight = F.when(drawn < 368, 0).when(drawn < 736, 1).when(drawn < 920, 2).when(drawn < 981, 3).otherwise(4)
    rows = f.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight).where("w > 0")
    rows = cut(rows.select("tree", "w", "label", "f", F.lit(1).alias("node")))
    rng = np.random.default_rng(seed)
    out: list[dict[int, tuple]] = [{} for _ in range(trees)]
    tried = max(2, 2 * len(FEATURES) // 3)
    for level in range(depth + 1):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r in rows.select("tree", "node", "w", "label", F.posexplode("f").alias("k", "bin")).groupBy("tree", "node", "k", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y")).orderBy("tree", "node").collect():
            sums.setdefault((r.tree, r.node), np.zeros((len(FEATURES), BINS, 2)))[r.k, r.bin] = r.n, r.y
        splits = []
        for (tree, node), s in sorted(sums.items()):
            n, y = s[0].sum(axis=0)
            best = None
            if level < depth and 0 < y < n:
                for k in rng.permutation(len(FEATURES))[:tried].tolist():
                    below = s[k].cumsum(axis=0)[:-1]
                    a, p = below[:, 0], below[:, 1]
                    b, q = n - a, y - p
                    with np.errstate(invalid="ignore", divide="ignore"):
                        impure = np.where((a > 0) & (b > 0), p * (a - p) / a + q * (b - q) / b, np.inf)
                    at = int(impure.argmin())
                    if impure[at] < np.inf and (best is None or impure[at] < best[0]):
                        best = impure[at], k, at
            if best is None:
                out[tree][node] = (float(y / n),)
            else:
                out[tree][node] = best[1], best[2]
                splits.append((tree, node, best[1], best[2]))
        if not splits:
            break
        at = spark.createDataFrame(splits, "tree int, node int, k int, cut int")  # a row for each node of a level
        rows = cut(rows.join(F.broadcast(at), ["tree", "node"]).select("tree", "w", "label", "f", (F.col("node") * 2 + (F.element_at("f", F.col("k") + 1) > F.col("cut")).cast("int")).alias("node")))
    return out


def probability(forest: list[dict[int, tuple]], f: list[Column]) -> Column:
    """Mean share of secrets over the trees, as nested conditions."""

    def tree(nodes: dict[int, tuple], node: int) -> Column:
        x = nodes[node]
        return F.lit(x[0]) if len(x) == 1 else F.when(f[x[0]] <= x[1], tree(nodes, 2 * node)).otherwise(tree(nodes, 2 * node + 1))

    return reduce(lambda a, b: a + b, (tree(t, 1) for t in forest)) / len(forest)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once; a lambda works out all but its own arguments anew for each element."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column) -> tuple[Column, Column]:
    """Of a text: gap (before a match), x (the match) and led (the characters of x before the candidate) of each match; what follows the last."""
    found, rest = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    led = lambda x: F.length(F.concat(F.regexp_extract(x, CANDIDATE, 1), F.regexp_extract(x, CANDIDATE, 2)))
    return F.zip_with(F.slice(rest, 1, F.size(found)), found, lambda gap, x: F.struct(gap.alias("gap"), x.alias("x"), led(x).alias("led"))), F.try_element_at(rest, F.lit(-1))


def _begins(pieces: Column) -> Column:
    """Where each candidate begins in the text: running sums in blocks, as appending to one long array would copy it each time."""
    return _let(pieces, _sums)


def _sums(pieces: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("own"))
    add = lambda s, p: F.struct((s["at"] + F.length(p["gap"]) + F.length(p["x"])).alias("at"), F.concat(s["own"], F.array(s["at"] + F.length(p["gap"]) + p["led"])).alias("own"))
    last = F.greatest(F.ceil(F.size(pieces) / BLOCK).cast("int") - 1, F.lit(0))
    return _let(F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), zero, add)), _shifted)


def _shifted(blocks: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("own"))
    starts = F.aggregate(blocks, zero, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["own"], F.array(s["at"])).alias("own")), lambda s: s["own"])
    return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["own"], lambda x: x + at)))


def _candidates(pieces: Column, tail: Column) -> Column:
    """Array of text, left and right (the characters beside it, whatever other candidates stand there), in order."""
    # a match has three characters at least: so many pieces hold all that is wanted
    back, ahead = 2 * (LEFT_CHARS // 3 + 1), 2 * (RIGHT_CHARS // 3 + 1)

    def all_of(x: Column) -> Column:
        before = lambda i: F.array_join(F.slice(x["ends"], F.greatest(2 * i + 1 - back, F.lit(1)), F.least(2 * i + 1, F.lit(back + 1))), "")
        after = lambda i: F.array_join(F.slice(x["heads"], 2 * i + 3, F.lit(ahead)), "")
        lead = lambda p: F.substring(p["x"], F.lit(1), p["led"])
        return F.transform(x["pieces"], lambda p, i: F.struct(F.substring(p["x"], p["led"] + 1, F.length(p["x"])).alias("text"), F.substring(F.concat(before(i), lead(p)), -LEFT_CHARS, LEFT_CHARS).alias("left"), F.substring(after(i), 1, RIGHT_CHARS).alias("right")))

    def sides(x: Column) -> Column:
        flat = F.concat(F.flatten(F.transform(x["pieces"], lambda p: F.array(p["gap"], p["x"]))), F.array(x["tail"]))
        return _let(F.struct(x["pieces"].alias("pieces"), F.transform(flat, lambda y: F.substring(y, -LEFT_CHARS, LEFT_CHARS)).alias("ends"), F.transform(flat, lambda y: F.substring(y, 1, RIGHT_CHARS)).alias("heads")), all_of)

    return _let(F.struct(pieces.alias("pieces"), tail.alias("tail")), sides)


def scan(docs: DataFrame, forest: list[dict[int, tuple]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: id, begin, length, sha256, score, secret."""
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    pieces, tail = _pieces(F.col("_text"))
    cut = some.select("_id", pieces.alias("pieces"), tail.alias("tail"))
    own = F.arrays_zip(_begins(F.col("pieces")).alias("begin"), _candidates(F.col("pieces"), F.col("tail")).alias("c"))
    rows = cut.select("_id", F.explode(own).alias("o")).select("_id", "o.begin", "o.c")
    rows = rows.select("_id", "begin", "c", *[x.alias(f"f{k}") for k, x in enumerate(features(F.col("c.text"), F.col("c.left"), F.col("c.right")))])
    scored = rows.withColumn("score", F.round(probability(forest, [F.col(f"f{k}") for k in range(len(FEATURES))]), 6))
    return scored.select(F.col("_id").alias(id_col), F.col("begin").cast("bigint").alias("begin"), F.length("c.text").cast("bigint").alias("length"), F.sha2("c.text", 256).alias("sha256"), "score", (F.col("score") >= THRESHOLD).alias("secret"))


def redact(docs: DataFrame, forest: list[dict[int, tuple]], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, each secret replaced by the mark; other texts, and other columns, as they are."""
    text = F.col(text_col)

    def shown(x: Column) -> Column:
        known = F.transform(_candidates(x["pieces"], x["tail"]), lambda c: F.array(*features(c["text"], c["left"], c["right"])))
        secret = F.transform(known, lambda f: F.round(probability(forest, [f[k] for k in range(len(FEATURES))]), 6) >= THRESHOLD)
        parts = F.zip_with(x["pieces"], secret, lambda p, yes: F.concat(p["gap"], F.when(yes, F.concat(F.substring(p["x"], F.lit(1), p["led"]), F.lit(mark))).otherwise(p["x"])))
        return F.concat(F.array_join(parts, ""), x["tail"])

    pieces, tail = _pieces(text)
    return docs.withColumn(text_col, F.when(text.rlike(CANDIDATE), _let(F.struct(pieces.alias("pieces"), tail.alias("tail")), shown)).otherwise(text))
