"""Tokens, decontamination, near duplicates and chunks against plain versions."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexspark.llm import bpe, decontam, minhash, queries, substring

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, found string, a string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, ties, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None, None, "x", "y"), (2, "", "s", None, "y"), (3, " \t\n ", "s", "x", None), (4, long, "s", "x", "y"), (5, long, "s", "x", "y"), (None, "one two three", None, None, None), (7, "One two\nthree", "s", "x", "y"), (7, "One two\nthree", "s", "x", "y"), (8, "one TWO three", "s", "x", "y"), (9, "ÉTÉ été 漢字 😀 a\x1cb", "s", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_tiktoken(odd, real):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.select("doc_id", "text").union(real.select("doc_id", "text"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids)))
    assert got == want


def test_bpe_replay_fuzz():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    letters = "abcdeth the  \n\t\x1c\x85　éßÄ漢字か😀１'sS.,!"
    for x in ["".join(rng.choice(letters if i % 2 else "aaab the") for _ in range(rng.randrange(90))) for i in range(1500)]:
        ids = codec.encode(x)
        assert ids.tolist() == plain.encode_ordinary(x)
        assert codec.decode(ids).decode() == x


def test_bpe_long_text_in_portions(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    x = "the andé " * 500 + "a" * 3000
    whole = codec.encode(x).tolist()
    monkeypatch.setattr(bpe, "PORTION", 100)
    assert codec.encode(x).tolist() == whole


def brute_hits(text, items, size=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("bits", [1 << 22, 1 << 12])
def test_decontamination_equals_brute_force(spark, odd, real, bits, monkeypatch):
    """With few bits every word passes the table, and the join alone decides."""
    monkeypatch.setattr(decontam, "BITS", bits)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "one two three"), (902, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (902, "one two three"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = odd.select("doc_id", "text").union(real.select("doc_id", "text").limit(60)).union(real.select("doc_id", "text").where(F.col("text").rlike("(?i)that and onesen|eaea ndorea")))
    got = sorted(map(str, decontam.report(decontam.decontaminate(docs, items)).collect()))
    kept = [b for b in bench if b[0] is not None]
    from pyspark.sql import Row

    row = Row("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(str(row(r.doc_id, *brute_hits(r.text, kept))) for r in docs.collect())


def test_decontamination_keeps_other_columns(odd, spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = odd.withColumn("key", F.lit(1)).withColumn("word", F.lit("w")).withColumn("n", F.lit(2))
    out = decontam.decontaminate(docs, items)  # `found` is there already, as a text
    assert out.columns == ["doc_id", "text", "source", "a", "key", "word", "n", "found"]
    assert out.count() == docs.count() and out.where("size(found.items) > 0").count() == 4
    assert decontam.decontaminate(odd, items.limit(0)).where("size(found.items) > 0").count() == 0
    assert decontam.decontaminate(odd.limit(0), items).count() == 0


def brute_components(rows, share=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            own[x].append(i)
    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in own[x]:
                both[j] += j > i
        for j, n in both.items():
            if n and 100 * n >= share * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def family(rng, base, n, edits, start):
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_near_duplicates_equal_brute_force(spark, odd, real):
    rng = random.Random(3)
    base = [f"b{rng.randrange(5000)}" for _ in range(400)]
    rows = [(r.doc_id + 1000, r.text) for r in real.limit(120).collect()] + [(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()]
    rows += [(5000, " ".join(base)), *family(rng, base, 60, 3, 5001)]  # around one text: partners of one another or only of it
    rows += family(rng, [f"c{i}" for i in range(300)], 40, 4, 6000)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SALT", 5)
    rng = random.Random(4)
    rows = family(rng, [f"c{i}" for i in range(300)], 50, 4, 0) + family(rng, [f"d{i}" for i in range(200)], 30, 3, 100)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_with_a_full_table_of_ids(spark, monkeypatch):
    """A table of eight bits keeps no text out: set keys decide. Late links join components."""
    monkeypatch.setattr(minhash, "BITS", 8)
    rng = random.Random(9)
    rows = family(rng, [f"c{i}" for i in range(250)], 40, 5, 0) + [(900 + k, f"other words {k} stand here alone {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    some = docs.select(F.col("doc_id").alias("id")).where("id % 3 = 0")
    assert {r.doc_id for r in minhash._hashed_in(docs, "doc_id", some).collect()} >= {r.id for r in some.collect()}
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (7, 7, True), (8, 7, False), (None, None, True)} <= got
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_different_sizes(spark, monkeypatch):
    """Texts that are the beginning of one another: links join neighbouring sizes only, chains lead on."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"c{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in range(20, 400, 9)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_one_id_with_two_texts_and_of_text_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [("k1", a), ("k1", b), ("k2", a + " end"), ("k3", b + " end"), ("k4", "lone"), (None, a)]
    docs = spark.createDataFrame(rows, "name string, body string").withColumn("doc_id", F.lit(1)).withColumn("node", F.lit(1)).withColumn("salt", F.lit(1))
    got = sorted((r.name or "", r.component_id or "", r.kept) for r in minhash.near_duplicates(docs, "name", "body").collect())
    assert got == [("", "", True), ("k1", "k1", True), ("k1", "k1", True), ("k2", "k1", False), ("k3", "k1", False), ("k4", "k4", True)]


def test_components_of_a_long_chain(spark):
    n = 10_000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 500, n + 499)], "a bigint, b bigint")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {n + 500: n + 499}


def test_chunks_resist_insertions_and_rebuild():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(3000)).encode()
    pieces = lambda t: [t[a:b] for a, b in zip([0, *substring.cuts(t)], substring.cuts(t), strict=False)]
    assert b"".join(pieces(text)) == text
    moved = text[:5000] + b" inserted words " + text[5000:]
    assert len(set(pieces(text)) - set(pieces(moved))) <= 3
    assert substring.cuts(b"") == [] and substring.cuts(b"ab") == [2]


def plain_cuts(text, bits=substring.BITS, least=substring.LEAST):
    """Byte by byte: the hash moves on by a shift and the next byte's number."""
    h = last = 0
    out = []
    for p, c in enumerate(text, 1):
        h = (h << 1) + int(substring._GEAR[c]) & 0xFFFFFFFF
        if h < 1 << (32 - bits) and p - last >= least and p < len(text):
            out.append(p)
            last = p
    return [*out, len(text)] if text else []


def plain_runs(docs):
    """Of (id, text): the size and the runs that count."""
    places = defaultdict(list)
    for i, t in docs:
        last = 0
        for e in plain_cuts(t):
            places[t[last:e]].append((i, last, e))
            last = e
    found = defaultdict(set)
    for own in places.values():
        first = min(own)[:2]
        for i, a, e in own:
            if (i, a) != first:
                found[i].add((a, e))
    out = {}
    for i, t in docs:
        runs = []
        for a, e in sorted(found[i]):
            if runs and runs[-1][1] == a:
                runs[-1] = (runs[-1][0], e)
            else:
                runs.append((a, e))
        out[i] = (len(t), [r for r in runs if r[1] - r[0] >= substring.SHORTEST or r == (0, len(t))])
    return out


def test_substring_deduplicate_equals_plain(spark, odd, real):
    passage = " ".join(f"passage{i * i % 101}" for i in range(55))
    extra = [(9001 + i, f"{'x' * i} own{i} text {passage} end{i * 7}", None, None, None) for i in range(4)]
    docs = odd.where("doc_id <> 7").unionByName(spark.createDataFrame(extra, DOCS)).select("doc_id", "text").union(real.select("doc_id", "text").where("doc_id > 20"))
    want = plain_runs([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, [(s.begin, s.end) for s in r.spans]) for r in substring.deduplicate(docs).collect()}
    assert got == want
    assert all(got[9001 + i][1] for i in (1, 2, 3)) and not got[9001][1]
    left = {r.doc_id: r.text for r in substring.cleaned(docs).collect()}
    assert left[9001] == extra[0][1] and left[9003].startswith("xx own2") and left[9003].endswith("end14") and len(left[9003]) < 350
    assert left[1] is None and left[2] == "" and left[4] != "" and left[5] == ""  # 5 is a copy of 4
    assert all(r.text is None or len(left[r.doc_id].encode()) >= want[r.doc_id][0] - sum(b - a for a, b in want[r.doc_id][1]) for r in docs.collect())


def test_substring_odd_rows(spark, odd):
    assert substring.deduplicate(odd.limit(0)).count() == 0 and substring.deduplicate(odd).count() == odd.count()
    named = odd.withColumn("id", F.lit(1)).withColumn("key", F.lit(1)).withColumn("begin", F.lit(1)).withColumn("n_bytes", F.lit(1))
    assert substring.cleaned(named).columns == named.columns and substring.cleaned(named).count() == odd.count()
    long = "é漢字か😀" * 60
    rows = [(1, "a " + long), (2, "b" + long), (3, "cc" + long)]
    for r in substring.cleaned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r.text in dict(rows)[r.doc_id] or r.doc_id > 1  # whole characters, or decoding would have failed
    many = [(1, "line of a text that comes again and again, each time the same words in it. " * 3000), (2, "x")]
    assert substring.deduplicate(spark.createDataFrame(many, "doc_id bigint, text string")).where("longest_dup > 100000").count() == 1


def test_substring_exact_copy_is_one_span(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    texts = [words(n) for n in (400, 120, 60, 3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t) for i, t in enumerate(texts)] + [(20, words(40) + " " + texts[1] + " " + words(40)), (21, texts[2]), (21, texts[2])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_substring(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert not got[i].spans and got[i].dup_chunks == got[i].dup_bytes == 0
        r = got[10 + i]
        assert [tuple(s) for s in r.spans] == [(0, len(t))] and r.longest_dup == r.dup_bytes == r.n_bytes == len(t) and r.dup_chunks == len(substring.cuts(t.encode()))
        assert substring.remove(t.encode(), r.spans) == b""
    # inside another text all but the cut chunks at the passage's ends; a twice-held row's run is one span
    assert [s for s in got[20].spans if s.end - s.begin > 0.75 * len(texts[1])] and all(s.end - s.begin >= substring.SHORTEST for s in got[20].spans)
    assert [tuple(s) for s in got[21].spans] == [(0, len(texts[2]))]
