"""The pipeline's stages on odd rows and, each on its own input, against plain versions."""

import hashlib
import re
import shutil

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lexspark.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Each stage's input and output, over the smallest tables with odd rows added."""
    at = tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", at)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    copy = real.where("length(text) > 300").orderBy("doc_id").first()
    rows = [(9001, None, "en", "s", None), (9002, "", None, "s", 0), (None, "no id at all", "en", None, 3), (9003, copy.text, "en", "s", 1), (9004, copy.text, "en", "s", 1), (9005, "set password: hunter2pass now", "en", "s", 1), (9006, "long word " * 60_000, "en", "s", 1), (9002, "", None, "s", 0)]
    real.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).withColumn("score", F.lit("x")).withColumn("found", F.lit("x")).withColumn("_gone", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    docs, steps = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(at)).persist()
        steps.append((name, before, docs))
    return dict((n, (a, b)) for n, a, b in steps), copy.doc_id


def test_columns_and_empty_tables(spark, ran, tmp_path):
    steps, _ = ran
    assert [n for n in steps] == [n for n, _ in corpus_pipeline.STAGES]
    for name, (_, after) in steps.items():
        assert after.columns == (corpus_pipeline.COLUMNS if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_as_plain_versions(ran):
    steps, first = ran
    before, after = steps["toxicity"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.where("doc_id in (9001, 9002, 9005) or doc_id is null").count() == 5
    before, after = steps["near_duplicates"]
    kept = {r.doc_id for r in after.collect()}
    assert first in kept and not {9003, 9004} & kept and {9001, 9002, None, 9006} <= kept
    before, after = steps["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = before.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {(r.item_id, " ".join(w[i : i + 8])) for r in bench if r.item_id is not None for w in [words(r.text)] for i in range(max(1, len(w) - 7)) if w}
    owned: dict = {}
    for item, w in windows:
        owned.setdefault(w, set()).add(item)
    least = min(len(w.split()) for w in owned)
    bad = 0
    for r in before.collect():
        w, found = words(r.text), set()
        for n in range(least, 9):
            for i in range(len(w) - n + 1):
                found |= owned.get(" ".join(w[i : i + n]), set())
        bad += len(found) >= 2
    assert after.count() == before.count() - bad
    before, after = steps["secrets"]
    assert after.count() == before.count() and after.where("doc_id = 9005").first().text == "set password: [SECRET] now"
    assert after.where("not n_chars <=> length(text)").count() == 0
    before, after = steps["bpe"]
    want = sorted((r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in after.collect()) == want
    assert toxicity.THRESHOLD == 0.3
