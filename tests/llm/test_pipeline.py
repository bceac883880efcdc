import re
import uuid

import numpy as np
import pytest

import corpus_pipeline as P
from docrisk.llm import near_dup, toxicity
from docrisk.llm.scratch import shared_folder

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, the documents first."""
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    docs = P.read(spark, SF, "documents")
    found = [docs.toPandas()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "mixing" or out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs.toPandas())
    return found


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    labels = P.read(spark, SF, "labels").toPandas().set_index("doc_id").toxic
    gone = set(before.doc_id) - set(after.doc_id)
    known = labels[labels.index.isin(set(before.doc_id))]
    assert np.mean([(i in gone) == bool(y) for i, y in known.items()]) >= 0.93
    docs = P.read(spark, SF, "documents")
    model = toxicity.learn(docs, P.read(spark, SF, "labels"))
    assert gone == {r.document.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}


def test_one_of_each_group_stays(spark, stages):
    before, after = stages[1], stages[2]
    label = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(before)).collect()}
    assert sorted(after.doc_id) == sorted(set(label.values()))


def test_repeated_passages_go(stages):
    before, after = stages[2].sort_values("doc_id"), stages[3].set_index("doc_id").text
    first = {}
    for r in before.itertuples():
        w = WORD.findall(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if first.setdefault(key, (r.doc_id, i)) != (r.doc_id, i):
                gone[i : i + 20] = [True] * 20
        kept = [a for a, b in zip(w, gone) if not b]
        if w and not kept:
            assert r.doc_id not in after.index
        else:
            assert WORD.findall(after[r.doc_id]) == kept
            assert any(gone) or after[r.doc_id] == r.text
    counts = stages[3]
    assert (counts.n_chars == counts.text.str.len()).all()


def test_benchmark_goes(spark, stages):
    normal = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [normal(r.text) for r in P.read(spark, SF, "benchmark").collect()]
    before, after = stages[3], stages[4]
    with_item = {r.doc_id for r in before.itertuples() if any(i in normal(r.text) for i in items)}
    gone = set(before.doc_id) - set(after.doc_id)
    assert with_item and with_item <= gone
    for r in before[before.doc_id.isin(gone)].itertuples():
        text = normal(r.text)
        assert any(" ".join(i.split()[k : k + 5]) in text for i in items for k in range(len(i.split()) - 4))


def test_mix_meets_its_targets(stages):
    before, mix = stages[4], stages[5]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before.itertuples()}
    taken, target, total = {}, {}, {}
    for r in before.itertuples():
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    for r in mix.itertuples():
        assert r.mix["taken"] == r.mix["copies"] * size[r.doc_id] and 1 <= r.mix["copies"] <= 2
        taken[r.source] = taken.get(r.source, 0) + r.mix["taken"]
        target[r.source] = r.mix["target"]
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-3 * sum(total.values())
    # whole documents alone are taken, so what is missing is less than the shortest
    shortest = {s: min(size[r.doc_id] for r in before[before.source == s].itertuples() if size[r.doc_id]) for s in target}
    assert all(abs(taken[s] - target[s]) <= max(5, shortest[s]) for s in target)


def test_run_gives_the_same_mix(spark, stages):
    got = P.run(spark, SF).toPandas()
    mix = stages[5]
    assert dict(zip(got.doc_id, got.taken)) == {r.doc_id: r.mix["taken"] for r in mix.itertuples()}


def test_odd_rows_pass_all_stages(spark, tmp_path):
    long = " ".join(f"l{i}" for i in range(20_000))
    rows = [
        (1, "a plain text", "en", "s", 12, 0.5), (2, None, None, None, None, None), (3, "", "en", "s", 0, 0.5), (None, "no id", "en", None, 5, 0.5),
        (4, "a plain text", "en", "t", 12, 0.5), (1, "a plain text", "en", "s", 12, 0.5), (5, long, "en", "s", len(long), 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for table in ("labels", "benchmark"):
        P.read(spark, SF, table).write.parquet(f"{tmp_path}/{table}.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in P.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "mixing":
                assert now.columns == docs.columns
                if name != "toxicity":
                    assert sorted((r.doc_id or 0) for r in now.collect()) == ([] if given is not docs else [0, 1, 2, 3, 5])
        assert sorted(r.doc_id or 0 for r in now.collect()) == ([] if given is not docs else [0, 1, 5])
