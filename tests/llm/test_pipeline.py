"""The corpus pipeline against a plain Python version, stage by stage, and its registration."""

from __future__ import annotations

import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidelog.llm import mixing, records, registry, toxicity
from tidelog.llm.simhash_kernel import fingerprint

DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in registry.MODULES} == set(range(1, 11))
    assert set(registry.MODULES) | {"pipeline"} <= set(found)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.settled(stage(spark, docs, DIR), "test")
        out.append((before, docs))
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    scores = toxicity.score_documents(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert rows_of(after.select("doc_id")) == rows_of(scores.where("predicted = 0").select("doc_id"))


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    marks = {r.doc_id: fingerprint(r.text) % 2**64 for r in before.collect()}
    group = {i: i for i in marks}
    for i in sorted(marks):
        for j in sorted(marks):
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 4:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))


def least_edits(item, text):
    """The least edit distance of ``item`` to any part of ``text``, a row of the table at a time."""
    letters, places = np.array(list(map(ord, text))), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))])
        row = np.minimum.accumulate(new - places) + places
    return row.min()


def test_leaks_go(spark, stages):
    before, after = stages[2]
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = lambda t: {t[i : i + 10] for i in range(len(t) - 9)}
    known, want = [grams(t) for t in items], []
    for r in before.collect():
        text = plain(r.text)
        have = grams(text)
        # 8 edits in 100 leave at least one run of 11 letters of the item as they are
        near = [t for t, g in zip(items, known) if have & g]
        if not any(t in text or least_edits(t, text) <= int(0.08 * len(t)) for t in near if t):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(want) and len(want) < before.count()


def test_copies_follow_the_mix(stages):
    before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mixture(mixing.sizes(before)).collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in want.items() if c}


def test_records_follow_the_order(stages):
    import public_tokenizers

    before, after = stages[4]
    plain = Tokenizer.from_file(public_tokenizers.path(records.VOCABULARY))
    start, listed = 0, {r.start: r for r in after.collect()}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        assert listed[start].doc_id == r.doc_id
        start += len(plain.encode(r.text, add_special_tokens=False).ids) + 1
    assert len(listed) == before.count()


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{DIR}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kept", [("corpus_pipeline.py",), ()])
@pytest.mark.parametrize("left", [True, False])
def test_the_rest_works_without_this_package(tmp_path, kept, left):
    """Also where the pipeline stays, in a folder of its own or on the path, and where an empty folder stays."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        shutil.copy(root / name, tmp_path)
    if left:
        (tmp_path / "tidelog/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(root) if not kept else ""})
