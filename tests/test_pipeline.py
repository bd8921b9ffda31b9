"""Stages are written once and rebuilt when an option of theirs or before them changes."""

import os

import pytest

from carteggio.plans import pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_resume(spark, tmp_path):
    done = pipeline.run(spark, DATA, str(tmp_path))
    assert set(done) == {n for n, _, _ in pipeline.STAGES} and all(df.count() > 0 for df in done.values())
    assert done["folded"].agg({"outgoing": "sum"}).first()[0] > 0
    first = set(os.listdir(tmp_path))
    pipeline.run(spark, DATA, str(tmp_path))
    assert set(os.listdir(tmp_path)) == first
    pipeline.run(spark, DATA, str(tmp_path), {"linked": {"days": 1}}, ("texts",))
    new = {n.split("-")[0] for n in set(os.listdir(tmp_path)) - first}
    assert new == {"linked", "texts"}
    assert done["folded"].agg({"message_count": "sum"}).first()[0] == done["linked"].count()


def test_study_of_a_mailbox_folder(spark, tmp_path):
    import bench

    bench.archive(str(tmp_path / "in"), 12)
    (tmp_path / "in/copy.eml").write_bytes((tmp_path / "in/0/3-1.eml").read_bytes())
    counts = pipeline.study_mailboxes(spark, str(tmp_path / "in"), str(tmp_path / "out"), ("studio@own.example",))
    assert (counts["messages"], counts["errors"], counts["conversations"], counts["conversation_messages"]) == (24, 0, 12, 24)
    c = spark.read.parquet(str(tmp_path / "out/conversations.parquet")).collect()
    assert {(r["message_count"], r["incoming"], r["outgoing"], r["method"]) for r in c} == {(2, 1, 1, "headers")} and len({r["key"] for r in c}) == 12
    assert spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "out/clean_texts.csv")).count() == 24
