"""Files and streams: round trips, gates, batch against stream."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from textloom.places import has_data
from textloom.sources import readers, writers
from textloom.streaming import intake


@pytest.fixture
def folder(tmp_path, spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    return tmp_path


def record(**change):
    row = {"id": "1", "text": "t", "label": "AD", "language": "en", "source": "s", "source_license": "l", "sender_group": "a", "template_group": "b", "split": "train", "is_synthetic": False, "is_adversarial": False, "parent_id": None, "annotator_ids": ["x"]}
    return row | change


def test_messages(spark, folder):
    path = folder / "in"
    path.mkdir()
    (path / "a.jsonl").write_text(json.dumps(record()) + "\n\n" + json.dumps({"id": "2"}) + "\n")
    rows = readers.read_raw_dir(spark, str(path))
    assert sorted((r.id, r.text, r.is_synthetic) for r in rows.collect()) == [("1", "t", False), ("2", "", False)]
    writers.write_messages_jsonl(rows, str(folder / "out"))
    again = readers.read_messages_jsonl(spark, str(folder / "out")).drop("_file")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.drop("_file").collect()))
    (path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="bad line"):
        readers.read_raw_dir(spark, str(path)).collect()
    assert readers.read_messages_jsonl(spark, str(path / "b.jsonl"), strict=False).first()["_corrupt_record"] == "{bad"
    assert readers.sample_texts(spark, str(path / "a.jsonl"), 1).count() == 1


def test_split_folder_and_gate(spark, folder):
    for name, i in (("train", "1"), ("validation", "2"), ("test", "3")):
        (folder / f"{name}.jsonl").write_text(json.dumps(record(id=i, split="nowhere", template_group=i)))
    rows = readers.read_split_dir(spark, str(folder)).drop("_file")
    assert {(r.id, r.split) for r in rows.collect()} == {("1", "train"), ("2", "validation"), ("3", "test")}
    writers.write_splits_gated(rows, str(folder / "ok"))
    assert (folder / "ok" / "split=train").exists()
    leaking = rows.withColumn("template_group", F.lit("same"))
    with pytest.raises(ValueError, match="leak"):
        writers.write_splits_gated(leaking, str(folder / "no"))
    assert not (folder / "no").exists()


def test_annotation_csv(spark, folder):
    path = folder / "pack.csv"
    path.write_bytes('﻿id,text,label,uci_binary\n1,"two\nlines, ""quoted""",AD,spam\n2,x,,ham\n'.encode())
    rows = readers.read_annotation_csv(spark, str(path)).orderBy("id").collect()
    assert rows[0].text == 'two\nlines, "quoted"' and rows[0].orig_label == "spam" and rows[1].label == "" and rows[1].notes == ""
    writers.write_annotation_csv(readers.read_annotation_csv(spark, str(path)), str(folder / "csv"))
    assert readers.read_annotation_csv(spark, str(folder / "csv")).count() == 2
    gbk = folder / "gbk.csv"
    gbk.write_bytes("id,text\n1,验证码您好\n".encode("gbk"))
    assert readers.read_csv_encoding_fallback(spark, str(gbk)).first()["text"] == "验证码您好"


def test_labelled_texts(spark, folder):
    (folder / "l.tsv").write_text("ham\thi there\nspam\t\nother\tx\n\nspam win now\n")
    assert {tuple(r) for r in readers.read_labelled_tsv(spark, str(folder / "l.tsv"), ("ham", "spam"), True).collect()} == {("ham", "hi there"), ("spam", "win now")}
    for label in ("ham", "spam", "junk"):
        (folder / "dirs" / label).mkdir(parents=True)
        (folder / "dirs" / label / "1.txt").write_text(f"{label} text\n")
    assert {(r.label, r.text) for r in readers.read_labelled_text_dirs(spark, str(folder / "dirs")).collect()} == {("ham", "ham text"), ("spam", "spam text")}


def test_json_tables(spark, folder):
    (folder / "r.json").write_text(json.dumps({"rules": [{"id": "A", "pattern": "x", "type": "AD_HINT", "categoryHint": "AD"}, {"id": "B", "pattern": "y", "enabled": False}]}, indent=1))
    rules = readers.rules_of(readers.read_rules(spark, str(folder / "r.json")))
    assert [(r.id, r.priority, r.reason, r.language) for r in rules] == [("A", 0, "RULE_MATCH", "unknown")]
    (folder / "agent.json").write_text(json.dumps({"changes": [{"id": "1", "old": "AD", "new": "FRAUD", "reason": "r"}], "reviewed": 2}, indent=1))
    change = readers.read_corrections(spark, str(folder / "agent.json"), {"agent": 80}).first()
    assert (change.source, change.priority, change.seq, change.new) == ("agent", 80, 0, "FRAUD")
    (folder / "e1.json").write_text(json.dumps([{"text": "a", "label": " "}, {"id": "q", "body": "b", "expectedCategory": "AD"}]))
    (folder / "e2.json").write_text(json.dumps({"samples": [{"body": "c"}]}))
    got = readers.read_eval_samples(spark, str(folder / "e*.json")).collect()
    assert {(r.id, r.body, r.expected_category) for r in got} == {("eval-0", "a", None), ("q", "b", "AD"), ("eval-0", "c", None)}
    (folder / "s.json").write_text(json.dumps({"sources": [{"id": "x", "license": "MIT"}]}))
    assert readers.read_sources(spark, str(folder / "s.json")).first()["license"] == "MIT"
