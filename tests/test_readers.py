"""Encodings file by file, and line numbers of bad lines in files that are read in pieces."""

import json
import random

import pytest

from textloom.operators import keyword_cascade
from textloom.sources import readers


def test_each_file_in_its_own_encoding(spark, tmp_path):
    head = "id,text,label\n"
    (tmp_path / "a.csv").write_bytes((head + '1,"验证码\n两行",AD\n').encode("gbk"))
    (tmp_path / "b.csv").write_bytes("﻿".encode() + (head + "2,验证码é,AD\n").encode())
    (tmp_path / "c.csv").write_bytes((head + "3,𠀀𠀁,\n").encode("gb18030"))
    (tmp_path / "d.csv").write_bytes(head.encode())
    found = {r.file.rsplit("/", 1)[1]: r.encoding for r in readers.file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": "gbk", "b.csv": "utf-8", "c.csv": "gb18030", "d.csv": "utf-8"}
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = readers.read_csv_encoding_fallback(spark, str(tmp_path)).select("id", "text", "label")
    assert sorted(map(tuple, got.collect())) == [("1", "验证码\n两行", "AD"), ("2", "验证码é", "AD"), ("3", "𠀀𠀁", "")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    (tmp_path / "e.csv").write_bytes(head.encode() + b"4,\xff\xff\n")
    with pytest.raises(ValueError, match="e.csv"):
        readers.read_csv_encoding_fallback(spark, str(tmp_path))


def test_long_files_are_decoded_in_pieces(spark, tmp_path):
    rows = [f"{k},{'验证码' * 30}{k},AD" for k in range(3000)]
    (tmp_path / "a.csv").write_bytes("\n".join(["id,text,label", *rows]).encode("gbk"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        assert readers.file_encodings(spark, str(tmp_path)).first()["encoding"] == "gbk"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.read_csv_encoding_fallback(spark, str(tmp_path)).count() == 3000


@pytest.mark.parametrize("piece", ["1000", "128m"])
def test_bad_lines_have_the_number_of_their_line(spark, tmp_path, piece):
    rng, wanted = random.Random(3), []
    for name in ("a", "b", "empty"):
        lines = []
        for k in range(0 if name == "empty" else 400):
            kind = rng.randrange(5)
            bad = '{"id": "x' + str(k) if kind == 0 else "no record"
            lines.append(json.dumps({"id": str(k), "text": "é" * rng.randrange(60)}) if kind > 1 else "" if kind == 1 and k % 2 else bad)
            if kind <= 1 and lines[-1]:
                wanted.append((name, k + 1, bad))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if lines else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        got = readers.bad_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file.rsplit("/", 1)[1][: -len(".jsonl")], r.line, r.text) for r in got) == sorted(wanted) and len(wanted) > 100
    name, line, _ = min(wanted)
    with pytest.raises(ValueError, match=rf"{name}\.jsonl:{line}: "):
        readers.checked_messages_jsonl(spark, str(tmp_path))


def test_good_files_pass(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1"}) + "\n\n")
    assert readers.bad_lines(spark, str(tmp_path)).collect() == [] and readers.checked_messages_jsonl(spark, str(tmp_path)).count() == 1


def test_word_lists_from_files_decide(spark, tmp_path):
    (tmp_path / "a.txt").write_text("zubereitung\n\n  neu im  angebot \nzubereitung\n")
    (tmp_path / "b.txt").write_text("b-word\n")
    words = readers.read_words(spark, str(tmp_path))
    assert words == ("zubereitung", "neu im  angebot", "b-word")
    rows = spark.createDataFrame([("1", "Zubereitung!"), ("2", "nothing else"), ("3", "you won mobile")], "id string, text string")
    got = {r.id: r.label for r in keyword_cascade.keyword_hi(rows, ad_words=words).collect()}
    assert got == {"1": "AD", "2": "NEEDS_REVIEW", "3": "FRAUD"}
