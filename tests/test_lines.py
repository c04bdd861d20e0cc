"""Numbered lines, torn and strict scans, and the tail of logs against a reader on the driver."""

import json
import os

import pytest

from assayer.sources import lines


@pytest.fixture
def folder(tmp_path):
    """Files of many sizes, one of which is split over tasks; some lines are torn, some blank."""
    for f, n in (("a.jsonl", 3), ("b.jsonl", 4000), ("c.jsonl", 1), ("d.jsonl", 0)):
        with open(tmp_path / f, "w", encoding="utf-8") as out:
            for i in range(n):
                said = json.dumps({"k": i, "t": "é" * (i % 50)}, ensure_ascii=False)
                out.write(("" if i % 11 == 3 else said[:-2] if i % 97 == 5 else said) + "\n")
    return tmp_path


def read(folder):
    out = {}
    for f in sorted(os.listdir(folder)):
        with open(folder / f, encoding="utf-8") as text:
            out |= {(f, i): line.rstrip("\n") for i, line in enumerate(text, 1)}
    return out


@pytest.mark.parametrize("split", ["128m", "20k"])
def test_numbers_equal_a_reader_on_the_driver(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {(os.path.basename(r.file), r.line): r.value for r in lines.numbered(spark, f"file://{folder}").collect()}
        rows, torn = lines.scan(spark, f"file://{folder}", "k long, t string")
        kept = {(os.path.basename(r.file), r.line): r.k for r in rows.collect()}
        dropped = {(os.path.basename(r.file), r.line) for r in torn.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = read(folder)
    assert got == want
    full = {at: line for at, line in want.items() if line}
    assert dropped == {at for at, line in full.items() if not line.endswith("}")} and dropped
    assert kept == {at: json.loads(line)["k"] for at, line in full.items() if at not in dropped}


def test_strict_scan_names_file_and_line(spark, folder):
    with pytest.raises(ValueError, match=r"b\.jsonl, line 6: "):
        lines.scan_strict(spark, f"file://{folder}", "k long, t string")
    os.remove(folder / "b.jsonl")
    assert lines.scan_strict(spark, f"file://{folder}", "k long, t string").count() == 4
    assert lines.scan_strict(spark, f"file://{folder}/none", "k long").count() == 0


def test_latest_line_of_the_tail(spark, tmp_path):
    with open(tmp_path / "x.log", "w", encoding="utf-8") as out:
        out.write("step 1\n" + "noise of a log\n" * 3000 + "step 2\n" + "more noise\n" * 2000)
    latest = lambda tail: [(r.line, r.value) for r in lines.latest_matching(spark, f"file://{tmp_path}", "^step", tail).collect()]
    assert latest(1 << 20) == [(3002, "step 2")]
    assert latest(22_007) == [(3002, "step 2")] and latest(22_006) == []
    assert lines.latest_matching(spark, f"file://{tmp_path}", "^none").count() == 0
