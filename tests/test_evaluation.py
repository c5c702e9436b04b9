"""Evaluation records: JSON round trip and the scoring rules.

The records are made up from the micro panel of ``test_micro_panel.py``."""

import json
import os
import tempfile

from periodix.operators import evaluation as EV

RECORDS = {
    "total_tests": 3,
    "timestamp": "2031-05-06T07:08:09",
    "tests": [
        {"question": "Market NPL ratio of 2024?", "answer": "Context:\n2024: 3 firms, NPL 16.00%",
         "expected": "16.0", "type": "numerical"},
        {"question": "Which firm was biggest in 2024?", "answer": "no. 1 is firm a, then firm b",
         "expected": "Firm A", "type": "text"},
        {"question": "Both segments side by side, year 2024?", "answer": "10.0 against 20.0",
         "expected": "any text", "type": "analytical"},
    ],
}


def test_read_score_write(spark):
    d = tempfile.mkdtemp(prefix="periodix-eval-")
    src = os.path.join(d, "run.json")
    with open(src, "w") as fh:
        json.dump(RECORDS, fh, indent=1)
    recs = EV.read_evaluation(spark, src)
    assert recs.count() == 3
    scored = {r["type"]: r["passed"] for r in EV.score(recs).collect()}
    assert scored == {"numerical": True, "text": True, "analytical": True}
    acc = {r["type"]: (r["n_tests"], r["n_passed"]) for r in EV.accuracy(EV.score(recs)).collect()}
    assert acc["all"] == (3, 3) and acc["text"] == (1, 1)
    out = os.path.join(d, "out")
    EV.write_evaluation(recs, out)
    again = EV.read_evaluation(spark, out)
    assert sorted(r["question"] for r in again.collect()) == sorted(t["question"] for t in RECORDS["tests"])


def test_score_failures(spark):
    rows = [("q1", "NPL was 17.1%", "16.0", "numerical"), ("q2", "nobody", "Firm A", "text"),
            ("q3", "   ", "any text", "analytical"), ("q4", None, "x", "numerical"),
            ("q5", "15,995", "16.0", "numerical")]
    df = spark.createDataFrame(rows, "question STRING, answer STRING, expected STRING, type STRING")
    got = {r["question"]: r["passed"] for r in EV.score(df).collect()}
    assert got == {"q1": False, "q2": False, "q3": False, "q4": False, "q5": True}


def test_repeated_questions_do_not_multiply(spark):
    answers = spark.createDataFrame([(1, "same?", "a"), (2, "same?", "b")], "qid INT, question STRING, answer STRING")
    expected = spark.createDataFrame([(1, "a", "text"), (2, "c", "text")], "qid INT, expected STRING, type STRING")
    got = {r["qid"]: r["passed"] for r in EV.score(EV.attach_expected(answers, expected)).collect()}
    assert got == {1: True, 2: False}


def test_faulty_documents_and_bounded_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(EV, "DOCUMENT_TESTS", 7)
    runs = [("t1", f"q{n}", "a", "b", "text") for n in range(40)] + [("t2", "q", None, "b", "text")] * 3
    columns = "timestamp STRING, question STRING, answer STRING, expected STRING, type STRING"
    out = tmp_path / "out"
    EV.write_evaluation(spark.createDataFrame(runs, columns), str(out))
    written = [json.loads(x) for f in out.glob("*.json") for x in open(f)]
    assert sum(d["total_tests"] for d in written) == 43 and max(len(d["tests"]) for d in written) <= 7
    mixed = "\n".join([json.dumps(RECORDS), '{"tests": [{"question"', "", '{"other": 1}', json.dumps(RECORDS)])
    (out / "mixed.json").write_text(mixed)
    (out / "indented.json").write_text(json.dumps(RECORDS, indent=2))
    (out / "cut.json").write_text(json.dumps(RECORDS, indent=2)[:60])
    records, faulty = EV.parse_evaluation(spark, str(out))
    got = sorted((r["timestamp"], r["question"]) for r in records.collect())
    assert got == sorted([r[:2] for r in runs] + 3 * [(RECORDS["timestamp"], t["question"]) for t in RECORDS["tests"]])
    assert sorted(os.path.basename(r["file"]) for r in faulty.collect()) == ["cut.json", "mixed.json", "mixed.json"]


def test_question_ids_do_not_depend_on_splits(spark, tmp_path):
    """Ids are those of file and byte offset, for any size of split."""
    import hashlib

    from periodix.sources.sinks import read_questions

    lines = ["who leads?", "", "\u043a\u0442\u043e?", "who leads?", " ", "x" * 300, "crlf?\r", "last"]
    path = tmp_path / "q.txt"
    path.write_bytes("\n".join(lines).encode())
    want, at = {}, 0
    for line in lines:
        if line.strip(" \r"):
            want[at] = line.rstrip("\r")
        at += len(line.encode()) + 1
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    try:
        for size in ("5", "17", "100", "1m"):
            spark.conf.set(conf, size)
            rows = read_questions(spark, str(path)).collect()
            uri = spark.read.text(str(path)).select("_metadata.file_path").first()[0]
            assert {r["qid"]: r["question"] for r in rows} == {
                hashlib.sha256(f"{uri}\0{k}".encode()).hexdigest(): v for k, v in want.items()}
            assert len(rows) == len(want)
    finally:
        spark.conf.set(conf, before)
