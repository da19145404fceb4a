"""Reading encounters and publishing messages."""

import json

from caretide.sources.messages import publish
from caretide.sources.tables import read_encounters


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    good = [{"patient_id": f"e{i}", "encounter_text": "t"} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('[{"patient_id": "e9", "encounter_text": ')
    ok, rejects = read_encounters(spark, str(tmp_path))
    assert sorted(r["patient_id"] for r in ok.collect()) == ["e0", "e1", "e2"]
    assert rejects.count() == 1 and "e9" in rejects.first()["record"]


def test_published_messages_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1, None), ("e2", None, "x")], "encounter_id string, n int, note string")
    publish(rows, "text", {"path": str(tmp_path / "topic")}, "encounter_id")
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "topic")).collect()]
    assert sorted(got, key=lambda r: r["encounter_id"]) == [{"encounter_id": "e1", "n": 1, "note": None}, {"encounter_id": "e2", "n": None, "note": "x"}]
