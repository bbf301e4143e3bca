"""What is wrong with a platform's landings is found in one scan of them."""

import json

from hirelens.plans import collection


def test_faults_in_reading_need_one_scan(spark, tmp_path):
    payloads = {
        "A": {"jobs": [None, {"id": 1}, "x"], "meta": {"total": 5}}, "B": {"jobs": [], "meta": {"total": 0}}, "C": {"meta": {"total": 1}},
        "D": {"jobs": [{"id": 1}]}, "E": {"jobs": [{"id": 1}], "meta": {"total": 2}},
    }
    for company, payload in payloads.items():
        folder = tmp_path / "ats=Greenhouse" / f"company={company}" / "run=r1"
        folder.mkdir(parents=True)
        (folder / "drop.json").write_text(json.dumps(payload), encoding="utf-8")
    _, faults = collection._platform(spark, str(tmp_path), "Greenhouse", "r1", "2026-01-02T00:00:00Z", True)
    rows = sorted((r["company"], r["kind"], r["place"], r["error"]) for fault in faults for r in fault.collect())
    assert rows == [
        ("A", collection.ODD_ITEM, 0, "item 1 is no object"), ("A", collection.ODD_ITEM, 2, "item 3 is no object"),
        ("A", collection.WRONG_TOTAL, 0, "5 postings declared, 3 held"),
        ("C", collection.UNREADABLE, 0, 'not the payload that was expected: {"meta":{"total":1}}'),
        ("E", collection.WRONG_TOTAL, 0, "2 postings declared, 1 held"),
    ]
    plans = "".join(fault._jdf.queryExecution().executedPlan().toString() for fault in faults)
    assert plans.count("FileScan json") == 1
