import re

from quillfind.llm import licenses

GLUED = {
    "GPLv3": "gpl-3.0", "GPLv2": "gpl-2.0", "LGPLv2.1": "lgpl-2.1", "MPLv2": "mpl-2.0", "Apache2.0": "apache-2.0", "(AGPL3)": "agpl-3.0", "GPLv3plus": "gpl-3.0",
    "WTFPLv2": "wtfpl",
}
SENTENCES = {
    "licensed under the\r\n   Apache  License,\n\tVersion 2.0 (the \"License\")": "apache-2.0",
    "permission is hereby granted, free of charge, to\r\nany person  obtaining a copy": "mit",
    "either version 3 of the License, or (at your option) any\n    later version": "gpl-or-later",
    "under the terms of the gnu lesser general public license as published": "lgpl",
}


def test_glued_versions_and_runs_of_blanks(spark):
    forms = {**GLUED, **SENTENCES}
    texts = [f"é  see {x} here" for x in forms] + ["permit  licenses", "l", "gplv3"]
    got = [r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    for r, (form, label) in zip(got, forms.items()):
        assert label in r["labels"].split(","), (form, r["labels"])
        at = next(d for d in r["detections"] if d["label"] == label)
        assert form.lower().strip("(").startswith(texts[r["doc_id"]][at["start"] : at["end"]].lower()[:3])
        assert re.sub(r"\s", "", texts[r["doc_id"]][at["start"] : at["end"]]) in re.sub(r"\s", "", texts[r["doc_id"]])
    assert [r["labels"] for r in got[-3:]] == ["", "", "gpl-3.0"]


def test_gate_passes_all_that_rules_match():
    whole = licenses.Scanner()
    for name, rule in ((r.name, r) for r in whole.rules if r.name.startswith("id-") and not r.name.startswith("id-cc")):
        stem, version = rule.label.rsplit("-", 1)
        for form in (f"{stem}{version}", f"{stem}v{version}", f"{stem}-{version}", f"{stem} v{version}"):
            import numpy as np

            data = np.frombuffer(form.encode(), np.uint8)
            (row,) = whole.scan(data, np.array([0, len(data)]))
            assert (rule.label in row[5].split(",")) == bool(re.search(rule.pattern, form)), (name, form)
