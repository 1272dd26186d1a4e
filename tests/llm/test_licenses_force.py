"""License signatures one by one, and whole results against a plain search over all rules without gates."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillfind.llm import licenses


def example(pattern):
    """The shortest text that a pattern matches, with first choices."""

    def made(tree):
        out = ""
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "ANY":
                out += "x"
            elif name == "IN":
                kind, first = value[0]
                out += chr(first) if str(kind) == "LITERAL" else chr(first[0]) if str(kind) == "RANGE" else "2"
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += made(value[2]) * value[0]
            elif name == "SUBPATTERN":
                out += made(value[3])
            elif name == "BRANCH":
                out += made(value[1][0])
        return out

    return made(re._parser.parse(pattern))


def plain(text):
    """All labels by running every rule on the text, whose keywords are checked as words; containment by all pairs."""
    low = re.sub(r"[ \t\r\n]+", " ", text.lower())
    words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    words |= {m[1].decode() for m in licenses.GLUED.finditer(low.encode())}
    found = [(r.priority, m.start(), m.end(), k) for k, r in enumerate(licenses.rules()) if set(r.keywords) <= words for m in re.finditer(r.pattern, low)]

    def hidden(x):
        return any(y[1] <= x[1] and x[2] <= y[2] and (y[0] > x[0] or y[0] == x[0] and (y[2] - y[1] > x[2] - x[1] or y[2] - y[1] == x[2] - x[1] and y[3] < x[3])) for y in found)

    labels = {licenses.rules()[x[3]].label for x in found if not hidden(x)}
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.BASE for k in range(len(tokens)) if tokens[k : k + len(phrase.split())] == phrase.split()]
    starts = [p for p, _ in places]
    return len(tokens), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels | {x for _, x in places}))


def test_every_text_signature_is_found(spark):
    rows = [(k, f"Some Words, {example(p).capitalize()} and more.", label) for k, (label, _, p) in enumerate(licenses._TEXTS + licenses._NAMES)]
    bad = [(label, t) for (_, t, label), (_, _, p) in zip(rows, licenses._TEXTS + licenses._NAMES) if not re.search(p, t.lower())]
    assert not bad
    got = {x["doc_id"]: x["detections"] for x in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    names = {r.name for r in licenses.rules()}
    assert len(licenses._TEXTS) + len(licenses._NAMES) > 240 and len(names) == len(licenses.rules())
    missed = [t for k, t, _ in rows if not got[k]]
    assert not missed


def test_matches_all_rules_on_mixed_texts(spark):
    r = random.Random(13)
    pieces = [example(p) for _, _, p in licenses._TEXTS + licenses._NAMES] + ["MIT License", "apache license, version 2.0", "GPLv3", "gpl-2.0-only", "gnu general public license version 3 or later", "cc by-sa 4.0", "CC-BY", "mozilla public license 2.0", "lgplv2.1", "apache2.0"]
    rows = [(i, "  \n ".join(r.choice(pieces) if r.random() < 0.7 else "plain words here" for _ in range(r.randint(1, 12)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, rows[0][1]), (903, rows[0][1]), (None, "MIT license"), (904, "filler " * 60_000 + "the MIT license")]
    got = licenses.scan_documents(spark.createDataFrame([(*x, 1.0, "x") for x in rows], "doc_id long, text string, score double, labels string"))
    key = lambda x: (str(x[0]), str(x[1:]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    assert sorted((tuple(x) for x in got.select(*names).collect()), key=key) == sorted(((i, *plain(t or "")) for i, t in rows), key=key)
    assert got.filter((F.col("score") < 0) | (F.col("score") > 1) | ((F.col("score") > 0) != (F.col("labels") != ""))).count() == 0


def test_suppression_is_not_quadratic():
    scanner, text = licenses.Scanner(), "mit license apache license 2.0 " * 20_000
    present = set(scanner.number.values())
    began = time.perf_counter()
    assert len(scanner.detect(text, present)) == 40_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("text", ["Permission is hereby granted, free\n    of  charge,\tto any person obtaining a copy"])
def test_runs_of_blanks(spark, text):
    assert licenses.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == "mit"
