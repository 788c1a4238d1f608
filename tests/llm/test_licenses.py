import math
import re

import pytest

from webloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, base = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    met, best = set(), 0.0
    for label, t in licenses.TEMPLATES:
        every = WORD.findall(t.lower())
        tp, half = set(zip(every, every[1:])), 32
        while half < len(every):
            half *= 2
        for s in range(0, max(len(w) - 1, 1), half):
            part = w[s : s + 2 * half]
            both = len(tp & set(zip(part, part[1:])))
            if both >= math.ceil(licenses.THRESHOLD * len(tp) - 1e-9):
                met.add(label)
                best = max(best, both / len(tp))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), 1.0 if at else best


def same(got, want):
    return tuple(got)[1:-1] == want[:-1] and got.score == pytest.approx(want[-1])


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        assert same(got[r.doc_id], plain(r.text)), r.doc_id
    assert any(r.labels for r in got.values())


def test_edges(spark, edge_docs, empty_docs):
    more = [
        (20, "MIT License mit-license APACHE  license, general public license general public"), (21, "licensed under GNU general public v3 this work license is"),
        (22, ("pad " * 40) + "Released UNDER the MIT " + "License"), (23, "permission " * 70 + "all rights reserved"), (24, "mit"), (25, "License"), (25, "License"),
    ]
    mit = dict(licenses.TEMPLATES)["text:mit"]
    more += [
        (30, "pad " * 333 + mit + " pad" * 500), (31, mit.upper().replace("SOFTWARE", "PROGRAM").replace("PERMISSION", "leave")), (32, " ".join(mit.split()[::2])),
        (33, "released under the BSD license"), (34, "Released under the Apache License, Version 2.0"), (35, "all of the guests reserved a room and the rights went to the owner"),
        (36, "All rights  RESERVED."), (37, " ".join(reversed(mit.split()))), (38, dict(licenses.TEMPLATES)["text:gpl-notice"] + " " + dict(licenses.TEMPLATES)["text:zlib"]),
    ]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = licenses.scan(docs.withColumn("words", docs["text"]).withColumn("label", docs["text"])).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert same(r, plain(texts[r.doc_id])), r
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[30] == labels[31] == "text:mit" and "text:mit" not in labels[32]
    assert (labels[33], labels[34], labels[35], labels[36]) == ("", "apache,notice:apache-2.0", "", "notice:reserved")
    assert labels[38] == "gpl,text:gpl-notice,text:zlib"
    assert licenses.scan(empty_docs).count() == 0


def test_near_texts_and_notices(spark):
    """Edited licenses and near notices are met with a score under 1; neither a sentence of a license's words nor another license is."""
    t = dict(licenses.TEMPLATES)
    plain_sentence = " for research use with data that the author provided; regard all results with care, as loss of special data can appear in it"
    edited = lambda text, every: " ".join(w for i, w in enumerate(text.split()) if i % every)
    rows = [(i, f"intro {i} " + edited(t[label], 17) + " outro") for i, label in enumerate(("text:mit", "text:bsd", "text:isc", "text:zlib", "text:unlicense"))]
    rows += [(10, t["text:mit"] + plain_sentence), (11, t["text:isc"].replace("THE AUTHOR", "THE HOLDER")), (12, "This work is licensed under the GNU General Public License, version 2"), (13, "It is licensed under the Apache Software License, version 2.0, they say")]
    rows += [(14, "the license was released under the name of a public work, all in general"), (15, edited(t["text:mit"], 3))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(("text:mit", "text:bsd", "text:isc", "text:zlib", "text:unlicense")):
        assert got[i].labels == label and 0.8 <= got[i].score < 1
    assert got[10].labels == "text:mit" and got[10].score == 1.0 and got[11].labels == "text:isc" and 0.8 < got[11].score < 1
    assert got[12].labels == "gpl,notice:gpl-3" and got[13].labels == "notice:apache-2.0" and 0.8 <= got[13].score < 1
    assert got[14].labels == "" and got[15].labels == ""


def test_any_template(spark):
    """Templates of any length and number: one of thousands of words, and many short ones."""
    long = " ".join(f"clause{i} of the agreement" for i in range(400))
    given = [("long", long), ("none", " ,. "), *((f"s{i}", f"grant {i} stands") for i in range(60))]
    docs = spark.createDataFrame([(1, "x " * 700 + long), (2, " ".join(long.split()[: int(len(long.split()) * 0.7)])), (3, "the grant 17 stands, grant 18 falls"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs, given).collect()} == {1: "long", 2: "", 3: "s17", 4: ""}
