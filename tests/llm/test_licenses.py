import pytest

from pagewright.llm import licenses as L

CASES = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("at http://www.apache.org/licenses/LICENSE-2.0 .", "Apache-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ('BSD 3-Clause "New" or "Revised" License', "BSD-3-Clause"),
    ("GNU Lesser General Public License v2.1", "LGPL-2.1"),
    ("Permission is hereby granted, free of\ncharge, to any person obtaining a copy", "MIT"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "CC0-1.0"),
]


def test_there_are_hundreds():
    assert len(L.rules()) >= 300 and len({r.rule_id for r in L.rules()}) == len(L.rules())


@pytest.mark.parametrize("text, license_id", CASES)
def test_detects(text, license_id):
    assert [L.rules()[n].license_id for *_, n in L.detect(text)] == [license_id]


def test_clean_texts():
    for t in ("", "Mit der Lizenz zum Lesen", "the public was permitted to redistribute flyers", "MIT is a school", "copyright is a word"):
        assert L.detect(t) == []


def test_every_match_has_its_keyword(spark, sf_dir):
    """What the keywords let through gives all that running every rule gives."""
    texts = [t for t, _ in CASES] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in texts:
        low = t.encode().lower()
        assert L.detect(t, {r.keyword for r in L.rules() if r.keyword.encode() in low}) == L.detect(t)


def test_containment():
    spans = L.detect("Licensed under the Apache License, Version 2.0 and the Apache License, Version 2.0")
    assert len(spans) == 2
    assert all(not (a <= c and d <= b) for k, (a, b, _) in enumerate(spans) for j, (c, d, _) in enumerate(spans) if j != k)


def test_scan_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, L.rules()[n].rule_id, s, e) for r in docs.collect() for s, e, n in L.detect(r.text))
    got = L.scan(docs).collect()
    assert sorted((r.doc_id, r.rule_id, r.start, r.stop) for r in got) == want
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id][r.start : r.stop] == r.matched for r in got)


def test_edges(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "é" * 10 + CASES[2][0], "k"), (3, CASES[0][0], "k"), (None, CASES[1][0], "k"), (4, "x " * 500_000 + CASES[3][0], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = L.scan(docs).collect()
    assert sorted(((r.doc_id, r.license_id) for r in got), key=str) == sorted([(3, "MIT"), (3, "GPL-3.0"), (None, "CC-BY-NC-4.0"), (4, "Apache-2.0")], key=str)
    assert L.scan(docs.limit(0)).count() == 0


def test_resolving_against_slow():
    """Priority first, then length, then the rule's number, then the place; what holds or is held by one taken goes."""
    import random

    rnd = random.Random(4)
    rules = [r for r, _ in L.compiled()]
    for _ in range(300):
        found = []
        for _ in range(rnd.randrange(1, 9)):
            s = rnd.randrange(0, 20)
            found.append((s, s + rnd.randrange(1, 12), rnd.randrange(len(rules))))
        left, want = list(found), []
        while left:
            best = left[0]
            for f in left[1:]:
                a, b = (rules[f[2]].priority, f[1] - f[0], -f[2], -f[0]), (rules[best[2]].priority, best[1] - best[0], -best[2], -best[0])
                best = f if a > b else best
            want.append(best)
            left = [f for f in left if not (best[0] <= f[0] and f[1] <= best[1]) and not (f[0] <= best[0] and best[1] <= f[1])]
        assert L.resolve(found) == sorted(want)
