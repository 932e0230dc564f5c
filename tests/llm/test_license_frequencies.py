"""Licence lines and paragraphs by the TF-IDF of all their words, against a plain version; whole licence files and null paths."""

import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from strophic.llm import licenses


def plain(texts):
    """Best (similarity, licence) of each text, or (None, None)."""
    parts = [[(x, False) for x in t.lower().split("\n")] + [(x, True) for x in re.split(r"\n[ \t\r]*\n", t.lower()) if "\n" in x] for t in texts]
    flags = [[paragraph for x, paragraph in own if re.search("[a-z0-9]", x)] for own in parts]
    bags = [[set(w) for x, _ in own if (w := re.findall("[a-z0-9]+", x))] for own in parts]
    n, df = sum(map(len, bags)), Counter(w for lines in bags for x in lines for w in x)
    square = lambda words: sum((math.log((1 + n) / (1 + df[w])) + 1) ** 2 for w in words)
    out = []
    for lines, paragraphs in zip(bags, flags):
        found = [(round(square(x & own) / math.sqrt(square(x) * square(own)), 6), -k, name) for x, paragraph in zip(lines, paragraphs) for k, (name, kind, t) in enumerate(licenses.TEMPLATES) if not (paragraph and kind == "notice") and (own := set(licenses.terms(t)))]
        similarity, _, name = max(found, default=(0, 0, None))
        out.append((similarity, name) if similarity >= licenses.SIMILAR else (None, None))
    return out


def test_common_words_weigh_little(spark):
    common = [f"page copyright 2024 acme corp unless noted otherwise x{k % 5}" for k in range(400)]
    lone = [f"zq{k} wq{k} vq{k} uq{k} tq{k}" for k in range(60)]
    notices = [
        "Copyright 2024 Acme Corp. Licensed under the Apache License, Version 2.0", "Copyright 2024 Acme Corp\nreleased under the MIT License unless noted otherwise",
        "Copyright qqqa wwwb eeec rrrd tttf yyyg Licensed under the Apache License", "SPDX-License-Identifier: MIT", "the license", "acme corp MIT License 2024",
    ]
    texts = common + lone + notices * 2
    rows = [(k, f"d{k}/x", t) for k, t in enumerate(texts)] + [(9999, "e/x", None)]
    found = {r.doc_id: (r.similarity, r.own_license) for r in licenses.report(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3), F.col("path")).collect()}
    expected = plain([t or "" for *_, t in rows])
    assert [found[k] for k, *_ in rows] == expected
    assert {"Apache-2.0", "MIT"} <= {name for _, name in expected} and (None, None) in expected
    n, df = 400 + 60 + 14 + 2, 400  # with idf of df = 0 for words outside the templates the second one is lost
    assert expected[460] != (None, None) and math.log((1 + n) / (1 + df)) + 1 < 1.2


def whole(name, width=70):
    """A licence file: its title and paragraphs, wrapped."""
    parts = [t for own, kind, t in licenses.TEMPLATES if own == name and kind in ("title", "text")]
    return "\n\n".join(["\n".join(textwrap.wrap(t, width)) for t in [parts[0], "Copyright (c) 2024 Some Holder", *parts[1:]]])


def test_whole_files_hold_below(spark):
    prose = " ".join(f"w{k % 97} the of and in" for k in range(200))
    apache = "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n" + "\n\n".join(f"{k}. Section about w{k} and the other terms {prose[:300]}" for k in range(9))
    untitled = "\n\n".join(whole("MIT").split("\n\n")[1:])
    rows = [(1, "a/LICENSE", whole("MIT")), (2, "a/b/x", prose), (3, "c/LICENSE", whole("BSD-3-Clause")), (4, "c/y", prose), (5, "e/LICENSE", apache), (6, "e/f/g/z", prose), (7, "h/COPYING", untitled), (8, "h/u", prose),
            (9, None, whole("GPL-3.0")), (10, None, prose), (11, "top", prose), (12, "i/only", "Released under the MIT License\n" + prose), (13, "i/other", prose), (14, "a/LICENSE.txt", whole("MIT"))]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit("mine") for c in ("units", "words", "row", "directory", "license")})
    found = {r.doc_id: r for r in licenses.report(df.repartition(3), F.col("path")).collect()}
    assert len(found) == len(rows)
    assert {k for k, r in found.items() if r.is_file} == {1, 3, 5, 7, 9, 14}
    assert {k: found[k].license for k in (2, 4, 6, 8)} == {2: "MIT", 4: "BSD-3-Clause", 6: "Apache-2.0", 8: "MIT"}
    assert found[6].license_from == "e" and found[9].own_license == "GPL-3.0"
    assert [found[k].license for k in (10, 11, 13)] == [None, None, None] and found[12].license == "MIT"
