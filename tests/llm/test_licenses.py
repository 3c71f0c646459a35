"""The licence scan against a plain search, and the expression parser by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base, labels = [], set(), set()
    for phrase, label in {**li.BASE, **li.NOTICES}.items():
        p = phrase.split()
        for i in range(len(found) - len(p) + 1):
            if found[i : i + len(p)] == p:
                labels.add(label)
                if phrase in li.BASE:
                    places.append(i)
                    base.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels)


def test_phrases_equal_plain_search(spark):
    rng = random.Random(4)
    pieces = ["Under the MIT License.", "under the", "mit", "license", "Apache License, Version 2.0", "apache", "CC BY-NC 4.0", "cc", "by", "nc", "É", "wordé", "all rights reserved", "GNU General Public License, version 3", "cc-by-nc-cc-by-nc", "\n", "\x00", "cc0 1.0 universal"]
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(150)] + [None, "", "x " * 50000 + "cc by nc", "ſ under the mit licenseé", "é cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    rows = {r.doc_id: r for r in li.scan(docs, "found").collect()}
    assert len(rows) == len(texts) and rows[0].n_words == "clash"
    for i, text in enumerate(texts):
        f = rows[i].found
        assert (f.n_words, f.n_base, f.first_word, f.last_word, f.base_labels, f.labels) == slow(text)
        assert 0 <= f.score <= 1
    assert li.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("expression", "order"),
    [
        ("MIT", ["MIT"]),
        ("MIT or Apache-2.0 AND GPL-2.0-only", ["MIT", "Apache-2.0", "GPL-2.0-only", "AND", "OR"]),
        ("(MIT OR Apache-2.0) AND CC-BY-4.0", ["MIT", "Apache-2.0", "OR", "CC-BY-4.0", "AND"]),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0+", "Classpath-exception-2.0", "WITH", "MIT", "OR"]),
        ("MIT OR", None),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT Apache-2.0", None),
        ("()", None),
        ("", None),
    ],
)
def test_shunting_yard(expression, order):
    assert li.postfix(expression) == order


def test_tags(spark):
    texts = ["# SPDX-License-Identifier: MIT OR GPL-3.0-only\nmore", "/* spdx-license-identifier: (gpl-2.0-only with x-exception) and BSD-3-Clause */", "SPDX-License-Identifier MIT", "SPDX-License-Identifier: AND", "SPDX-License-Identifier: Apache-2.0 AND CC-BY-NC-4.0. under the MIT license"]
    rows = [r.licenses for r in li.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [(r.labels, r.score) for r in rows[:4]] == [(["gpl-3", "mit"], 1.0), (["bsd-3-clause", "gpl-2"], 0.7), ([], 0.5), ([], 0.5)]
    assert rows[4].labels == ["apache-2", "cc-by-nc", "mit"] and rows[4].base_labels == ["cc-by-nc", "mit"]
