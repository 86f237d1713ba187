import random
import re

import duckdb
import oracle
import pyarrow as pa
import pytest
from cases import documents, nothing
from pyspark.sql import functions as F

from lakewright.llm import license_rules, mixing, quality_rules, sql
from lakewright.session import table

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def planted(spark):
    rows = [(1, "The MIT License, see Apache License 2.0."), (2, "GNU General Public License v3; mit license mit LICENSE"), (3, "permit license"), (4, "summit  licenses"), (5, "MIT\n(license)"), (6, "mité license")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("make", [planted, documents, nothing, lambda s: table(s, "/root/testdata/sf0.001", "documents")])
def test_base_columns(spark, make):
    d = make(spark)
    want = []
    for r in d.select("doc_id", "text").collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = {k: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for k, p in BASE.items()}
        places = sorted(i for v in at.values() for i in v)
        want.append((r.doc_id, len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, v in at.items() if v))))
    got = license_rules.contract(d).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def sample(rng, parsed):
    """A string that the parsed pattern matches, lookarounds left out."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            out += "x" if str(arg[0][0]) == "NEGATE" else rng.choice([chr(c) for k, v in arg for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            out += "".join(sample(rng, inner) for _ in range(rng.randint(least, min(int(most), least + 3))))
        elif name == "SUBPATTERN":
            out += sample(rng, arg[-1])
        elif name == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        else:
            assert name == "ASSERT", name
    return out


def signatures():
    rng = random.Random(4)
    return [(rule, {sample(rng, re._parser.parse(rule[4])) for _ in range(12)}) for rule in license_rules.RULES]


def test_each_match_passes_the_gate_and_holds_its_keyword():
    for (_, key, _, _, pattern), samples in signatures():
        for s in samples:
            assert re.search(pattern, f" {s} ") and key in s and re.search(license_rules.GATE, s.upper().replace(" ", "\n-")), (key, s)


def test_gated_results_are_the_ungated(spark, monkeypatch):
    texts = [f"a text, {s}." for _, samples in signatures() for s in sorted(samples)[:2]] + ["Released under GPLv2.", "Creative Commons Attribution Share Alike license", "GNU Library General Public License", "nothing here", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gated = sorted(map(tuple, license_rules.contract(d).collect()))
    monkeypatch.setattr(license_rules, "GATE", "^")
    monkeypatch.setattr(license_rules, "RULES", tuple((label, "", *rest) for label, _, *rest in license_rules.RULES))
    assert gated == sorted(map(tuple, license_rules.contract(d).collect()))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under GPLv2.", "gpl-2.0"),
        ("License: GPL3", "gpl-3.0"),
        ("Creative Commons Attribution Share Alike license", "cc-by-sa"),
        ("Creative Commons Attribution Non-Commercial License", "cc-by-nc"),
        ("GNU Library General Public License", "gpl,lgpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that", "bsd"),
        ("Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ],
)
def test_names_and_bodies(spark, text, labels):
    assert license_rules.contract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def boilerplate_rows(spark):
    """A host whose documents share lines, copies among them; one host is null, some ids are null or repeat."""
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice("abcdefghij") * 3 for _ in range(n))
    shared = ["Home | About  us", "home | about us ", "Terms of use", "Copyright 2020 Example"]
    rows = [(i % 140 if i % 50 else None, "\n".join([rng.choice(shared), line(rng.choice([3, 60])), rng.choice(shared + ["", " ", line(4)]), line(2)]), "en", rng.choice(["a", "b", None])) for i in range(400)]
    rows += [(1000 + i, "one copied line of words\n" + "another copied line " * 20, "en", "c") for i in range(60)] + [(2000 + i, line(70), "en", "c") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("make", [boilerplate_rows, documents, nothing])
def test_sql_operators_on_edge_rows(spark, make):
    d = make(spark)
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[c] for r in d.collect()], pa.int64() if c == "doc_id" else pa.string()) for c in ("doc_id", "text", "lang", "source")}))
    assert oracle.compare(mixing.mixture(d), con, sql.MIXING_SQL) == ""
    assert oracle.compare(quality_rules.verdicts(d), con, sql.QUALITY_RULES_SQL) == ""


def test_boilerplate_counts_documents(spark):
    rows = [(i, "same line here\n" + f"own {i} " * 40, "h") for i in range(30)] + [(100 + i, f"other {i} words " * 30 + "\nsame copy", "h") for i in range(3)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert found[0].clean_text == "own 0 " * 40 and found[100].removed_chars == 0
    copies = spark.createDataFrame([(i, "a copied line\n" + "w " * 60, "h") for i in range(40)], "doc_id long, text string, source string")
    assert {r.removed_chars for r in quality_rules.judge(copies).collect()} == {71}
    assert {r.removed_chars for r in quality_rules.judge(copies, once_per_text=True).collect()} == {0}


def test_repeated_documents_keep_line_ends_and_lengths(spark):
    rows = [(i, "x" if i % 3 else "y", f" one two\n{i} three\tfour  five\n", 0) for i in range(61)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    plan = mixing.mix(d)
    got = mixing.repeat_documents(d, plan).collect()
    assert all(r.n_chars == len(r.text) and f" one two\n{r.doc_id} three\tfour  five\n".startswith(r.text) for r in got)
    due, have = {r.doc_id: r.taken for r in plan.collect()}, dict.fromkeys(range(61), 0)
    for r in got:
        have[r.doc_id] += len(r.text.split())
    assert have == due and any(n % 6 for n in due.values())


def brute_detections(text):
    """All rules' matches in word numbers, those gone that another of no lower priority contains."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    padded = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = []
    for no, (label, key, priority, sure, pattern) in enumerate(license_rules.RULES):
        if key in padded:
            for m in re.finditer(pattern, padded):
                s = padded[: m.start()].count(" ") - 1
                found.append((s, s + m.group().count(" "), priority, no, sure, label))
    kept = []
    for i, x in enumerate(found):
        if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:3] != x[:3] or (y[3], j) < (x[3], i)) for j, y in enumerate(found) if j != i):
            kept.append((x[0], x[1], x[2], x[4], x[5]))
    return sorted(kept)


def test_labels_priority_and_containment(spark, monkeypatch):
    monkeypatch.setattr(license_rules, "PART", 3)
    rng = random.Random(12)
    pool = [s for _, samples in signatures() for s in sorted(samples)[:2]]
    texts = [", ".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["Licensed under the MIT License. See the MIT License for details.", "SPDX-License-Identifier: GPL-2.0-or-later", None, ""]
    got = {r.doc_id: r for r in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute_detections(t)
        assert sorted(tuple(x) for x in got[i].detections) == want, t
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(base | {x[4] for x in want}))
        assert got[i].score == max([x[3] for x in want] + [0.6 * bool(base)])


def test_time_grows_with_the_text(spark):
    rows = [(n, "mit license " * n) for n in (1, 2000, 64000)]
    got = {r.doc_id: r for r in license_rules.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((r.n_words, r.n_base, r.first_word, r.last_word) == (2 * n, n, 0, 2 * n - 2) for n, r in got.items())


NAMED = [
    ("GNU GPLv3", {"gpl-3.0"}),
    ("SPDX-License-Identifier: EPL-2.0", {"epl-2.0"}),
    ("SPDX-License-Identifier: BSL-1.0", {"bsl-1.0"}),
    ("BSD-2-Clause license", {"bsd-2-clause"}),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0"}),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
    ("License: LGPLv3", {"lgpl-3.0"}),
    ("see LGPLv3 and AGPLv3", {"lgpl-3.0", "agpl-3.0"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("the 2 apaches and 3 gnus, a bsd host, mit students", set()),
]


def test_identifiers_expressions_and_bare_names(spark):
    found = {r.doc_id: r for r in license_rules.contract(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMED)], "doc_id long, text string")).collect()}
    for i, (text, labels) in enumerate(NAMED):
        assert (set(filter(None, found[i].labels.split(","))), found[i].score > 0) == (labels, bool(labels)), text
