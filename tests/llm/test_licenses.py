import math
import re
from collections import Counter

from tests.llm.brute import alnum_words
from tidelog.llm.licenses import FULL_TEXTS, TEMPLATES, THRESHOLD, scan_licenses

KNOWN = TEMPLATES + FULL_TEXTS

PROSE = "Some words that are about nothing at all\nand go on for a while in lines of their own\n"


def plain(docs):
    """TF-IDF cosine of every line, sentence, paragraph and whole text to every template."""
    words = {w for _, t in KNOWN for w in alnum_words(t)}
    df = Counter(w for _, t in docs for w in set(alnum_words(t)))
    weight = lambda w: math.log((len(docs) + 1) / (df[w] + 1)) + 1
    idf = {w: weight(w) for w in words}
    others = [w for w in df if w not in words]
    other = sum(df[w] * weight(w) for w in others) / sum(df[w] for w in others)
    out = []
    for _, text in docs:
        matches = []
        paragraphs = (text or "").split("\n\n")
        sentences = [s for p in paragraphs for s in re.split(r"[.!?](?=[ \t-\r])", p)]
        for u in [*(text or "").split("\n"), *sentences, *paragraphs, text or ""]:
            c = Counter(alnum_words(u))
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items() if w in words) + other**2 * sum(n for w, n in c.items() if w not in words))
            cosines = []
            for name, t in KNOWN:
                v = Counter(alnum_words(t))
                dot = sum(n * idf[w] * c[w] * idf[w] for w, n in v.items())
                if norm:
                    cosines.append((-round(dot / norm / math.sqrt(sum((n * idf[w]) ** 2 for w, n in v.items())), 9), name, -sum(v.values())))
            if cosines and -min(cosines)[0] >= THRESHOLD:
                cosine, name, n = min(cosines)
                matches.append((n, cosine, name))
        out.append(min(matches)[2] if matches else None)
    return out


def rows():
    docs = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/x.txt", PROSE),
        ("a/b/y.txt", "Released under the MIT License.\n" + PROSE),
        ("a/b/c/z.txt", PROSE),
        ("a/b/LICENSE", "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License\n"
         "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        ("ab/x.txt", PROSE),
        ("top.txt", None),
        (None, PROSE),
        (None, "All rights reserved."),
        ("a/empty.txt", ""),
        ("q/w.txt", PROSE * 300 + "Licensed under CC BY-NC 4.0.\n" + PROSE * 300),
        ("q/v.txt", "the license of the version is free and public, as the terms say"),
        ("a/x.txt", PROSE),
    ]
    return [(k, p, t, "clash") for k, (p, t) in enumerate(docs)]


def result(spark, data):
    df = spark.createDataFrame(data, "doc_id long, path string, text string, license string")
    return {r["doc_id"]: (r["license"], r["inherited"], r["inherited_from"]) for r in scan_licenses(df).collect()}


def test_own_and_inherited(spark):
    got = result(spark, rows())
    assert got == {
        0: ("Apache-2.0", False, None), 1: ("Apache-2.0", True, "a"), 2: ("MIT", False, None), 3: ("GPL-3.0", True, "a/b"), 4: ("GPL-3.0", False, None),
        5: (None, False, None), 6: (None, False, None), 7: (None, False, None), 8: ("LicenseRef-proprietary", False, None), 9: ("Apache-2.0", True, "a"),
        10: ("CC-BY-NC-4.0", False, None), 11: (None, False, None), 12: ("Apache-2.0", True, "a"),
    }


def test_matches_plain_cosine(spark):
    data = rows()
    own = {i: lic if not inherited else None for i, (lic, inherited, _) in result(spark, data).items()}
    assert [own[i] for i, *_ in data] == plain([(p, t) for _, p, t, _ in data])


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_versions_and_variants_are_told_apart(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cases = [
        (notice.format("", 2), "GPL-2.0"), (notice.format("", 3), "GPL-3.0"), (notice.format("Lesser ", 3), "LGPL-3.0"), (notice.format("Affero ", 3), "AGPL-3.0"),
        (notice.format("", 9), None), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: BSD-4-Clause", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ]
    got = result(spark, [(k, f"d{k}/x", t, "") for k, (t, _) in enumerate(cases)])
    assert [got[k][0] for k in range(len(cases))] == [name for _, name in cases]


def test_ties_go_by_name_and_whole_conditions_before_lines(spark):
    one, two = "Released under the MIT License.", "Licensed under CC BY 4.0."
    full = dict(FULL_TEXTS)
    first_line = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    wrapped = lambda text: "Copyright (c) 2024 Jane Doe\n\n" + text.replace(": 1. ", ":\n\n1. ").replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. ").replace(" THIS ", "\n\nTHIS ")
    cases = [(f"{one}\n\n{two}\n", None), (f"{two}\n\n{one}\n", None), (f"All rights reserved.\n{one}", "MIT")]
    cases += [(wrapped(full[name]), name) for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "0BSD", "Zlib", "Unlicense", "Apache-2.0")]
    assert wrapped(full["BSD-2-Clause"]).split("\n")[2] == first_line
    got = result(spark, [(k, f"d{k}/LICENSE", t, "") for k, (t, _) in enumerate(cases)] + [(100 + k, f"d{k}/x/y.txt", PROSE, "") for k in range(3, len(cases))])
    assert got[0] == got[1] and got[0][0] in ("MIT", "CC-BY-4.0")
    assert [got[k][0] for k in range(2, len(cases))] == [name for _, name in cases[2:]]
    # the license files cover what lies below
    assert [got[100 + k] for k in range(3, len(cases))] == [(name, True, f"d{k}") for k, (_, name) in enumerate(cases) if k > 2]


def test_order_in_a_text_decides_nothing(spark):
    notices = [t for _, t in TEMPLATES]
    pairs = [(a, b) for k, a in enumerate(notices) for b in notices[k + 1 :: 5]]
    docs = [(k, None, f"{x}\n\n{y}", "") for k, (a, b) in enumerate(pairs) for x, y in ((a, b),)]
    docs += [(10_000 + k, None, f"{b}\n\n{a}", "") for k, (a, b) in enumerate(pairs)]
    got = result(spark, docs)
    assert all(got[k][0] == got[10_000 + k][0] for k in range(len(pairs)))


HELD = [("Copyright (c) 2023 Acme Corporation. All rights reserved.", "LicenseRef-proprietary"), ("Copyright (c) 2021 Jane Doe. Released under the MIT License.", "MIT")]


def test_holders_and_years_beside_a_notice(spark):
    got = result(spark, [(k, None, t, "") for k, (t, _) in enumerate(HELD)] + [(100 + k, None, PROSE, "") for k in range(50)])
    assert [got[k][0] for k in range(len(HELD))] == [name for _, name in HELD]
    assert all(got[100 + k][0] is None for k in range(50))


def test_the_number_of_documents_decides_nothing(spark):
    texts = [t for t, _ in HELD] + ["Released under the MIT License by Jane", "the GNU Lesser General Public License, version 3, for this file", PROSE, "All rights reserved by Acme"]
    scanned = []
    for times in (50, 2000):
        rows = [(k, None, t, "") for k, t in enumerate(texts * times)]
        df = spark.createDataFrame(rows, "doc_id long, path string, text string, license string")
        scanned.append({r["doc_id"]: (r["license"], r["similarity"]) for r in scan_licenses(df, threshold=0.5).where(f"doc_id < {len(texts)}").collect()})
    assert all(scanned[0][k][0] == scanned[1][k][0] for k in range(len(texts)))
    assert any(x[0] for x in scanned[0].values())
    assert all(abs((scanned[0][k][1] or 0) - (scanned[1][k][1] or 0)) < 0.01 for k in scanned[0])
