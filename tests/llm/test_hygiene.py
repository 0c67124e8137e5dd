"""URL rules, fingerprints, personal data and licenses."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from gridsmith.llm import fingerprints, licenses, pii, urlrules
from gridsmith.llm.shingles import shingle_set


def fits(rule, host, path):
    return (host == rule[1] or host.endswith("." + rule[1])) and path.startswith(rule[2])


@pytest.mark.parametrize("lane", [50_000, 2])
def test_url_rules_against_every_rule(spark, monkeypatch, lane):
    monkeypatch.setattr(urlrules, "LANE", lane)
    draw = random.Random(lane)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "a.net", "org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/é/", "/a/\U0010ffff", "//"]
    rules = list({(h, p): (draw.choice(["allow", "block"]), h, p) for h, p in (
        (draw.choice(hosts), draw.choice(paths)) for _ in range(25))}.values())
    urls = [f"http://{draw.choice(['', 'z.', 'WWW.'])}{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', 'q', '?x=/a', '#/a/b'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "://x.net/a?b", "http://A.com:80/a", "http://u@a.com/a/b", "x" * 20_000, "http://" + "a." * 3000 + "com/a/b"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules, rules[0], ("block", None, "/")], "verdict string, host string, path string")
    found = {r.page_id: r for r in urlrules.apply_rules(pages, table).collect()}
    assert len(found) == len(urls)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, url in enumerate(urls):
        match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (match[1].translate(lower), match[2]) if match else ("", "")
        best = max((r for r in rules if fits(r, host, path)), key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        row = found[i]
        assert (row.host, row.path) == (host, path)
        assert (row.rule, row.verdict) == ((best[1] + best[2], best[0]) if best else (None, "allow")), url[:80]


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [r.verdict for r in urlrules.apply_rules(pages, none, default="block").collect()] == ["block"]
    assert urlrules.apply_rules(pages.limit(0), none).count() == 0


TEXTS = ["", None, "one", "one two three four five six seven", "a " * 400, "é" * 7, *[
    " ".join(random.Random(i).choices([f"w{k}" for k in range(400)], k=20 + 40 * i)) for i in range(20)
]]


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("share", [1, 2000])
def test_fingerprints(spark, monkeypatch, share):
    ids = [i * 10 - 50 for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS)], "doc_id long, text string, fingerprint string").repartition(3)
    if share == 1:
        monkeypatch.setattr(fingerprints.with_next, "__defaults__", (1, 50_000))
    rows = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, TEXTS)}
    for at, i in enumerate(order):
        follower = order[(at + 1) % len(order)]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[follower][:half]
        row = rows[i]
        assert row.n_chars == len(text[i]) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, other = brute_sets(text[i]), brute_sets(edited), brute_sets(text[follower])
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        exact = len(own | changed) <= fingerprints.K
        assert row.near_edited == pytest.approx(near(own, changed), abs=1e-9 if exact else 0.15)
        assert row.near_next == pytest.approx(near(own, other), abs=0.15)
        assert row.n_shingles == pytest.approx(len(own), rel=0.5)
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


def test_fingerprints_of_repeated_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, "e f")], "doc_id long, text string")
    rows = sorted(((r.doc_id is None, r.doc_id, r.edited_sha256) for r in fingerprints.fingerprint_documents(docs).collect()), key=str)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # From the top: e f, a b, a b, c d, and round to e f.
    expected = [(False, 1, digest("a a")[:0] + digest("a " + "a")), (False, 1, digest("a " + "c")), (False, 2, digest("e a")), (True, None, digest("c e"))]
    assert rows == sorted(expected, key=str)


def test_merged_sketches(spark):
    left, right = " ".join(f"l{i}" for i in range(300)), " ".join(f"r{i}" for i in range(500))
    df = spark.createDataFrame([(left, right, left + " " + right)], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_sketch(df, c, f"s{c}")
    both = fingerprints.merged(F.col("sa"), F.col("sb"))
    row = df.select(
        fingerprints.resemblance(both, F.col("sc")).alias("r"), fingerprints.containment(F.col("sa"), F.col("sc")).alias("c"),
        fingerprints.distinct_shingles(F.col("sc")).alias("n"), fingerprints.distinct_shingles(both).alias("m"),
    ).first()
    assert row.r > 0.9 and row.c > 0.9 and row.n == pytest.approx(len(shingle_set(left + " " + right)), rel=0.3) and row.m == pytest.approx(row.n, rel=0.1)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0])]
    return [f"{name}:{s}:{e}" for s, _, e, name in sorted(found)]


def test_base_spans_against_the_patterns(spark):
    draw = random.Random(12)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "0.10.0.255", "00.000.1.0256", "1.1.1.0", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112",
             "+1 (555) 010-9999", "+12", "+1((((", " ", "  ", "-", ".", "é🙂", "\x01", "\x02", "77", "_", "a@b.c_d@e.f", "abc", "\n"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(500)]
    texts += [None, "", "a" * 100_000, "1" * 50_000, "1 " * 20_000, "a.b@c.de " * 700, "+1 (826) 555-4081 190.137.223.204 x"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int")
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text or "")
        row = rows[i]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text[:200]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(row.spans.split(",")) or not spans
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_a_swallowed_span_is_added_and_redacted(spark):
    plain = [f"call +1 (826) 555-40{i:02d} now, or mail a{i}@mail.example.com, 190.137.22.{i}" for i in range(60)]
    plain += ["paid 4111111111111111 by card", "nothing here 12345", None, ""]
    swallowed = "call +1 (826) 555-4081 4111111111111111 for more"
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*plain, swallowed])], "doc_id long, text string, __x string")
    row = pii.find_personal_data(docs).where(f"doc_id = {len(plain)}").first()
    assert base_spans(swallowed) == [] and "phone:5:22" in row.spans.split(",") and row.n_added == len(row.spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "call [phone] now, or mail [email], [ip]" and clean[60] == "paid [card] by card"
    assert clean[61] == "nothing here 12345" and clean[62] is None and clean[63] == ""
    assert pii.redact(docs).columns == docs.columns


def test_reliabilities():
    # Labeler 0 is right, labeler 1 votes at random.
    patterns = {(0, (1, 1)): 50, (0, (1, -1)): 50, (0, (-1, 1)): 30, (0, (-1, -1)): 70}
    belief = pii.estimate(patterns)
    assert belief[0, (1, 1)] > 0.5 > belief[0, (-1, -1)]


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a.py", "x = 1"), ("src/b.py", f"# {apache}\ncode"), ("src/c.py", None),
        ("src/deep/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), ("src/deep/er/d.py", ""),
        ("src/deep2/e.py", "no notice"), (None, "text"), ("src/b.py", f"# {apache}\ncode"), ("f.md", "My driving licence is new. " + "word " * 500),
    ]
    files = spark.createDataFrame([(i, *r, "old") for i, r in enumerate(rows)], "k long, path string, text string, license string")
    found = {r.k: (r.license, r.origin) for r in licenses.scan_licenses(files).collect()}
    assert found == {
        0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "own"), 3: ("MIT", "inherited"), 4: ("GPL-3.0", "own"),
        5: ("GPL-3.0", "inherited"), 6: ("MIT", "inherited"), 7: (None, None), 8: ("Apache-2.0", "own"), 9: ("MIT", "inherited"),
    }
    assert licenses.scan_licenses(files.limit(0)).count() == 0


GPL = """This program is free {0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1}General Public License for more details."""
BSD = """Copyright (c) 2019, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice."""
CLAUSE = """
3. Neither the name of Somebody nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""
HEADERS = [
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-3.0", GPL.format("software:", "", ",", "3")), ("GPL-2.0", GPL.format("software;", "", ";", "2")),
    ("LGPL-2.1", GPL.replace("program", "library").format("software;", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", GPL.format("software:", "Lesser ", ",", "3")), ("AGPL-3.0", GPL.format("software:", "Affero ", ",", "3")),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""),
    ("MIT", """Copyright 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + CLAUSE),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons\nAttribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Notes\nLicensed under CC BY-SA 4.0.\nmore text"), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy this license document."),
    ("MIT", "# tool\n\n## License\n\nThis project is licensed under the MIT License - see\nthe [LICENSE](LICENSE) file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("Zlib", "SPDX-License-Identifier: Zlib"), ("MIT OR Apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)"),
    (None, "Released under the Zlib License."), (None, "My driving licence is new."), (None, "The GNU General Public License, version 4"),
    (None, "You need a license to drive. The license costs 2.0 coins."), (None, "SPDX-License-Identifier:"), (None, "the licence of the MIT press"),
]


def commented(text, style):
    lines = text.split("\n")
    if style == "block":
        return "/*\n" + "\n".join(f" * {line}".rstrip() for line in lines) + "\n */\nint main() { return 0; }"
    if style == "markup":
        return "<!--\n" + text + "\n-->\n<a/>"
    if style == "plain":
        return text.replace("\n", "\r\n")
    return "\n".join(f"{style} {line}".rstrip() for line in lines) + "\n\nx = 1"


def test_wrapped_headers_and_tags(spark):
    styles = ["plain", "block", "markup", "#", "//", "--", ";;"]
    rows = [(i * 10 + k, f"p{i}/{k}/a.txt", commented(text, style)) for i, (_, text) in enumerate(HEADERS) for k, style in enumerate(styles)]
    files = spark.createDataFrame(rows, "k long, path string, text string").repartition(4)
    found = {r.k: (r.license, r.origin) for r in licenses.scan_licenses(files).collect()}
    wrong = {(HEADERS[k // 10][1][:60], styles[k % 10]): v for k, v in found.items() if v != (HEADERS[k // 10][0], HEADERS[k // 10][0] and "own")}
    assert not wrong and len(found) == len(rows)


def brute_terms(text):
    lowered = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return Counter(w for w in regex.split(r"[^\p{L}\p{N}.+-]+|[.]+(?=\s|$)", lowered) if w)


def brute_passages(text):
    """Sentences with a trigger, of lines and paragraphs, once each."""
    if text is None:
        return []
    bare = regex.sub(licenses.COMMENT, "", text.replace("\r\n", "\n").replace("\r", "\n"))
    parts = regex.split(r"\n+", bare) + [regex.sub(r"\s+", " ", p) for p in regex.split(r"\n[ \t]*\n\s*", bare)]
    sentences = [s.strip(" ") for p in parts if regex.search(licenses.TRIGGER, p) for s in regex.split(licenses.SENTENCE, p)]
    return list(dict.fromkeys(s for s in sentences if regex.search(licenses.TRIGGER, s) and "SPDX-License-Identifier" not in s))


def test_similarity_against_brute_force(spark):
    draw = random.Random(3)
    texts = [None, "", *[commented(t, draw.choice(["plain", "block", "#"])) for _, t in HEADERS if t and "SPDX" not in t]]
    texts += ["A license of " + " ".join(draw.choices("the MIT License software GNU terms use copy 3 2.0".split(), k=9)) + "." for _ in range(40)]
    texts += [texts[5], "A license. " * 3000]
    templates = [(name, set(needed.split()), brute_terms(body)) for name, needed, body in licenses.notices()]
    held = [brute_passages(t) for t in texts]
    bags = {p: brute_terms(p) for ps in held for p in ps}
    seen = Counter(w for ps in held for p in ps for w in bags[p]) + Counter(w for _, _, body in templates for w in body)
    total = sum(map(len, held)) + len(templates)

    def weigh(bag):
        return {w: (1 + math.log(n)) * (math.log((total + 1) / (seen[w] + 1)) + 1) for w, n in bag.items()}

    def best(passages):
        matches = []
        for passage in passages:
            a = weigh(bags[passage])
            scored = []
            for name, needed, body in templates:
                b = weigh(body)
                norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                if needed <= set(a) and set(licenses.VARIANTS) & set(a) <= set(b) and norm and sum(a[w] * b[w] for w in a if w in b):
                    scored.append((-round(sum(a[w] * b[w] for w in a if w in b) / norm, 9), name))
            if scored and -min(scored)[0] >= licenses.THRESHOLD:
                matches.append(min(scored))
        return min(matches, key=lambda m: (m[1] == licenses.SHARED_OPENING, *m), default=None)

    files = spark.createDataFrame([(i, t, f"d{i}/a.c") for i, t in enumerate(texts)], "k long, text string, path string").repartition(3)
    rows = {r.k: r for r in licenses.scan_licenses(files).collect()}
    matched = 0
    for i, passages in enumerate(held):
        expected = best(passages)
        assert rows[i].license == (expected and expected[1]), (texts[i], expected, rows[i])
        if expected:
            matched += 1
            assert rows[i].similarity == pytest.approx(-expected[0], abs=1e-8)
    assert matched > 15


def test_license_columns_and_written_text(spark):
    files = spark.createDataFrame([("a", "Licensed under CC BY 4.0.", 1, "x")], "path string, text string, __mine int, origin string")
    assert licenses.scan_licenses(files).columns == ["path", "text", "__mine", "license", "similarity", "origin"]
    assert licenses.scan_licenses(files, keep_text=False).first().asDict() == {
        "path": "a", "__mine": 1, "license": "CC-BY-4.0", "similarity": 1.0, "origin": "own",
    }
