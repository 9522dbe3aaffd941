from __future__ import annotations

import math
import re
from collections import Counter

from deltaloom.llm import licences

FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("a/x.py", "import os"), ("a/b/y.py", None), ("a/b/z.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/e.py", ""), ("top.py", "words\nAll rights reserved.\r\nmore"), ("q/LICENSE.txt", "the of and a very long text about nothing licensed"), ("q/r.py", "license"), (None, "Released under the MIT License."), (None, None),
    ("a/x.py", "twice"), ("dir/a.py", "w " * 20_000 + "Released under the MIT License."), ("dir/b.py", "w " * 20_000 + "\nReleased under the MIT License.\n"), ("é/ü.py", "Licensed under CC BY-NC 4.0."),
]


def brute(files):
    w = licences.Weights()

    def best(line):
        counts = Counter(licences.terms_of(line))
        length = math.sqrt(sum((n * w.idf.get(t, w.unseen)) ** 2 for t, n in counts.items())) or 1
        scores = [round(sum(n * w.idf[t] * v[t] for t, n in counts.items() if t in v) / length, 6) for v in w.vectors]
        k = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return scores[k], -k

    own = {}
    for path, text in files:
        if path is None:
            continue
        lines = re.split("\r\n|\n|\r", text or "")
        if re.search(licences.LICENCE_FILE, path):
            lines.append(text or "")
        score = max(map(best, lines))
        if score[0] >= licences.THRESHOLD:
            own[path] = max(own.get(path, (0, 0)), score)
    of_dir = {}
    for path, (score, minus) in sorted(own.items()):
        if re.search(licences.LICENCE_FILE, path):
            d = path.rpartition("/")[0]
            if d not in of_dir or score > of_dir[d][0]:
                of_dir[d] = (score, minus, path)
    out = []
    for path, _ in files:
        if path in own:
            out.append((path, w.names[-own[path][1]], own[path][0], "file" if re.search(licences.LICENCE_FILE, path) else "header", path))
            continue
        d = path
        while d:
            d = d.rpartition("/")[0]
            if d in of_dir:
                break
        if path and d in of_dir:
            score, minus, origin = of_dir[d]
            out.append((path, w.names[-minus], score, "inherited", origin))
        else:
            out.append((path, None, None, "none", None))
    return sorted(out, key=str)


def test_files_and_inheritance(spark):
    rows = [(i, p, t, "x") for i, (p, t) in enumerate(FILES)]
    got = licences.licensed(spark.createDataFrame(rows, "score int, path string, text string, licence string"), keep=("score",)).toPandas()
    assert list(got.columns) == ["score", "path", "licence", "score", "basis", "from_path"]
    out = licences.licensed(spark.createDataFrame(rows, "id int, path string, text string, licence string")).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(FILES)
    kinds = {r.path: (r.licence, r.basis, r.from_path) for r in out if r.path}
    assert kinds["a/b/y.py"] == ("MIT", "inherited", "a/LICENSE") and kinds["a/b/c/d/e.py"][0] == "GPL-3.0" and kinds["a/b/z.py"][:2] == ("Apache-2.0", "header")
    assert kinds["q/r.py"][0] is None and kinds["dir/a.py"][0] is None and kinds["dir/b.py"][0] == "MIT"


def test_empty(spark):
    assert licences.licensed(spark.createDataFrame([], "path string, text string")).count() == 0


def test_cues_lose_nothing():
    w = licences.Weights()
    for vector in w.vectors:
        rest = {t: x for t, x in vector.items() if t not in w.cues}
        assert math.sqrt(sum(x * x for x in rest.values())) < licences.THRESHOLD
