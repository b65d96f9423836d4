import random

from llm_samples import prose

from spark_trials.llm import licenses

MIT = licenses.TEMPLATES["MIT"]


def test_planted_notices(spark, docs, no_docs):
    rng = random.Random(4)
    words = MIT.split()
    for k in range(5, len(words), 17):
        words[k] = "changed"
    near = " ".join(words)
    rows = [
        (1, f"{prose(rng, 50)} {MIT} {prose(rng, 3000)}"), (2, f"x {near} y"), (3, prose(rng, 400)), (4, " ".join(MIT.split()[:60])), (5, None), (6, ""),
        (7, f"{licenses.TEMPLATES['MIT-notice']} {prose(rng, 40)}\n{licenses.TEMPLATES['Apache-2.0-notice'].upper()}"), (7, "released under the mit license"), (8, "the of MIT License"),
        (9, f"{MIT} {prose(rng, 30)} {MIT}"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, start int")
    got = [r.asDict() for r in licenses.scan_licenses(df).collect()]
    found = sorted((r["doc_id"], r["license"]) for r in got)
    assert [f for f in found if f[0] != 9] == [(1, "MIT"), (2, "MIT"), (7, "Apache-2.0-notice"), (7, "MIT-notice"), (7, "MIT-notice")]
    assert found.count((9, "MIT")) == 2
    text = dict(rows[:1])[1]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["coverage"] == 1.0 and text[one["start"] : one["end"]] == MIT.rstrip(".")
    assert 0.8 <= next(r for r in got if r["doc_id"] == 2)["coverage"] < 1
    assert licenses.scan_licenses(no_docs).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_alignment_against_full_table():
    import numpy as np

    rng = random.Random(8)
    for _ in range(40):
        a = [rng.randint(1, 9) for _ in range(rng.randint(3, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [0], [b[at], 0]])
            b = b or [0]
        matches, first, last = licenses.align(np.array(a), np.array(b), 0, 0)
        assert matches == longest_common(a, b)
        assert longest_common(a, b[first : last + 1]) == matches


def test_index_loses_no_long_match():
    """Every template inside other words meets the index."""
    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(6)
    for name, text in licenses.TEMPLATES.items():
        found = licenses.scan(f"{prose(rng, 7)} {text} {prose(rng, 9)}", index)
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)], name


def test_scan_against_full_alignment():
    """Texts with damaged templates: the best template by a full table over the whole text, none where it covers too little."""
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Apache-2.0-header", "GPL-2.0-header", "GPL-3.0-header", "LGPL-3.0-header", "MPL-2.0-header"]
    index = licenses.Index({n: licenses.TEMPLATES[n] for n in names})
    cut = {n: [w.lower() for w in licenses.WORDS.findall(licenses.TEMPLATES[n])] for n in names}
    rng = random.Random(21)
    for name in names:
        for damage in (0.0, 0.05, 0.1, 0.4):
            words = [w if rng.random() >= damage else rng.choice(["", "zz", f"{w} yy"]) for w in licenses.TEMPLATES[name].split()]
            text = f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"
            own = [w.lower() for w in licenses.WORDS.findall(text)]
            full = {n: longest_common(t, own) / len(t) for n, t in cut.items()}
            found = licenses.scan(text, index)
            if damage <= 0.05:
                assert [f[0] for f in found] == [name]
            if full[name] < 0.8:
                assert name not in [f[0] for f in found]
            for f in found:  # a band and nothing less
                assert f[1] <= full[f[0]] + 1e-9 and f[1] >= 0.8


def test_notices_by_their_telling_words():
    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(9)
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    said = {
        "All rights reserved.": ["All-rights-reserved-notice"], "Licensed under CC BY 4.0.": ["CC-BY-4.0-notice"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0-notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"], "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0-notice"], gnu.format("", 2): ["GPL-2.0-notice"],
        gnu.format("", 3): ["GPL-3.0-notice"], gnu.format("Lesser ", 3): ["LGPL-3.0-notice"], gnu.format("Lesser ", 2.1): ["LGPL-2.1-notice"], gnu.format("Affero ", 3): ["AGPL-3.0-notice"],
        "Licensed under CC BY-ND 4.0.": [], gnu.format("", 1): [],
    }
    for text, want in said.items():
        for _ in range(5):
            assert [f[0] for f in licenses.scan(f"{prose(rng, 7)} {text} {prose(rng, 9)}", index)] == want, text
