"""Operators that SQL can express, and their edge cases."""

import duckdb
import pytest

import __spark_entry__
from lanelytics.llm import licenses, oracle, quality, queries
from tests.llm.conftest import EDGE_ROWS, PROSE


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    sf_dir = f"/root/testdata/{size}"
    connection, got = duckdb.connect(), queries.queries()[name](spark, sf_dir)
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    connection.register("got", got.toArrow())
    wanted, columns = f"({oracle.ORACLE[name]})", ", ".join(got.columns)
    for one, other in (("got", wanted), (wanted, "got")):
        rows = connection.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other}").fetchall()
        assert not rows, rows[:3]


def test_every_operator_is_registered():
    names = [name for name in __spark_entry__.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(queries.queries()) == set(names)


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rules(make_docs):
    rows = [r for r in EDGE_ROWS if r[0] not in (9,)] + [
        (30, "a b c a b c a b c x y z"),
        (31, "x\nx \nx\n\n \n#|<%\nx\x0by"),
        (32, "é 漢 " * 40),
        (33, " ".join(f"w{n}" for n in range(60))),
        (34, " ".join(f"w{n % 35}" for n in range(70))),
    ]
    got = quality.quality_rules(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        counts = slow_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert {r["doc_id"] for r in got if r["kept"]} == {33}


def test_outliers_of_a_source_are_rejected(make_docs):
    clean = [(n, PROSE + " ".join(f"{'ab' * (1 + (n * k) % 4)}{k}" for k in range(60 + n)), "en", "s") for n in range(60)]
    marked = [(100 + n, " ".join(f"{w}###" for w in clean[n][1].split()), "en", "s") for n in range(9)]
    docs = make_docs(*clean, *marked, (200, None, None, None))
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert all(verdicts[n] for n in range(60)) and not any(verdicts[100 + n] for n in range(9)) and verdicts[200] is False
    kept = quality.without_rejected(docs)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def slow_estimate(vectors):
    """Mean and factors of the smallest determinant over three starts, with numpy on one group."""
    import numpy as np

    least, x = np.array([100.0, 40.0, 130.0, 130.0]), np.array(vectors, float)

    def factors(c):
        lower, d = np.eye(4), np.zeros(4)
        for j in range(4):
            d[j] = max(c[j, j] - (lower[j, :j] ** 2 * d[:j]).sum(), least[j] ** 2)
            for i in range(j + 1, 4):
                lower[i, j] = (c[i, j] - (lower[i, :j] * lower[j, :j] * d[:j]).sum()) / d[j]
        return lower, d

    def squares(mean, lower, d):
        return (np.linalg.solve(lower, (x - mean).T).T ** 2 / d).sum(1)

    middle = lambda values: np.sort(values, axis=0)[(len(values) - 1) // 2]
    medians, found = middle(x), []
    mad = 1.4826 * middle(abs(x - medians))
    for mean, c in ((medians, np.diag(least**2)), (medians, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True))):
        fit = mean, *factors(c)
        for _ in range(20):
            away = np.minimum(np.floor(100 * np.sqrt(squares(*fit))), 5000)
            near = x[away <= middle(away)]
            fit = near.mean(0), *factors(2.109 * np.cov(near.T, bias=True))
        found.append((fit[2].prod(), fit))
    return squares(*min(found, key=lambda f: f[0])[1])


def test_estimates_equal_a_plain_one(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for grp, size in (("a", 150), ("b", 41), ("c", 64), ("flat", 40)):
        x = rng.multivariate_normal([1500, 100, 0, 50], np.outer([90, 60, 200, 80], [90, 60, 200, 80]) * (np.eye(4) * 0.6 + 0.4), size)
        x[: size // 3] += [600, 300, 500, 0]  # a third of the rows are outliers of one kind
        rows += [(grp, *map(int, np.abs(v if grp != "flat" else v * 0 + 7).round())) for v in x]
    vectors = spark.createDataFrame(rows, "grp string, z1 long, z2 long, z3 long, z4 long").cache()
    got = quality._distances(vectors, quality.estimates(vectors), True).select("grp", *quality.NAMES, "square").collect()
    for grp in ("a", "b", "c", "flat"):
        of_group = sorted(r[1:] for r in rows if r[0] == grp)
        wanted = slow_estimate(of_group)
        assert np.allclose([r[5] for r in sorted(r for r in got if r[0] == grp)], wanted, rtol=1e-6, atol=1e-6)


def test_a_step_needs_few_exchanges(spark, monkeypatch):
    """Each exchange of the steps takes memory and a thread of the driver; estimates that do not change end them."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"g{n % 3}", *map(int, rng.integers(0, 900, 4))) for n in range(120)]
    vectors, steps = spark.createDataFrame(rows, "grp string, z1 long, z2 long, z3 long, z4 long").cache(), []
    plain = quality._concentrated
    monkeypatch.setattr(quality, "_concentrated", lambda *args: steps.append(plain(*args)) or steps[-1])
    monkeypatch.setattr(quality, "STEPS", 40)
    assert quality.estimates(vectors).count() == 3 and 1 < len(steps) < 40
    found = [sorted(tuple(r)[2:-1] for r in step.collect()) for step in steps[-3:]]
    assert found[-1] == found[-2] != found[0]
    plan = steps[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[-1]
    assert plan.count(" Exchange hashpartitioning") == 2
    assert plan.count("BroadcastExchange") == plan.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize("kind", ["length", "symbols", "lines", "repeats"])
def test_each_statistic_alone_rejects(make_docs, kind):
    """Clean documents of a source with some outliers of one statistic."""
    word = lambda n, k: f"{'abcdefghij'[(n * 7 + k) % 10]}{'ab' * (1 + (n + k) % 3)}{k % 17}x{(n * 31 + k * k) % 991}"
    lines = lambda n: [" ".join(word(n, 8 * k + j) for j in range(8)) for k in range(80)]
    clean = [(n, "\n".join(lines(n)), "en", "s") for n in range(200)]

    def spoiled(n):
        own = lines(n)
        if kind == "length":
            return "\n".join(" ".join(w + "ness" * 8 for w in line.split()) for line in own)
        if kind == "symbols":
            return "\n".join(" ".join(w + "#" for w in line.split()) for line in own)
        if kind == "lines":
            return "\n".join(own[k] if k < 41 else f"{own[0][:6]}" for k in range(80))
        half = " ".join(own[:40]).split()
        return " ".join(half[k] if k < 162 else half[k % 3] if k < 318 else half[k] for k in range(320))

    docs = make_docs(*clean, *[(1000 + n, spoiled(n), "en", "s") for n in range(5)])
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs).collect()}
    assert all(verdicts[n] == (False, True) for n in range(200))
    assert all(verdicts[1000 + n] == (False, False) for n in range(5))


def test_no_rows(make_docs):
    assert quality.quality_rules(make_docs()).count() == 0
    assert licenses.scan(licenses.document_paths(make_docs())).count() == 0


MIT, GPL = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]


def test_nearest_directory_gives_its_licence(spark):
    files = [
        ("repo/LICENSE", MIT),
        ("repo/src/deep/a.py", PROSE),
        ("repo/src/vendor/COPYING", GPL),
        ("repo/src/vendor/x/b.py", PROSE),
        ("repo/src/c.py", f"# Released under the  MIT license\n{PROSE * 5}"),
        ("repo/src/vendor/d.py", f"{PROSE * 5}\n// {licenses.TEMPLATES['Apache-2.0']}"),
        ("repository/e.py", PROSE),
        ("top.py", None),
        ("repo/src/vendor/x/b.py", PROSE),
        (None, MIT),
        ("repo/f.py", "Copyright notice of nobody in particular, all rights are kept"),
        ("repo/g.py", ""),
    ]
    frame = spark.createDataFrame([(n, p, t, "x", "x") for n, (p, t) in enumerate(files)], "doc_id long, path string, text string, license string, directory string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(frame).collect()}
    assert got == {
        0: ("MIT", "MIT", None),
        1: (None, "MIT", "repo"),
        2: ("GPL-3.0", "GPL-3.0", None),
        3: (None, "GPL-3.0", "repo/src/vendor"),
        4: ("MIT", "MIT", None),
        5: ("Apache-2.0", "Apache-2.0", None),
        6: (None, None, None),
        7: (None, None, None),
        8: (None, "GPL-3.0", "repo/src/vendor"),
        9: (None, None, None),
        10: (None, "MIT", "repo"),
        11: (None, "MIT", "repo"),
    }


def test_a_null_source_is_no_pool(make_docs):
    text = lambda n, mark: " ".join(f"w{n}x{k}{mark}" for k in range(60))
    null = [(n, text(n, ""), "en", None) for n in range(40)]
    small = [(100 + n, text(n, "###"), "en", "small") for n in range(9)]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_rules(make_docs(*null, *small)).collect()}
    assert len(verdicts) == 49 and all(verdicts.values())  # each group is all alike


def wrapped(text, width=60, mark=""):
    import textwrap

    return "\n".join((mark + line).rstrip() for line in textwrap.wrap(text, width))


OWN = {name: texts[-1] for name, texts in licenses.TEXTS.items()}
MIT_FILE = f"MIT License\n\nCopyright (c) 2019 Some Body\n\n{wrapped(OWN['MIT'], 75)}\n"
APACHE_C = f"/*\n * Copyright 2020 Some Body\n *\n{wrapped(OWN['Apache-2.0'], 70, ' * ')}\n */\nint main(void) {{ return 0; }}\n"
GPL_C = "// This work is licensed under the GNU General Public\n// License, version 3.\nint other(void) { return 1; }\n"
GNU_C = f"/* other.c\nCopyright (C) 2001 A. Nobody\n\n{wrapped(licenses.TEXTS['LGPL-2.1'][1])}\n*/\nint third;\n"
CODE = "int f(int x) { return x + 1; }\n" * 3
#: Path, text, own licence, whether a licence file, licence in the end.
REAL_FILES = [
    ("mit/LICENSE", MIT_FILE, "MIT", True, "MIT"),
    ("mit/src/a.c", CODE, None, False, "MIT"),
    ("bsd3/LICENSE.txt", wrapped(OWN["BSD-3-Clause"].replace("(c)", "(c) 2011, The Authors of It.")), "BSD-3-Clause", True, "BSD-3-Clause"),
    ("bsd2/COPYING", wrapped(OWN["BSD-2-Clause"].replace("(c)", "(c) 2011, The Authors of It.")), "BSD-2-Clause", True, "BSD-2-Clause"),
    ("isc/license.md", f"Copyright (c) 2001, Some Body\n\n{wrapped(OWN['ISC'])}", "ISC", True, "ISC"),
    ("unnamed/terms", wrapped(OWN["MIT"], 50), "MIT", True, "MIT"),
    ("unnamed/a.c", CODE, None, False, "MIT"),
    ("tag/a.c", f"// SPDX-License-Identifier: MIT\n{CODE}", "MIT", False, "MIT"),
    ("tag/b.py", f"# SPDX-License-Identifier:  GPL-2.0-or-later\n{CODE}", "GPL-2.0", False, "GPL-2.0"),
    ("tag/c.c", f"/* SPDX-License-Identifier: (Apache-2.0 OR MIT) */\n{CODE}", "Apache-2.0", False, "Apache-2.0"),
    ("tag/d.c", f"// SPDX-License-Identifier: Zlib\n{CODE}", None, False, None),
    ("pair/apache.c", APACHE_C, "Apache-2.0", False, "Apache-2.0"),
    ("pair/gpl.c", GPL_C, "GPL-3.0", False, "GPL-3.0"),
    ("pair/gnu.h", GNU_C, "LGPL-2.1", False, "LGPL-2.1"),
    ("pair/none.c", CODE, None, False, None),
    ("long/COPYING", f"  GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nEveryone may copy this license document.\n\n{PROSE * 40}", "GPL-3.0", True, "GPL-3.0"),
    ("apache/LICENSE", f"   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n{PROSE * 40}", "Apache-2.0", True, "Apache-2.0"),
    ("other/a.txt", f"The driver's license of nobody.\n{PROSE}", None, False, None),
]


def test_real_licences(spark):
    rows = [(n, path, text) for n, (path, text, *_) in enumerate(REAL_FILES)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    found = {r["path"]: (r["own_license"], r["is_license_file"], r["license"]) for r in got}
    assert found == {path: tuple(wanted) for path, _, *wanted in REAL_FILES}


@pytest.mark.parametrize("root", ["", "/"])
def test_the_root_speaks_for_files_below(spark, root):
    rows = [(1, f"{root}LICENSE", MIT_FILE), (2, f"{root}top.c", CODE), (3, f"{root}a/b/c.c", CODE)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["inherited_from"]) for r in got} == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}


def test_real_licences_equal_sql(spark):
    """The texts as documents, whose paths are made of source, language and id."""
    rows = [(1000 * (n // 3) + n, text, "en", path.split("/")[0]) for n, (path, text, *_) in enumerate(REAL_FILES)]
    rows += [(7, None, None, None), (8, "", "en", "mit"), (9, "/* open licence", "en", "mit"), (1, MIT_FILE, "en", "mit"), (2, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, connection = licenses.scan(licenses.document_paths(docs)), duckdb.connect()
    connection.register("documents", docs.toArrow())
    connection.register("got", got.toArrow())
    wanted, columns = f"({oracle.ORACLE['op9_licenses']})", ", ".join(got.columns)
    assert got.filter("own_license is not null").count() > 12 and got.filter("is_license_file").count() > 5
    for one, other in (("got", wanted), (wanted, "got")):
        rows = connection.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other}").fetchall()
        assert not rows, rows[:3]
