"""Line deduplication and fill-in-middle on unusual rows; both have SQL for whole tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lanelytics.llm import fill_middle, line_dedup
from tests.llm.conftest import EDGE_ROWS, PROSE

SHARED = "A line that several DOCUMENTS share, Ä included"
HOT = "another line, of at least forty code points, in most documents"
SHORT = "thirty-nine code points are too short!!"


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if c.isascii() else c for c in bare)


def wanted_rows(rows, least=40, documents=5):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least:
                holders[key_of(line)].add((doc_id is not None, doc_id or 0))
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stays = [
            line
            for line in lines
            if len(holders[key_of(line)]) < documents or max(holders[key_of(line)]) == (doc_id is not None, doc_id or 0)
        ]
        yield doc_id, "\n".join(stays), len(lines), len(lines) - len(stays)


ROWS = [
    *[row[:2] for row in EDGE_ROWS],
    *[(20 + n, f"own line {n} of this document, which no other one holds\n \t{SHARED.upper() if n % 2 else SHARED}\r\nend") for n in range(5)],
    *[(40 + n, f"{SHARED.replace('share', 'hold')}\n\n{n}") for n in range(4)],  # one too few
    (43, f"{SHARED.replace('share', 'hold')}"),  # the same document again
    *[(n, f"{SHORT}\n{HOT}\n{HOT} \n{n}") for n in range(100, 160)],
    *[(None, f"{HOT}\n{PROSE}")] * 30,
    *[(170, f"{HOT}\n{HOT}\nlast")] * 2,
    (171, "\n".join(f"line {n} of a long text of very many lines, some twice" for n in range(3000)) + f"\n{HOT}\n" * 2),
]


@pytest.mark.parametrize(("lines", "hot"), [(line_dedup.LINES, line_dedup.HOT), (7, 10_000), (1, 3)])
def test_lines(make_docs, monkeypatch, lines, hot):
    """However a line of many documents is dealt out."""
    monkeypatch.setattr(line_dedup, "LINES", lines)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    got = Counter(map(tuple, line_dedup.dedup_lines(make_docs(*ROWS)).collect()))
    wanted = Counter(wanted_rows(ROWS))
    assert got == wanted
    assert max(row[3] for row in got) >= 2 and (24, ROWS[len(EDGE_ROWS) + 4][1], 3, 0) in got


def test_other_limits(make_docs):
    got = Counter(map(tuple, line_dedup.dedup_lines(make_docs(*ROWS), least_chars=3, documents=2).collect()))
    assert got == Counter(wanted_rows(ROWS, 3, 2))


def test_line_plan_stays_in_the_jvm(make_docs):
    plan = line_dedup.digests(make_docs(*ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def wanted_form(doc_id, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(make_docs):
    texts = ["🙂é\n\r\u2028漢", "<P", "a<P>b", "<S<S<P<M<", "$1\\$2 \\E \\Q", "x", "\n", PROSE, "S>x<P", "ab🙂" * 20000]
    rows = [row[:2] for row in EDGE_ROWS] + [(1000 + 20 * k + n, text) for n, text in enumerate(texts) for k in range(8)]
    cut = fill_middle.transform(make_docs(*rows))
    got = Counter(map(tuple, cut.collect()))
    assert got == Counter(wanted_form(*row) for row in rows)
    assert {row[2] for row in got} == {"plain", "psm", "spm"}
    back = cut.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((i, text or "") for i, text in rows)


def test_other_units_and_markers(make_docs):
    rows = [(n, " ".join(f"w{k}" for k in range(n * 40)) + " ") for n in range(1, 60)]
    markers = ("$p\\", "{s}", "\\E")
    cut = fill_middle.transform(make_docs(*rows), plain_percent=0, unit=r"\S*+\s", markers=markers)
    for doc_id, n, form, before, size, output in cut.collect():
        words = [word + " " for word in rows[doc_id - 1][1].split()]
        parts = ["".join(p) for p in (words[:before], words[before : before + size], words[before + size :])]
        pieces = [mark + part for mark, part in zip((markers[0], markers[2], markers[1]), parts)]
        assert n == len(words) and output == "".join(pieces[i] for i in ((0, 2, 1) if form == "psm" else (2, 0, 1)))
    assert {r[0] for r in cut.select("form").distinct().collect()} == {"psm", "spm"}
    back = cut.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), markers))
    assert sorted(map(tuple, back.collect())) == rows


def test_a_very_long_text(make_docs):
    """Millions of units neither fill the stack nor give millions of matches."""
    text = "é🙂\nx" * 1_000_000
    row = fill_middle.transform(make_docs((5, text)), plain_percent=0).first()
    assert tuple(row)[1:2] == (4_000_000,) and len(row["output"]) == 4_000_009


def test_no_documents(make_docs):
    assert line_dedup.digests(make_docs()).count() == 0
    assert fill_middle.digests(make_docs()).count() == 0
