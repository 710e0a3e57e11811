"""Licence windows: notices over line breaks and within lines, full texts, against brute force."""

import random
import re
from collections import Counter

import pytest

from paymatch.llm.licenses import TEMPLATES, scan

KNOWN = dict(TEMPLATES)


def words(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(ws):
    return list(zip(ws, ws[1:]))


def dice(a, b):
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def brute_windows(text, notice, threshold):
    """Best windows: (start, dice) of every window that fits and that no better one overlaps."""
    has, all_ = bigrams(words(notice)), bigrams(words(text))
    size = len(has)
    fit = {}
    for p, b in enumerate(all_):
        if b in has:
            d = dice(all_[p:p + size], has)
            if d >= threshold:
                fit[p] = d
    return {p: d for p, d in fit.items()
            if not any(abs(q - p) < size and (e > d or (e == d and q < p)) for q, e in fit.items())}


def found(spark, rows, **options):
    out = scan(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return {(r.doc_id, r.line, r.license): r.dice for r in out}


def wrapped(text, width, prefix):
    ws = text.split()
    return "\n".join(prefix + " ".join(ws[i:i + width]) for i in range(0, len(ws), width))


@pytest.fixture(scope="module")
def planted(spark):
    head = "int main() { return 0; }\n"
    rows = [
        (1, head + wrapped(KNOWN["gpl-3.0-header"], 12, "// ") + "\n" + head * 5),
        (2, "This demo was Released under the MIT License. See the file for more of it."),
        (3, "Copyright 2020 X. All rights reserved. Ask us first about what you want to do."),
        (4, head * 40 + wrapped(KNOWN["mit-text"], 9, " * ") + "\n" + head * 40),
        (5, head + wrapped(KNOWN["bsd-2-clause-text"], 11, "# ") + "\n" + head + wrapped(KNOWN["isc-text"], 8, "# ")),
        (6, head + KNOWN["gpl-3.0"] + "\n" + head + KNOWN["gpl-3.0"] + "\n"),
        (7, head * 200),
        (8, " ".join(KNOWN["mpl-2.0"].split()[:30]) + "\nand nothing else follows here at all, " + head * 9),
        (9, "Released\nunder\n\n\nthe\nMIT License"),
        (10, None), (11, ""), (12, "license"), (13, KNOWN["mit"]), (13, KNOWN["mit"]),
    ]
    return found(spark, rows)


def test_planted(planted):
    assert planted[1, 1, "gpl-3.0-header"] == 1.0
    assert planted[2, 0, "mit"] == 1.0
    assert planted[3, 0, "all-rights-reserved"] == 1.0
    assert planted[4, 40, "mit-text"] == 1.0 and planted[4, 40, "mit-grant"] == 1.0
    assert planted[5, 1, "bsd-2-clause-text"] == 1.0
    assert [d for (i, _, x), d in planted.items() if i == 5 and x == "isc-text"] == [1.0]
    assert {k: d for k, d in planted.items() if k[0] == 6} == {(6, 1, "gpl-3.0"): 1.0, (6, 3, "gpl-3.0"): 1.0}
    assert planted[8, 0, "mpl-2.0"] >= 0.8
    assert planted[9, 0, "mit"] == 1.0 and planted[9, -1, "mit"] == 1.0
    assert planted[13, 0, "mit"] == 1.0
    assert not [k for k in planted if k[0] in (7, 10, 11, 12)]


def test_windows_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = "a b c d e f".split()
    templates = [(f"t{k}", " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate((2, 3, 5, 9, 14))]
    rows = []
    for i in range(60):
        ws = [r.choice(vocabulary + ["x", "y"]) for _ in range(r.randint(2, 40))]
        if i % 3:
            at = r.randrange(len(ws))
            ws[at:at] = r.choice(templates)[1].split()
        # one word a line: no line is a part that fits, so all but the whole texts are windows
        rows.append((i, "\n".join(ws)))
    got = {k: d for k, d in found(spark, rows, templates=templates, threshold=0.7).items() if k[1] >= 0}
    expected = {(i, p, name): d for i, text in rows for name, notice in templates
                for p, d in brute_windows(text, notice, 0.7).items()}
    assert got == pytest.approx(expected)
    assert len(expected) > 40


def test_no_window_scores_more(spark):
    """The best window of a template begins at one of its bigrams."""
    r = random.Random(9)
    for name in ("mit", "gpl-3.0", "bsd-header"):
        has = bigrams(words(KNOWN[name]))
        text = words(KNOWN[name])
        text[r.randrange(len(text))] = "other"
        text = ["before"] * 5 + text + ["after"] * 30
        pairs = bigrams(text)
        anywhere = max(dice(pairs[p:p + len(has)], has) for p in range(len(pairs)))
        best = max(brute_windows(" ".join(text), KNOWN[name], 0.01).values())
        assert best == anywhere
