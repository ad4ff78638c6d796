"""Each license pattern's alternatives hold one of its keywords as a word."""

import itertools
import re
from re import _parser

import pytest

from cartolake.llm import licenses


def texts(parsed):
    """Texts that a pattern matches: every branch and letter set, optional parts with and without, a wildcard as nothing and as a letter."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(x) for _, x in arg]
        elif op == "ANY":
            more = ["x"]
        elif op == "SUBPATTERN":
            more = texts(arg[3])
        elif op == "BRANCH":
            more = [x for branch in arg[1] for x in texts(branch)]
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
            more = [""] * (arg[0] == 0) + texts(arg[2])
        out = [a + b for a, b in itertools.product(out, more)]
    return out


@pytest.mark.parametrize("rule", licenses.rules(), ids=lambda r: f"{r[0]}: {r[2][:30]}")
def test_every_alternative_passes_its_gate(rule):
    _, keywords, pattern, _ = rule
    for text in texts(_parser.parse(pattern)):
        assert re.fullmatch(pattern, text)
        assert set(text.split()) & set(keywords.split()), text


def test_texts_that_the_gate_skipped(spark):
    cases = {
        "CreativeML OpenRAIL-M license": "rail", "End User License Agreement": "proprietary", "FreeBSD License": "bsd-2-clause", "0BSD": "0bsd", "GPL2": "gpl-2.0",
        "General Public License version 2 plus": "gpl-2.0-or-later", "LGPL2.1": "lgpl-2.1", "CeCILL2.1": "cecill-2.1",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(cases.values()))
