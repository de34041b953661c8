"""The span finder: every family of patterns, what is no citation, and work that grows with the text."""

import re
import time

import pytest

from citeforge.functions import occurrence_patterns as P
from citeforge.operators.spans import find_spans


@pytest.mark.parametrize("text,want", [
    ("as (Smith et al., 2020) says", [("(Smith et al., 2020)", "apa_intext_parenthetical")]),
    ("as [Smith, n.d.] says", [("[Smith, n.d.]", "apa_intext_parenthetical")]),
    ("as (Smith, 2020, p. 25) says", [("(Smith, 2020, p. 25)", "apa_intext_parenthetical")]),
    ("as van Dijk và Trần (2019) say", [("van Dijk và Trần (2019)", "apa_intext_narrative")]),
    ("However, Smith (2019) says", [("Smith (2019)", "apa_intext_narrative")]),
    ("says Smith et al. 2019 too", [("Smith et al. 2019", "apa_intext_narrative")]),
    ("see Nghị định 12/2020/NĐ-CP (2020) there", [("Nghị định 12/2020/NĐ-CP (2020)", "apa_intext_narrative")]),
    ("as [1, 3-5] and [12]", [("[1, 3-5]", "ieee_numeric"), ("[12]", "ieee_numeric")]),
    ("as [1234] says", [("[1234]", "acm_numeric_range")]),
    ("as (Smith 2020: 25) says", [("(Smith 2020: 25)", "harvard_parenthetical")]),
    ("as (Smith, 2020: 25) says", [("(Smith, 2020: 25)", "harvard_parenthetical_comma")]),
    ("as Smith (2020: 25) says", [("Smith (2020: 25)", "harvard_narrative")]),
    ("as words^1,2 say", [("^1,2", "nature_superscript")]),
    ("as x^2 is", []),
    ("as (Nguyen 25-27) says", [("(Nguyen 25-27)", "mla_intext_parenthetical_page")]),
    ("as (Table 4) and (Step 12) show", []),
    ("as Nguyen (p. 25) says", [("Nguyen (p. 25)", "mla_intext_narrative")]),
    ("as (1, 2) says", [("(1, 2)", "numeric_parenthesized")]),
    ("at https://x.org/a, 10.1000/xy.", [("https://x.org/a", "url"), ("10.1000/xy", "doi")]),
    ("on (May 2012), (Spring, 2013), (September 23, 1934), (Received: May, 2020)", []),
    ("between [0], [2020] and [0, 1]", []),
    # A year that no author's pattern owns is a number in brackets to the last pattern.
    ("(Author, 2020) and Author (2020)", [("(2020)", "numeric_parenthesized")]),
    ("Scenario: [1] is expected", []),
    ("How to cite: Smith (2020). A title", [("(2020)", "numeric_parenthesized")]),
    ("(New York: Penguin, 1999)", []),
    ("[4] Xiao, Y. wrote it\n[5], and others\n  [6] show that", [("[5]", "ieee_numeric"), ("[6]", "ieee_numeric")]),
    ("Papers (2020) and see", [("(2020)", "numeric_parenthesized")]),
    ("", []), (None, []),
])
def test_families(text, want):
    assert [(raw, name) for _, _, raw, name, _ in sorted(find_spans(text))] == want


def test_table_is_whole_and_spans_do_not_overlap():
    assert len(P.PATTERNS) == 34 and len({n for n, _, _ in P.PATTERNS}) == 34
    text = " ".join(["see Smith (2020), (Doe, 1999: 3) and [3]; (Roe 12) or (Roe 2012), words^7."] * 20)
    spans = sorted(find_spans(text))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(spans) == 120
    assert all(re.sub(r"\s+", " ", text[a:b]).strip() == raw for a, b, raw, _, _ in spans)


def test_work_grows_with_the_text():
    def seconds(n):
        text = " ".join(f"as Smith and Jones ({1950 + i % 70}) say, (Tran, {1950 + i % 60}) and [{i % 90 + 1}, 3] see" for i in range(n // 3))
        began = time.process_time()
        assert sum(1 for _ in find_spans(text)) >= n - 3
        return time.process_time() - began

    seconds(1000)
    assert seconds(48_000) < 4 * max(0.3, seconds(16_000))
