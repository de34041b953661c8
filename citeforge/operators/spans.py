"""Citations in a text by a table of patterns: the first pattern to claim a span owns it.

No pattern runs over the whole text: one that begins with a bracket or a caret is tried where these stand, one that begins
with names between what names can't hold and the year in brackets behind them. Spans that are taken are marked byte by character, so whether a new one
overlaps is one search within its own length; where lines begin, and where a line warns that what follows is no
citation, is found once a text. The work grows with the text and not with the square of its citations.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from ..functions import occurrence_patterns as P

#: Equal patterns of one kind run once, for the first name.
_PATTERNS: list[tuple[str, str, re.Pattern]] = []
for _name, _kind, _text in P.PATTERNS:
    if not any(k == _kind and p.pattern == _text for _, k, p in _PATTERNS):
        _PATTERNS.append((_name, _kind, re.compile(_text)))
#: Patterns that begin with names, and what ends them: a bracket behind a blank, or for the first one a year behind "et al.".
_YEAR_AFTER = re.compile(r"\s[(\[](?:(?:18|19|20)\d\d|n)")
_AL_YEAR = re.compile(r"et\s+al\.\s+(?:18|19|20)\d\d")
_ENDS = {"apa_intext_narrative": _YEAR_AFTER, "harvard_narrative": re.compile(r"\s\(\d{4}"), "vancouver_narrative": re.compile(r"\s\(\d{4}"), "mla_intext_narrative": re.compile(r"\s\(pp?\.")}
#: What names and what joins them can't hold: a full stop only stands behind "et al." and "và cs.".
_BARRIER = re.compile(r"(?<!al)(?<!cs)(?<! l)\.|[;:!?\"“”()\[\]{}]")
_CLOSE = re.compile(r"[)\]]")


def _before(text: str, at: int, least: int) -> int:
    """Where names that end at ``at`` can begin at the earliest, not before least."""
    reach = 200
    while True:
        lo = max(least, at - reach)
        last = None
        for last in _BARRIER.finditer(text, lo, at):
            pass
        if last or lo == least:
            return last.end() if last else lo
        reach *= 4


def _ends(name: str, text: str, opening: list[int]) -> list[re.Match]:
    """Where names that the pattern claims may end, in order."""
    hits = [m for at in opening if at and (m := _ENDS[name].match(text, at - 1))]
    if name == "apa_intext_narrative" and "al." in text:
        hits = sorted([*hits, *_AL_YEAR.finditer(text)], key=re.Match.start)
    return hits


def _matches(name: str, pattern: re.Pattern, text: str, opening: dict[str, list[int]], carets: list[int]) -> Iterator[re.Match]:
    """What pattern.finditer(text) gives; opening has where each bracket stands, and where any does under ""."""
    if name in ("doi", "url"):
        if ("10." if name == "doi" else "http") in text:
            yield from pattern.finditer(text)
        return
    end = 0
    if name in _ENDS:
        for hit in _ends(name, text, opening[""]):
            if hit.end() <= end:
                continue
            close = _CLOSE.search(text, hit.end())
            for m in pattern.finditer(text, _before(text, hit.start(), end), max(hit.end() + 2, close.end() if close else len(text))):
                yield m
                end = m.end()
    elif name == "acs_author_superscript":
        for at in carets:
            lo = at
            while lo > end and text[lo - 1].isalpha():
                lo -= 1
            m = pattern.search(text, lo)
            if m and m.start() < at:
                yield m
                end = m.end()
    else:
        for at in carets if "superscript" in name else opening.get(pattern.pattern[:2], opening[""]):
            if at >= end and (m := pattern.match(text, at)):
                yield m
                end = m.end()


_RULES = {n: re.compile(getattr(P, n)) for n in dir(P) if n.isupper() and isinstance(getattr(P, n), str) and n not in ("UPPER", "NOT_A_NAME", "AUTHOR", "BODY", "YEAR", "PAGES", "SUPERSCRIPT", "PAGE_AFTER", "TWO_NAMES", "NAME_YEAR", "NOT_BEFORE_YEAR", "NOT_BEFORE_YEAR_CHICAGO", "NOT_BEFORE_PAGE", "SURNAME")}
#: How the matches of two rules end; a text without such an end has none of them.
_TAILS = {"SCENARIO_BEFORE": re.compile(r"(?i)(?:text|reference)$"), "HOW_TO_CITE": re.compile(r"(?i)(?:dẫn|viết|cite|this|citation|article)$")}
_COLON = re.compile(r"(?<!\s)\s*+:")
_QUOTES = "\"“”'‘’"


class _Lines:
    """Where lines begin, and which of a rule's matches a line has before an offset."""

    def __init__(self, text: str):
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.found: dict[str, tuple[list[int], list[int]]] = {}
        self.heads: list[str] | None = None

    def begin(self, at: int) -> int:
        i = bisect_left(self.breaks, at)
        return self.breaks[i - 1] + 1 if i else 0

    def before(self, rule: str, at: int) -> bool:
        """Whether the line of at has a match of the rule that ends before it."""
        if rule not in self.found:
            got = [m.span() for m in _RULES[rule].finditer(self.text)] if self.may_hold(rule) else []
            self.found[rule] = ([a for a, _ in got], [b for _, b in got])
        starts, ends = self.found[rule]
        i = bisect_left(starts, self.begin(at))
        return i < len(starts) and ends[i] <= at

    def may_hold(self, rule: str) -> bool:
        """Whether what stands before any colon ends as the rule's matches do."""
        if self.heads is None:
            self.heads = [self.text[max(0, m.start() - 9) : m.start()] for m in _COLON.finditer(self.text)]
        return any(map(_TAILS[rule].search, self.heads))

    def opens(self, at: int) -> bool:
        """Whether only blanks stand before at in its line."""
        while at and self.text[at - 1] != "\n" and self.text[at - 1].isspace():
            at -= 1
        return at == 0 or self.text[at - 1] == "\n"


def _is_date(raw: str) -> bool:
    """A date, a received note, a publisher's block or a numbered thing in brackets."""
    inner = raw.strip("()[]").strip()
    if _RULES["PUBLISHER_BLOCK"].match(inner) or _RULES["RECEIVED"].match(inner) or _RULES["NUMBERED_THING"].match(inner):
        return True
    first = inner.split(",")[0].strip().lower()
    words = first.split()
    if first in P.MONTHS or first in P.SEASONS:
        return True
    if len(words) == 2 and re.match(r"^\d{1,2}(?:st|nd|rd|th)?$", words[1]) and (words[0].rstrip(".") in P.MONTHS or words[0].rstrip(".") in P.SHORT_MONTHS):
        return True
    words = inner.lower().split()
    return len(words) == 2 and (words[0] in P.MONTHS or words[0] in P.SEASONS) and bool(re.match(r"^\d{4}$", words[1]))


def _in_scenario(lines: _Lines, a: int) -> bool:
    """Whether the text around describes tests or templates of citations."""
    text = lines.text
    around = text[max(0, a - 50) : a + 100]
    line = text[lines.begin(a) : lines.begin(a) + 200].split("\n")[0]
    return bool(_RULES["SCENARIO"].search(around) or _RULES["SCENARIO_LINE"].match(line) or _RULES["TEMPLATE"].search(around)) or lines.before("SCENARIO_BEFORE", a)


def _numeric(raw: str, lines: _Lines, a: int, b: int, kind: str) -> bool:
    if _RULES["NOT_AN_INDEX"].search(raw) and raw.startswith("["):
        return False
    if kind == "numeric" or re.match(r"^\[\s*\d+\s*\]$", raw):
        # A marker that opens a line opens an entry of a list, unless the sentence goes on behind it.
        after = lines.text[b : b + 200]
        if lines.opens(a) and not re.match(r"^\s*[,.;:)\]]|^\s+[a-z]", after):
            return False
    return not _in_scenario(lines, a)


def _narrative(raw: str, lines: _Lines, a: int) -> str | None:
    if lines.before("HOW_TO_CITE", a):
        return None
    raw = _RULES["ACRONYMS"].sub("", raw).strip()
    return None if _RULES["THING_BEFORE_YEAR"].match(raw) or _RULES["FOUNDING_YEAR"].search(raw) else raw


def _bracketed(raw: str, name: str) -> bool:
    if not name.startswith("mla") and not _RULES["SOME_YEAR"].search(raw):
        return False
    head = _RULES["LEAD_IN"].sub("", raw[1:].split(",")[0].strip().lstrip(_QUOTES)).strip()
    if not head or head[0].isdigit() or not any(c.isupper() for c in head):
        return False
    return not head[0].islower() or bool(_RULES["PARTICLE"].match(head))


def find_spans(text: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, raw, pattern, kind) of the citations of a text, pattern by pattern."""
    text = text or ""
    lines, taken, seen = _Lines(text), bytearray(len(text)), set()
    every, carets = ([m.start() for m in re.finditer(c, text)] for c in (r"[(\[]", r"\^"))
    opening = {"": every} | {f"\\{c}": [at for at in every if text[at] == c] for c in "(["}
    for name, kind, pattern in _PATTERNS:
        for m in _matches(name, pattern, text, opening, carets):
            a, b = m.span()
            raw = re.sub(r"\s+", " ", m.group(0)).strip()
            if len(raw) > P.LONGEST or _RULES["BARE_YEAR"].match(raw) or (a, b) in seen or taken.find(1, a, b) >= 0:
                continue
            seen.add((a, b))
            if kind in ("doi", "url"):
                raw = raw.rstrip(".,;:")
            else:
                if (kind == "numeric" or raw.startswith("[")) and not _numeric(raw, lines, a, b, kind):
                    continue
                if _RULES["PLACEHOLDER"].match(raw) or _RULES["TITLE"].search(raw) or _is_date(raw):
                    continue
                if kind == "in_text" and raw[0] not in "([":
                    raw = _narrative(raw, lines, a)
                    if raw is None:
                        continue
                elif kind == "in_text" and not _bracketed(raw, name):
                    continue
            taken[a:b] = b"\1" * (b - a)
            yield a, b, raw, name, kind
