"""URLs of a text in time linear in its length.

As a regular expression (``as_pattern``) the rule is quadratic or worse: optional user info may end at any "@" of a run
without spaces, hosts of labels may be cut after any label, and every start tries all of that again. ``Matcher`` gives the
same matches by steps that each look at a character a bounded number of times:

* anchors: a scheme with "://", "www" with its dot, or the "/" after a name and a short top-level label;
* of each run without spaces: where it ends, its last word boundary, and the last "@" after which a host follows, since
  the expression takes the rightmost one;
* of each place where a label begins: whether a host that begins there holds, and where its match ends. That is the
  answer of the next label, or else of a top-level label here, so it is kept.

Character classes, boundaries and upper and lower case are those of Python's ``re``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

#: Fixed value: schemes that begin a URL.
SCHEMES = "https?|ftp|file|data|javascript|mailto|tel|git|ssh|magnet"
#: Private networks, and the numbers that may stand in the four places of an address.
PRIVATE = (r"(?:10|127)(?:\.\d{1,3}){3}", r"(?:169\.254|192\.168)(?:\.\d{1,3}){2}", r"172\.(?:1[6-9]|2\d|3[0-1])(?:\.\d{1,3}){2}")
FIRST, MIDDLE, LAST = r"[1-9]\d?|1\d\d|2[01]\d|22[0-3]", r"1?\d{1,2}|2[0-4]\d|25[0-5]", r"[1-9]\d?|1\d\d|2[0-4]\d|25[0-4]"
LETTER, LETTER_OR_DIGIT = r"a-z\u00a1-\uffff", r"a-z0-9\u00a1-\uffff"

_FLAGS = re.IGNORECASE
_ANCHOR = re.compile(rf"\b(?:(?:{SCHEMES})://|www\d{{0,3}}[.])", _FLAGS)
_SLASH = re.compile(r"[.][a-z]{2,4}/", _FLAGS)
_LABEL = re.compile(rf"(?:[{LETTER_OR_DIGIT}][{LETTER_OR_DIGIT}_-]{{0,62}})?[{LETTER_OR_DIGIT}]\.", _FLAGS)
_TOP = re.compile(rf"[{LETTER}]{{2,}}", _FLAGS)
_PORT = re.compile(r":\d{2,5}")
_SPACE = re.compile(r"\s")
_EDGE = re.compile(r"\b")
_NETWORK = re.compile("".join(f"(?!{p})" for p in PRIVATE) + rf"(?:{FIRST})(?:\.(?:{MIDDLE})){{2}}\.(?=\d)")
#: What the last number of an address may be, in the order of the alternatives.
_LAST = tuple(re.compile(p) for p in (r"[1-9]\d", r"[1-9]", r"1\d\d", r"2[0-4]\d", r"25[0-4]"))
#: Characters of the name before a top-level label and "/", with the four that ignoring case adds to a-z.
_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-İıſK"


def as_pattern(slash: bool, edge: bool) -> str:
    """The rule as an expression for Python's ``re`` with IGNORECASE; with ``slash`` a name before "/" begins a URL, with ``edge`` a match ends at a word boundary."""
    network = "".join(f"(?!{p})" for p in PRIVATE) + rf"(?:{FIRST})(?:\.(?:{MIDDLE})){{2}}(?:\.(?:{LAST}))"
    host = rf"(?:(?:[{LETTER_OR_DIGIT}][{LETTER_OR_DIGIT}_-]{{0,62}})?[{LETTER_OR_DIGIT}]\.)*(?:[{LETTER}]{{2,}}\.?)"
    start = rf"(?:{SCHEMES})://|www\d{{0,3}}[.]" + (r"|[a-z0-9.\-]+[.][a-z]{2,4}/" if slash else "")
    return rf"\b(?:{start})(?:\S+(?::\S*)?@)?(?:{network}|{host})(?::\d{{2,5}})?(?:[/?#][^\s]*)?" + (r"\b" if edge else "")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Matcher:
    """Matches of one text, from left to right and apart, as ``re.finditer`` gives them."""

    def __init__(self, text: str, slash: bool, edge: bool, seconds: float | None = None):
        self.text, self.slash, self.edge = text, slash, edge
        self.until = time.monotonic() + seconds if seconds is not None else None
        self.runs = [(0, -1, 0)]
        self.hosts: dict[int, int] = {}
        self.asked_until, self.last_at = -1, (-1, -1)

    def check_time(self) -> None:
        if self.until is not None and time.monotonic() > self.until:
            raise TimeoutError

    def is_edge(self, i: int) -> bool:
        t = self.text
        return (i > 0 and _word(t[i - 1])) != (i < len(t) and _word(t[i]))

    def run_at(self, i: int) -> tuple[int, int, int]:
        """Of the run without spaces that ``i`` lies in or ends: from where it is known, its end, its last word boundary."""
        for run in self.runs:
            if run[0] <= i <= run[1]:
                return run
        m, t = _SPACE.search(self.text, i), self.text
        edge = end = m.start() if m else len(t)
        while edge > i and not _word(t[edge - 1]):
            edge -= 1
        self.runs = [(i, end, edge), self.runs[0]]  # a host may reach into the next run, as some white space is a letter to it
        return self.runs[0]

    def path_end(self, i: int) -> int:
        """The end of a match whose host and port end at ``i``; -1 if none may end there or later."""
        t = self.text
        if i < len(t) and t[i] in "/?#":
            _, end, edge = self.run_at(i)
            if not self.edge:
                return end
            if edge > i:
                return edge
        return i if not self.edge or self.is_edge(i) else -1

    def tail_end(self, i: int) -> int:
        """The same before a port."""
        m = _PORT.match(self.text, i)
        if m:
            for j in range(m.end(), i + 2, -1):
                if (end := self.path_end(j)) >= 0:
                    return end
        return self.path_end(i)

    def top_end(self, i: int) -> int:
        """The end of a match whose top-level label begins at ``i``."""
        m = _TOP.match(self.text, i)
        if not m:
            return -1
        t, z = self.text, m.end()
        if z < len(t) and t[z] == "." and (end := self.tail_end(z + 1)) >= 0:
            return end
        if (end := self.tail_end(z)) >= 0:
            return end
        label = t[i:z]
        if label.isalnum():  # no boundary inside
            return -1
        return next((j for j in range(z - 1, i + 1, -1) if self.is_edge(j)), -1)

    def host_end(self, i: int) -> int:
        """The end of a match whose host begins at ``i``: with as many labels as give one."""
        hosts, waiting, at = self.hosts, [], i
        while at not in hosts:
            waiting.append(at)
            m = _LABEL.match(self.text, at)
            if not m:
                break
            at = m.end()
        end = hosts.get(at, -1)
        for place in reversed(waiting):
            if end < 0:
                end = self.top_end(place)
            hosts[place] = end
        return end

    def network_end(self, i: int) -> int:
        m = _NETWORK.match(self.text, i)
        if m:
            for p in _LAST:
                if (n := p.match(self.text, m.end())) and (end := self.tail_end(n.end())) >= 0:
                    return end
        return -1

    def site_end(self, i: int) -> int:
        """The end of a match whose address or host begins at ``i``."""
        end = self.network_end(i)
        return end if end >= 0 else self.host_end(i)

    def rest_end(self, p: int) -> int:
        """The end of a match whose anchor ends at ``p``; -1 without one."""
        if p > self.asked_until:  # the rightmost "@" of the run that a site follows; later anchors of the run ask for the same
            self.asked_until, self.hosts = self.run_at(p)[1], {}
            at, end = self.asked_until, -1
            while end < 0 and (at := self.text.rfind("@", p + 1, at)) >= 0:
                self.check_time()
                end = self.site_end(at + 1)
            self.last_at = (at, end)
        at, end = self.last_at
        return end if at > p else self.site_end(p)

    def slash_start(self, found: re.Match, since: int) -> int:
        """Where a name before a top-level label and "/" begins; -1 if it does not."""
        dot = low = found.start()
        for n in (64, 4096, dot):  # mostly a short way back
            first = max(since, dot - n)
            low = first + len(self.text[first:dot].rstrip(_NAME))
            if low > first or first == since:
                break
        m = _EDGE.search(self.text, low)
        return m.start() if m and m.start() < dot else -1

    def spans(self) -> Iterator[tuple[int, int]]:
        """Start and end of every match."""
        t, since = self.text, 0
        anchor = _ANCHOR.search(t)
        slash = _SLASH.search(t) if self.slash else None
        slash_at = -1
        while anchor or slash:
            self.check_time()
            if slash and slash_at < 0:
                slash_at = self.slash_start(slash, since)
                if slash_at < 0:
                    slash = _SLASH.search(t, slash.end() - 1)
                    continue
            if anchor and not (slash and slash_at < anchor.start()):
                start, end = anchor.start(), self.rest_end(anchor.end())
                if end < 0:
                    anchor = _ANCHOR.search(t, start + 1)
            else:
                start, end = slash_at, self.rest_end(slash.end())
                if end < 0:
                    slash, slash_at = _SLASH.search(t, slash.end() - 1), -1
            if end >= 0:
                yield start, end
                since = end
                if anchor and anchor.start() < end:
                    anchor = _ANCHOR.search(t, end)
                if slash:
                    slash, slash_at = _SLASH.search(t, end) if slash.start() < end else slash, -1


def find_urls(text: str, slash: bool, edge: bool, seconds: float | None = None) -> list[str]:
    """Sorted distinct matches."""
    return sorted({text[a:b] for a, b in Matcher(text, slash, edge, seconds).spans()})
