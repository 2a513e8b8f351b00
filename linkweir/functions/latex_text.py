"""Text of LaTeX sources, by a reader with a stack of open groups, environments and formulas.

One pass over the tokens, linear in the length and without recursion:

* comments go, with the line end and the indent after them; ``\\%`` is a percent sign, and so is ``%`` inside ``\\url``;
* groups are transparent, so the arguments of macros that the reader does not know stay as text;
* macros of ``DROPPED`` go with their arguments; definitions go whole and are not expanded;
* ``\\url{u}`` reads ``<u>`` and ``\\href{u}{t}`` reads ``t <u>``, with the target taken literally but for escapes;
* accents become the composed letter, line breaks and spaces their characters;
* verbatim environments and ``\\verb`` stand as they are, ``comment`` environments go.

Input that does not close what it opens, or closes what it did not open, is broken: ``to_text`` raises, and ``readable``
gives the source itself, as its commands and addresses can still be found there.
"""

from __future__ import annotations

import re
import unicodedata


class Broken(ValueError):
    """A source whose groups, environments or formulas do not nest."""


_TOKEN = re.compile(r"[^\\{}%$~&]+|\\(?P<word>[A-Za-z@]+\*?)[ \t]*(?:\n(?![ \t]*\n)[ \t]*)?|\\(?P<sign>.)|%[^\n]*(?:\n[ \t]*)?|.", re.S)
_BRACE = re.compile(r"\\.|%[^\n]*\n?|[{}]", re.S)
_LITERAL_BRACE = re.compile(r"\\.|[{}]", re.S)
_GAP = re.compile(r"\s*(?:%[^\n]*\n\s*)*")
_OPTION = re.compile(r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]")
_DEFINED = re.compile(r"\s*\\(?:[A-Za-z@]+|.)[^{}]*", re.S)
_ESCAPED = re.compile(r"\\([%#&_$~{}\\])")

#: How many arguments in braces go with a macro; options in brackets go too.
DROPPED = {
    "documentclass": 1, "usepackage": 1, "RequirePackage": 1, "label": 1, "ref": 1, "eqref": 1, "pageref": 1, "cref": 1,
    "cite": 1, "citep": 1, "citet": 1, "nocite": 1, "bibitem": 1, "bibliography": 1, "bibliographystyle": 1, "input": 1, "include": 1,
    "includegraphics": 1, "vspace": 1, "hspace": 1, "setlength": 2, "addtolength": 2, "setcounter": 2, "addtocounter": 2,
    "pagestyle": 1, "thispagestyle": 1, "graphicspath": 1, "hypersetup": 1, "color": 1, "newcommand": 2, "renewcommand": 2,
    "providecommand": 2, "newenvironment": 3, "renewenvironment": 3, "DeclareMathOperator": 2, "newtheorem": 2,
}
#: The same for the beginnings of environments.
ENVIRONMENTS = {"tabular": 1, "tabularx": 2, "array": 1, "thebibliography": 1, "minipage": 1, "multicols": 1, "wrapfigure": 2}
VERBATIM = ("verbatim", "Verbatim", "lstlisting", "minted", "alltt")
#: Combining characters of the accents.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
SYMBOLS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ", "textbackslash": "\\", "textasciitilde": "~", "textunderscore": "_", "ldots": "...", "dots": "...", "newline": "\n", "par": "\n\n", "slash": "/"}


class _Reader:
    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.out: list[str] = []
        #: What is open, and what its end adds to the text.
        self.open: list[tuple[str, str]] = []

    def skip_gap(self) -> str:
        """The character after white space and comments, '' at the end."""
        self.at = _GAP.match(self.source, self.at).end()
        return self.source[self.at : self.at + 1]

    def skip_options(self) -> None:
        here = self.at
        while self.skip_gap() == "[" and (m := _OPTION.match(self.source, self.at)):
            here = self.at = m.end()
        self.at = here

    def group_end(self, braces: re.Pattern) -> int:
        """After the brace that closes the one at the reader."""
        depth = 0
        for m in braces.finditer(self.source, self.at):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                return m.end()
        raise Broken("group")

    def skip_arguments(self, n: int) -> None:
        for _ in range(n):
            self.skip_options()
            if self.skip_gap() == "{":
                self.at = self.group_end(_BRACE)
            elif self.source.startswith("\\", self.at):  # \newcommand\name
                self.at = _TOKEN.match(self.source, self.at).end()
            else:
                return

    def literal(self) -> str | None:
        """An argument taken as it stands, between braces or equal signs; None without one."""
        c = self.skip_gap()
        if c == "{":
            end = self.group_end(_LITERAL_BRACE)
        elif c and not c.isalnum() and not c.isspace() and c not in "\\}%":
            end = self.source.find(c, self.at + 1) + 1
            if not end:
                raise Broken("delimiter")
        else:
            return None
        got, self.at = self.source[self.at + 1 : end - 1], end
        return got

    def address(self) -> str | None:
        got = self.literal()
        return None if got is None else _ESCAPED.sub(r"\1", got).strip()

    def close(self, kind: str) -> None:
        if not self.open or self.open[-1][0] != kind:
            raise Broken(kind)
        self.out.append(self.open.pop()[1])

    def begin(self) -> None:
        name = (self.literal() or "").strip()
        if name in VERBATIM or name == "comment":
            mark = f"\\end{{{name}}}"
            end = self.source.find(mark, self.at)
            if end < 0:
                raise Broken(name)
            if name != "comment":
                self.skip_options()
                self.out.append(self.source[self.at : end])
            self.at = end + len(mark)
            return
        self.open.append((f"env {name}", "\n"))
        self.skip_options()
        self.skip_arguments(ENVIRONMENTS.get(name.rstrip("*"), 0))
        self.out.append("\n")

    def accent(self, mark: str) -> None:
        c = self.skip_gap()
        if c == "{":
            end = self.group_end(_BRACE)
            base, self.at = self.source[self.at + 1 : end - 1], end
        else:
            m = _TOKEN.match(self.source, self.at) if c == "\\" else None
            base = m[0] if m else c
            self.at += len(base)
        base = base.strip()
        base = {"\\i": "i", "\\j": "j"}.get(base, base)
        self.out.append(unicodedata.normalize("NFC", base[:1] + mark + base[1:]) if base else "")

    def word(self, name: str) -> None:
        bare = name.rstrip("*")
        if bare == "url" or bare == "nolinkurl" or bare == "path":
            if (u := self.address()) is not None:
                self.out.append(f"<{u}>")
        elif bare == "href":
            self.skip_options()
            u = self.address()
            if u is not None and self.skip_gap() == "{":
                self.at += 1
                self.open.append(("group", f" <{u}>"))
            elif u is not None:
                self.out.append(f" <{u}> ")
        elif bare == "begin":
            self.begin()
        elif bare == "end":
            self.close(f"env {(self.literal() or '').strip()}")
        elif bare in ("verb", "lstinline"):
            self.out.append(self.literal() or "")
        elif bare in ("def", "edef", "gdef", "xdef"):
            m = _DEFINED.match(self.source, self.at)
            self.at = m.end() if m else self.at
            self.skip_arguments(1)
        elif bare in DROPPED:
            self.skip_options()
            self.skip_arguments(DROPPED[bare])
            self.out.append(" ")
        elif bare == "footnote":
            self.out.append(" ")
        elif bare in ("item", "section", "subsection", "subsubsection", "paragraph", "chapter", "title", "author", "caption"):
            self.out.append("\n")
        elif bare in SYMBOLS:
            self.out.append(SYMBOLS[bare])
        elif len(bare) == 1 and bare in ACCENTS:
            self.accent(ACCENTS[bare])

    def sign(self, c: str) -> None:
        if c in "%&#_${}":
            self.out.append(c)
        elif c == "\\":
            self.skip_star_and_length()
            self.out.append("\n")
        elif c in ACCENTS:
            self.accent(ACCENTS[c])
        elif c in "([":
            self.open.append((f"math {c}", ""))
        elif c in ")]":
            self.close(f"math {'(' if c == ')' else '['}")
        elif c in " ,;:!/-\n\t":
            self.out.append("" if c in "!/-" else " ")

    def skip_star_and_length(self) -> None:
        if self.source.startswith("*", self.at):
            self.at += 1
        if self.source.startswith("[", self.at) and (m := _OPTION.match(self.source, self.at)):
            self.at = m.end()

    def dollar(self) -> None:
        kind = "$$" if self.source.startswith("$", self.at) and (self.open[-1:] != [("$", "")]) else "$"
        self.at += len(kind) - 1
        if self.open and self.open[-1][0] == kind:
            self.open.pop()
        elif any(k in ("$", "$$") for k, _ in self.open[-1:]):
            raise Broken("formula")
        else:
            self.open.append((kind, ""))

    def read(self) -> str:
        source = self.source
        while self.at < len(source):
            m = _TOKEN.match(source, self.at)
            self.at = m.end()
            token = m[0]
            if m["word"]:
                self.word(m["word"])
            elif m["sign"]:
                self.sign(m["sign"])
            elif token == "{":
                self.open.append(("group", ""))
            elif token == "}":
                self.close("group")
            elif token[0] == "%":
                pass
            elif token == "$":
                self.dollar()
            elif token in ("~", "&"):
                self.out.append(" ")
            elif token != "\\":
                self.out.append(token)
        if self.open:
            raise Broken(self.open[-1][0])
        return "".join(self.out)


def to_text(source: str) -> str:
    """Text of a source; raises ``Broken``."""
    return _Reader(source).read()


def readable(source: str) -> tuple[str, bool]:
    """Text of a source and whether it could be read; a broken one stands for itself."""
    try:
        return to_text(source), True
    except Broken:
        return source, False
