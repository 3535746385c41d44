"""The block structure of a Markdown text, as far as its headings need it.

Lines go through a stack of open containers (quotes and list items), each of which takes its part of the line or is left; what follows
opens further containers or a leaf: a heading, fenced or indented code, an HTML block, a break or a paragraph. Headings count wherever they
stand, and nothing in code or HTML is one. Offsets are code points.
"""

from __future__ import annotations

import html
import re
import unicodedata
from typing import NamedTuple


class Heading(NamedTuple):
    start: int
    end: int
    level: int
    title: str


LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
FENCE = re.compile(r"`{3,}(?=[^`]*$)|~{3,}")
ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
BREAK = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
ITEM = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})[.)](?=[ \t]|$)")
DEFINITION = re.compile(r"\[(?!\s*\])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
# The names of the CommonMark specification for HTML blocks.
RAW_TAGS = "pre|script|style|textarea"
BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|"
    "iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
TAG = rf"<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
#: How each kind of HTML block begins and what its last line has; without that it lasts to a blank line.
HTML_BLOCKS = (
    (re.compile(rf"<(?:{RAW_TAGS})(?:\s|>|$)", re.I), re.compile(rf"</(?:{RAW_TAGS})>", re.I)), (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(rf"</?(?:{BLOCK_TAGS})(?:\s|/?>|$)", re.I), None), (re.compile(rf"(?:{TAG})\s*$"), None),
)


class _Line:
    """What is left of a line, with the column that tabs are counted from."""

    def __init__(self, text: str):
        self.text, self.at, self.column, self.owed = text, 0, 0, 0

    @property
    def rest(self) -> str:
        return self.text[self.at :]

    def indent(self) -> int:
        """Columns of blanks before the next character."""
        column = self.column
        for c in self.rest:
            if c == "\t":
                column += 4 - column % 4
            elif c == " ":
                column += 1
            else:
                break
        return self.owed + column - self.column

    def blank(self) -> bool:
        return not self.rest.strip(" \t")

    def skip(self, columns: int) -> None:
        """Take so many columns of blanks; a tab may be taken in part."""
        take = min(columns, self.owed)
        self.owed -= take
        columns -= take
        while columns > 0 and self.at < len(self.text) and self.text[self.at] in " \t":
            width = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
            self.at, self.column = self.at + 1, self.column + width
            self.owed = max(0, width - columns)
            columns -= min(width, columns)

    def take(self, n: int) -> None:
        self.at, self.column, self.owed = self.at + n, self.column + n, 0


class _Blocks:
    def __init__(self) -> None:
        self.found: list[Heading] = []
        #: Open containers: None for a quote, [columns, whether it has content] for a list item.
        self.open: list[list | None] = []
        #: "", "fence", "html", "code" or "paragraph".
        self.leaf = ""
        self.fence, self.until, self.start, self.lines = "", None, 0, []

    def close(self) -> None:
        self.leaf, self.lines = "", []

    def line(self, text: str, at: int, end: int) -> None:
        """One line without its break, where it begins, and where the next one does."""
        line, kept = _Line(text), 0
        for box in self.open:
            if box is None:
                if line.indent() > 3 or not line.rest.lstrip(" \t").startswith(">"):
                    break
                self._quote(line)
            elif line.blank():
                if not box[1]:
                    break
            elif line.indent() >= box[0]:
                line.skip(box[0])
            else:
                break
            kept += 1
        whole = kept == len(self.open)
        if whole and self.leaf in ("fence", "html", "code") and self._goes_on(line):
            return
        fresh = False  # whether this line opened a container
        while not line.blank():
            if line.indent() > 3:
                if self.leaf != "paragraph" or fresh:
                    self._leave(kept)
                    self.leaf = "code"
                    return
                break
            bare = line.rest.lstrip(" \t")
            gap = len(line.rest) - len(bare)
            inside = self.leaf == "paragraph" and not fresh
            if bare[0] == ">":
                self._leave(kept)
                self._quote(line)
                self.open.append(None)
                kept, fresh = len(self.open), True
                continue
            if m := ATX.match(bare):
                self._leave(kept)
                title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2].rstrip(" \t"))
                self.found.append(Heading(at + line.at + gap, end, len(m[1]), plain_title(title)))
                self._filled()
                return
            if m := FENCE.match(bare):
                self._leave(kept)
                self.leaf, self.fence = "fence", m[0]
                self._filled()
                return
            if self._html(line, bare, kept, inside):
                return
            if inside and whole and (m := UNDERLINE.match(bare)):
                lines = DEFINITIONS.sub("", "\n".join(self.lines))
                if lines.strip():
                    self.found.append(Heading(self.start, end, 1 if m[1][0] == "=" else 2, plain_title(lines)))
                    self.close()
                    return
            if BREAK.match(bare):
                self._leave(kept)
                self._filled()
                return
            m = ITEM.match(bare)
            if not m or inside and whole and (not bare[m.end() :].strip(" \t") or m[2] not in (None, "1")):
                break
            self._leave(kept)
            self._item(line, m, gap)
            kept, fresh = len(self.open), True
        if line.blank():
            if not fresh:
                self._leave(kept)
            self.close()
            return
        if self.leaf == "paragraph" and not fresh:  # also of a container that this line doesn't continue
            self.lines.append(line.rest.strip(" \t"))
            return
        self._leave(kept)
        self._filled()
        self.leaf, self.start, self.lines = "paragraph", at + len(text) - len(line.rest.lstrip(" \t")), [line.rest.strip(" \t")]

    def _leave(self, kept: int) -> None:
        """Close the leaf, and the containers that the line doesn't continue."""
        self.close()
        del self.open[kept:]

    def _filled(self) -> None:
        for box in self.open:
            if box is not None:
                box[1] = True

    def _quote(self, line: _Line) -> None:
        line.skip(line.indent())
        line.take(1)
        if line.rest[:1] in (" ", "\t"):
            line.skip(1)

    def _item(self, line: _Line, m: re.Match, gap: int) -> None:
        before = line.indent()
        line.skip(before)
        line.take(m.end())
        after = line.indent()
        blank = line.blank()
        pad = 1 if blank or after > 4 else after
        line.skip(pad)
        for box in self.open:
            if box is not None:
                box[1] = True
        self.open.append([before + m.end() + pad, not blank])

    def _goes_on(self, line: _Line) -> bool:
        """Whether the line belongs to the open code or HTML block."""
        if self.leaf == "fence":
            bare = line.rest.strip(" \t")
            if line.indent() <= 3 and len(bare) >= len(self.fence) and set(bare) == {self.fence[0]}:
                self.close()
            return True
        if self.leaf == "html":
            if self.until is None and line.blank():
                self.close()
                return False
            if self.until is not None and self.until.search(line.rest):
                self.close()
            return True
        if line.indent() > 3 or line.blank():
            return True
        self.close()
        return False

    def _html(self, line: _Line, bare: str, kept: int, inside: bool) -> bool:
        if bare[0] != "<":
            return False
        for k, (begin, until) in enumerate(HTML_BLOCKS):
            if begin.match(bare) and not (k == len(HTML_BLOCKS) - 1 and inside):
                self._leave(kept)
                self._filled()
                if until is None or not until.search(bare):
                    self.leaf, self.until = "html", until
                return True
        return False


DEFINITIONS = re.compile(rf"\A(?:{DEFINITION.pattern})+")


def headings(text: str) -> list[Heading]:
    """The headings of a text in order; a heading's end takes in its line break. A title is its plain text."""
    blocks = _Blocks()
    for m in LINE.finditer(text):
        if m.end() > m.start():
            blocks.line(m[0].rstrip("\r\n"), m.start(), m.end())
    return blocks.found


CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
INLINE_HTML = re.compile(rf"{TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_title(raw: str) -> str:
    """The text of a heading's inline content: without marks of emphasis, links and tags, with code and entities as what they stand for."""
    pieces: list[str | list] = []  # text, or a run of marks: [mark, left over, opens, closes, length]
    brackets: list[int] = []
    k, buffer = 0, []

    def flush() -> None:
        if buffer:
            pieces.append("".join(buffer))
            buffer.clear()

    while k < len(raw):
        c = raw[k]
        if c == "\\" and raw[k + 1 : k + 2] and raw[k + 1] in PUNCTUATION:
            buffer.append(raw[k + 1])
            k += 2
        elif c == "`":
            m = CODE.match(raw, k)
            run = m[0] if m else re.match(r"`+", raw[k:])[0]
            if m:
                inner = m[2].replace("\n", " ")
                run_text = inner[1:-1] if inner[0] == inner[-1] == " " and inner.strip(" ") else inner
            buffer.append(run_text if m else run)
            k += len(run)
        elif c == "<" and (m := AUTOLINK.match(raw, k)):
            buffer.append(m[1])
            k = m.end()
        elif c == "<" and (m := INLINE_HTML.match(raw, k)):
            k = m.end()
        elif c == "&" and (m := ENTITY.match(raw, k)):
            buffer.append(html.unescape(m[0]))
            k = m.end()
        elif c == "\n":  # a line break is no text
            while buffer and buffer[-1] in (" ", "\\"):
                buffer.pop()
            k += 1
        elif c in "*_":
            run = re.match(rf"\{c}+", raw[k:])[0]
            flush()
            pieces.append([c, len(run), *_sides(c, raw[k - 1 : k], raw[k + len(run) : k + len(run) + 1]), len(run)])
            k += len(run)
        elif c == "[" or raw.startswith("![", k):
            flush()
            brackets.append(len(pieces))
            pieces.append("[" if c == "[" else "![")
            k += 1 if c == "[" else 2
        elif c == "]" and brackets:
            flush()
            opened = brackets.pop()
            if m := TARGET.match(raw, k + 1):
                inner = pieces[opened + 1 :]
                pieces[opened:] = [_without_marks(inner)]
                k = m.end()
            else:
                buffer.append("]")
                k += 1
        else:
            buffer.append(c)
            k += 1
    flush()
    return _without_marks(pieces).strip()


def _sides(mark: str, before: str, after: str) -> tuple[bool, bool]:
    """Whether a run of marks may open and may close emphasis."""
    space = lambda x: not x or x.isspace()
    sign = lambda x: bool(x) and unicodedata.category(x)[0] in "PS"
    left = not space(after) and (not sign(after) or space(before) or sign(before))
    right = not space(before) and (not sign(before) or space(after) or sign(after))
    return (left, right) if mark == "*" else (left and (not right or sign(before)), right and (not left or sign(after)))


def _without_marks(pieces: list) -> str:
    """The text without the marks that pair up as emphasis."""
    for k, closer in enumerate(pieces):
        while isinstance(closer, list) and closer[3] and closer[1]:
            for opener in reversed(pieces[:k]):
                if isinstance(opener, list) and opener[0] == closer[0] and opener[2] and opener[1]:
                    odd = (opener[3] or closer[2]) and (opener[4] + closer[4]) % 3 == 0 and (opener[4] % 3 or closer[4] % 3)
                    if not odd:
                        break
            else:
                break
            n = 2 if min(opener[1], closer[1]) >= 2 else 1
            opener[1] -= n
            closer[1] -= n
            between = next(j for j in range(k - 1, -1, -1) if pieces[j] is opener)
            for j in range(between + 1, k):  # what stands between can't pair any more
                if isinstance(pieces[j], list):
                    pieces[j] = pieces[j][0] * pieces[j][1]
    return "".join(p if isinstance(p, str) else p[0] * p[1] for p in pieces)
