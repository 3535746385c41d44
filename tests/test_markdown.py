"""Headings by the block rules of CommonMark. The cases follow the public specification's sections on each block."""

import pytest

from corvane.functions.markdown import headings, plain_title
from corvane.operators.chunking import cut_markdown


def titles(text):
    return [(h.level, h.title) for h in headings(text)]


@pytest.mark.parametrize(("text", "wanted"), [
    # ATX headings
    ("# foo\n## foo\n### foo\n#### foo\n##### foo\n###### foo", [(k, "foo") for k in range(1, 7)]),
    ("####### foo", []), ("#5 bolt\n\n#hashtag", []), ("\\## foo", []), ("# foo *bar* \\*baz\\*", [(1, "foo bar *baz*")]), ("#                  foo                     ", [(1, "foo")]),
    (" ### foo\n  ## foo\n   # foo", [(3, "foo"), (2, "foo"), (1, "foo")]), ("    # foo", []), ("foo\n    # bar", []), ("## foo ##\n  ###   bar    ###", [(2, "foo"), (3, "bar")]),
    ("# foo ##################################\n##### foo ##", [(1, "foo"), (5, "foo")]), ("### foo ### b", [(3, "foo ### b")]), ("# foo#", [(1, "foo#")]), ("### foo \\###\n## foo #\\##\n# foo \\#", [(3, "foo ###"), (2, "foo ###"), (1, "foo #")]),
    ("****\n## foo\n****", [(2, "foo")]), ("Foo bar\n# baz\nBar foo", [(1, "baz")]), ("## \n#\n### ###", [(2, ""), (1, ""), (3, "")]), ("#\tFoo", [(1, "Foo")]),
    # setext headings
    ("Foo *bar*\n=========\n\nFoo *bar*\n---------", [(1, "Foo bar"), (2, "Foo bar")]), ("Foo *bar\nbaz*\n====", [(1, "Foo barbaz")]), ("  Foo *bar\nbaz*\t\n====", [(1, "Foo barbaz")]), ("Foo\n-------------------------\n\nFoo\n=", [(2, "Foo"), (1, "Foo")]),
    ("   Foo\n---\n\n  Foo\n-----\n\n  Foo\n  ===", [(2, "Foo"), (2, "Foo"), (1, "Foo")]), ("    Foo\n    ---\n\n    Foo\n---", []), ("Foo\n   ----      ", [(2, "Foo")]), ("Foo\n    ---", []), ("Foo\n= =\n\nFoo\n--- -", []),
    ("`Foo\n----\n`", [(2, "`Foo")]), ("> Foo\n---", []), ("> foo\nbar\n===", []), ("- Foo\n---", []), ("Foo\nBar\n---", [(2, "FooBar")]), ("---\nFoo\n---\nBar\n---\nBaz", [(2, "Foo"), (2, "Bar")]), ("\n====", []), ("---\n---", []), ("- foo\n-----", []),
    ("    foo\n---", []), ("> foo\n-----", []), ("\\> foo\n------", [(2, "> foo")]), ("Foo\n\nbar\n---\nbaz", [(2, "bar")]), ("Foo\nbar\n\n---\n\nbaz", []), ("Foo\nbar\n* * *\nbaz", []), ("Foo\nbar\n\\---\nbaz", []),
    # code and HTML hold none
    ("```\n# a\n```\n# b", [(1, "b")]), ("```\n# a\n~~~\n# b", []), ("````\n# a\n```\n# b\n`````\n# c", [(1, "c")]), ("~~~ x `y\n# a\n~~~", []), ("``` x `y\n# a", [(1, "a")]), ("    # a\n\n    # b\n# c", [(1, "c")]), ("   ```\n   # a\n  ```\n# b", [(1, "b")]),
    ("```\n# a\n    ```\n# b", []), ("> ```\n> # a\n\n# b", [(1, "b")]), ("<div>\n# a\n\n# b", [(1, "b")]), ("<pre>\n# a\n\n# b\n</pre>\n# c", [(1, "c")]), ("<!-- x\n# a\n\n-->\n# c", [(1, "c")]), ("<?php\n# a\n?>\n# b", [(1, "b")]), ("<b>\n# a", []),
    ("text\n<b>\n# a", [(1, "a")]), ("<![CDATA[\n# a\n]]>\n# b", [(1, "b")]), ("<!DOCTYPE html>\n# b", [(1, "b")]),
    # quotes and lists
    ("> # Foo\n> bar", [(1, "Foo")]), ("># Foo\n>bar", [(1, "Foo")]), ("   > # Foo", [(1, "Foo")]), ("    > # Foo", []), ("> # a\n# b", [(1, "a"), (1, "b")]), ("> a\n> ===", [(1, "a")]), (">\t# Foo", [(1, "Foo")]), ("> > > # deep", [(1, "deep")]),
    ("- # Foo\n- Bar\n  ---\n  baz", [(1, "Foo"), (2, "Bar")]), ("1. # a\n\n   ## b\n\n       # code\n# c", [(1, "a"), (2, "b"), (1, "c")]), ("-\n  # a", [(1, "a")]), ("-\n\n  # a", [(1, "a")]), ("- a\n\n      # code", []), ("- a\n# b", [(1, "b")]),
    ("* a\n  > # q\n\n  # i", [(1, "q"), (1, "i")]), ("10) # a\n\n    # b\n\n   # c", [(1, "a"), (1, "b"), (1, "c")]), ("-\t# a", [(1, "a")]), ("- a\n\n\t# b", [(1, "b")]), ("text\n2. # a", []), ("text\n1. # a", [(1, "a")]), ("text\n-\n# b", [(2, "text"), (1, "b")]),
    # definitions are no text of a heading
    ("[foo]: /url\n===\n[foo]", []), ("[foo]: /url 'x'\nbar\n===\n", [(1, "bar")]),
    # other characters end no line
    ("a\x0c# b", []), ("a\u2028# b\x85# c", []), ("a\r# b\r\n## c\rd\r===", [(1, "b"), (2, "c"), (1, "d")]), ("", []), ("\n\n", []), ("# a\x00b", [(1, "a\x00b")]),
])
def test_headings(text, wanted):
    assert titles(text) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [
    ("`code *x*` **b** _i_ snake_case_name 2*3*4", "code *x* b i snake_case_name 234"), ("[a *b*](/u 'x') ![alt](i.png) [ref] [x]()", "a b alt [ref] x"), ("&amp; &copy; &#35; &nope", "& © # &nope"), ("<b>x</b> <http://a.b> <!-- c -->y", "x http://a.b y"),
    ("***a** b*", "a b"), ("**a", "**a"), ("``a`b`` `c", "a`b `c"), ("a\\", "a\\"), ("*(**foo**)*", "(foo)"), ("** a **", "** a **"), ("foo*bar*baz_qux_", "foobarbaz_qux_"), ("[a](<b c> (t))", "a"), ("\\[a](b)", "[a](b)"),
])
def test_titles(raw, wanted):
    assert plain_title(raw) == wanted


def test_offsets_and_regions():
    text = "> # Q é\n> body\n\nSet\n===\nend"
    (quote, setext) = headings(text)
    assert text[quote.start : quote.end] == "# Q é\n" and text[setext.start : setext.end] == "Set\n===\n"
    chunks = cut_markdown(text, 100, 0)
    assert "".join(c["content"] for c in chunks) == text and [c["section_path"] for c in chunks] == [None, "/Q é", "/Q é", "/Set", "/Set"]


def test_long_texts_take_time_in_proportion():
    assert len(headings("# a\n\nsome *text* here\n- item\n" * 20_000)) == 20_000
    assert headings("> " * 50 + "# a")[0].title == "a" and headings("x" * 1_000_000 + "\n===")[0].level == 1
