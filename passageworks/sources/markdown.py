"""Markdown text as one HTML string.

A text is a sequence of lines in one of a few states: in a fence, in a list of some depth, in
raw HTML, in a quote, in plain paragraphs. Every step is one linear pattern over the text inside its row:
fences are cut out first, so nothing in them is read as Markdown; list items carry their depth and are
closed from the deepest level outwards; code spans, raw tags and link targets are put out of reach (their
marks become private-use characters) before emphasis is looked for.

Supported: ATX and underlined headings, rules, fenced and indented code, nested lists, quotes, raw HTML
blocks and tags, paragraphs; code spans, emphasis with ``*`` and ``_``, links, images, automatic
links, hard line breaks, backslash escapes and entities. Four blanks of indent make one level of a list;
items of ``DEPTHS`` levels or more count as one level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binding import bind

#: Levels of nested lists that are told apart.
DEPTHS = 6
# Control characters that do not occur in text files: between blocks, around a list item, around
# a list inside another one, and a rule.
BLOCK, ITEM, END, OPEN, CLOSE, RULE = "\x1e", "\x1c", "\x1d", "\x01", "\x02", "\x1f"
# Characters that a backslash escapes, and tags that begin a block of raw HTML.
MARKS = "\\`*_{}[]()#+-.!<>&"
RAW = (
    "address|article|aside|blockquote|body|center|details|dialog|dd|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    "h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|noscript|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
#: Stand-ins for marks that are not Markdown.
PRIVATE = "".join(chr(0xE000 + i) for i in range(len(MARKS)))

FENCE = r"(?ms)^ {0,3}(`{3,}+|~{3,}+)[^`\n]*+\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$\n?|\z)"
MARKER = r"(?:[-*+]|[0-9]+\.)[ \t]+"
LINE = rf"(?m)^[ \t]*{MARKER}[^\n{BLOCK}]*+(?:\n(?![ \t]*{MARKER})(?![ \t]*$)[^\n{BLOCK}]*+)*+"
# Parts of a paragraph that emphasis must not reach: escaped mark, code span, automatic link, tag, target of a link.
APART = r"(?s)\\[\\`*_{}\[\]()#+\-.!<>&]|(?<!`)(?:(`++).+?(?<!`)\1(?!`)|<(?:https?|ftp)://[^<>\s]+>|</?[A-Za-z][^<>@\s]*(?:\s[^<>]*)?>|<!--.*?-->|\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\))"


def _escaped(text: Column) -> Column:
    """Text outside of tags: entities stay, other special characters become entities."""
    text = F.regexp_replace(text, r"&(?!#?[A-Za-z0-9]+;)", "&amp;")
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _code(text: Column) -> Column:
    """Text of code: every special character becomes an entity."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _woven(rests: Column, parts: Column) -> Column:
    """What lies between the parts, and the parts, in turn."""
    return F.array_join(F.zip_with(rests, parts, lambda r, p: F.concat(r, F.coalesce(p, F.lit("")))), "")


def _apart(part: Column) -> Column:
    """HTML of a part that emphasis must not reach, with its marks out of reach."""
    hidden = lambda c: F.translate(c, MARKS, PRIVATE)
    body = F.regexp_replace(part, r"\A`+\s*|\s*`+\z", "")
    link = F.substring(part, F.lit(2), F.length(part) - 2)
    return (
        F.when(part.startswith("\\"), hidden(_code(F.substring(part, 2, 1))))
        .when(part.startswith("`"), F.concat(F.lit("<code>"), hidden(_code(body)), F.lit("</code>")))
        .when(part.startswith("]("), F.translate(F.regexp_replace(part, r"&(?!#?[A-Za-z0-9]+;)", "&amp;"), "*_", "".join(PRIVATE[MARKS.index(c)] for c in "*_")))
        .when(part.rlike(r"\A<(?:https?|ftp)://"), hidden(F.concat(F.lit('<a href="'), link, F.lit('">'), link, F.lit("</a>"))))
        .otherwise(hidden(part))
    )


def inline(text: Column) -> Column:
    """HTML of the inside of a block."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(APART), F.lit(0)), _apart)
    done = _woven(F.transform(F.split(text, APART), _escaped), parts)
    word = r"\p{L}\p{N}_"
    for mark, html in (
        (r"!\[([^\[\]\n]*+)\]\(([^()\s]*)(?:\s+(\"[^\"\n]*\"))?\)", '<img alt="$1" src="$2" />'),
        (r"\[([^\[\]\n]*+)\]\(([^()\s]*)\s+(\"[^\"\n]*\")\)", '<a href="$2" title=$3>$1</a>'),
        (r"\[([^\[\]\n]*+)\]\(([^()\s]*)\)", '<a href="$2">$1</a>'),
        (r"\*\*\*(?=\S)([^*]+)(?<=\S)\*\*\*", "<strong><em>$1</em></strong>"),
        (r"(?<!\*)\*(?![*\s])([^*]+)(?<![*\s])\*(?!\*)", "<em>$1</em>"),
        (r"\*\*(?=\S)([^*]+)(?<=\S)\*\*", "<strong>$1</strong>"),
        (rf"(?<![{word}])___(?=\S)([^_]+)(?<=\S)___(?![{word}])", "<strong><em>$1</em></strong>"),
        (rf"(?<![{word}])_(?![_\s])([^_]+)(?<![_\s])_(?![{word}])", "<em>$1</em>"),
        (rf"(?<![{word}])__(?=\S)([^_]+)(?<=\S)__(?![{word}])", "<strong>$1</strong>"),
        (r" {2,}\n", "<br />\n"),
    ):
        done = F.regexp_replace(done, mark, html)
    return F.translate(done, PRIVATE, MARKS)


def _split(piece: Column) -> Column:
    """Blocks of a text without fences; headings, rules and list items stand alone."""
    for pattern, alone in (
        (r"(?m)^([^\s#>*+-][^\n]*)\n=+[ \t]*$", "# $1"),
        (r"(?m)^([^\s#>*+-][^\n]*)\n-{2,}[ \t]*$", "## $1"),
        (r"(?m)^ {0,3}(?:\*[ \t]*\*[ \t]*\*[* \t]*+|-[ \t]*-[ \t]*-[- \t]*+|_[ \t]*_[ \t]*_[_ \t]*+)$", f"{BLOCK}{RULE}{BLOCK}"),
        (r"(?m)^(#{1,6}[ \t]*[^#\n][^\n]*)$", f"{BLOCK}$1{BLOCK}"),
        (LINE, f"{BLOCK}$0{BLOCK}"),
        (r"\n[ \t]*(?=\n)", BLOCK),
    ):
        piece = F.regexp_replace(piece, pattern, alone)
    blocks = F.transform(F.split(piece, BLOCK), lambda b: F.regexp_replace(b, r"\A\n+|[ \t\n]+\z", ""))
    return F.filter(blocks, lambda b: b != "")


def _kind(block: Column) -> Column:
    return (
        F.when(block == RULE, "rule")
        .when(block.rlike(r"\A#{1,6}[ \t]*[^#\n][^\n]*\z"), "heading")
        .when(block.rlike(rf"\A[ \t]*{MARKER}"), "item")
        .when(block.rlike(r"\A(?: {4}|\t)[^\n]*(?:\n(?: {4}|\t)[^\n]*+)*+\z"), "code")
        .when(block.rlike(r"\A {0,3}>"), "quote")
        .when(block.rlike(rf"(?i)\A<(?:!--|/?(?:{RAW})\b)"), "raw")
        .otherwise("paragraph")
    )


def _inside(block: Column, kind: Column) -> Column:
    """The text of a block without what marks its kind."""
    return (
        F.when(kind == "heading", F.regexp_replace(block, r"\A#{1,6}[ \t]*|[ \t]*#*[ \t]*\z", ""))
        .when(kind == "item", F.regexp_replace(F.regexp_replace(block, rf"\A[ \t]*{MARKER}", ""), r"\n[ \t]+", "\n"))
        .when(kind == "code", F.regexp_replace(block, r"(?m)^(?: {4}|\t)", ""))
        .when(kind == "quote", F.regexp_replace(block, r"(?m)^ {0,3}>[ \t]?", ""))
        .when(kind == "paragraph", F.ltrim(block))
        .otherwise(block)
    )


def _around(block: Column, kind: Column, html: Column) -> Column:
    """The HTML of a block from that of its inside; of a list item, its depth and kind too."""
    level = F.concat(F.lit("h"), F.length(F.regexp_extract(block, r"\A(#{1,6})", 1)).cast("string"), F.lit(">"))
    indent = F.length(F.replace(F.regexp_extract(block, r"\A([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    depth = F.least(F.floor(indent / 4), F.lit(DEPTHS - 1)).cast("string")
    list_kind = F.when(block.rlike(r"\A[ \t]*[0-9]"), F.lit("o")).otherwise(F.lit("u"))
    between = lambda before, after: F.concat(F.lit(before), html, F.lit(after))
    return (
        F.when(kind == "rule", "<hr />")
        .when(kind == "heading", F.concat(F.lit("<"), level, html, F.lit("</"), level))
        .when(kind == "item", F.concat(F.lit(ITEM), depth, list_kind, html, F.lit(END)))
        .when(kind == "code", between("<pre><code>", "\n</code></pre>"))
        .when(kind == "quote", between("<blockquote>\n<p>", "</p>\n</blockquote>"))
        .when(kind == "raw", html)
        .otherwise(between("<p>", "</p>"))
    )


def _render(block: Column) -> Column:
    def finished(kind: Column, inside: Column) -> Column:
        html = F.when(kind.isin("rule", "raw"), inside).when(kind == "code", _code(inside)).otherwise(inline(inside))
        return bind(html, lambda h: _around(block, kind, h))

    return bind(_kind(block), lambda kind: bind(_inside(block, kind), lambda inside: finished(kind, inside)))


def _lists(html: Column) -> Column:
    """Items closed into lists, the deepest first; a list goes into the item before it."""
    inside = f"[^{ITEM}{END}{OPEN}{CLOSE}]*+"
    for depth in range(DEPTHS - 1, -1, -1):
        for kind in "uo":
            one = f"{ITEM}{depth}{kind}"
            html = F.regexp_replace(html, f"{one}{inside}{END}(?:\n{one}{inside}{END})*+", f"{OPEN}<{kind}l>\n$0\n</{kind}l>{CLOSE}")
            html = F.regexp_replace(html, f"{one}({inside}){END}", "<li>$1</li>")
        html = F.regexp_replace(html, f"{END}\n{OPEN}({inside}){CLOSE}", f"$1\n{END}")
        # two lists of different kinds may follow one item
        html = F.regexp_replace(html, f"{END}\n{OPEN}({inside}){CLOSE}", f"$1\n{END}")
        html = F.translate(html, OPEN + CLOSE, "")
    return html


def markdown_html(text: Column) -> Column:
    """One HTML string per Markdown text, blocks separated by newlines."""
    fences = F.transform(
        F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)), lambda f: F.array(F.concat(F.lit("<pre><code>"), _code(f), F.lit("</code></pre>")))
    )
    pieces = F.transform(F.split(text, FENCE), lambda p: bind(_split(p), lambda blocks: F.transform(blocks, lambda b: bind(b, _render))))
    parts = F.zip_with(pieces, fences, lambda p, f: F.concat(p, F.coalesce(f, F.array().cast("array<string>"))))
    return _lists(F.array_join(F.flatten(parts), "\n"))
