"""Leaf blocks of a text in HTML, Markdown, wiki or LaTeX notation, each with its tag path and content."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_SPECIAL = re.compile(
    r"""(?P<comment><!--.*?-->)
    |<pre\b[^>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)
    |(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*\n(?P<fenced>.*?)(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*$|\Z))
    |\{code(?::[^}\n]*)?\}(?P<wcode>.*?)\{code\}
    |\{noformat(?::[^}\n]*)?\}(?P<wraw>.*?)\{noformat\}
    |\\begin\{(?P<env>verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{[a-z]+\})?(?P<lcode>.*?)(?:\\end\{(?P=env)\}|\Z)
    |(?P<tick>(?<!`)`[^`\n]+`(?!`))
    |\{(?P<wm>math|latex)(?::[^}\n]*)?\}(?P<wmath>.*?)\{(?P=wm)\}
    |\\begin\{(?P<eq>equation\*?|align\*?|displaymath|math)\}(?P<lmath>.*?)\\end\{(?P=eq)\}
    |\\\[(?P<disp>.*?)\\\]
    |\\\((?P<inl>.*?)\\\)
    |(?<!\\)\$\$(?P<dd>(?:[^$]|\\\$)+?)\$\$
    |(?<![\\$\w])\$(?=[^\s$])(?P<d>[^$\n]*?[^\s$\\])\$(?!\d)""",
    re.X | re.S | re.M | re.I,
)
_CODE = {"pre": "html/pre", "fence": "md/fence", "wcode": "wiki/code", "wraw": "wiki/noformat", "lcode": "latex/verbatim"}
_MATH = {"wmath": "wiki/math", "lmath": "latex/equation", "disp": "tex/display", "inl": "tex/inline", "dd": "dollar/display", "d": "dollar/inline"}
_KEPT = re.compile("\0(\\d+)\0")
_TAG = re.compile(
    r"<(/?)(h[1-6]|li|ul|ol|p|div|blockquote|table|thead|tbody|tr|td|th|br|hr|html|head|body|img|b|strong|i|em|u|tt|code|span|a|del|ins|s|strike|sub|sup|kbd|samp|dl|dt|dd)\b([^<>]*)>",
    re.I,
)
_INLINE = frozenset("b strong i em u tt code span a del ins s strike sub sup kbd samp img".split())
_LINE = re.compile(
    r"^(?:[ ]{0,3}(?P<atx>\#{1,6})[ \t]+(?P<atx_text>.*?)(?:[ \t]+\#+)?[ \t]*"
    r"|[ \t]*h(?P<wh>[1-6])\.[ \t]+(?P<wh_text>.*)"
    r"|[ \t]*(?P<ord>\d{1,9}[.)])[ \t]+(?P<ord_text>.*)"
    r"|[ \t]*(?P<bul>[-*+]+)[ \t]+(?P<bul_text>.*)"
    r"|[ \t]*\\(?P<sec>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{(?P<sec_text>.*)"
    r"|[ \t]*\\item\b(?:\[[^\]]*\])?[ \t]*(?P<item_text>.*))$"
)
_NUMBERED = re.compile(r"[ ]{0,3}#[ \t]+\S")
_RULE = re.compile(r"[ ]{0,3}(?:=+|-{2,})[ \t]*$")
_BREAK = re.compile(r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_CLEAN = [
    ("![", re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    ("](", re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    ("|", re.compile(r"\[([^\]|\n]+)\|[^\]\n]+\]"), r"\1"),
    ("{color", re.compile(r"\{color(?::[^}\n]*)?\}"), ""),
    ("{{", re.compile(r"\{\{(.+?)\}\}"), r"\1"),
    ("`", re.compile(r"`([^`\n]+)`"), r"\1"),
    ("~~", re.compile(r"~~(?=\S)(.+?)(?<=\S)~~"), r"\1"),
    ("??", re.compile(r"\?\?(?=\S)(.+?)(?<=\S)\?\?"), r"\1"),
    ("**", re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*"), r"\1"),
    ("__", re.compile(r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)"), r"\1"),
    ("*", re.compile(r"(?<![\w*])\*(?=[\w\[{`_])([^*\n]*?)(?<=[\w\])}`_])\*(?![\w*])"), r"\1"),
    ("_", re.compile(r"(?<!\w)_(?=[^\W_]|[\[{`*])([^\n]*?)(?<=[^\s_])_(?!\w)"), r"\1"),
    ("+", re.compile(r"(?<![\w+])\+(?=[\w\[{])([^+\n]*?)(?<=[\w\])}])\+(?![\w+])"), r"\1"),
]
_TEX_LINK = re.compile(r"\\(?:href|textcolor|hyperref)(?:\[[^\]]*\])?\{[^{}]*\}\{([^{}]*)\}")
_TEX_WRAP = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|textsc|textsf|textrm|text|mbox|uline|sout|url)\{([^{}]*)\}")
_TEX_ESC = re.compile(r"\\([&%$#_{}])")


class Block(NamedTuple):
    """path: the tags or marks that lead to the block; source: what stands between the delimiters. What the block is, the labeller decides."""

    path: str
    source: str
    is_html: bool


NONE = "none"


def squeeze(s: str) -> str:
    return " ".join(s.split())


def plain(block: Block) -> str:
    """The content of a heading, list item or paragraph: inline markup removed, entities decoded, white space squeezed."""
    s = block.source
    if block.is_html:
        return squeeze(html.unescape(_TAG.sub("", s)))
    if "\\" in s:
        while (t := _TEX_WRAP.sub(r"\1", _TEX_LINK.sub(r"\1", s))) != s:
            s = t
        s = _TEX_ESC.sub(r"\1", s)
    for cue, pattern, to in _CLEAN:
        if cue in s:
            s = pattern.sub(to, s)
    if "<" in s:
        s = _TAG.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    return squeeze(s)


def raw(block: Block) -> str:
    """The content of a code block or formula: its source, entities decoded in HTML, white space squeezed."""
    s = block.source
    if block.is_html:
        s = html.unescape(_TAG.sub("", s))
        s = re.sub(r"^\s*(?:\\\(|\\\[)|(?:\\\)|\\\])\s*$", "", s)
    return squeeze(s)


def blocks(text: str) -> list[Block]:
    """The leaf blocks of a text in reading order. Never fails; a text without markup is a row of paragraphs."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", " ")
    kept: list[Block] = []

    def keep(m: re.Match) -> str:
        name = m.lastgroup
        if name in ("comment",):
            return " "
        if name == "tick":
            return m.group()
        for group, path in _CODE.items():
            if m.group(group) is not None:
                inside = m.group("fenced") if group == "fence" else m.group(group)
                kept.append(Block(path, inside, group == "pre"))
                return f"\n\0{len(kept) - 1}\0\n"
        for group, path in _MATH.items():
            if m.group(group) is not None:
                kept.append(Block(path, m.group(group), False))
                return f"\0{len(kept) - 1}\0"
        return m.group()

    text = _SPECIAL.sub(keep, text)
    out: list[Block] = []
    if "<" in text and _TAG.search(text):
        _html(text, kept, out)
    else:
        _lines(text, kept, out)
    return out


def _emit(path: str, marked: bool, source: str, is_html: bool, kept: list[Block], out: list[Block]) -> None:
    """A block, and after it the formulas and code blocks that stand inside it; a marked block (no plain paragraph) keeps their sources in its own."""
    inner = [kept[int(k)] for k in _KEPT.findall(source)] if "\0" in source else []
    if inner:
        source = _KEPT.sub(lambda m: " " + kept[int(m[1])].source + " ", source) if marked else _KEPT.sub(" ", source)
    if source.strip():
        out.append(Block(path, source, is_html))
    for b in inner:
        out.append(b._replace(is_html=True) if is_html and not b.path.startswith("html") else b)


def _html(text: str, kept: list[Block], out: list[Block]) -> None:
    """Blocks of HTML; text outside every block element is read by lines, so HTML inside other notations works too."""
    stack: list[str] = []
    begin = 0
    block: str | None = None

    def close(end: int) -> None:
        nonlocal begin
        piece = text[begin:end]
        if piece.strip():
            if block is None:
                _lines(piece, kept, out)
            else:
                marked = block == "li" or (block[0] == "h" and block[1:].isdigit())
                _emit("html/" + "/".join(stack[-3:] + [block] if not stack or stack[-1] != block else stack[-3:]), marked, piece, True, kept, out)
        begin = end

    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name in _INLINE:
            continue
        closing = m[1] == "/"
        if name in ("br", "hr"):
            if block is None:
                close(m.start())
                begin = m.end()
            continue
        close(m.start())
        begin = m.end()
        if closing:
            if name in stack:
                while stack and stack.pop() != name:
                    pass
            block = next((x for x in reversed(stack) if x not in ("html", "body", "div", "ul", "ol", "table", "tr", "thead", "tbody")), None)
            if block is not None and stack and stack[-1] in ("ul", "ol"):
                block = "p"
            if block is None and stack and stack[-1] == "div":
                block = "div"
            if name == "li" or name in ("ul", "ol"):
                block = None if not stack or stack[-1] in ("html", "body") else ("p" if block == "li" or stack[-1] in ("ul", "ol") else block)
        else:
            if name == "li" and "li" in stack and not any(x in ("ul", "ol") for x in stack[len(stack) - stack[::-1].index("li"):]):
                del stack[len(stack) - 1 - stack[::-1].index("li"):]
            elif name in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote") and "p" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("p"):]
            stack.append(name)
            block = None if name in ("html", "body") else name if name not in ("ul", "ol", "table", "tr", "thead", "tbody") else "p"
    close(len(text))


def _balanced(s: str) -> str:
    """What stands before the brace that closes an opened one."""
    depth = 1
    for k, c in enumerate(s):
        if c == "{" and s[k - 1:k] != "\\":
            depth += 1
        elif c == "}" and s[k - 1:k] != "\\":
            depth -= 1
            if not depth:
                return s[:k]
    return s


def _lines(text: str, kept: list[Block], out: list[Block]) -> None:
    """Blocks of Markdown, wiki and LaTeX text, line by line; neighbouring lines of plain text are one paragraph."""
    rows = text.split("\n")
    para: list[str] = []

    def flush() -> None:
        if para:
            _emit("p", False, " ".join(para), False, kept, out)
            para.clear()

    for k, row in enumerate(rows):
        if not row.strip():
            flush()
            continue
        m = _LINE.match(row)
        if m is None or _BREAK.match(row):
            if _RULE.match(row) and len(para) == 1 and (k < 2 or not rows[k - 2].strip() or "\0" in rows[k - 2]) and "\0" not in para[0]:
                head = para.pop()
                _emit("md/setext" + row.strip()[0], True, head, False, kept, out)
            else:
                para.append(row)
            continue
        flush()
        if m["atx"]:
            numbered = len(m["atx"]) == 1 and ((k and _NUMBERED.match(rows[k - 1])) or (k + 1 < len(rows) and _NUMBERED.match(rows[k + 1])))
            _emit("list/#" if numbered else "md/" + m["atx"], True, m["atx_text"], False, kept, out)
        elif m["wh"]:
            _emit("wiki/h", True, m["wh_text"], False, kept, out)
        elif m["ord"]:
            _emit("list/1" + m["ord"][-1], True, m["ord_text"], False, kept, out)
        elif m["bul"]:
            _emit("list/" + (m["bul"][:2] if len(m["bul"]) < 2 or set(m["bul"]) == {"*"} else "mixed"), True, m["bul_text"], False, kept, out)
        elif m["sec"]:
            _emit("latex/" + m["sec"], True, _balanced(m["sec_text"]), False, kept, out)
        else:
            _emit("latex/item", True, m["item_text"], False, kept, out)
    flush()
