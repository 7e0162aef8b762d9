"""A Markdown block lexer in Python, the one thing about Markdown for which Spark has no operator.

It cuts a text into the block tokens of GitHub-flavoured Markdown: heading, code, blockquote, list, html,
def, table, hr, paragraph, text and space. Inline marks are left in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

_BLANK = re.compile(r"(?: *(?:\n|\Z))+")
_INDENTED = re.compile(r"(?: {4}[^\n]+(?:\n(?: *(?:\n|\Z))*)?)+")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`\n]*(?:\n|\Z))|~{3,})([^\n]*)(?:\n|\Z)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?=\s|\Z)([^\n]*)(?:\n+|\Z)")
_RULE = re.compile(r" {0,3}(?:(?:-[\t ]*){3,}|(?:_[\t ]*){3,}|(?:\*[\t ]*){3,})(?:\n+|\Z)")
_BULLET = re.compile(r"( {0,3})([*+-]|\d{1,9}[.)])(?=[ \t]|\n|\Z)([ \t]*)")
_DEF = re.compile(r" {0,3}\[(?!\s*\])(?:\\.|[^\[\]\\])+\]: *(?:\n *)?(?:<[^<>\n]*>|[^<\s]\S*)(?:(?: +(?:\n *)?| *\n *)(?:\"(?:\\\"?|[^\"\\])*\"|'[^'\n]*'|\([^()]*\)))? *(?:\n+|\Z)")
_SETEXT = re.compile(r" {0,3}(=+|-+) *(?:\n+|\Z)")
_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|meta|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_HTML = re.compile(
    r" {0,3}(?:<(script|pre|style|textarea)[\s>][\s\S]*?(?:</\1>[^\n]*\n+|\Z)"
    r"|<!--(?:-?>|[\s\S]*?(?:-->|\Z))[^\n]*(?:\n+|\Z)"
    r"|<\?[\s\S]*?(?:\?>\n*|\Z)|<![A-Z][\s\S]*?(?:>\n*|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>\n*|\Z)"
    rf"|</?(?:{_TAGS})(?: +|\n|/?>)[\s\S]*?(?:(?:\n *)+\n|\Z)"
    r"|<(?!script|pre|style|textarea)[a-z][\w-]*(?: +[a-zA-Z:_][\w.:-]*(?: *= *(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'=<>`]+))?)*? */?>(?=[ \t]*(?:\n|\Z))[\s\S]*?(?:(?:\n *)+\n|\Z)"
    r"|</(?!script|pre|style|textarea)[a-z][\w-]*\s*>(?=[ \t]*(?:\n|\Z))[\s\S]*?(?:(?:\n *)+\n|\Z))",
    re.I,
)
_DASHES = re.compile(r" {0,3}(?:\| *)?:?-+:? *(?:\| *:?-+:? *)*(?:\| *)?(?:\n|\Z)")
_QUOTE = re.compile(r" {0,3}>")


def _line(text: str, at: int) -> tuple[str, int]:
    end = text.find("\n", at)
    return (text[at:], len(text)) if end < 0 else (text[at:end], end + 1)


def _cells(line: str) -> int:
    row = re.sub(r"\\.", "", line.strip())
    return len(row.removeprefix("|").removesuffix("|").split("|"))


def _table(text: str, at: int) -> int:
    """The end of the table that starts here, or 0."""
    head, after = _line(text, at)
    dashes = _DASHES.match(text, after) if head.strip() and after < len(text) else None
    if not dashes or ("|" not in head and "|" not in dashes[0] and ":" not in dashes[0]) or _cells(head) != _cells(dashes[0]):
        return 0
    end = dashes.end()
    while end < len(text):
        line, nxt = _line(text, end)
        if not line.strip() or _starts_block(text, end):
            break
        end = nxt
    return end


def _starts_block(text: str, at: int) -> bool:
    """Whether a paragraph ends before this line."""
    if _FENCE.match(text, at) or _HEADING.match(text, at) or _RULE.match(text, at) or _QUOTE.match(text, at):
        return True
    b = _BULLET.match(text, at)
    if b and b[3] and b[2] in ("*", "+", "-", "1.", "1)") and _line(text, b.end())[0].strip():
        return True
    h = _HTML.match(text, at)
    return bool(h) and not re.match(r" {0,3}</?(?!script|pre|style|textarea|(?:" + _TAGS + r")\b)[a-z]", text[at : at + 64], re.I)


def _fence_text(opening: str, body: str) -> str:
    pad = re.match(r" *", opening)[0]
    if not pad:
        return body
    return "\n".join(line[len(pad) :] if line.startswith(pad) else line for line in body.split("\n"))


def _list_end(text: str, at: int, first: re.Match) -> int:
    """The end of the list that starts with this bullet: its items, what is indented under them, and lazy lines."""
    kind = first[2][-1]
    width = len(first[0]) if 1 <= len(first[3]) <= 4 else len(first[1]) + len(first[2]) + 1
    end = at
    blank = fence = None
    while at < len(text):
        line, nxt = _line(text, at)
        b = _BULLET.match(text, at)
        indent = len(line) - len(line.lstrip(" "))
        if fence:
            inside = indent >= width or not line.strip()
            if inside:
                if re.fullmatch(re.escape(fence) + r"[`~]* *", line.strip()):
                    fence = None
                at = end = nxt
                continue
            fence = None
        if not line.strip():
            blank, at = True, nxt
            continue
        if b and b[2][-1] == kind and not _RULE.match(text, at):
            width = len(b[0]) if 1 <= len(b[3]) <= 4 else len(b[1]) + len(b[2]) + 1
            rest = line[len(b[0]) :]
            opened = re.match(r"(`{3,}|~{3,})", rest)
            fence = opened[1] if opened else None
        elif indent >= width:
            opened = re.match(r"(`{3,}|~{3,})", line.strip())
            fence = opened[1] if opened else None
        elif blank or b or _FENCE.match(text, at) or _HEADING.match(text, at) or _RULE.match(text, at):
            break
        blank, at = None, nxt
        end = at
    return end


def lex(text: str) -> Iterator[tuple[str, int | None, str | None, str, str | None]]:
    """(type, depth, text, raw, language) of each block."""
    out: list[list] = []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at = 0
    while at < len(text):
        if len(out) > 1:  # only the last block may still change
            yield tuple(out.pop(0))
        m = _BLANK.match(text, at)
        if m and m.end() > at:
            if len(m[0]) == 1 and out:
                out[-1][3] += "\n"
            else:
                out.append(["space", None, None, m[0], None])
            at = m.end()
            continue
        if m := _INDENTED.match(text, at):
            body = re.sub(r"(?m)^ {1,4}", "", m[0])
            if out and out[-1][0] == "paragraph":
                out[-1][3] += "\n" + m[0]
                out[-1][2] += "\n" + body.rstrip("\n")
            else:
                out.append(["code", None, body.rstrip("\n"), m[0], None])
            at = m.end()
            continue
        if m := _FENCE.match(text, at):
            close = re.compile(rf"(?m)^ {{0,3}}{re.escape(m[1])}[~`]* *$").search(text, m.end())
            body = text[m.end() : close.start() if close else len(text)]
            end = close.end() if close else len(text)
            out.append(["code", None, _fence_text(m[0], body.removesuffix("\n")), text[at:end], m[2].strip() or None])
            at = end
            continue
        if m := _HEADING.match(text, at):
            title = m[2].strip()
            if title.endswith("#"):
                cut = title.rstrip("#")
                if not cut or cut.endswith(" "):
                    title = cut.strip()
            out.append(["heading", len(m[1]), title, m[0], None])
            at = m.end()
            continue
        if m := _RULE.match(text, at):
            out.append(["hr", None, None, m[0], None])
            at = m.end()
            continue
        if _QUOTE.match(text, at):
            end, lazy = at, False
            while end < len(text):
                line, nxt = _line(text, end)
                if _QUOTE.match(text, end):
                    lazy = bool(line.lstrip(" >").strip()) and not re.match(r"[ >]*(?:#{1,6}(?:\s|$)|`{3}|~{3})", line)
                elif not (lazy and line.strip() and not _starts_block(text, end)):
                    break
                end = nxt
            raw = text[at:end]
            out.append(["blockquote", None, re.sub(r"(?m)^ *>[ \t]?", "", raw).rstrip("\n"), raw, None])
            at = end
            continue
        m = _BULLET.match(text, at)
        if m and (m[3] or _line(text, m.end())[0] == ""):
            end = _list_end(text, at, m)
            raw = text[at:end].rstrip()
            out.append(["list", None, None, raw, None])
            at += len(raw)  # the line feeds after it are white space of their own
            continue
        if m := _HTML.match(text, at):
            out.append(["html", None, m[0], m[0], None])
            at = m.end()
            continue
        if m := _DEF.match(text, at):
            out.append(["def", None, None, m[0], None])
            at = m.end()
            continue
        if end := _table(text, at):
            out.append(["table", None, None, text[at:end], None])
            at = end
            continue
        start, (_, at) = at, _line(text, at)
        depth = None
        while at < len(text):
            if m := _SETEXT.match(text, at):
                depth, at, body_end = 1 if m[1][0] == "=" else 2, m.end(), at
                break
            line, nxt = _line(text, at)
            if not line.strip() or _starts_block(text, at) or _table(text, at):
                break
            at = nxt
        if depth:
            out.append(["heading", depth, text[start:body_end].removesuffix("\n"), text[start:at], None])
        else:
            at -= text[at - 1] == "\n"  # a blank line after it is a token of its own
            out.append(["paragraph", None, text[start:at], text[start:at], None])
    yield from map(tuple, out)


def outline(text: str) -> Iterator[tuple]:
    """(position, *token, position of the heading it stands under, of a heading's parent, numbers from the top) for each token of a text.

    What stands before the first heading belongs to it; that one is looked for beforehand, so that no tokens are held.
    """
    own = next((pos for pos, token in enumerate(lex(text)) if token[0] == "heading"), None)
    above, top = [], 0
    for pos, token in enumerate(lex(text)):
        kind, depth, *_ = token
        if kind != "heading":
            yield pos, *token, own, None, None
            continue
        while above and above[-1][0] >= depth:
            above.pop()
        if above:
            above[-1][2] += 1
            number, parent = above[-1][2], above[-1][1]
        else:
            top += 1
            number, parent = top, None
        place = [*(above[-1][3] if above else ()), number]
        above.append([depth, pos, 0, place])
        own = pos
        yield pos, *token, own, parent, place


_KINDS = {"path": pa.string(), "pos": pa.int32(), "type": pa.string(), "depth": pa.int32(), "text": pa.string(), "raw": pa.string(), "lang": pa.string(), "section": pa.int32(), "parent": pa.int32(), "place": pa.list_(pa.int32())}
#: Tokens of a batch at most, and characters of it from which on it ends, whatever the texts are.
BATCH_TOKENS, BATCH_CHARS = 4096, 1 << 20


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            path, text, title = column["path"][i].as_py(), column["text"][i].as_py() or "", None
            for row in outline(text):
                if title is None and row[1] == "heading" and row[2] == 1:
                    title = row[3]
                yield path, *row
            if "front" in column:
                yield path, -1, "top", None, title, column["front"][i].as_py(), None, -1, None, None


def lex_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of rows (path, text), for mapInArrow; where there is a column `front`, after those of a text a row for the text itself with its title and that."""
    rows, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))

    for row in _tokens(batches):
        rows.append(row)
        chars += len(row[4] or "") + len(row[5] or "")
        if len(rows) >= BATCH_TOKENS or chars >= BATCH_CHARS:
            yield batch()
            rows, chars = [], 0
    if rows:
        yield batch()
