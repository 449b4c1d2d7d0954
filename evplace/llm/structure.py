"""A pushdown parser for the structure of a text: quotes, brackets, fences, markup.

Only structural characters are visited (one compiled pattern finds them), so a long
text costs little; every text is read whole.
"""

from __future__ import annotations

import re

# Opening signs and what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“”", "‹": "›"}
_OPENERS = set(PAIRS)
_OPENERS_OF = {c: tuple(o for o, cs in PAIRS.items() if c in cs) for cs in PAIRS.values() for c in cs}
_EVENT = re.compile(r"```|~~~|</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|<!--|-->|[()\[\]{}“”«»„‹›]|\"")
# Elements without an end tag, elements whose end tag may be left out, and other usual elements.
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "col", "wbr", "source"}
_OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "colgroup", "html", "body", "head"}
_ELEMENTS = set(
    "a abbr article aside b blockquote button caption center cite code del details div em fieldset figcaption figure font footer form"
    " h1 h2 h3 h4 h5 h6 header i iframe ins kbd label main mark nav ol pre q quote s script section select small span strong style sub summary sup table textarea title u ul video".split()
)
# A line that holds nothing but the sign of a list item.
_LIST_MARK = re.compile(r"(?:^|\n)[ \t]*(?:\(?\d{1,3}[.)]|\(?[a-z]\)|[-*•‣◦])[ \t]*$")
_LIST_ITEM = re.compile(r"(?:^|[\n:])[ \t]*(?:\(?\d{1,3}[.)]|\(?[a-z]\)|[-*•‣◦])[ \t]+\S")
_BROKEN = re.compile(
    r"(?:\ufffd|[\ud800-\udfff]"  # bytes of a character lost
    r"|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?"  # an escape begun
    r"|&(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{2,7})"  # an entity without its end
    r"|%[0-9A-Fa-f]?)$"  # half a percent escape
)
_TAG_BEGUN = re.compile(r"(?:</?[A-Za-z][\w-]*(?:\s[^<>]*)?|<!--.*|</?)$", re.S)
TERMINATORS = ".!?。！？؟।"
_CLOSING = "\"'”’»)]}*_`›"
_SENTENCE = re.compile(r"[.!?。！？][\"'”’»)\]*_]*(?:\s|$)|\n")


def open_signs(text: str) -> list[tuple[str, int]]:
    """Signs still open at the end of the text, with their places, outermost first.

    Closers without an opener are ignored. Straight quotes count where they open a word
    or close one. An opening quote that repeats at the start of a paragraph replaces the
    one before (quotes over several paragraphs).
    """
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}

    def push(sign: str, at: int) -> None:
        stack.append((sign, at))
        depth[sign] = depth.get(sign, 0) + 1

    def close(signs: tuple[str, ...]) -> bool:
        """Close the last of these signs, and what was opened inside it; false if none is open."""
        if not any(depth.get(x) for x in signs):
            return False
        while True:
            top = stack.pop()[0]
            depth[top] -= 1
            if top in signs:
                return True

    for m in _EVENT.finditer(text):
        s, at = m.group(), m.start()
        if s in ("```", "~~~"):
            if not close((s,)):
                push(s, at)
        elif stack and stack[-1][0] in ("```", "~~~"):
            continue  # inside a fence nothing else counts
        elif s == '"':
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            if before.strip() and not after.isalnum() and depth.get('"'):
                close(('"',))
            elif not before.isalnum() and after.strip():
                close(('"',))
                push('"', at)
        elif s[0] == "<" and len(s) > 1:
            name = s.strip("</>!- ").split()[0].lower() if s.strip("</>!- ") else "!--"
            if s.startswith("</"):
                close((f"<{name}",))
            elif s == "<!--" or (not s.endswith("/>") and name not in _VOID):
                push(f"<{name}", at)
        elif s == "-->":
            close(("<!--",))
        elif s in _OPENERS and not (s == "“" and depth.get("„")):
            if s in "“«„" and stack and stack[-1][0] == s and (at == 0 or text[at - 1] == "\n"):
                close((s,))
            push(s, at)
        elif s in _OPENERS_OF:
            close(_OPENERS_OF[s])
    return stack


def broken_end(text: str) -> bool:
    """The text stops inside a character, an escape, an entity or a tag."""
    if _BROKEN.search(text[-16:]):  # no form of these is longer
        return True
    at = text.rfind("<")
    return at > text.rfind(">") and bool(_TAG_BEGUN.match(text, at)) and text[at + 1 :].strip() != ""


def list_mark_end(text: str) -> bool:
    """The last line is the sign of a list item without its item, in a text with such items."""
    body = text.rstrip()
    m = _LIST_MARK.search(body, max(body.rfind("\n"), 0))
    return bool(m) and bool(_LIST_ITEM.search(body, 0, m.start() + 1))


def terminated(text: str) -> bool:
    """The last sign, closing quotes, brackets and end tags aside, ends a sentence; so does a line that closes a fence."""
    core = text.rstrip()
    while core.endswith(">") and core.startswith("</", at := core.rfind("<")):
        core = core[:at].rstrip()
    if core.endswith(("\n```", "\n~~~")):
        return True
    core = core.rstrip(_CLOSING)
    return bool(core) and core[-1] in TERMINATORS


def last_sentence_start(text: str) -> int:
    """Where the last sentence begins: looked for backwards in windows that double, so it takes linear time."""
    body = text.rstrip().rstrip(_CLOSING).rstrip(TERMINATORS)
    span = 1000
    while True:
        low = max(0, len(body) - span)
        at = 0
        for m in _SENTENCE.finditer(body, low):
            at = m.end()
        if at or not low:
            return at
        span *= 2


def open_elements(text: str) -> list[tuple[str, int]]:
    """What the stack holds at the end, but for elements whose end tag may be left out and names that are no elements."""
    return [(s, at) for s, at in open_signs(text) if len(s) == 1 or s in ("```", "~~~", "<!--") or s[1:] in _ELEMENTS]


def left_open(text: str) -> bool:
    """What is open at the end shows that something is missing.

    Fences and elements count wherever they were opened, quotes and brackets in the last sentence, and a list item
    of which only the sign is there. Elements whose end tag may be left out, and names that are no elements, do not count.
    """
    if list_mark_end(text):
        return True
    stack = open_elements(text)
    if not stack:
        return False
    start = last_sentence_start(text)
    return any(len(s) > 1 or at >= start for s, at in stack)
