"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
itself: blocks inside navigation, footers, forms, adverts, comments and the
like (by tag, or by the words of class, id and role) and blocks that are
mostly links are boilerplate; blocks inside an article or main part are
content, and where a page has one, what lies outside is boilerplate; elsewhere
long blocks are content if enough of their words are stop words, and blocks
that are short or in between stay undecided. In pass two the undecided take
the label of the nearest decided block, content if two at the same distance
differ.

Wrappers. A class or id names a part of the page by its words, but not by those
after "has", "with" and the like (``has-sidebar``), and inside an article an id
such as ``copyright`` is taken for the subject of a section. A form, or a
wrapper named for a part, that holds most of a page without any article or
main part elsewhere is the page itself: what it holds is decided as if it
weren't there. A link that is never closed ends at the next block.

The stop words are those of English, German, French and Spanish.

Defined cases: null or empty html gives the empty text; unclosed or stray tags
end with what holds them; an unclosed script, style or comment reaches to the
end of the page; rows with null ids and repeated rows are extracted one by one;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

# The four languages' commonest function words.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by not but what all were when we there can an your which their if will each how them then she her him has its who did no my "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wie nach am sie wird "
    "le la les de et un une du que qui dans en pour pas sur au ce il elle est par plus ne se avec sont "
    "el los las y en por con para una del al lo su más o pero sus le ya como fue este".split())
# Words in class, id and role that name parts of a page.
_AROUND = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent "
    "notice notices alert popup modal newsletter subscribe signup share sharing social related recommended comment comments disqus replies reply respond widget pagination pager toolbar "
    "login search copyright legal".split())
#: Words before which a part is only said to be there, and parts that a section of an article may be about (fixed values).
_WITH = frozenset("has have with without no not is show hide".split())
_SUBJECTS = frozenset("copyright legal notice notices search alert consent social sharing promotion".split())
_MAIN = frozenset("article main content post entry story body text".split())
_HOLDERS = frozenset("div section article main nav header footer aside form ul ol dl table head menu dialog fieldset details figure".split())
_BAD = frozenset("nav footer aside form menu dialog head fieldset".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|button|title|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Share of link characters from which a block is boilerplate; words from which it is long; share of stop words.
LINKS, LONG, STOPS = 0.5, 15, 0.2
_GOOD, _NONE, _OUT = 1, 0, -1


#: Share of a page's text from which on a form or a wrapper named for a part is the page itself.
WHOLE = 0.5


@dataclass
class Block:
    text: str
    linked: float
    role: int
    inside: int  # the role if the outermost wrapper weren't there
    wrapper: int  # that wrapper's number, -1 if there is none


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, each with its share of linked characters and the role of what holds it."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    in_link = loose = linked = at = wrappers = 0
    ground = (_NONE, _NONE, -1)

    def close() -> None:
        nonlocal linked
        text = _BLANKS.sub(" ", "".join(parts)).strip(" ")
        if text:
            found.append(Block(text, min(1.0, linked / len(text)), *(stack[-1][1:] if stack else ground)))
        parts.clear()
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(text := html.unescape(page[at:m.start()]))
            linked += len(text) if in_link else 0
        at = m.end()
        end, name = m.group(2), (m.group(3) or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not end
            following = _NEXT_LINK.search(page, at) if in_link else None
            loose = in_link and not (following and following.group(1))
        if name in _INLINE:
            continue
        close()
        if loose:
            in_link = loose = False
        if name not in _HOLDERS:
            continue
        if not end:
            if not m.group(4).endswith("/"):
                role, inside, wrapper = stack[-1][1:] if stack else ground
                own = _role(name, m.group(4), role)
                if wrapper >= 0:
                    inside = _role(name, m.group(4), inside)
                elif own == _OUT and role != _OUT and (name == "form" or name not in _BAD and name != "header"):
                    inside, wrapper, wrappers = role, wrappers, wrappers + 1
                else:
                    inside = own
                stack.append((name, own, inside, wrapper))
        elif any(t[0] == name for t in stack):
            while stack.pop()[0] != name:
                pass
    parts.append(html.unescape(page[at:]))
    close()
    return _unwrapped(found)


def _unwrapped(found: list[Block]) -> list[Block]:
    """Blocks of a wrapper that is the page itself get the roles that they have without it."""
    if any(b.role == _GOOD for b in found):
        return found
    held: dict[int, int] = {}
    for b in found:
        held[b.wrapper] = held.get(b.wrapper, 0) + len(b.text)
    total = sum(held.values())
    for b in found:
        if b.wrapper >= 0 and held[b.wrapper] > WHOLE * total:
            b.role = b.inside
    return found


def _role(name: str, attributes: str, outer: int) -> int:
    if outer == _OUT or name in _BAD or (name == "header" and outer != _GOOD):
        return _OUT
    around = main = False
    for kind, value in _NAMED.findall(attributes):
        for whole in value.lower().strip("\"'").split():
            said = [w for w in re.split(r"[^a-z]+", whole) if w]
            said = said[:next((i for i, w in enumerate(said) if w in _WITH), len(said))]
            subject = outer == _GOOD and kind.lower() == "id"
            around |= any(w in _AROUND and not (subject and w in _SUBJECTS) for w in said)
            main |= any(w in _MAIN for w in said)
    if around and not main:
        return _OUT
    return _GOOD if name in ("article", "main") or (main and not around) else outer


def _label(b: Block, has_main: bool) -> int:
    """Pass one: content, boilerplate or undecided."""
    if b.role == _OUT or b.linked >= LINKS or (has_main and b.role != _GOOD):
        return _OUT
    if b.role == _GOOD:
        return _GOOD
    ws = b.text.lower().split()
    if len(ws) < LONG:
        return _NONE
    stops = sum(w in STOP_WORDS for w in _LETTERS.findall(b.text.lower())) / len(ws)
    return _GOOD if stops >= STOPS else _NONE


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has_main = any(b.role == _GOOD for b in found)
    labels = [_label(b, has_main) for b in found]
    before, last = [], (None, _NONE)
    for i, x in enumerate(labels):
        last = (i, x) if x else last
        before.append(last)
    after, last = [None] * len(labels), (None, _NONE)
    for i in range(len(labels) - 1, -1, -1):
        last = (i, labels[i]) if labels[i] else last
        after[i] = last
    out = []
    for i, (b, x) in enumerate(zip(found, labels, strict=True)):
        if not x:
            near = [(abs(i - j), -y) for j, y in (before[i], after[i]) if j is not None]
            x = -min(near)[1] if near else _GOOD
        if x == _GOOD:
            out.append(b.text)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns ``keep``, ``text`` and ``n_chars``."""
    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return ready(pages).select(*keep, html_col).mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long")
