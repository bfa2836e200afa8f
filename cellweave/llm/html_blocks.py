"""Blocks of a web page, each with what its markup says about it.

One pass from left to right in time proportional to the page, whatever it holds:
unclosed quotes, comments and elements included.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all but script and style end at the next tag if they are never closed.
RAW = frozenset("script style title textarea iframe noscript noframes xmp".split())
#: Elements whose content is no text of the page, though it is markup.
SILENT = frozenset("template svg math select option optgroup datalist button object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form menu dialog search fieldset head".split())
MAIN_ELEMENTS = frozenset(["article", "main"])
#: Elements that a new one of the kind ends, unless one of the second set stands between.
IMPLIED = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
# Words in class, id and role. The first kind always marks page furniture; the second is a hint that the repeats weigh.
FURNITURE = frozenset(
    "cookie cookies consent gdpr popup modal overlay sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer masthead "
    "comment comments commentlist disqus signup login pagination pager contentinfo complementary".split()
)
HINTS = (
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices alert side aside rail widget widgets "
    "foot discussion replies respond share sharing social related recommended newsletter subscribe search skip".split()
)
#: These count outside a main element only, where an article may have its own.
OUTSIDE_ONLY = frozenset(["header"])

#: What becomes of a block: PROSE stays, CHROME goes, and of the rest the repeats decide.
PROSE, CHROME, BESIDE, HINTED, OPEN = range(5)

#: Elements whose places among the open ones are kept, so that none is looked for by climbing.
_SPOTTED = frozenset(IMPLIED).union(*IMPLIED.values(), ["p", "head"])

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_BEGUN = re.compile(r"</?[a-zA-Z]")
_WORD = re.compile(r"[a-z]+")
_SILENT = re.compile(rf"<(/?)({'|'.join(sorted(SILENT))})(?=[\s/>])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    """One block: its text, what its markup says, and its slot (the place in the markup that the repeats judge as one)."""

    kind: int
    slot: str
    text: str


def _attributes(raw: str) -> tuple[bool, bool, bool, str]:
    """Whether attributes mark furniture, a header or the main element, and the first hint in them."""
    drop = head = main = False
    hint = ""
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            drop = True
        elif name != "aria-hidden":
            words = set(_WORD.findall(value))
            drop |= not words.isdisjoint(FURNITURE)
            head |= not words.isdisjoint(OUTSIDE_ONLY)
            main |= name == "role" and "main" in words
            hint = hint or next((h for h in HINTS if h in words), "")
    return drop, head, main, hint


class _Silent:
    """Where elements without text end: one look over the page, then a search for each of them."""

    def __init__(self, lowered: str):
        self.opens: dict[str, list[int]] = {}
        self.closes: dict[str, list[int]] = {}
        for m in _SILENT.finditer(lowered):
            (self.closes if m[1] else self.opens).setdefault(m[2], []).append(m.start())

    def end(self, name: str, at: int) -> int:
        """Position of the end tag of an element whose start tag ends at ``at``; -1 if another begins first or none follows."""
        closes = self.closes.get(name, [])
        i = bisect_left(closes, at)
        if i == len(closes):
            return -1
        opens = self.opens.get(name, [])
        j = bisect_left(opens, at)
        return -1 if j < len(opens) and opens[j] < closes[i] and name != "svg" else closes[i]


def blocks(page: str) -> list[Block]:
    """Blocks in page order, character references decoded and white space folded.

    PROSE: inside an article or main element and not marked otherwise. CHROME: inside
    elements that hold menus, headers, footers, sidebars, forms, comments and the
    like. BESIDE: outside the main element of a page that has one. HINTED: marked by a
    word that only hints at furniture. OPEN: any other text of a page without a main
    element. Text without any tag is one block.
    """
    found: list[tuple[int, str, str, bool]] = []  # kind, slot, text, whether inside main
    text: list[str] = []
    # Element, and the state outside it: furniture (1: a form, which may hold a whole page), hint, whether inside main.
    stack: list[tuple[str, int, str, bool]] = []
    open_names: Counter = Counter()
    spots: dict[str, list[int]] = {name: [] for name in _SPOTTED}  # places in the stack, ascending
    walls: list[int] = []  # places of open blocks other than paragraphs
    chrome, hint, inside, any_main = 0, "", False, False
    silent: _Silent | None = None
    endless: set[str] = set()  # elements of RAW that nothing ends any more
    muted = False  # inside an unclosed element without text: up to the next block
    at, stop_at = 0, max(page.rfind(">"), page.rfind("<!--"))

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                around = [s[0] for s in stack[-8:] if s[0] in BLOCK][-2:]
                found.append((CHROME if chrome else HINTED if hint else PROSE if inside else OPEN, f"{'>'.join(around)}.{hint}", line, inside))

    def close(i: int):
        nonlocal chrome, hint, inside
        _, chrome, hint, inside = stack[i]
        for name, *_ in stack[i:]:
            open_names[name] -= 1
            if name in spots:
                spots[name].pop()
            if name in BLOCK and name != "p":
                walls.pop()
        del stack[i:]

    def last(names) -> int:
        return max((spots[name][-1] for name in names if spots[name]), default=-1)

    while at <= stop_at:
        tag = _TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at and not muted:
            text.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            if name in BLOCK:
                flush()
                muted = False
            elif name in SILENT:
                muted = False
            if open_names[name] > 0:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if stack[i][1:] != (chrome, hint, inside):
                    flush()
                close(i)
            continue
        raw = tag[3] if tag[2] else tag[6]
        if name in VOID:
            if name == "hr":
                flush()
                muted = False
            else:
                text.append(" ")
            continue
        if name in RAW or name in SILENT:
            text.append(" ")
            if raw.rstrip().endswith("/"):
                continue
            if name in RAW:
                end = None if name in endless else _RAW_END[name].search(page, at)
                if end is None:
                    endless.add(name)
                if end:
                    stop = page.find(">", end.end())
                    at = stop + 1 if stop >= 0 else len(page)
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    stop = page.find("<", at)
                    at = stop if stop >= 0 else len(page)
                continue
            silent = silent or _Silent(page.lower() if page.isascii() else page.translate(_LOWER))
            stop = silent.end(name, at)
            if stop >= 0:
                stop = page.find(">", stop)
                at = stop + 1 if stop >= 0 else len(page)
            else:
                muted = True
            continue
        if name in BLOCK:
            flush()
            muted = False
            if name == "body" and open_names["head"] > 0:
                close(spots["head"][0])
            if open_names["p"] > 0 and spots["p"][-1] > (walls[-1] if walls else -1):  # a block ends an open paragraph
                close(spots["p"][-1])
            if name in IMPLIED and open_names[name] > 0 and spots[name][-1] > last(IMPLIED[name]):
                close(spots[name][-1])
        drop, head, main, word = _attributes(raw) if raw and not raw.isspace() else (False, False, False, "")
        gone = drop or name in DROPPED or (head or name == "header") and not inside
        now = max(chrome, (1 if name == "form" and not drop else 2) if gone else 0)
        enters = now < 2 and not inside and (name in MAIN_ELEMENTS or main)
        if enters:
            now = 0
        if name not in BLOCK and (now != chrome or word and word != hint or enters):
            flush()
        if name in spots:
            spots[name].append(len(stack))
        if name in BLOCK and name != "p":
            walls.append(len(stack))
        stack.append((name, chrome, hint, inside))
        open_names[name] += 1
        chrome, hint = now, word or hint
        if enters:
            inside = any_main = True
            hint = word
    if at < len(page) and not muted:
        cut = _BEGUN.search(page, at)  # a tag that the page's end cuts off
        text.append(page[at : cut.start() if cut else len(page)])
    flush()
    return [Block(BESIDE if kind == OPEN and any_main else kind, f"{int(was_inside)}{int(any_main)}:{slot}", line) for kind, slot, line, was_inside in found]


#: Lower-casing that keeps every position.
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
