"""Leaf blocks of a page's DOM: their text, the tags and names around them, and features for a sequence model."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

#: Elements that begin and end a block of text.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("script style template svg math iframe object head title textarea select datalist canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends these open elements, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Sectioning elements; the innermost one around a block is a feature.
_SCOPES = frozenset("article main section nav aside header footer form".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words (lower case, also inside others) that mark a short block.
_CUES = {
    "rights": ("©", "(c)", "copyright", "all rights", "tous droits", "alle rechte", "derechos"),
    "notice": ("cookie", "consent", "gdpr", "javascript", "privacy", "datenschutz", "confidentialit", "privacidad"),
    "invite": ("subscribe", "newsletter", "sign up", "sign in", "log in", "login", "register", "abonn", "anmeld", "suscr",
               "search", "submit", "e-mail", "email"),
    "share": ("share", "tweet", "facebook", "follow us", "partager", "teilen", "compartir"),
    "reply": ("comment", "reply", "replies", "respond", "says:", "kommentar", "antwort", "coment", "répon"),
    "more": ("related", "read more", "see also", "popular", "recommended", "sponsored", "advert", "anzeige", "publicit",
             "publicid", "lire aussi"),
}
_SPLIT_MARK = re.compile(r"[|·•»›→]")


@dataclass
class Block:
    text: str
    features: list[str]
    inside: int  # number of the element around the block's own element
    own: str  # tag of the block's own element

    def relation(self, before: Block) -> int:
        """To the block before: 0 in another element, 1 in the same one, 2 also with an equal tag."""
        return 0 if self.inside != before.inside else 1 + (self.own == before.own)


class _Pages(HTMLParser):
    """Collects blocks; a missing or stray end tag never loses text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str], int]] = []  # tag, its ancestor features, number
        self.around: Counter = Counter()
        self.n_elements = 0
        self.scopes: list[str] = []
        self.hidden = 0
        self.links = 0
        self.buffer: list[str] = []
        self.linked = 0
        self.found: list[tuple[str, list[str], int, str, float]] = []

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)  # a comment without an end goes on to the end of the page

    def _end_block(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            blocks = [k for k in range(len(self.open) - 1, max(-1, len(self.open) - 33), -1) if self.open[k][0] in BLOCK_TAGS]
            own = self.open[blocks[0]] if blocks else ("none", [], 0)
            inside = self.open[blocks[1]][2] if len(blocks) > 1 else 0
            total = sum(map(len, self.buffer))
            features = [*self.around, "scope:" + (self.scopes[-1] if self.scopes else "none"), "own:" + own[0], *("own:" + f for f in own[1] if f[0] == "#")]
            self.found.append((text, features, inside, own[0], self.linked / max(total, 1)))
        self.buffer.clear()
        self.linked = 0

    def _pop(self) -> None:
        tag, features, _ = self.open.pop()
        for f in features:
            self.around[f] -= 1
            if not self.around[f]:
                del self.around[f]
        if tag in _SCOPES:
            self.scopes.pop()
        self.hidden -= tag in HIDDEN_TAGS
        self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append(" ")
        if tag in BLOCK_TAGS:
            self._end_block()
            if tag not in ("button", "label") and any(o[0] == "p" for o in self.open[-8:]):
                while any(o[0] == "p" for o in self.open[-8:]):
                    self._pop()
            closes, until = _ENDS.get(tag, ((), ()))
            if closes:
                at = len(self.open) - 1
                while at >= 0 and self.open[at][0] not in until and self.open[at][0] not in closes:
                    at -= 1
                if at >= 0 and self.open[at][0] in closes:
                    while len(self.open) > at:
                        self._pop()
        if tag in VOID_TAGS:
            return
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value:
                names += {"#" + n.lower() for n in _NAME.findall(value[:400])}
        self.n_elements += 1
        self.open.append((tag, names, self.n_elements))
        for f in names:
            self.around[f] += 1
        if tag in _SCOPES:
            self.scopes.append(tag)
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                while len(self.open) > at:
                    self._pop()
                return
            if tag not in BLOCK_TAGS and name in BLOCK_TAGS:
                return  # an inline end tag ends no block
            if tag == "p" and name in BLOCK_TAGS:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)


def _bucket(n: int, *limits: int) -> int:
    return sum(n >= x for x in limits)


def text_features(text: str, link_share: float) -> list[str]:
    n = text.count(" ") + 1
    inner = min(2, sum(text.count(c, 0, -1) for c in ".!?,;") // 2)
    out = [f"words:{_bucket(n, 2, 4, 8, 16, 40)}", f"links:{_bucket(int(link_share * 100), 1, 30, 70)}",
           f"ends:{text[-1] in '.!?…:;'}", f"inner:{inner}"]
    if n < 40:  # in long prose the cue words say nothing
        low = text.lower()
        out += ["cue:" + name for name, cues in _CUES.items() if any(c in low for c in cues)]
        if _SPLIT_MARK.search(text):
            out.append("marks")
        if sum(map(text.count, "0123456789")) * 4 > len(text):
            out.append("digits")
    if text[0].islower():
        out.append("lower")
    return out


def blocks(html: str) -> list[Block]:
    """The blocks of a page in page order, each with its features."""
    parser = _Pages()
    parser.feed(html)
    parser.close()
    parser._end_block()
    out = []
    n = len(parser.found)
    for k, (text, around, inside, own, share) in enumerate(parser.found):
        size = f"words:{_bucket(text.count(' ') + 1, 2, 4, 8, 16, 40)}"
        place = "place:first" if k * 8 < n else "place:last" if (n - 1 - k) * 8 < n else "place:inner"
        out.append(Block(text, ["bias", *around, *text_features(text, share), place, f"{place}+{size}"], inside, own))
    return out
