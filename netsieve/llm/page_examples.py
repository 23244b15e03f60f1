"""Made-up labelled pages: an article in one of many layouts among menus, notices, adverts, forms and comments.

Page k is the same at every call. Layouts, tags and names are drawn at random from the
lists below, in semantic and in plain mark-up, tidy or with missing end tags.
"""

from __future__ import annotations

import html as _html
import random

_ONSETS = "b c d f g h l m n p r s t v w th sh ch br st tr é à ü ö ß ñ".split()
_RIMES = "a e i o u an en er in on ou ai ent ing ion ura elle ado".split()

CONTENT = "article content main post entry story text body page article-body post-content entry-content main-content".split()
MENUS = "nav menu navbar navigation main-menu top-nav links breadcrumb breadcrumbs toolbar tabs pagination pager toc".split()
HEADERS = "header masthead site-header page-header topbar banner branding logo tagline".split()
FOOTERS = "footer site-footer page-footer bottom copyright legal credits colophon".split()
SIDES = "sidebar side aside widget related recommended popular trending right-column left-column promo-box rail".split()
NOTICES = "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay disclaimer warning announcement".split()
ADS = "ad ads advert advertisement ad-slot sponsor sponsored promo banner-ad adsbox".split()
COMMENTS = "comments comment-list comment-section discussion responses replies reader-comments disqus reviews".split()
SHARES = "share social social-links share-buttons follow tags meta post-meta".split()
FORMS = "search login newsletter subscribe signup contact form search-form comment-form respond".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.common = [self._word(2) for _ in range(25)]
        self.lines: list[str] = []
        self.tidy = self.r.random() < 0.7

    def _word(self, most: int = 4) -> str:
        return "".join(self.r.choice(_ONSETS) + self.r.choice(_RIMES) for _ in range(self.r.randint(1, most)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.common) if self.r.random() < 0.5 else self._word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(3, 18).capitalize()
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def names(self, options: list[str]) -> str:
        if self.r.random() < 0.04:
            return ""
        name = self.r.choice(options)
        if self.r.random() < 0.2:
            name += self.r.choice([" wide", "-box", " clearfix", "-wrapper", " col-8", "Area"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"'

    def wrap(self, inner: str, tags: str, options: list[str]) -> str:
        """In a telling tag, with a telling name, or both."""
        tag = self.r.choice(tags.split())
        named = self.names(options) if tag == "div" or self.r.random() < 0.5 else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self._word()}">{text}</a>'

    def links(self, low: int = 2, high: int = 8) -> str:
        each = [self.link(self.words(1, 3).capitalize()) for _ in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{e}</li>" for e in each) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; ", "<br>", " &raquo; "]).join(each)

    # Parts that are no main text.
    def menu(self) -> str:
        return self.wrap(self.links(), "nav nav div div ul", MENUS)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.link(self.words(1, 3).title())}</h1>", f"<p>{self.words(1, 4).title()}</p>",
                               f"<h2>{self.words(1, 3).title()}</h2><p>{self.sentence()}</p>", f"<span>{self.words(1, 3)}</span>"])
        return self.wrap(inner + (self.links(2, 5) if self.r.random() < 0.3 else ""), "header header div", HEADERS)

    def notice(self) -> str:
        cue = self.r.choice(["We use cookies. ", "This site uses cookies to improve your visit. ", "Nous utilisons des cookies. ", "",
                             "Diese Seite verwendet Cookies. ", "Please enable JavaScript. ", "Privacy notice: ", "", "Important notice: "])
        text = cue + self.prose(1, 3)
        button = self.r.choice(["", "<button>OK</button>", f"<button>{self.words(1, 2)}</button>", self.link("Accept")])
        return self.wrap(self.r.choice([text, f"<p>{text}</p>"]) + button, "div div div aside section noscript", NOTICES)

    def advert(self) -> str:
        text = self.r.choice(["", "Advertisement. ", "Sponsored: ", ""]) + self.prose(1, 2)
        return self.wrap(self.r.choice([text, f"<p>{text}</p>", self.link(text), f"<span>{text}</span>"]), "div div div aside", ADS)

    def side(self) -> str:
        title = f"<h3>{self.r.choice(['Related', 'Popular', 'Read more', self.words(1, 3).capitalize()])}</h3>"
        body = self.r.choice([self.links, lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<p>{self.link(self.sentence())}</p><p>{self.sentence()}</p>",
                              lambda: "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>"])()
        return self.wrap(title * (self.r.random() < 0.7) + body, "aside aside div div section", SIDES)

    def form(self) -> str:
        label = self.r.choice(["Search", "E-mail", "Name", "Subscribe to our newsletter", "Log in", self.words(1, 4).capitalize()])
        tag = self.r.choice(["label", "p", "span", "div"])
        inner = f'<{tag}>{label}</{tag}><input type="text">' + self.r.choice(["", "<button>Submit</button>", f"<p>{self.sentence()}</p>"])
        inner += self.r.choice(["", "<select><option>one<option>two</select>", "<textarea>write here</textarea>"])
        return f"<form{self.names(FORMS) if self.r.random() < 0.5 else ''}>{inner}</form>"

    def share(self) -> str:
        return self.wrap(self.r.choice([self.links(2, 4), f"<span>Share</span> {self.link('Tweet')}", f"<p>{self.words(2, 5)}</p>"]),
                         "div div ul", SHARES)

    def comments(self) -> str:
        out = self.r.choice([f"<h3>{self.r.randint(1, 40)} comments</h3>", "<h2>Comments</h2>", "", f"<h3>{self.words(1, 2)}</h3>"])
        one = self.r.choice(["div", "li", "article", "p"])
        for _ in range(self.r.randint(1, 6)):
            who = self.r.choice([f"<b>{self._word().title()}</b> says: ", f"<span class=\"author\">{self._word().title()}</span> ",
                                 f"<cite>{self._word().title()}</cite>, {self.r.randint(1, 28)}.{self.r.randint(1, 12)}.2021 ", ""])
            body = who + self.prose(1, 4)
            named = self.r.choice([' class="comment"', "", ' class="comment-body"', ' class="reply"'])
            out += f"<{one}{named}>" + (body if one == "p" else f"<p>{body}</p>") + f"</{one}>"
        if one == "li":
            out = f"<ol>{out}</ol>"
        return self.wrap(out + (self.form() if self.r.random() < 0.3 else ""), "section div div div aside", COMMENTS)

    def footer(self) -> str:
        text = self.r.choice([f"&copy; 20{self.r.randint(10, 29)} {self.words(1, 3)}", f"&copy; {self._word()}.example.com &middot; {self.prose(1, 3)}",
                              f"Copyright {self.words(1, 3)}. All rights reserved.", self.prose(1, 2)])
        return self.wrap(self.r.choice([text, f"<p>{text}</p>", f"<p>{text}</p>" + self.links(2, 5)]), "footer footer div", FOOTERS)

    # The article.
    def say(self, text: str) -> str:
        """A block of the article: its text is a line of the label."""
        self.lines.append(" ".join(text.split()))
        text = _html.escape(text, quote=False)
        if self.r.random() < 0.15:
            cut = text.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = self.r.choice([f"<b>{cut[k]}</b>", f"<em>{cut[k]}</em>", self.link(cut[k]), f"<span>{cut[k]}</span>", cut[k] + "<br>"])
            text = " ".join(cut)
        return text

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            text = self.prose(1, 9)
            odd = self.r.random()
            if odd < 0.06:
                text = " ".join(w + self.r.choice(["&&&", "***", "###", "$$$", "%%%"]) for w in text.split())
            elif odd < 0.12:
                text = self.r.choice([" | ", " - ", " &middot; ", " > "]).replace("&middot;", "·").join(text.split())
            elif odd < 0.16:
                text = " ".join(str(self.r.randint(0, 9999)) for _ in range(self.r.randint(1, 30)))
            elif odd < 0.20:
                text += " " + self.r.choice(["Copyright 2020.", "Write to a@example.com.", "All rights reserved.", "Log in to reply.", "Share."])
            if not self.tidy and self.r.random() < 0.4:
                return self.r.choice(["<p>", "<p><b>", "<p><i>"]) + self.say(text) + self.r.choice(["", "<br>"])
            return f"<p>{self.say(text)}</p>"
        if kind < 0.78:
            return f"<p>{self.say(self.words(1, 3).capitalize() + '.')}</p>"
        if kind < 0.84:
            return f"<h{(k := self.r.choice('23'))}>{self.say(self.words(1, 6).capitalize())}</h{k}>"
        if kind < 0.90:
            return "<ul>" + "".join(f"<li>{self.say(self.r.choice([self.words(1, 8), self.sentence()]))}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote><p>{self.say(self.prose(1, 3))}</p></blockquote>"
        if kind < 0.97:
            return f"<div>{self.say(self.prose(1, 5))}</div>"
        cells = [[self.words(1, 3) for _ in range(2)] for _ in range(self.r.randint(2, 3))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.say(c)}</td>" for c in row) + "</tr>" for row in cells) + "</table>"

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.9:
            title = f"<h1>{self.say(self.words(2, 9).capitalize() + self.r.choice(['', '.']))}</h1>"
            parts.append(f"<header>{title}</header>" if self.r.random() < 0.1 else title)
        for _ in range(self.r.choice([1, 2, 3, 4, 6, 8, 12, 18])):
            parts.append(self.paragraph())
            if self.r.random() < 0.12:
                parts.append(self.r.choice([self.advert, self.advert, self.notice, self.share, self.form, self.side])())
        if self.r.random() < 0.15:
            parts.append(self.share())
        if self.r.random() < 0.05:
            parts.append(f"<footer><p>{self.words(2, 6)}</p></footer>")
        inner = "".join(parts)
        style = self.r.random()
        if style < 0.5:
            tag = self.r.choice(["article", "article", "main"])
            return f"<{tag}{self.names(CONTENT) if self.r.random() < 0.4 else ''}>{inner}</{tag}>"
        if style < 0.9:
            tag = self.r.choice(["div", "div", "section", "td"])
            out = f"<{tag}{self.names(CONTENT)}>{inner}</{tag}>"
            return f"<table><tr>{out}</tr></table>" if tag == "td" else out
        return inner


def page(seed: int) -> tuple[str, str]:
    """(html, main text) of the made-up page ``seed``."""
    p = _Page(seed)
    r = p.r
    before = [f() for f in (p.header, p.menu, p.notice, p.advert, p.side, p.form, p.menu) if r.random() < 0.4]
    r.shuffle(before)
    core = p.article()
    after = [f() for f in (p.share, p.comments, p.side, p.form, p.advert, p.menu) if r.random() < 0.4]
    if r.random() < 0.5:
        r.shuffle(after)
    if r.random() < 0.8:
        after.append(p.footer())
    if r.random() < 0.15:
        after.append(p.notice())
    inner = "".join([*before, core, *after])
    if r.random() < 0.3:
        inner = f'<div{r.choice(["", " class=wrapper", " id=page", " class=container"])}>{inner}</div>'
    script = r.choice(["", "<script>var t='</p>';track(1);</script>", "<style>p{margin:0}</style>"])
    tail = "</body></html>" if p.tidy else ""
    return (f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{p.words(2, 6)}</title>{script}</head><body>{inner}{script}{tail}",
            "\n".join(p.lines))
