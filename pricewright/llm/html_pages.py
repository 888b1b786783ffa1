"""Labelled pages for training: layouts of common sites, written with a label on every element.

The words are drawn from a seeded generator, with phrases that sites put beside their articles; what the layouts teach
is structure. ``data-y`` holds the label: 1 for the main article and what is in it, 0 for everything else. A page's style
says whether it names its parts by class, by tag or not at all.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas vor el in do sha pre con ter ly ous ment qua bri zen fa".split()
#: Class names that sites give to what isn't the article.
BOILER = {
    "nav": ["menu", "main-nav", "navbar", "breadcrumbs", "pagination", "toc", "tabs", "nav"],
    "header": ["site-header", "header", "masthead", "topbar", "banner", "logo", "top"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "side", "widget", "aside", "related", "recommended", "popular", "tags"],
    "notice": ["notice", "cookie", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "paywall", "subscribe"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense"],
    "form": ["newsletter", "signup", "login", "search", "search-form", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "respond"],
    "share": ["share", "social", "sharing", "author-box", "byline-links", "meta", "related-posts"],
}
GOOD = ["content", "main", "article", "post", "entry", "entry-content", "article-body", "post-content", "story", "text", "body"]
#: What such parts say; ``{}`` stands for other words.
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Blog", "Products", "Archive", "Login", "Home / {}", "Categories", "Help", "Support", "Shop", "FAQ", "Next page", "Older posts", "Back to top", "{}"],
    "header": ["{}", "The {}", "Welcome to {}", "{} News", "{} - your home for {}", "{} Blog", "All about {}", "Skip to content"],
    "footer": ["© 2024 {}", "Copyright 2023 {} Inc. All rights reserved.", "All rights reserved.", "Copyright {} Ltd.", "Privacy policy", "Terms of use", "Powered by {}", "Contact us: {}", "© {}. Published by {}.", "Impressum", "Legal notice {}"],
    "aside": ["Related", "Popular posts", "Recent posts", "Most read", "You may also like", "Tags", "Archives", "About the site", "Follow us", "Categories", "Top stories", "Recommended for you"],
    "notice": ["We use cookies to improve {}.", "This site uses cookies. By browsing you agree to {}.", "Please accept our cookie policy.", "Subscribe to read more.", "Notice: {}", "Sign up to continue reading.", "We have updated our privacy policy."],
    "ad": ["Advertisement", "Sponsored: {}", "Buy {} now!", "Ad: {}", "Special offer on {}. Shop now!", "{}", "{}."],
    "form": ["Search", "Subscribe to our newsletter", "Your email", "Sign up", "Username", "Password", "Log in", "Join our mailing list for {}"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Join the discussion", "Replies", "{} says: {}", "Reader comments"],
    "share": ["Share this", "Share on Facebook", "Tweet", "Tagged: {}", "Posted by {}", "Follow us on Twitter", "Print this page", "Filed under {}"],
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class Pages:
    def __init__(self, seed: int = 7):
        self.r = random.Random(seed)
        self.style, self.plain = "class", False

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        text = [" ".join(self.word() for _ in range(r.randint(2, 14))).capitalize() + r.choice(".....?!") for _ in range(max(r.randint(1, 6), hi // 12 if hi > 120 else 0))]
        return " ".join(" ".join(text).split()[: r.randint(lo, hi)])

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 9))).capitalize()

    def prose(self, longest: int) -> str:
        """Sentences; now and then with a word that boilerplate uses too. A page of plain style has a few words without a mark."""
        text = self.words(1, min(longest, 8) if self.plain else longest).rstrip(".?!").split()
        if self.r.random() < 0.15:
            text.insert(self.r.randrange(len(text) + 1), self.r.choice("home news search share post top terms help contact products you your all more comment about like page story shop support follow back".split()))
        return " ".join(text) + self.r.choice(["", "", "", "."] if self.plain else [".", ".", ".", ".", "!", "?", "", ":"])

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind]).replace("{}", self.words(1, 4).rstrip(".?!"), 1).replace("{}", self.word())

    def el(self, tag: str, y: int, inner: str = "", cls: str = "") -> str:
        name = f' {self.r.choice(["class", "class", "id"])}="{cls}"' if cls and self.style == "class" else ""
        return f'<{tag}{name} data-y="{y}">{inner}</{tag}>'

    def links(self, y: int, n: int, kind: str = "") -> str:
        text = lambda: self.phrase(kind) if kind and self.r.random() < 0.7 else self.words(1, 4)
        shape = self.r.random()
        if shape < 0.6:
            return self.el("ul", y, "".join(self.el("li", y, f'<a href="/x">{text()}</a>') for _ in range(n)))
        between = self.r.choice([" | ", " ", " · ", "", " &gt; "])
        return self.el("div" if shape < 0.8 else "p", y, between.join(f'<a href="/x">{text()}</a>' for _ in range(n)))

    def boiler(self, kind: str) -> str:
        r, e = self.r, self.el
        cls, tag = r.choice(BOILER[kind]), TAGS.get(kind, "div")
        if self.style == "none" and kind != "form":
            tag = r.choice(["div", "div", "div", "section", "p"])
        elif self.style == "class" and r.random() < 0.5:
            tag = r.choice(["div", "section", "div"]) if kind != "form" else "form"
        elif self.style == "class":
            cls = cls if kind in ("notice", "ad", "comments", "share") or r.random() < 0.5 else ""
        say = lambda: self.phrase(kind)
        much = 90 if self.style != "none" else 9  # without a name, long sentences can't be told from the article's
        flat = tag == "p"
        if kind == "nav":
            inner = " | ".join(f'<a href="/x">{say()}</a>' for _ in range(r.randint(2, 6))) if flat else self.links(0, r.randint(2, 8), kind)
        elif kind == "header":
            inner = say() if flat else r.choice([e("h1", 0, say()), e("h1", 0, say()) + e("p", 0, self.words(2, 9)), say(), e("div", 0, say()), e("h2", 0, say()) + self.links(0, 4, "nav"), f'<a href="/">{say()}</a>' + e("p", 0, say()), e("h1", 0, f'<a href="/">{say()}</a>') + e("p", 0, say()) + self.links(0, 4, "nav")])
        elif kind == "footer":
            inner = r.choice([say(), f'{say()} <a href="/p">{say()}</a>']) if flat else r.choice([say(), "&copy; " + self.words(2, 8), e("p", 0, say()), e("p", 0, self.words(4, much)), e("p", 0, self.words(4, much)) + e("p", 0, say()), self.links(0, 4, "footer") + e("p", 0, say()), e("div", 0, say()) + e("div", 0, say())])
        elif kind == "aside":
            inner = say() if flat else r.choice([e("h3", 0, say()), e("h2", 0, say()), e("p", 0, say())]) + r.choice([self.links(0, 5), e("p", 0, self.words(5, much)), e("div", 0, self.words(3, 25)), self.links(0, 3, "aside")])
        elif kind == "form":
            inner = e("label", 0, say()) + "<input>" + r.choice(["", e("p", 0, self.words(4, 20)), say()]) + e("button", 0, say())
        elif kind == "comments":
            item = lambda: e(r.choice(["div", "div", "li", "li", "article", "p"]), 0, r.choice([e("p", 0, self.words(3, r.choice([60, 60, 300]))) * r.randint(1, 2), self.words(3, 40), e("b", 0, self.word()) + " " + self.words(4, 40), f"{self.word()} says: " + self.words(4, 30)]), r.choice(["comment", "reply", "comment-body"]))
            inner = say() if flat else r.choice([e("h3", 0, say()), e("h2", 0, say()), e("h4", 0, say())]) + "".join(item() for _ in range(r.randint(1, 5)))
        else:
            inner = say() if flat else r.choice([say(), self.words(3, much), e("p", 0, say()), e("p", 0, self.words(3, much)), e("span", 0, say()) + self.links(0, 2, kind), e("b", 0, say()) + " " + self.words(3, 12)])
        return e(tag, 0, inner, cls)

    def body_parts(self, tag: str = "p") -> str:
        """Parts of an article whose paragraphs have this tag."""
        r, e = self.r, self.el
        parts = []
        if r.random() < 0.7:
            head = e(r.choice(["h1", "h1", "h2"]), 1, self.title())
            parts.append(e("header", 1, head + r.choice(["", e("p", 1, self.prose(20))])) if self.style != "none" and r.random() < 0.1 else head)
        longest = r.choice([20, 60, 120, 120, 400])
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 8, 12])):
            kind = r.random()
            if kind < 0.74:
                text = self.prose(r.choice([longest, longest, longest, 3]))
                if r.random() < 0.08:  # a part of it, or all, in an element of its own
                    text = (self.prose(20) + " " if r.random() < 0.5 else "") + e(r.choice(["span", "span", "em", "font", "b"]), 1, text, r.choice(["lead", "intro", "first", "highlight", "dropcap", ""]))
                parts.append(e(tag, 1, text))
            elif kind < 0.8:
                parts.append(e(r.choice(["h2", "h3"]), 1, self.title()))
            elif kind < 0.85:
                parts.append(e(r.choice(["ul", "ol"]), 1, "".join(e("li", 1, self.words(1, 20)) for _ in range(r.randint(2, 5)))))
            elif kind < 0.88:
                parts.append(e("blockquote", 1, r.choice([e("p", 1, self.prose(40)), self.prose(30)])))
            elif kind < 0.91:
                parts.append(e("table", 1, "".join(e("tr", 1, "".join(e("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(3))))
            elif kind < 0.93:
                parts.append(e("figure", 1, "<img>" + e("figcaption", 1, self.words(3, 12))))
            elif kind < 0.95:
                parts.append(e("pre", 1, self.words(3, 20)))
            elif kind < 0.96:
                parts.append(e("dl", 1, "".join(e("dt", 1, self.words(1, 3)) + e("dd", 1, self.words(3, 12)) for _ in range(2))))
            elif self.style != "none":
                parts.append(self.boiler(r.choice(["ad", "ad", "share", "aside", "form", "notice"])))
        return "".join(parts) or e(tag, 1, self.prose(40))

    def sections(self, tag: str) -> str:
        r, e = self.r, self.el
        headed = r.random() < 0.5
        head = lambda: e(r.choice(["h2", "h3"]), 1, self.title()) if headed and r.random() < 0.8 else ""
        return "".join(e(tag, 1, head() + "".join(e("p", 1, self.prose(80)) for _ in range(r.choice([1, 1, 2, 3])))) for _ in range(r.randint(2, 5)))

    def article(self) -> tuple[str, int]:
        """The article, and the label of what holds it: 1 only if text of the article stands there itself."""
        r, e = self.r, self.el
        if self.style == "none":
            shape = r.random()
            if shape < 0.25:
                return e("div", 1, self.body_parts()), 0
            if shape < 0.38:
                return self.sections("div"), 0
            if shape < 0.5:
                return self.body_parts(), 0
            if shape < 0.6:
                return e("div", 1, self.prose(200)), 0
            if shape < 0.7:
                return e("div", 1, "<br><br>".join(self.prose(80) for _ in range(r.randint(1, 5)))), 0
            if shape < 0.82:
                return "<br><br>".join(self.prose(120) for _ in range(r.randint(1, 5))), 1
            if shape < 0.88:
                return e("div", 1, self.body_parts("div")), 0
            if shape < 0.93:
                return e("table", 1, e("tr", 1, e("td", 1, self.body_parts()))), 0
            return e("div", 1, e("div", 1, self.body_parts())), 0
        inner = self.sections(r.choice(["section", "section", "div"])) if r.random() < 0.12 else self.body_parts(r.choice(["p", "p", "p", "p", "p", "div"]))
        shape = r.random()
        if shape < 0.5:
            return e("article", 1, r.choice([inner, inner, inner, self.prose(80)]), r.choice(["", "", *GOOD])), 0
        if shape < 0.7:
            return e("main", 1, r.choice([inner, inner, e("article", 1, inner), e("div", 1, inner, r.choice(GOOD)), self.prose(80)]), r.choice(["", *GOOD])), 0
        if shape < 0.9:
            return e("div" if self.style == "class" else r.choice(["div", "section"]), 1, r.choice([inner, e("div", 1, inner, r.choice(GOOD)), e("section", 1, inner)]), r.choice(GOOD)), 0
        return inner, 0

    def page(self) -> str:
        r, e = self.r, self.el
        self.style = r.choices(["class", "tag", "none"], [4, 3, 3])[0]
        much, self.plain = r.choice([0, 0.2, 0.5, 0.5]), r.random() < 0.15
        main, loose = self.article()
        before = [self.boiler(k) for k in ("header", "nav", "ad", "notice", "form") if r.random() < much]
        after = [self.boiler(k) for k in ("comments", "aside", "share", "form", "ad", "footer") if r.random() < much]
        if self.style == "none" and not loose and r.random() < 0.12:
            side = [self.boiler(r.choice(["nav", "nav", "aside"])) if r.random() < 0.5 else "<br>".join(f'<a href="/x">{self.phrase("nav")}</a>' for _ in range(r.randint(2, 6)))]
            cells = [e("td", 0, side[0]), e("td", 1, self.body_parts())]
            main = e("table", 0, e("tr", 0, "".join(cells if r.random() < 0.7 else cells[::-1])))
        if r.random() < 0.1:
            after, before = after + before[:1], before[1:]
        if not loose and r.random() < 0.3:
            cut = r.choice([0, 1, len(after)])
            main = e("div", 0, (before.pop() if before and r.random() < 0.5 else "") + main + "".join(after[:cut]), r.choice(["wrapper", "container", "page", "row"]))
            after = after[cut:]
        if r.random() < (0.4 if loose else 0.1):
            return "".join(before) + main + "".join(after)
        return f'<html data-y="0"><body data-y="{loose}">{"".join(before)}{main}{"".join(after)}</body></html>'


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
