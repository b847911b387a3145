"""Drawn page layouts in which it is known which blocks are content.

The blocks of text come from the caller; what is drawn is what stands around
them: landmarks with or without names, wrappers, menus, adverts, notices, forms,
sidebars, comments by readers, and articles of headings, paragraphs, lists,
quotations, tables and figures. Comments, adverts and sidebars get whole
paragraphs too, so that length alone tells nothing.
"""

from __future__ import annotations

import html
import random

# Names that pages give to their parts, and phrases of their furniture.
NAMED = {
    "menu": ["nav", "main-nav", "navbar", "menu", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "site-navigation"],
    "head": ["header", "site-header", "masthead", "page-head", "branding", "top-banner"],
    "foot": ["footer", "site-footer", "page-foot", "colophon", "copyright", "legal"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "right-rail", "trending", "recommended", "more-stories"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "banner-ad", "promo", "adsense"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter", "subscribe-box", "gdpr-bar", "popup"],
    "comment": ["comments", "comment-list", "reader-comments", "responses", "discussion", "disqus_thread", "replies"],
    "share": ["share", "social", "share-buttons", "social-links"],
    "form": ["search", "search-form", "login", "signup", "contact-form"],
    "content": ["content", "article", "post", "entry-content", "post-body", "article-body", "story", "main-content", "text", "page-content"],
    "plain": ["wrap", "container", "row", "col", "inner", "layout", "grid", "page", "outer", "box1", "c3"],
}
LINES = {
    "menu": ["Home", "About", "Contact", "News", "Products", "Blog", "Help", "Login", "Archive", "Sports", "World", "Search"],
    "notice": ["We use cookies to improve this site.", "Accept all", "By using this site you agree to our terms.", "Subscribe to our newsletter", "Enter your email", "This site uses cookies.", "No thanks", "Important notice"],
    "foot": ["© 2023 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Powered by"],
    "comment": ["Reply", "3 comments", "Comments", "Leave a comment", "says:", "2 days ago", "Report", "Log in to reply", "Great post, thanks!", "I disagree with this."],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Save 50% today", "Limited offer", "Click here"],
    "side": ["Related articles", "Most read", "Popular", "About the author", "Tags", "Follow us", "Read more", "You may also like"],
    "share": ["Share", "Tweet", "Like", "Print", "Email this"],
    "form": ["Name", "Email", "Search", "Send", "Your message", "Password"],
}


class _Layout:
    def __init__(self, pool: list[str], rng: random.Random):
        self.pool, self.rng, self.out, self.labels = pool, rng, [], []
        #: How often a part bears a name, and a landmark's own tag.
        self.named, self.landmark = rng.choice([0.95, 0.8, 0.4]), rng.choice([0.9, 0.5, 0.1])
        self.loose = rng.random() < 0.2  # paragraphs are not closed

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def put(self, raw: str) -> None:
        self.out.append(raw)

    def sentence(self, least: int = 1, most: int = 80) -> str:
        words = self.rng.choice(self.pool).split()
        n = min(len(words), self.rng.randint(least, most))
        a = self.rng.randrange(len(words) - n + 1)
        return " ".join(words[a : a + n]) or "x"

    def inline(self, text: str) -> str:
        """The text escaped, now and then with marks or a link in it."""
        words = [html.escape(w, quote=False) for w in text.split()] or ["x"]
        if len(words) > 4 and self.chance(0.3):
            i = self.rng.randrange(len(words) - 2)
            tag = self.rng.choice(["a href='/x'", "b", "em", "span", "i", "strong"])
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split()[0]}>"
        if self.chance(0.05):
            words.insert(self.rng.randrange(len(words)), "<br>")
        return self.rng.choice([" ", " ", "\n", "  "]).join(words)

    def block(self, tag: str, text: str, content: bool, attributes: str = "", closed: bool = True) -> None:
        self.put(f"<{tag}{attributes}>{self.inline(text)}" + (f"</{tag}>" if closed else ""))
        self.labels.append(content)

    def link(self, tag: str, text: str, content: bool) -> None:
        self.put(f'<{tag}><a href="/{self.rng.randrange(999)}">{html.escape(text, quote=False)}</a></{tag}>')
        self.labels.append(content)

    def opened(self, kind: str, tags: list[str]) -> str:
        """Open a part of this kind by a landmark's tag or a div; the tag."""
        tag = tags[0] if self.chance(self.landmark) else self.rng.choice(tags[1:] or tags)
        name = self.rng.choice(NAMED[kind])
        named = self.chance(self.named)
        self.put(f"<{tag}" + (f' {self.rng.choice(["class", "class", "id"])}="{name}"' if named else "") + ">")
        return tag

    def line(self, kind: str) -> str:
        return self.rng.choice(LINES[kind]) if self.chance(0.7) else self.sentence(1, 6)

    def menu(self, kind: str = "menu") -> None:
        tag = self.opened(kind, ["nav", "div", "ul", "div"])
        items = self.rng.randint(2, 10)
        if tag != "ul" and self.chance(0.8):
            self.put("<ul>")
        for _ in range(items):
            self.link("li", self.line("menu") if self.chance(0.5) else self.sentence(1, 2), False)
        self.put(f"</ul></{tag}>" if tag != "ul" else "</ul>")

    def header(self) -> None:
        tag = self.opened("head", ["header", "div"])
        if self.chance(0.7):
            kind = self.rng.choice(["div", "h1", "h2", "h1", "p"])
            self.link(kind, self.sentence(1, 4), False) if self.chance(0.5) else self.block(kind, self.sentence(1, 4), False)
        if self.chance(0.6):
            self.block("p", self.sentence(3, 12), False)
        if self.chance(0.4):
            self.menu()
        if self.chance(0.3):
            self.form()
        self.put(f"</{tag}>")

    def form(self) -> None:
        self.put(self.rng.choice(["<form>", '<form class="search-form" action="/s">', '<form id="signup">']))
        for _ in range(self.rng.randint(1, 3)):
            self.block(self.rng.choice(["p", "div"]), self.line("form"), False)
        self.put("<input type=text value='q'><textarea>x y</textarea><select><option>a<option>b</select><button>Go</button></form>")

    def notice(self) -> None:
        tag = self.opened("notice", ["div", "section", "aside", "div"])
        for _ in range(self.rng.randint(1, 2)):
            self.block(self.rng.choice(["p", "div", "h3", "p"]), self.rng.choice(LINES["notice"]) if self.chance(0.7) else self.sentence(4, 30), False)
        self.put(self.rng.choice(["<button>OK</button>", "", "<a href='/p'>Privacy</a>"]))
        if self.out[-1].startswith("<a"):
            self.labels.append(False)
        self.put(f"</{tag}>")

    def advert(self) -> None:
        named, self.named = self.named, max(self.named, 0.9)
        tag = self.opened("advert", ["aside", "div", "div", "section"])
        self.named = named
        if self.chance(0.5):
            self.put(html.escape(self.line("advert") if self.chance(0.4) else self.sentence(3, 30), quote=False))
            self.labels.append(False)
        else:
            for _ in range(self.rng.randint(1, 3)):
                self.block("p", self.sentence(3, 40) if self.chance(0.6) else self.line("advert"), False)
        self.put(f"</{tag}>")

    def related(self, kind: str = "side") -> None:
        tag = self.opened(kind, ["aside", "div", "section", "div"])
        for _ in range(self.rng.randint(1, 3)):
            self.block(self.rng.choice(["h3", "h2", "h4"]), self.line("side"), False)
            if self.chance(0.7):
                self.put("<ul>")
                for _ in range(self.rng.randint(2, 6)):
                    self.link("li", self.sentence(2, 12), False)
                self.put("</ul>")
            else:
                self.block("p", self.sentence(5, 50), False)
        self.put(f"</{tag}>")

    def sharing(self) -> None:
        tag = self.opened("share", ["div", "ul"])
        for _ in range(self.rng.randint(2, 4)):
            self.link("li" if tag == "ul" else "div", self.line("share"), False)
        self.put(f"</{tag}>")

    def comments(self) -> None:
        named, self.named = self.named, max(self.named, 0.9)
        tag = self.opened("comment", ["section", "div", "div", "aside"])
        self.named = named
        if self.chance(0.8):
            self.block("h3", self.line("comment"), False)
        style = self.rng.choice(["li", "div", "article", "p"])
        self.put("<ol>" if style == "li" else "")
        for _ in range(self.rng.randint(1, 6)):
            if style == "p":
                self.block("p", self.sentence(3, 60), False)
                continue
            self.put(f'<{style} class="comment">' if self.chance(0.7) else f"<{style}>")
            if self.chance(0.7):
                self.block("div", self.sentence(1, 2) if self.chance(0.5) else self.line("comment"), False)
            for _ in range(self.rng.randint(1, 2)):
                self.block("p", self.sentence(3, 80) if self.chance(0.8) else self.line("comment"), False)
            if self.chance(0.4):
                self.link("div", "Reply", False)
            self.put(f"</{style}>")
        self.put("</ol>" if style == "li" else "")
        if self.chance(0.4):
            self.form()
        self.put(f"</{tag}>")

    def footer(self) -> None:
        tag = self.opened("foot", ["footer", "div"])
        if self.chance(0.4):
            self.menu()
        self.put("&copy; " + html.escape(self.sentence(1, 10), quote=False)) if self.chance(0.6) else self.put("<p>" + html.escape(self.line("foot"), quote=False) + "</p>")
        self.labels.append(False)
        self.put(f"</{tag}>")

    def body_block(self) -> None:
        kind = self.rng.choices(["p", "h", "list", "quote", "pre", "table", "figure", "div", "intrusion"], [60, 9, 7, 5, 2, 4, 3, 5, 7])[0]
        if kind == "p":
            bold = self.chance(0.06)
            self.put("<p><b>") if bold else None
            if bold:
                self.put(self.inline(self.sentence(4, 90)) + "<br>")
                self.labels.append(True)
            else:
                self.block("p", self.sentence(1, 90), True, closed=not self.loose)
        elif kind == "h":
            self.block(self.rng.choice(["h2", "h3", "h4"]), self.sentence(1, 9), True)
        elif kind == "list":
            tag = self.rng.choice(["ul", "ol"])
            self.put(f"<{tag}>")
            for _ in range(self.rng.randint(2, 7)):
                self.link("li", self.sentence(2, 9), True) if self.chance(0.1) else self.block("li", self.sentence(2, 25), True, closed=not self.loose)
            self.put(f"</{tag}>")
        elif kind == "quote":
            self.put("<blockquote>")
            self.block("p", self.sentence(4, 40), True)
            self.put("</blockquote>")
        elif kind == "pre":
            self.block("pre", self.sentence(4, 40), True)
        elif kind == "table":
            self.put("<table>")
            for _ in range(self.rng.randint(1, 4)):
                self.put("<tr>")
                for _ in range(self.rng.randint(2, 3)):
                    self.block("td", self.sentence(1, 6), True)
                self.put("</tr>")
            self.put("</table>")
        elif kind == "figure":
            self.put("<figure><img src=x alt='y'>")
            self.block("figcaption", self.sentence(3, 15), True)
            self.put("</figure>")
        elif kind == "div":
            self.block("div", self.sentence(3, 90), True)
        else:
            self.rng.choice([self.advert, self.sharing, self.related, self.notice, self.form])()

    def article(self) -> None:
        named, self.named = self.named, self.rng.choice([0.9, self.named])
        tag = self.opened("content", ["article", "div", "section", "div", "main", "td"])
        self.named = named
        if tag == "td":  # only right within a table
            self.out[-1] = "<table><tr>" + self.out[-1]
        if self.chance(0.85):
            head = self.chance(0.2)
            self.put("<header>") if head else None
            self.block("h1" if self.chance(0.8) else "h2", self.sentence(2, 14), True)
            self.put("</header>") if head else None
        depth = self.rng.choice([0, 0, 1, 2])
        for _ in range(depth):
            self.put(f'<div class="{self.rng.choice(NAMED["content"] + NAMED["plain"])}">' if self.chance(0.7) else "<div>")
        if self.chance(0.12):  # an article of a line or two
            for _ in range(self.rng.randint(1, 2)):
                self.block("p", self.sentence(1, 6), True)
        else:
            for _ in range(self.rng.choice([1, 2, 3, 5, 8, 14])):
                self.body_block()
        self.put("</div>" * depth)
        if self.chance(0.2):
            self.comments()
        self.put(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))

    def page(self) -> str:
        c = self.chance
        self.put("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>x='</p>'</script></head><body>")
        wraps = self.rng.choice([0, 0, 1, 2])
        if c(0.3):
            self.notice()
        for _ in range(wraps):
            self.put(f'<div class="{self.rng.choice(NAMED["plain"])}">' if c(0.6) else "<div>")
        before = [(self.header, 0.6), (self.menu, 0.7), (self.advert, 0.45)]
        self.rng.shuffle(before)
        for part, p in before:
            if c(p):
                part()
        side_first = c(0.25)
        main = c(0.5)
        if main:
            self.put(self.rng.choice(["<main>", "<main id='content'>", "<div id='main'>", '<div class="container">', "<div>"]))
        closing = {"<main>": "</main>", "<main id='content'>": "</main>"}.get(self.out[-1], "</div>") if main else ""
        if side_first:
            self.related()
        self.article()
        for part, p in ((self.sharing, 0.2), (self.related, 0.3), (self.comments, 0.4), (self.advert, 0.2), (self.form, 0.1)):
            if c(p):
                part()
        if not side_first and c(0.4):
            self.related()
        self.put(closing)
        self.put("</div>" * wraps)
        if c(0.85):
            self.footer()
        if c(0.15):
            self.notice()
        self.put("</body></html>" if c(0.8) else "")
        return "".join(self.out)


def laid_out(pool: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page's html and, of its blocks of text in order, which are content."""
    layout = _Layout(pool, rng)
    return layout.page(), layout.labels
