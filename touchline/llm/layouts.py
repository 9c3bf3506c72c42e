"""Pages drawn by chance, whose main text is known: what the block labeller of operator 11 is trained on.

A page is a site's structure (element names, class names, order of parts) filled with invented words. Each part is written by a
function of its own; main text gets a mark in front. Parts other than the article hold prose as well, and articles hold
short lines, lists and links, so that neither length nor punctuation alone tells them apart.
"""

from __future__ import annotations

import numpy as np

# Names that sites give to their parts, and words that such parts use.
NAMES = {
    "article": "article post entry content story main-content post-content article-body entry-content text body-text blog-post news-text",
    "nav": "nav menu navbar navigation main-menu top-menu breadcrumb breadcrumbs site-nav links pagination pager tabs",
    "header": "header site-header masthead top banner logo branding page-header topbar",
    "footer": "footer site-footer bottom copyright page-footer legal colophon foot",
    "aside": "sidebar side aside widget related related-posts rail recommended popular trending tags tag-cloud more-stories author-box",
    "notice": "cookie cookie-notice notice gdpr consent alert banner-notice popup modal newsletter-notice message warning paywall overlay",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot promoted adsbygoogle dfp sponsor partner",
    "form": "form search search-form subscribe newsletter signup login contact-form poll feedback",
    "comments": "comments comment comment-list responses discussion reader-comments replies comment-body disqus user-comments",
    "share": "share social share-buttons social-links follow sharing tools actions",
}
SAYS = {
    "nav": "Home About Contact News Sports Blog Products Services Login Archive Next Previous Page Menu Help FAQ Shop Categories",
    "header": "Welcome Official Site Daily News Portal Blog Magazine Online Today",
    "footer": "Copyright © 2024 All rights reserved Privacy Policy Terms of Service Imprint Contact Powered by",
    "aside": "Related Popular Trending Recommended Tags Archives Recent Posts Read more Most read See also About the author",
    "notice": "We use cookies Accept Decline this site uses to improve your experience privacy settings Please enable JavaScript Subscribe now",
    "ad": "Advertisement Sponsored Buy now Sale Offer Free Click here Learn more Ad Order today Discount",
    "form": "Search Email Name Subscribe Submit Send Password Sign up Log in Newsletter Your message Enter your",
    "comments": "Reply said says wrote Comments Comment ago Like Report Posted by Anonymous Guest thanks agree",
    "share": "Share Tweet Facebook Twitter Email Print Pin Like Follow us",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SAYS = {k: v.split() for k, v in SAYS.items()}
OWN_TAG = {"article": ["article", "main", "div", "section"], "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "dialog", "p"], "ad": ["div", "ins", "aside", "section"], "form": ["form"], "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul"]}


class Drawer:
    """One page's choices: its words, how it names its parts, and how carefully it closes its elements."""

    def __init__(self, random: np.random.Generator, mark: str):
        self.random, self.mark = random, mark
        letters = "abcdefghijklmnopqrstuvwxyzáéíóúäöüßñçè"
        parts = ["".join(letters[k] for k in random.integers(0, len(letters), random.integers(1, 4))) for _ in range(40)]
        self.lexicon = ["".join(parts[k] for k in row[: 1 + row[3] % 3]) for row in random.integers(0, 40, (120, 4)).tolist()]
        self.other = ["".join(parts[k] for k in row[: 1 + row[3] % 3]) for row in random.integers(0, 40, (60, 4)).tolist()]
        self.semantic = random.random() < 0.6
        self.named = random.random() < 0.85
        self.sloppy = random.random() < 0.4
        self.rare = random.random() < 0.4

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def among(self, low: int, high: int) -> int:
        return int(self.random.integers(low, high + 1))

    def pick(self, items: list):
        return items[int(self.random.integers(len(items)))]

    def words(self, n: int, other: bool = False) -> str:
        own = self.other if other else self.lexicon
        return " ".join(own[int(len(own) * self.random.random() ** 2)] for _ in range(n))

    def sentence(self, other: bool = False) -> str:
        said = self.words(self.among(1, 14), other)
        return said[:1].upper() + said[1:] + self.pick([".", ".", ".", "!", "?", ",", ""])

    def prose(self, low: int, high: int, other: bool = False) -> str:
        said = " ".join(self.sentence(other) for _ in range(self.among(low, high)))
        if self.chance(0.06):
            said = said.replace(" ", " | ")
        for sign, odds in (("&amp;", 0.1), ("&nbsp;", 0.05), ("&#8217;", 0.05), ("\n", 0.1), (str(self.among(0, 10**9)), 0.1)):
            if self.chance(odds):
                said = said.replace(" ", f" {sign} " if sign != "\n" else sign, 1)
        return said

    def typical(self, part: str, low: int, high: int) -> str:
        return " ".join(self.pick(SAYS[part]) if self.chance(0.6) else self.words(1) for _ in range(self.among(low, high)))

    def wrap(self, part: str, inner: str) -> str:
        """``inner`` in an element of the part's kind, or one that only its class or id tells."""
        tag = OWN_TAG[part][0] if self.semantic and self.chance(0.8) else self.pick(OWN_TAG[part])
        plain = tag in ("div", "section", "p", "ul", "ol", "ins", "dialog", "aside", "main")
        told = (plain and (self.named or part not in ("article", "nav", "footer", "header"))) or self.chance(0.3)
        name = self.pick(NAMES[part])
        if told and self.chance(0.2):
            name += self.pick(["-", " ", "_"]) + self.words(1)
        said = f' {self.pick(["class", "class", "id"])}="{name}"' if told else f' class="{self.words(1)}"' if self.chance(0.2) else ""
        if part == "notice" and self.chance(0.3):
            said += ' role="dialog"'
        return f"<{tag}{said}>{inner}</{tag}>"

    def anchors(self, n: int, part: str = "nav") -> list[str]:
        return [f'<a href="/{self.words(1)}">{self.typical(part, 1, 3) if self.chance(0.4) else self.words(self.among(1, 3))}</a>' for _ in range(n)]

    def menu(self) -> str:
        links = self.anchors(self.among(2, 9))
        style = self.among(0, 2)
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if style < 2 else self.pick([" | ", " ", " &raquo; "]).join(links)
        return self.wrap("nav", inner)

    def header(self) -> str:
        title = f"<{(t := self.pick(['div', 'h1', 'h2', 'p', 'span']))}>{self.typical('header', 1, 4)}</{t}>"
        return self.wrap("header", title + (f"<p>{self.prose(1, 1)}</p>" if self.chance(0.4) else "") + (self.menu() if self.chance(0.4) else ""))

    def footer(self) -> str:
        inner = "".join(self.pick([lambda: f"<p>&copy; {self.words(2)} {self.typical('footer', 2, 8)}</p>", lambda: f"&copy; {self.words(1)}.example &middot; {self.prose(1, 3, True)}", lambda: " ".join(self.anchors(3, "footer")), lambda: f"<div>{self.prose(1, 2)}</div>"])() for _ in range(self.among(1, 3)))
        return self.wrap("footer", inner)

    def aside(self) -> str:
        head = f"<h3>{self.typical('aside', 1, 3)}</h3>" if self.chance(0.6) else ""
        body = self.pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in self.anchors(self.among(2, 6), "aside")) + "</ul>", lambda: f"<p>{self.prose(1, 4)}</p>", lambda: "".join(f"<h4>{self.words(4)}</h4><p>{self.prose(1, 2)}</p>" for _ in range(self.among(1, 3)))])()
        return self.wrap("aside", head + body)

    def notice(self) -> str:
        said = self.typical("notice", 4, 20) if self.chance(0.6) else self.prose(1, 3)
        return self.wrap("notice", f"<p>{said}</p>" * (self.chance(0.5)) + said * (not self.chance(0.5)) + (f"<button>{self.typical('notice', 1, 2)}</button>" if self.chance(0.5) else "") + said[:9])

    def ad(self) -> str:
        said = self.typical("ad", 2, 10) if self.chance(0.3) else self.prose(1, 4, self.chance(0.5))
        return self.wrap("ad", self.pick([said, f"<p>{said}</p>", f'<a href="/x">{said}</a>', f"<span>{self.typical('ad', 1, 1)}</span> {said}"]))

    def form(self) -> str:
        fields = "".join(self.pick([f"<label>{self.typical('form', 1, 3)}</label><input name=a>", f"<input type=submit value=x><button>{self.typical('form', 1, 2)}</button>", f"<p>{self.prose(1, 2)}</p>", f"<select><option>{self.words(1)}<option>{self.words(2)}</select>", f"<textarea>{self.words(3)}</textarea>", f"<fieldset><legend>{self.typical('form', 1, 3)}</legend>{self.words(2)}</fieldset>"]) for _ in range(self.among(1, 4)))
        form = self.wrap("form", fields)
        return f'<div class="{self.pick(NAMES["form"])}">{form}</div>' if self.chance(0.3) else form

    def comments(self) -> str:
        one = self.pick(["article", "div", "li"])
        made = [f'<{one} class="{self.pick(["comment", "comment-item", "reply", "response", "post-comment"])}">' + self.pick([f"<b>{self.words(1)}</b> ", f"<cite>{self.typical('comments', 1, 3)}</cite>", f"<div class=\"meta\">{self.typical('comments', 1, 3)}</div>", ""]) + self.pick(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.prose(1, 4)) + (f"<a href=#>{self.typical('comments', 1, 1)}</a>" if self.chance(0.5) else "") + f"</{one}>" for _ in range(self.among(1, 6))]
        inner = (f"<h3>{self.among(1, 90)} {self.typical('comments', 1, 2)}</h3>" if self.chance(0.6) else "") + "".join(made)
        return self.wrap("comments", inner + (self.form() if self.chance(0.3) else ""))

    def share(self) -> str:
        return self.wrap("share", " ".join(self.anchors(self.among(2, 5), "share")) if self.chance(0.6) else f"<span>{self.typical('share', 1, 4)}</span>")

    def main(self, low: int, high: int) -> str:
        """Prose of the article with inline elements, which do not part it."""
        said = self.prose(low, high)
        if self.chance(0.06):  # an article may speak of anything
            said = self.typical(self.pick(list(SAYS)), 1, 8) + self.pick([".", "", " " + said])
        if self.chance(0.2):
            words = said.split(" ")
            k = self.among(0, len(words) - 1)
            tag = self.pick(["b", "em", "i", "strong", "a href='/y'", "span", "code"])
            words[k] = f"<{tag}>{words[k]}</{tag.split(' ')[0]}>"
            said = " ".join(words)
        return self.mark + said

    def paragraph(self) -> str:
        low, high = self.pick([(1, 1), (1, 2), (2, 6), (4, 14)])
        said = self.main(low, high)
        if self.chance(0.08):
            said = f"<b>{said}<br>" + ("" if self.sloppy else self.main(1, 3) + "</b>")
        elif self.chance(0.08):
            said += f"<br>{self.main(1, 2)}"
        return f"<p>{said}" + ("" if self.sloppy and self.chance(0.4) else "</p>")

    def piece(self) -> str:
        kind = self.random.random()
        if kind < 0.68:
            return self.paragraph()
        if kind < 0.78:
            tag = self.pick(["h2", "h3", "h4"])
            return f"<{tag}>{self.mark}{self.words(self.among(1, 7))}</{tag}>"
        if kind < 0.85:
            tag = self.pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.main(1, 2)}" + ("" if self.sloppy else "</li>") for _ in range(self.among(2, 6))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote>{self.pick([self.paragraph(), self.main(1, 4)])}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.mark}{self.words(self.among(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.among(1, 4))) + "</table>"
        if kind < 0.95:
            return f"<figure><img src=a.png><figcaption>{self.main(1, 1)}</figcaption></figure>"
        if kind < 0.97:
            return f"<pre>{self.main(1, 3)}</pre>"
        return f"<div>{self.main(1, 5)}</div>"

    def article(self) -> str:
        title = self.mark + self.words(self.among(1, 9))
        head = self.pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "{}"]).format(title) if self.chance(0.9) else ""
        n = self.pick([self.among(1, 4), self.among(2, 12), self.among(8, 40)])
        made = []
        for _ in range(n):
            made.append(self.piece() if self.rare else self.paragraph())
            if self.chance(0.05):
                made.append(self.pick([self.ad, self.aside, self.form, self.share, self.notice, lambda: '<script>x("<p>")</script>', lambda: "<!-- x -->"])())
        body = head + "".join(made)
        for _ in range(self.pick([0, 0, 1, 2])):
            body = f'<div{self.pick(["", " class=\"" + self.words(1) + "\"", " id=\"" + self.pick(NAMES["article"]) + "\""])}>{body}</div>'
        if self.chance(0.1):
            return f"<table><tr><td>{self.menu()}</td><td>{body}</td></tr></table>"
        return self.wrap("article", body)

    def page(self) -> str:
        before = [part for part, p in ((self.header, 0.5), (self.notice, 0.25), (self.menu, 0.8), (self.ad, 0.45), (self.form, 0.2), (self.aside, 0.15), (self.share, 0.1)) if self.chance(p)]
        after = [part for part, p in ((self.share, 0.15), (self.ad, 0.25), (self.aside, 0.35), (self.comments, 0.35), (self.form, 0.15), (self.menu, 0.15), (self.notice, 0.15)) if self.chance(p)]
        self.random.shuffle(before)
        self.random.shuffle(after)
        middle = "".join(p() for p in before) + (self.article() if self.chance(0.97) else "") + "".join(p() for p in after)
        if self.chance(0.3):
            middle = f'<div class="{self.pick(["container", "wrapper", "page", "layout", "row", "site"])}">{middle}</div>'
        body = middle + (self.footer() if self.chance(0.85) else "")
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if self.chance(0.85) else "")


def draw(random: np.random.Generator, mark: str) -> str:
    """One page; ``mark`` stands in front of each stretch of its main text."""
    return Drawer(random, mark).page()
