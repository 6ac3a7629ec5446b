"""Labelled pages to learn from: invented layouts whose blocks are marked with data-main.

A page is an article in one of several containers, with or without telling names, among menus, headers, sidebars, notices,
adverts, forms, comments and footers, some of them inside the article. Words are invented, so nothing but form, names and
the cue words of page furniture can be learned. A page follows from its number alone.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Names that pages give to their parts, and sentences that page furniture says about itself, in four languages.
NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu mainnav nav-links menubar sidenav breadcrumb breadcrumbs pagination pager toc skip-link tabs",
    "header": "header site-header masthead topbar banner branding logo page-header site-title top brand",
    "footer": "footer site-footer colophon bottom page-footer copyright legal foot credits footer-links imprint",
    "side": "sidebar side aside right-col widget widget-area secondary rail related related-posts popular trending recommended more-stories tag-cloud tags archives author-box recent-posts",
    "ad": "ad ads advert advertisement adsbygoogle ad-slot ad-banner sponsored sponsor promo promoted banner-ad adbox dfp outbrain taboola affiliate",
    "notice": "notice cookie-notice cookie-banner cookies consent gdpr alert alert-info popup modal overlay paywall subscribe-wall message announcement disclaimer warning flash notification toast infobar privacy",
    "form": "form search search-form searchbox login login-form signup newsletter newsletter-signup subscribe contact-form poll survey",
    "share": "share social share-buttons social-links sharing addtoany follow tools toolbar actions print",
    "comments": "comments comment-list comment-section respond disqus disqus_thread discussion replies responses user-comments reader-comments kommentare commentaires",
    "comment": "comment reply comment-body response post-comment user-comment commentary",
    "main": "content main article post entry story body text post-content entry-content article-body page-content main-content prose hentry single blog-post news-article articleBody post-text content-area",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SAYS = {
    "notice": [
        "We use cookies to improve your experience. By continuing you accept our use of cookies.", "This site uses cookies.", "Wir verwenden Cookies, um unsere Seite zu verbessern. Mehr in der Datenschutzerklärung.", "Nous utilisons des cookies pour améliorer votre expérience.",
        "Utilizamos cookies para mejorar su experiencia.", "Please enable JavaScript in your browser.", "You have read your last free article. Subscribe to continue.", "Important notice: our terms have changed.", "Accept all", "Diese Seite ist nur für Abonnenten.",
    ],
    "footer": ["© 2024 All rights reserved.", "Copyright 2021", "© Alle Rechte vorbehalten.", "Impressum", "Datenschutz", "Mentions légales", "Tous droits réservés.", "Todos los derechos reservados.", "Powered by", "Privacy policy", "Terms of use", "Contact us", "Kontakt"],
    "form": ["Subscribe to our newsletter", "Search", "Sign up", "Log in", "Your e-mail", "Name", "Newsletter abonnieren", "Suche", "Rechercher", "Buscar", "Abonnez-vous", "Leave a comment", "Send", "Enter your address to get our newsletter every week."],
    "comments": ["Comments", "3 comments", "Kommentare", "Commentaires", "Comentarios", "Leave a reply", "Discussion", "Responses", "What do you think?", "Reader comments"],
    "share": ["Share", "Tweet", "Share this", "Teilen", "Partager", "Compartir", "Follow us", "Print", "E-mail", "Like"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Ad", "Buy now!", "Werbung"],
    "side": ["Related", "Popular", "Recent posts", "About the author", "Tags", "Archives", "Verwandte Artikel", "Articles similaires", "Más leídos", "Read more", "Trending"],
    "nav": ["Home", "Start", "Startseite", "Accueil", "Inicio", "Menu", "About", "Contact", "Previous", "Next", "Skip to content"],
}
_SOUNDS = "the en er in tion an re on at ha es or ti is ed th ver ung sch ge ción que de la ou eau ment les st ing ra do mi lo be ß é ö ñ".split()
_FRAMES = ["", "", "", "site-", "js-", "c-", "page-", "block-", "widget_", "l-"], ["", "", "", "-wrapper", "-container", "-box", "-inner", "-1", "__list", "Area", "-section"]


class Layout:
    def __init__(self, number: int):
        self.rng = random.Random(number * 7919 + 13)
        self.named = self.rng.choice([1.0, 1.0, 0.8, 0.4, 0.0])  # how often parts have telling names
        self.semantic = self.rng.choice([1.0, 0.9, 0.5, 0.0])  # how often they are elements made for it
        self.listy = self.rng.random() < 0.1

    def word(self) -> str:
        return "".join(self.rng.choice(_SOUNDS) for _ in range(self.rng.choice([1, 1, 2, 2, 3, 4])))

    def sentence(self, least: int = 1, most: int = 22) -> str:
        r = self.rng
        words = [self.word() for _ in range(r.randint(least, most))]
        gap = " | " if self.listy else " "
        return gap.join(w + ("," if r.random() < 0.06 else "") for w in words).capitalize() + r.choice([".", ".", ".", ".", "?", "!", ""])

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def title(self) -> str:
        return self.sentence(2, 9).rstrip(".!?")

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.word()}">{text or " ".join(self.word() for _ in range(self.rng.randint(1, 3)))}</a>'

    def names(self, part: str) -> str:
        r = self.rng
        if r.random() >= self.named:
            return r.choice(["", "", f' class="{self.word()}"', ' class="row"', ' class="col-md-8"', ' class="inner"'])
        name = r.choice(_FRAMES[0]) + r.choice(NAMES[part]) + r.choice(_FRAMES[1])
        return f' {r.choice(["class", "class", "class", "id"])}="{name}{r.choice(["", "", " " + self.word(), " clearfix", " row"])}"'

    def part(self, part: str, inner: str, elements: str = "") -> str:
        """inner in an element made for it, or in one of a general kind."""
        r = self.rng
        tag = r.choice(elements.split()) if elements and r.random() < self.semantic else r.choice(["div", "div", "div", "section"])
        role = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "dialog"}.get(part)
        extra = f' role="{role}"' if role and r.random() < 0.1 else ' style="display:none"' if part == "notice" and r.random() < 0.1 else ""
        return f'<{tag}{self.names(part)}{extra} data-main="0">{inner}</{tag}>'

    def say(self, part: str) -> str:
        return self.rng.choice(SAYS[part]) if self.rng.random() < 0.6 else self.sentence(1, 12)

    # parts that are no article

    def nav(self) -> str:
        r = self.rng
        links = [self.link(r.choice([None, None, r.choice(SAYS["nav"])])) for _ in range(r.randint(2, 12))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.75 else r.choice([" | ", " ", " &middot; ", " &raquo; "]).join(links)
        return self.part("nav", inner, "nav nav nav menu")

    def header(self) -> str:
        r = self.rng
        inner = r.choice([f"<h1>{self.title()}</h1>", f"<p>{self.title()}</p>", self.link(), f"<span>{self.word()}</span>", f"<div>{self.title()}</div>"]) + r.choice(["", f"<p>{self.sentence()}</p>", self.nav()])
        return self.part("header", inner, "header")

    def footer(self) -> str:
        r = self.rng
        bits = [r.choice([f"<p>&copy; {self.word()}.{self.word()} &middot; {self.sentence()}</p>", f"&copy; {self.word()} {self.sentence(2, 9)}", f"<p>{self.say('footer')}</p>", self.link(r.choice(SAYS["footer"])), f"<p>{self.prose(1, 3)}</p>", "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(4)) + "</ul>"]) for _ in range(r.randint(1, 3))]
        return self.part("footer", "".join(bits), "footer footer address")

    def side(self) -> str:
        r = self.rng
        bits = []
        for _ in range(r.randint(1, 3)):
            inner = r.choice(["<ul>" + "".join(f"<li>{self.link(self.title())}{r.choice(['', ' ' + self.sentence()])}</li>" for _ in range(r.randint(2, 7))) + "</ul>", f"<p>{self.prose(1, 3)}</p>", f"<p>{self.sentence()} {self.link()}</p>", self.link()])
            bits.append(r.choice(["", f"<h3>{self.say('side')}</h3>", f"<h2>{self.title()}</h2>"]) + inner)
        return self.part("side", "".join(bits), "aside")

    def ad(self) -> str:
        r = self.rng
        inner = r.choice([self.sentence(), self.say("ad"), f"<p>{self.say('ad')}</p><p>{self.prose(1, 2)}</p>", self.link(self.sentence()), f"<span>{self.say('ad')}</span>", self.prose(1, 3)])
        keep, self.named = self.named, max(self.named, 0.9)
        out = self.part("ad", inner, "ins aside div")
        self.named = keep
        return out

    def notice(self) -> str:
        r = self.rng
        inner = r.choice([f"<p>{self.say('notice')}</p>", self.say("notice"), f"<p>{self.say('notice')}</p><button>OK</button>", f"<strong>{self.title()}</strong> {self.prose(1, 2)}", f"<p>{self.prose(1, 3)}</p>{self.link()}"])
        keep, self.named = self.named, max(self.named, 0.9)
        out = self.part("notice", inner, "dialog aside div")
        self.named = keep
        return out

    def form(self) -> str:
        r = self.rng
        bits = [r.choice([f"<label>{self.say('form')} <input></label>", f"<p>{self.say('form')}</p>", f'<input type="submit" value="{self.word()}">', "<textarea></textarea>", f"<button>{self.say('form')}</button>", f"<legend>{self.title()}</legend>", f"<p>{self.prose(1, 2)}</p>", self.say("form")]) for _ in range(r.randint(2, 5))]
        inner = f'<form action="/x"{self.names("form")} data-main="0">{"".join(bits)}</form>'
        return r.choice([inner, self.part("form", r.choice([f"<h3>{self.say('form')}</h3>", f"<p>{self.sentence()}</p>"]) + inner)])

    def share(self) -> str:
        r = self.rng
        return self.part("share", r.choice(["", self.say("share")]) + r.choice(["<ul>" + "".join(f"<li>{self.link(r.choice(SAYS['share']))}</li>" for _ in range(3)) + "</ul>", " ".join(self.link(r.choice(SAYS["share"])) for _ in range(3)), f"<span>{r.choice(SAYS['share'])}</span>"]))

    def comments(self) -> str:
        r = self.rng

        def one(deep: int) -> str:
            who = r.choice([f"<b>{self.word()}</b>", f"<h4>{self.word()} {self.word()}</h4>", f'<span class="author">{self.word()}</span> <time>{r.randint(1, 28)}.{r.randint(1, 12)}.</time>', f"<p>{self.link()}:</p>", ""])
            said = r.choice([f"<p>{self.prose(1, 5)}</p>", self.prose(1, 3), f"<p>{self.prose(1, 3)}</p><p>{self.prose(1, 4)}</p>", f"<blockquote><p>{self.prose(1, 2)}</p></blockquote><p>{self.prose()}</p>"])
            below = one(deep + 1) if deep < 2 and r.random() < 0.25 else ""
            if r.random() < 0.4:
                return f'<{(t := r.choice(["article", "li", "div", "p"]))} data-main="0">{who if t != "p" else ""}{said if t != "p" else self.prose(1, 4)}</{t}>'
            return self.part("comment", who + said + r.choice(["", self.link("Reply")]) + below, "article li")

        head = r.choice([f"<h2>{self.say('comments')}</h2>", f"<h3>{r.choice(SAYS['comments'])}</h3>", f"<p>{r.choice(SAYS['comments'])}</p>", ""])
        keep, self.named = self.named, max(self.named, 0.9)
        inner = head + "".join(one(0) for _ in range(r.randint(1, 6)))
        if r.random() < 0.3:
            inner += self.form()
        out = self.part("comments", r.choice([inner, f"<ol>{inner}</ol>", f"<div>{inner}</div>"]), "section")
        self.named = keep
        return out

    # the article

    def inline(self, text: str) -> str:
        """Some words in inline elements."""
        r = self.rng
        words = text.split(" ")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            i = r.randrange(len(words))
            words[i] = r.choice([f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", self.link(words[i]), f"<strong>{words[i]}</strong>", f'<span class="{self.word()}">{words[i]}</span>', f"<code>{words[i]}</code>", f"<i>{words[i]}</i>", f"<sup>{r.randint(1, 9)}</sup>", f'<span class="highlight">{words[i]}</span>'])
        return " ".join(words)

    def listed(self, links: float) -> str:
        """An item of a list in the article; some such lists are full of links."""
        r = self.rng
        text = self.inline(self.sentence(1, r.choice([3, 8, 25])))
        return r.choice([f"{text} {self.link()}", f"{self.link()} {text}", self.link(self.title())]) if r.random() < links else text

    def content(self) -> str:
        """One block of the article, or a few."""
        r = self.rng
        kind = r.random()
        text = self.inline(self.prose() if r.random() < 0.75 else self.sentence(1, 4))
        if kind < 0.68:
            end = "</p>" if r.random() < 0.9 else ""
            if r.random() < 0.12:
                return f'<p data-main="1"><b>{text}<br>{end}'
            return f'<p{r.choice(["", "", "", self.names("main")])} data-main="1">{text}{end}'
        if kind < 0.76:
            return f'<{(h := r.choice(["h2", "h2", "h3", "h4"]))} data-main="1">{self.title()}</{h}>'
        if kind < 0.83:
            tag, links = r.choice(["ul", "ol"]), r.choice([0, 0, 0.3, 0.8])
            return f'<{tag} data-main="1">' + "".join(f"<li>{self.listed(links)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.88:
            return f'<blockquote data-main="1">{r.choice([f"<p>{text}</p>", text])}</blockquote>'
        if kind < 0.91:
            return f'<pre data-main="1">{self.prose()}</pre>'
        if kind < 0.94:
            return f'<figure data-main="1"><img src="x.png" alt=""><figcaption>{self.sentence()}</figcaption></figure>'
        if kind < 0.97:
            return '<table data-main="1">' + "".join("<tr>" + "".join(f"<td>{self.sentence(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f'<div data-main="1">{text}<br><br>{self.prose()}</div>'

    def article(self) -> str:
        r = self.rng
        amount = r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 20])
        inside: list[Callable[[], str]] = [self.ad, self.share, self.side, self.form, self.notice]
        bits = []
        for _ in range(amount):
            bits.append(self.content())
            if r.random() < 0.05:
                bits.append(r.choice(inside)())
        head = f'<h1{r.choice(["", "", self.names("main")])} data-main="1">{self.title()}</h1>'
        head = r.choice([head, head, head, f'<h2 data-main="1">{self.title()}</h2>', f"<header>{head}</header>", "" if amount else head])
        text = head + "".join(bits)
        if r.random() < 0.15:
            text += r.choice([self.share, self.side, self.comments, self.form])()
        if r.random() < 0.3:
            text = f"<div{self.names('main')}>{text}</div>"
        shape = r.random()
        if shape < self.semantic * 0.85:
            text = f"<article{r.choice(['', self.names('main')])}>{text}</article>"
            if r.random() < 0.4:
                text = f"<main{r.choice(['', self.names('main')])}>{text}</main>"
        elif shape < 0.9:
            text = f"<{(t := r.choice(['div', 'div', 'section', 'main']))}{self.names('main')}>{text}</{t}>"
        return text

    def page(self) -> str:
        r = self.rng
        before = [x() for x in (self.notice, self.header, self.nav, self.ad, self.form, self.side, self.share) if r.random() < 0.35]
        after = [x() for x in (self.comments, self.side, self.share, self.ad, self.nav, self.form, self.notice) if r.random() < 0.28]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.footer())
        if r.random() < 0.2:
            after.append(self.notice())
        top, bottom = "".join(before), "".join(after)
        if r.random() < 0.08:
            body = f"<table><tr><td>{top}</td><td>{self.article()}</td></tr><tr><td>{bottom}</td></tr></table>"
        elif r.random() < 0.35:
            body = f'{top}<div class="{r.choice(["container", "wrapper", "page", "layout", self.word()])}">{self.article()}{bottom}</div>'
        else:
            body = top + self.article() + bottom
        head = f"<head><meta charset=utf-8><title>{self.title()}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def layout(number: int) -> str:
    return Layout(number).page()
