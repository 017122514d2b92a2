"""Invented pages with known main text, from rules: what the block labeller learns from.

Words are random syllables, so that structure and the few words that mark menus,
notices, adverts, forms and comments are all there is to learn.  Pages come in
``FAMILIES`` of layouts: elements and classes that say what they hold; tables in
tables; nested divisions with meaningless names; portals whose columns of teasers
outweigh the article; text with hardly any markup.  A labeller can be trained
without one family and tried on it.
"""

from __future__ import annotations

import random

from .html_blocks import Block, blocks

_SYLLABLES = "an be co da el fi go ha il ju ka lo me no or pa qui re sa ti um ve wo xi yo ze th st ch é ñ ö ü ß ción tion".split()
#: Marks the texts of the main part while a page is made.
_MARK = ""

_MAIN = ("<article>", "<article class='post'>", "<main>", "<div class='content'>", "<div id='content'>", "<div class='entry-content'>", "<div class='post-body'>", "<div class='article-body'>", "<section class='story'>", "<div class='text'>", "<div role='main'>", "<main><article>", "<div class='page'><article>", "<div class='main'>")
FAMILIES = ("named", "tables", "nameless", "portal", "bare")
#: Words that mark what is not main text, in four languages.
_CUES = {
    "nav": "home about contact news archive login search menu sitemap startseite politik wirtschaft kultur sport kontakt suche accueil actualités rubriques inicio noticias deportes contacto",
    "footer": "copyright rights reserved terms privacy imprint policy last updated webmaster impressum datenschutz agb alle rechte vorbehalten mentions légales droits réservés aviso legal derechos reservados",
    "ad": "advertisement sponsored buy now offer sale discount anzeige werbung jetzt kaufen angebot publicité achetez promo publicidad oferta comprar",
    "notice": "cookies accept consent privacy this site uses affiliate links commission partner wir verwenden akzeptieren zustimmen provision nous utilisons accepter utilizamos aceptar enlaces",
    "form": "name email submit subscribe send password newsletter anmelden abonnieren senden passwort envoyer inscription nom enviar suscribirse nombre",
    "comments": "reply says comment posted ago user wrote kommentar antworten schrieb uhr commentaire répondre comentario responder dijo",
    "aside": "related popular recent posts tags read more most viewed meistgelesen mehr zum thema auch interessant les plus lus articles liés lire aussi lo más leído relacionados ver",
    "share": "share tweet facebook print mail teilen drucken partager imprimer compartir imprimir",
    "header": "daily times post journal zeitung tagblatt gazette diario",
}
_ANY = " ".join(_CUES.values())
_PARTS = {
    "nav": ("<nav>", "<div class='nav'>", "<div class='menu'>", "<ul class='menu'>", "<div id='navbar'>", "<div class='breadcrumb'>", "<nav class='main-nav'>", "<div role='navigation'>", "<div class='pagination'>"),
    "header": ("<header>", "<div class='header'>", "<div id='header'>", "<div class='masthead'>", "<div class='banner'>", "<header class='site-header'>"),
    "footer": ("<footer>", "<div class='footer'>", "<div id='footer'>", "<footer class='site-footer'>", "<div role='contentinfo'>", "<div class='copyright'>"),
    "aside": ("<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related'>", "<aside class='related-posts'>", "<div class='popular'>"),
    "ad": ("<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div id='ad-top'>", "<div class='sponsored'>", "<div class='promo'>", "<section class='ad-box'>"),
    "notice": ("<div class='cookie'>", "<div id='cookie-notice'>", "<div class='notice'>", "<div class='consent'>", "<div class='alert'>", "<div class='popup'>", "<div class='gdpr'>", "<div class='cookie-banner'>"),
    "form": ("<form>", "<form class='search'>", "<form id='login'>", "<div class='newsletter'><form>", "<form class='subscribe'>", "<div class='subscribe'>"),
    "comments": ("<div class='comments'>", "<section id='comments'>", "<section class='comments'>", "<div id='disqus'>", "<ol class='comment-list'>", "<div class='comment'>", "<div class='replies'>", "<section class='reader-comments'>"),
    "share": ("<div class='share'>", "<div class='social'>", "<ul class='social-links'>"),
}


class Sampler:
    def __init__(self, seed: int, families: tuple[str, ...] = ("named", "named", *FAMILIES)):
        self.random, self.families = random.Random(seed), families

    def word(self) -> str:
        r = self.random
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
        return w + r.choice(("!", ";", "%", "&amp;", "++", "@", "**")) if r.random() < 0.04 else w

    def words(self, low: int, high: int, cues: str = "") -> str:
        r = self.random
        out = [self.word() for _ in range(r.randint(low, high))]
        if cues and r.random() < 0.5:
            for _ in range(r.randint(1, 3)):
                out.insert(r.randrange(len(out) + 1), r.choice(cues.split()))
        if r.random() < 0.05:
            out = [out[0]] * r.randint(1, 30)
        return r.choice((" ", " ", " ", " ", " ", " ", " | ")).join(out).capitalize() + r.choice((".", ".", "", "?"))

    def sentence(self, low: int, high: int) -> str:
        r, text = self.random, self.words(low, high, _ANY if self.random.random() < 0.3 else "")
        if r.random() < 0.15:
            k = text.split(" ")
            i = r.randrange(len(k))
            k[i] = r.choice(("<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span class='x'>{}</span>", "<code>{}</code>")).format(k[i])
            text = " ".join(k)
        return text

    @staticmethod
    def closed(opening: str, inside: str) -> str:
        tags = [t.split()[0].strip("<>") for t in opening.split("<") if t]
        return opening + inside + "".join(f"</{t}>" for t in reversed(tags))

    def extra(self, kind: str) -> str:
        r, cues = self.random, _CUES.get(kind, "")
        opening = r.choice(_PARTS[kind])
        listed = opening.startswith(("<ul", "<ol"))
        if kind in ("nav", "share") or listed and kind != "comments":
            items = [f"<a href='/{k}'>{self.words(1, 3, cues)}</a>" for k in range(r.randint(2, 8))]
            inside = "".join(f"<li>{i}</li>" for i in items) if listed else f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if r.random() < 0.6 else " | ".join(items)
        elif kind == "comments":
            each = [r.choice(("<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<div class='comment'><span class='author'>ann</span><p>{}</p></div>", "<li><p>{}</p></li>" if listed else "<div class='comment-body'>{}</div>")).format(self.words(3, 40, cues)) for _ in range(r.randint(1, 5))]
            inside = r.choice(("", f"<h2>{self.words(1, 3, cues)}</h2>", f"<h3>{self.words(1, 3, cues)}</h3>")) + "".join(each)
        elif kind == "form":
            inside = f"<label>{self.words(1, 3, cues)}</label><input name='q'><button>{self.words(1, 2, cues)}</button>" + (f"<p>{self.words(3, 15, cues)}</p>" if r.random() < 0.5 else "") + (f"<select><option>{self.word()}</option><option>{self.word()}</option></select>" if r.random() < 0.2 else "")
        elif kind == "footer":
            inside = r.choice(("&copy; {} {{}}", "<p>&#169; {} {{}}</p>", "<p>{{}} {}</p>", "<small>{{}}</small>", "{{}}")).format(r.randint(1996, 2025)).format(self.words(2, 14, cues))
        elif kind == "header":
            inside = r.choice(("<h1>{}</h1>", "<div class='logo'>{}</div>", "<p>{}</p>", "{}")).format(self.words(1, 6)) + (self.extra("nav") if r.random() < 0.5 else "")
        else:
            inside = r.choice(("{}", "<p>{}</p>", "<h3>Title</h3><p>{}</p>", "<p>{}</p><p>more</p>", "<ul><li><a href='/'>{}</a></li></ul>")).format(self.words(2, 40, cues))
        return self.closed(opening, inside)

    def main(self) -> str:
        r, out = self.random, []
        if r.random() < 0.85:
            out.append(f"<h1>{_MARK}{self.sentence(1, 10)}</h1>")
        longest = r.choice((2, 4, 12, 60))
        for _ in range(r.randint(1, 12) if r.random() < 0.85 else r.randint(12, 60)):
            pick, text = r.random(), f"{_MARK}{self.sentence(1, longest)}"
            if pick < 0.7:
                out.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p class='lead'>{}</p>")).format(text))
            elif pick < 0.8:
                out.append(f"<h2>{_MARK}{self.sentence(1, 8)}</h2>")
            elif pick < 0.87:
                out.append("<ul>" + "".join(f"<li>{_MARK}{self.sentence(1, 15)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif pick < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif pick < 0.96:
                out.append("<table><tr>" + "".join(f"<td>{_MARK}{self.sentence(1, 4)}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            else:
                out.append(f"<pre>{text}</pre>")
            if r.random() < 0.08:
                out.append(self.extra(r.choice(("ad", "share", "aside", "form", "notice"))))
        return "".join(out)

    def named(self) -> str:
        r = self.random
        head = self.head()
        before = [self.extra(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.4]
        after = [self.extra(k) for k in ("share", "ad", "form", "comments", "aside", "notice") if r.random() < 0.4]
        if r.random() < 0.7:
            after.append(self.extra("footer"))
        r.shuffle(before)
        inside = self.main()
        if r.random() < 0.06:  # a fragment
            opening = r.choice(_MAIN)
            return r.choice((opening + inside, self.closed(opening, inside), self.closed(opening, f"<p>{_MARK}{self.sentence(1, 12)}")))
        body = inside if r.random() < 0.05 else self.closed(r.choice(_MAIN), inside + (self.extra("comments") if r.random() < 0.1 else ""))
        return head + "".join(before) + body + "".join(after) + r.choice(("</body></html>", "</body></html>", ""))

    def head(self) -> str:
        r = self.random
        inside = [f"<title>{self.words(1, 8)}</title>"]
        inside += [x for x in (f"<style>.{self.word()} a {{color: #333}}</style>", f"<script>if (1 < 2) {{ {self.word()}('<b>') }}</script>", "<meta name='viewport' content='width=device-width'>", f"<link rel='stylesheet' href='/{self.word()}.css'>") if r.random() < 0.4]
        r.shuffle(inside)
        return r.choice(("<!DOCTYPE html>\n", "<!doctype html>", "")) + f"<html><head>{''.join(inside)}</head><body>"

    def items(self, kind: str, low: int, high: int, longest: int, linked: float) -> list[str]:
        """Short texts of a menu or a column of teasers, with or without links."""
        r, cues = self.random, _CUES[kind].split()
        with_link = r.random() < linked
        texts = [" ".join([r.choice(cues)] if r.random() < 0.4 else [self.word() for _ in range(r.randint(1, longest))]).capitalize() for _ in range(r.randint(low, high))]
        return [f"<a href='/{k}'>{t}</a>" if with_link else t for k, t in enumerate(texts)]

    def loose(self, kind: str, wrap: tuple[str, ...]) -> str:
        """What is not main text, in elements whose names do not tell."""
        r = self.random
        a, b = r.choice(wrap).split("|")
        if kind in ("nav", "share"):
            items = self.items(kind, 2, 9, 2, 0.6)
            joint = r.choice((" ", " | ", " · ", " - ", f"{b}{a}", "<br>"))
            return a + joint.join(items) + b
        if kind == "aside":
            title = r.choice(_CUES["aside"].split()).capitalize()
            return a + (f"{title}{b}{a}" if r.random() < 0.7 else "") + f"{b}{a}".join(self.items("aside", 2, 8, 9, 0.7)) + b
        if kind == "comments":
            each = [f"{a}{self.word().capitalize()} {r.choice(_CUES['comments'].split())} {r.randint(1, 23)}:{r.randint(10, 59)}{b}{a}{self.words(2, 40)}{b}" for _ in range(r.randint(1, 4))]
            return f"{a}{r.randint(1, 90)} {r.choice(_CUES['comments'].split())}{b}" + "".join(each)
        if kind == "footer":
            year = r.randint(1996, 2025)
            return a + r.choice((f"{self.phrase('footer', 3)} {year}", f"&copy; {year} {self.phrase('footer', 3)}", f"{self.phrase('footer', 2)} | {self.phrase('footer', 2)}")) + b
        if kind == "header":
            return a + self.phrase("header", 2) + b
        if kind == "form":
            return f"<form>{a}{self.phrase('form', 4)} <input> <button>{r.choice(_CUES['form'].split())}</button>{b}</form>"
        return a + self.phrase(kind, r.randint(2, 8)) + b

    def phrase(self, kind: str, n: int) -> str:
        """Some words of its kind among others."""
        r, cues = self.random, _CUES[kind].split()
        out = [*(r.choice(cues) for _ in range(n)), *(self.word() for _ in range(r.randint(0, n)))]
        r.shuffle(out)
        return " ".join(out).capitalize() + r.choice((".", "", "", ":"))

    def paragraphs(self, wrap: tuple[str, ...], low: int = 1, high: int = 10) -> str:
        """The main text in such elements, with a heading in most."""
        r, out = self.random, []
        if r.random() < 0.8:
            a, b = r.choice(("<h1>|</h1>", "<h2>|</h2>", "<b>|</b><br><br>", "<font size=5>|</font><br><br>", *wrap)).split("|")
            out.append(f"{a}{_MARK}{self.sentence(2, 10)}{b}")
        for _ in range(r.randint(low, high)):
            a, b = r.choice(wrap).split("|")
            out.append(f"{a}{_MARK}{self.sentence(6, r.choice((15, 40, 80)))}{b}")
        return "".join(out)

    def loosely(self, kinds: str, wrap: tuple[str, ...], share: float = 0.6) -> str:
        return "".join(self.loose(k, wrap) for k in kinds.split() if self.random.random() < share)

    def tables(self) -> str:
        r = self.random
        cell = ("<p>|</p>", "<div>|</div>", "<font size=2>|</font><br>", "<center>|</center>")
        row = lambda inside: f"<tr><td colspan=2>{inside}</td></tr>" if inside else ""
        side = f"<td width=150 valign=top>{self.loosely('nav aside form ad', cell)}</td>"
        main = f"<td>{self.paragraphs(('<p>|</p>', '<p>|', '<div>|</div>', '<p align=left>|</p>'))}{self.loosely('share comments', cell, 0.3)}</td>"
        middle = "<tr>" + "".join(r.sample([side, main], 2) if r.random() < 0.5 else [side, main]) + (f"<td>{self.loosely('aside ad', cell)}</td>" if r.random() < 0.4 else "") + "</tr>"
        return f"{self.head()}<table border=0>{row(self.loosely('header nav ad', cell))}{middle}{row(self.loosely('nav footer', cell, 0.8))}</table></body></html>"

    def nameless(self) -> str:
        r = self.random
        name = lambda: r.choice("xzqkvw") + r.choice("abcdef") + r.choice("ghjkmn")
        wrap = tuple(f"<div class='{name()}'>|</div>" for _ in range(3)) + ("<div>|</div>", "<p>|</p>")
        main = self.paragraphs((f"<p class='{name()}'>|</p>", "<p>|</p>", f"<div class='{name()}'>|</div>", f"<div><span class='{name()}'>|</span></div>"))
        for _ in range(r.randint(1, 3)):
            main = f"<div class='{name()}'>{main}</div>"
        return f"{self.head()}<div class='{name()}'>{self.loosely('notice header nav ad', wrap)}</div>{main}<div>{self.loosely('share aside comments form ad footer', wrap)}</div></body></html>"

    def portal(self) -> str:
        r = self.random
        wrap = ("<li>|</li>", "<div class='item'>|</div>", "<h3>|</h3>", "<p>|</p>", "<div class='box'>|</div>")
        column = lambda: f"<div class='{r.choice(('col', 'left', 'right', 'column', 'rail', 'block'))}'>{self.loosely('aside nav aside ad notice form', wrap)}</div>"
        main = f"<div class='{r.choice(('center', 'middle', 'detail', 'story', 'document', 'body', 'col'))}'>{self.loosely('nav share notice', wrap, 0.3)}{self.paragraphs(('<p>|</p>', '<div>|</div>'))}{self.loosely('notice share aside comments', wrap, 0.4)}</div>"
        parts = [column(), main, column()] if r.random() < 0.6 else [main, column()]
        return f"{self.head()}<div class='top'>{self.loosely('notice header nav', wrap, 0.8)}</div>{''.join(parts)}<div class='bottom'>{self.loosely('aside nav footer', wrap, 0.8)}</div></body></html>"

    def bare(self) -> str:
        r = self.random
        wrap = ("<p>|</p>", "<p>|", "<center>|</center>", "<hr>|<hr>", "<div>|</div>")
        return r.choice(("", "<html><body>", "<body bgcolor=white>")) + self.loosely("nav header", wrap, 0.5) + self.paragraphs(("<p>|</p>", "<p>|", "<p>|<br>")) + self.loosely("nav footer", wrap, 0.6)

    def page(self) -> str:
        pick = self.random.choice(self.families)
        return getattr(self, pick)()

    def labelled(self) -> tuple[list[Block], list[int]]:
        """A page's blocks and whether each is main text."""
        found = blocks(self.page())
        return [b._replace(text=b.text.replace(_MARK, "")) for b in found], [int(_MARK in b.text) for b in found]

    def blurred(self, page: list[Block]) -> list[Block]:
        """The blocks without some of the names in their paths, the same ones all over the page: so that labels lean on words and places too."""
        r = self.random
        share = 1.0 if r.random() < 0.08 else 0.0
        lost = {n for b in page for n in b.path}
        lost = {n for n in sorted(lost) if r.random() < share}
        return [b._replace(path=tuple(n for n in b.path if n not in lost)) for b in page] if lost else page
