"""Made-up web pages with known main blocks, to train and test the block labeller on. All words are random."""

from __future__ import annotations

import html

import numpy as np

#: Names that sites give to their parts.
PARTS = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "tabs"),
    "header": ("header", "site-header", "masthead", "banner", "top-bar", "branding", "page-header"),
    "footer": ("footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "share", "social", "tags", "author-box", "newsletter-box"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsbox"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "subscribe"),
    "comments": ("comments", "comment-list", "comment", "disqus", "replies", "reader-comments", "discussion", "responses"),
    "form": ("form", "search", "login", "signup", "contact-form", "searchform"),
    "main": ("article", "content", "post", "entry", "main", "story", "article-body", "post-content", "entry-content", "body-text", "page", "text"),
    "wrap": ("wrapper", "container", "page", "site", "row", "col", "inner", "layout", "section", "block"),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu ch sch ung ción mente é ñ ä ü ou eau".split()
MARKS = ("", "", "", "", "", "***", "&&&", "%%%", "$$$", "!!", " |", "###")


def words(g: np.random.Generator, n: int) -> list[str]:
    return ["".join(g.choice(SYLLABLES, g.integers(1, 5))) for _ in range(n)]


def sentence(g: np.random.Generator, n: int, style: str = "") -> str:
    w = [x + style for x in words(g, n)]
    text = " ".join(w)
    return (text[:1].upper() + text[1:] if style != "!!" else text.upper()) + ("." if g.random() < 0.85 else "")


def paragraph(g: np.random.Generator, style: str) -> str:
    return " ".join(sentence(g, int(g.integers(1, 16)), style) for _ in range(int(g.choice([1, 1, 2, 4, 8]))))


def attr(g: np.random.Generator, part: str) -> str:
    r = g.random()
    if r < 0.15:
        return ""
    name = str(g.choice(PARTS[part]))
    return f' id="{name}"' if r < 0.3 else f' class="{name}"' if r < 0.8 else f' class="{g.choice(PARTS["wrap"])} {name}"'


def short(g: np.random.Generator) -> str:
    return html.escape(sentence(g, int(g.integers(1, 14))))


def links(g: np.random.Generator) -> str:
    many = int(g.integers(2, 9))
    if g.random() < 0.7:
        return "<ul>" + "".join(f'<li><a href="/{k}">{html.escape(" ".join(words(g, int(g.integers(1, 4)))))}</a></li>' for k in range(many)) + "</ul>"
    return " | ".join(f'<a href="/{k}">{html.escape(" ".join(words(g, int(g.integers(1, 3)))))}</a>' for k in range(many))


def texts(g: np.random.Generator, low: int, high: int) -> str:
    return "".join(f"<p>{short(g)}</p>" for _ in range(int(g.integers(low, high))))


def extra(g: np.random.Generator, part: str) -> str:
    """A part that isn't main text."""
    tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(part, "div")
    a = attr(g, part)
    if part in ("ad", "notice") or (g.random() < 0.4 and a):
        tag = str(g.choice(["div", "div", "section", "p"] if part in ("ad", "notice") else ["div", "section"]))
    if tag in ("div", "section", "p") and not a:
        a = f' class="{g.choice(PARTS[part])}"'
    inner = {
        "nav": lambda: links(g),
        "header": lambda: (f"<h1>{short(g)}</h1>" if g.random() < 0.3 else f"<p>{short(g)}</p>" if g.random() < 0.5 else short(g)) + (links(g) if g.random() < 0.5 else ""),
        "footer": lambda: ("&copy; " + " &middot; ".join(short(g) for _ in range(int(g.integers(1, 3)))) if g.random() < 0.7 else texts(g, 1, 3)) + (links(g) if g.random() < 0.4 else ""),
        "side": lambda: f"<h3>{short(g)}</h3>" * (g.random() < 0.6) + (links(g) if g.random() < 0.6 else texts(g, 1, 4)),
        "ad": lambda: short(g) if g.random() < 0.6 else f'<a href="/x">{short(g)}</a>' if g.random() < 0.5 else " ".join(short(g) for _ in range(3)),
        "notice": lambda: (short(g) if g.random() < 0.5 else texts(g, 1, 3)) + ("<button>OK</button>" if g.random() < 0.6 else ""),
        "comments": lambda: f"<h3>{short(g)}</h3>" * (g.random() < 0.6) + "".join(f'<div{attr(g, "comments")}><b>{" ".join(words(g, 1))}</b><p>{html.escape(paragraph(g, ""))}</p></div>' if g.random() < 0.7 else f"<li>{html.escape(paragraph(g, ''))}</li>" for _ in range(int(g.integers(1, 6)))),
        "form": lambda: f"<label>{short(g)}</label><input type=text><button>{' '.join(words(g, 1))}</button>",
    }[part]()
    if tag == "p":
        inner = inner.replace("<p>", " ").replace("</p>", " ")
    return f"<{tag}{a}>{inner}</{tag}>"


def page(g: np.random.Generator) -> tuple[str, set[str]]:
    """(html, texts of the main blocks)."""
    style = str(g.choice(MARKS))
    main: list[str] = []
    inside: list[str] = []
    title = sentence(g, int(g.integers(2, 12)), style)[:60]
    if g.random() < 0.85:
        tag = str(g.choice(["h1", "h1", "h1", "h2"]))
        inside.append(f"<{tag}>{html.escape(title, quote=False)}</{tag}>")
        main.append(title)
    for k in range(int(g.choice([1, 2, 3, 5, 8, 14]))):
        text = paragraph(g, style)
        shape = g.random()
        escaped = html.escape(text, quote=bool(g.random() < 0.5))
        if shape < 0.25:
            inside.append(f"<p><b>{escaped}<br>")
        elif shape < 0.3:
            half = len(text) // 2
            inside.append(f"<p>{html.escape(text[:half])}<a href='/k'>{html.escape(text[half:])}</a></p>")
        elif shape < 0.36 and k:
            inside.append(f"<h{2 + k % 2}>{escaped}</h{2 + k % 2}>")
        elif shape < 0.42:
            items = [sentence(g, int(g.integers(2, 9)), style) for _ in range(3)]
            inside.append("<ul>" + "".join(f"<li>{html.escape(i)}</li>" for i in items) + "</ul>")
            main += items
            continue
        elif shape < 0.46:
            inside.append(f"<blockquote>{escaped}</blockquote>")
        elif shape < 0.5:
            inside.append(f"<div>{escaped}</div>")
        else:
            inside.append(f"<p>{escaped}</p>")
        main.append(text)
        if g.random() < 0.06:
            inside.append(extra(g, str(g.choice(["ad", "side", "notice", "form"]))))
    if g.random() < 0.75:
        tag, a = ("article", attr(g, "main")) if g.random() < 0.75 else ("main", attr(g, "main"))
    else:
        tag, a = "div", f' class="{g.choice(PARTS["main"])}"'
    body = [f"<{tag}{a}>" + ("" if g.random() < 0.7 else "\n").join(inside) + f"</{tag}>"]
    before = [p for p in ("header", "nav", "notice", "ad", "form", "side") if g.random() < (0.8 if p == "nav" else 0.35)]
    after = [p for p in ("comments", "side", "ad", "nav", "form", "notice", "footer") if g.random() < (0.8 if p == "footer" else 0.3)]
    parts = [extra(g, p) for p in before] + body + [extra(g, p) for p in after]
    if g.random() < 0.3:
        k = int(g.integers(0, len(parts)))
        parts[k] = f'<div class="{g.choice(PARTS["wrap"])}">{parts[k]}</div>'
    if g.random() < 0.2:
        parts.insert(0, "<!-- note -->")
    text = "".join(parts) if g.random() < 0.7 else "\n".join(parts)
    head = f"<head><title>{html.escape(title)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
    out = f"<!DOCTYPE html><html>{head}<body>{text}" + ("</body></html>" if g.random() < 0.85 else "")
    return out, {" ".join(t.split()) for t in main}
