"""Labelled pages of varied markup, made by a rule: what ``html_extract`` was fitted on, and is tested on.

Each part is (html, content texts in order); a page is parts in a shell. Names
lie now and then: wrappers carry hints, boilerplate carries none.
"""

from __future__ import annotations

import random

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


def sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    words = [r.choice(WORDS) if r.random() < 0.5 else "".join(r.choices("abcdeghilmnoprstu", k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?"])


def prose(r: random.Random, low: int = 1, high: int = 6) -> str:
    return " ".join(sentence(r) for _ in range(r.randint(low, high)))


def title(r: random.Random) -> str:
    return sentence(r, 2, 7)[:-1]


def named(r: random.Random, names: list[str], often: float = 0.85) -> str:
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if r.random() < often else ""


def links(r: random.Random, n: int) -> str:
    tag = r.choice(["li", "li", "div", "span"])
    items = "".join(f'<{tag}><a href="/{i}">{title(r) if r.random() < 0.4 else r.choice(WORDS)}</a></{tag}>' for i in range(n))
    return f"<ul>{items}</ul>" if tag == "li" else items


def body(r: random.Random) -> tuple[str, list[str]]:
    """The article's inside, with strangers among its blocks."""
    out, texts = [], []
    for i in range(r.randint(1, 9)):
        kind = r.random()
        if i and kind < 0.12:
            t = title(r)
            out.append(f"<h{r.randint(2, 3)}>{t}</h2>")
        elif kind < 0.2 and i:
            items = [title(r) if r.random() < 0.5 else sentence(r) for _ in range(r.randint(2, 4))]
            out.append("<ul>" + "".join(f"<li>{t}{'</li>' if r.random() < 0.7 else ''}" for t in items) + "</ul>")
            texts += items
            continue
        elif kind < 0.27 and i:
            t = prose(r, 1, 2)
            out.append(f"<blockquote>{t}</blockquote>")
        elif kind < 0.34 and i:
            t = title(r)
            out.append(f"<figure><img src=x><figcaption>{t}</figcaption></figure>")
        elif kind < 0.42:
            t = prose(r, 1, 3)
            out.append(f"<div{named(r, ['story-notice', 'lead', 'article-comment-ready', 'intro'], 0.5)}>{t}</div>")
        else:
            t = prose(r) if r.random() < 0.85 else sentence(r, 1, 3)
            words = t.split()
            shown = " ".join(f'<a href="/x">{w}</a>' if r.random() < 0.03 else f"<b>{w}</b>" if r.random() < 0.03 else w for w in words)
            out.append(f"<p>{shown}" + ("</p>" if r.random() < 0.8 else ""))
        texts.append(t)
        if r.random() < 0.12:
            out.append(f"<{r.choice(['div', 'aside', 'section'])}{named(r, ['ad', 'ads', 'promo', 'newsletter-signup', 'related', 'share', 'social-links', 'advert-slot', 'story-related', 'article-ad', 'mod-newsletter'], 0.9)}>{r.choice([sentence(r, 2, 8), links(r, 3)])}</div></aside></section>")
    return "".join(out), texts


def page(seed: int) -> tuple[str, list[str]]:
    """(html, content texts) of one page."""
    r = random.Random(seed)
    head = f"<html><head><title>{title(r)}</title><script>for(var i=0;i<n;i++){{f('</p>')}}</script></head><body{named(r, ['home', 'has-sidebar', 'post-comments-enabled'], 0.3)}>"
    before, after = [], []
    if r.random() < 0.8:
        before.append(f"<{'nav' if r.random() < 0.6 else 'div'}{named(r, ['menu', 'nav-main', 'navbar', 'top-links'], 0.6)}>{links(r, r.randint(3, 8))}</nav></div>")
    if r.random() < 0.5:
        before.append(f"<header><div>{title(r)}</div><p>{sentence(r, 2, 6)}</p></header>")
    if r.random() < 0.4:
        before.append(f"<div{named(r, ['cookie-notice', 'cookies', 'alert', 'gdpr'], 0.9)}>{prose(r, 1, 2)} <button>OK</button></div>")
    if r.random() < 0.4:
        before.append(f"<div{named(r, ['ad', 'banner', 'sponsored'], 0.9)}>{prose(r, 1, 2)}</div>")
    if r.random() < 0.5:
        after.append(f"<{'aside' if r.random() < 0.5 else 'div'}{named(r, ['sidebar', 'rail', 'related-links', 'widget', 'article-sidebar', 'magazine-widget'], 0.9)}><h3>{title(r)}</h3>{links(r, r.randint(2, 6))}<p>{sentence(r)}</p></aside></div>")
    if r.random() < 0.3:
        after.append(f"<form{named(r, ['search', 'login'])}><label>{title(r)}</label><input name=q><p>{sentence(r, 3, 8)}</p></form>")
    if r.random() < 0.8:
        after.append(f"<{'footer' if r.random() < 0.6 else 'div'}{named(r, ['footer', 'site-footer', 'legal'], 0.8)}><p>&copy; {title(r)}</p><p>{sentence(r)}</p>{links(r, 3)}</footer></div>")
    text, found = body(r)
    h = title(r)
    text, found = f"<h1>{h}</h1>{text}", [h, *found]
    comments = ""
    if r.random() < 0.4:
        tag = r.choice(["div", "article", "li"])
        comments = f"<section{named(r, ['comments', 'comment-list', 'replies', 'discussion'], 1)}><h3>{title(r)}</h3>" + "".join(f"<{tag}><b>{r.choice(WORDS)}</b><p>{prose(r, 1, 3)}</p></{tag}>" for _ in range(r.randint(1, 4))) + "</section>"
    shell = r.random()
    wrap = named(r, ["post", "entry-content", "story", "content", "wrapper", "col-8", "article-body", "story-notice", "post-comments-enabled", "has-sidebar"], 0.8)
    if shell < 0.45:
        text = f"<article{wrap}>{text}{comments}</article>"
    elif shell < 0.65:
        text = f"<main><div{wrap}>{text}</div>{comments}</main>"
    elif shell < 0.75:
        text = f"<main><article{wrap}>{text}</article>{comments}</main>"
    else:
        text = f"<div{wrap}>{text}</div>{comments}"
    if shell < 0.75 and r.random() < 0.4:
        # A teaser without any name beside the main part.
        text = f"<{r.choice(['p', 'div'])}>{prose(r, 1, 2)}</p></div>{text}" if r.random() < 0.5 else f"{text}<p>{prose(r, 1, 2)}</p>"
    r.shuffle(before)
    if r.random() < 0.3:
        text = f"<div{named(r, ['layout', 'page-with-sidebar', 'container'], 0.9)}>{text}{''.join(after)}</div>"
        after = []
    return head + "".join(before) + text + "".join(after) + "</body></html>", [" ".join(t.split()) for t in found]


def content(blocks: list, texts: list[str]) -> list[bool]:
    """Which blocks are the page's content: its texts are met in order."""
    at, out = 0, []
    for b in blocks:
        hit = at < len(texts) and b.text == texts[at]
        at += hit
        out.append(hit)
    assert at == len(texts)
    return out
