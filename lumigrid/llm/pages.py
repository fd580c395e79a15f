"""Training pages made by rule, their main text marked with the attribute data-k."""

from __future__ import annotations

import random
from collections.abc import Iterator

from .html import TOKENS

PAGES, SEED = 1000, 99
_SYLLABLES = "an be co di en fu ga ho in ja ka lo mi ne or pa qui re sa ti un ve wa xe yo zu st th ch ing ment tion er".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        s = _words(r, 3, 18)
        if r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        out.append(s.capitalize() + r.choice("...!?"))
    return " ".join(out)


def _inline(r: random.Random, text: str) -> str:
    """Sprinkle a text with inline markup and character references."""
    words = text.split(" ")
    for i in range(len(words)):
        x = r.random()
        if x < 0.02:
            tag = r.choice(["b", "i", "em", "strong", "span", "code"])
            words[i] = f"<{tag}>{words[i]}</{tag}>"
        elif x < 0.03:
            words[i] = f'<a href="/{_word(r)}">{words[i]}</a>'
        elif x < 0.04:
            words[i] += r.choice(["&amp;", "&#39;", "&mdash;", "<br>", "&nbsp;"])
    return " ".join(words)


def _attributes(r: random.Random, kind: int | None, plain: float = 0.1) -> str:
    """class, id or role with a word of a kind, or with words that mean nothing."""
    if kind is None or r.random() < plain:
        return r.choice(["", "", f' class="{_word(r)}"', f' id="{_word(r)}-{r.randint(1, 9)}"'])
    word = r.choice(TOKENS[kind])
    return r.choice([' class="{}"', ' id="{}"', ' class="{} x"', ' class="site-{}"', ' class="{}-box"', ' class="c_{}" id="{}"']).replace("{}", word)


def _link_list(r: random.Random) -> str:
    rows = [f'<li><a href="/{_word(r)}">{_words(r, 1, 4)}</a></li>' for _ in range(r.randint(3, 9))]
    if r.random() < 0.25:
        return " | ".join(f'<a href="/{_word(r)}">{_words(r, 1, 2)}</a>' for _ in rows)
    return "<ul>" + "".join(rows) + "</ul>"


def _prose(r: random.Random, low: int = 1, high: int = 3) -> str:
    text = _inline(r, _sentences(r, low, high))
    return r.choice([text, f"<p>{text}</p>"])


def _boilerplate(r: random.Random, kind: str) -> str:
    box = r.choice(["div", "section", "div", "div"])
    if kind == "menu":
        return r.choice([f"<nav{_attributes(r, None)}>{_link_list(r)}</nav>", f"<nav>{_link_list(r)}</nav>", f"<div{_attributes(r, 0, 0)}>{_link_list(r)}</div>", f'<ul{_attributes(r, 0, 0)}><li><a href="#">{_words(r, 1, 2)}</a><li><a href="#">{_words(r, 1, 3)}</a></ul>'])
    if kind == "header":
        inner = f"<{(t := r.choice(['h1', 'h2', 'p', 'div', 'a', 'span']))}>{_words(r, 1, 5)}</{t}>" + r.choice(["", f"<p>{_words(r, 2, 9)}</p>", _link_list(r), _sentences(r, 1, 1)])
        return r.choice([f"<header{_attributes(r, 1)}>{inner}</header>", f"<div{_attributes(r, 1, 0)}>{inner}</div>"])
    if kind == "footer":
        inner = r.choice([f"&copy; {_word(r)} &middot; {_sentences(r, 1, 2)}", f"<p>&copy; 2020 {_words(r, 2, 8)}</p>", _link_list(r), _prose(r), f"<p>{_sentences(r, 1, 3)}</p>" + _link_list(r)])
        return r.choice([f"<footer{_attributes(r, 2)}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{_attributes(r, 2, 0)}>{inner}</div>"])
    if kind == "sidebar":
        inner = f"<h3>{_words(r, 1, 4)}</h3>" * (r.random() < 0.6) + r.choice([_link_list(r), _prose(r, 1, 4), f"<p>{_sentences(r, 1, 5)}</p>" * r.randint(1, 2), "<ul>" + "".join(f"<li>{_words(r, 2, 9)}</li>" for _ in range(4)) + "</ul>"])
        return r.choice([f"<aside{_attributes(r, 3)}>{inner}</aside>", f"<aside>{inner}</aside>", f"<{box}{_attributes(r, 3, 0)}>{inner}</{box}>"])
    if kind in ("notice", "advert", "share"):
        inner = r.choice([_sentences(r, 1, 3), _prose(r, 1, 4), f"<p>{_sentences(r, 1, 2)}</p><button>{_word(r)}</button>", f'<a href="/{_word(r)}">{_words(r, 2, 8)}</a>', f"<h4>{_words(r, 1, 4)}</h4><p>{_sentences(r, 1, 2)}</p>"])
        tag = r.choice([box, "div", "p", "aside"])
        inner = _sentences(r, 1, 3) if tag == "p" else inner
        return f"<{tag}{_attributes(r, {'notice': 4, 'advert': 5, 'share': 8}[kind], 0)}>{inner}</{tag}>"
    if kind == "form":
        inner = f"<label>{_words(r, 1, 3)}</label><input name=q>" + r.choice(["", f"<p>{_sentences(r, 1, 2)}</p>", f"<select><option>{_word(r)}</select>", f"<textarea>{_words(r, 1, 5)}</textarea>"]) + f"<button>{_word(r)}</button>"
        form = f"<form{_attributes(r, 6, 0.5)}>{r.choice([inner, f'<div>{inner}</div>', f'<fieldset><legend>{_words(r, 1, 3)}</legend>{inner}</fieldset>'])}</form>"
        return r.choice([form, f"<div{_attributes(r, 6, 0.2)}>{form}</div>"])
    rows = []  # reader comments
    item = r.choice(["div", "li", "article", "div"])
    for _ in range(r.randint(1, 6)):
        rows.append(f"<{item}{_attributes(r, 7, 0.3)}>{r.choice(['', f'<b>{_word(r)}</b> ', f'<h4>{_words(r, 1, 2)}</h4>', f'<div>{_words(r, 1, 3)}</div>'])}<p>{_inline(r, _sentences(r, 1, 5))}</p></{item}>")
    inner = f"<h3>{_words(r, 1, 3)}</h3>" * (r.random() < 0.5) + (f"<ol>{''.join(rows)}</ol>" if item == "li" else "".join(rows))
    return f"<{box}{_attributes(r, 7, 0)}>{inner}</{box}>"


KINDS = ("menu", "header", "footer", "sidebar", "notice", "advert", "share", "form", "comments")


def _article(r: random.Random, k: str) -> str:
    """Blocks of an article; each carries the mark."""
    out = []
    if r.random() < 0.85:
        out.append(f"<h1{k}>{_inline(r, _words(r, 2, 12))}</h1>")
    if r.random() < 0.3:
        out.append(f"<p{k}>{r.choice(['<b>', '<i>', ''])}{_words(r, 1, 12)}<br>")
    for _ in range(r.randint(1, 12)):
        x = r.random()
        if x < 0.74:
            out.append(f"<p{k}>{_inline(r, _sentences(r, 1, 9))}" + r.choice(["</p>", "</p>", "</p>", "\n"]))
        elif x < 0.82:
            t = r.choice(["h2", "h3"])
            out.append(f"<{t}{k}>{_words(r, 1, 7)}</{t}>")
        elif x < 0.88:
            t = r.choice(["ul", "ol"])
            out.append(f"<{t}>" + "".join(f"<li{k}>{_inline(r, r.choice([_words(r, 1, 8), _sentences(r, 1, 2)]))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + f"</{t}>")
        elif x < 0.92:
            out.append(f"<blockquote{k}>{r.choice([_sentences(r, 1, 3), f'<p{k}>{_sentences(r, 1, 3)}</p>'])}</blockquote>")
        elif x < 0.95:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td{k}>{_words(r, 1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif x < 0.97:
            out.append(f"<pre{k}>{_words(r, 3, 20)}</pre>")
        else:
            out.append(f"<figure><img src=x><figcaption{k}>{_sentences(r, 1, 1)}</figcaption></figure>")
    return "".join(out)


def _strange(r: random.Random) -> str:
    """Boilerplate whose class words, if any, say nothing: only its shape tells."""
    links = _link_list(r)
    name = f' class="{_word(r)}"' if r.random() < 0.7 else ""
    legal = r.choice([f"&copy; {_word(r)} {r.randint(1990, 2030)}", f"&copy; 2020 {_words(r, 1, 5)} | <a href=/x>{_word(r)}</a> | <a href=/y>{_words(r, 1, 2)}</a>"])
    return r.choice([
        f"<div{name}>{links}</div>", f"<div{name}><h3>{_words(r, 1, 3)}</h3>{links}</div>", f"<nav{name}>{links}</nav>", f"<aside{name}><h3>{_words(r, 1, 3)}</h3>{r.choice([links, f'<p>{_sentences(r, 1, 3)}</p>'])}</aside>",
        f"<div{name}><form action=/s><input name=q><button>{_word(r)}</button></form></div>", f"<header{name}><div><a href=/>{_words(r, 1, 3)}</a></div>{links}</header>", f"<footer{name}><p>{legal}</p></footer>",
    ])


def _table_page(r: random.Random, mark: str) -> str:
    """A page laid out as a table: links and advice in some cells, the article in one."""
    cell = lambda inner, more="": f"<td{more}{r.choice(['', ' valign=top', ' width=140'])}>{inner}" + r.choice(["</td>", "</td>", ""])
    links = lambda: r.choice([_link_list(r), "<br>".join(f"<a href=/{_word(r)}>{_words(r, 1, 3)}</a>" for _ in range(r.randint(2, 9))), "".join(f"<a href=/{_word(r)}>{_word(r)}</a> " for _ in range(r.randint(2, 6)))])
    article = _article(r, mark)
    if r.random() < 0.3:  # text straight in the cell
        article = "<br><br>".join(_sentences(r, 2, 6) for _ in range(r.randint(2, 6)))
        article = cell(f"{r.choice(['', f'<h1{mark}>{_words(r, 2, 8)}</h1>'])}{article}", mark)
    else:
        article = cell(article)
    row = [article]
    if r.random() < 0.8:
        row.insert(0, cell(links()))
    if r.random() < 0.3:
        row.append(cell(links()))
    rows = [row]
    if r.random() < 0.6:
        rows.insert(0, [cell(r.choice([links(), f"<b>{_words(r, 1, 3)}</b>", f"<img src=l.gif> {_words(r, 1, 3)}"]), f" colspan={len(row)}")])
    if r.random() < 0.6:
        rows.append([cell(r.choice([f"&copy; {_words(r, 1, 4)} 1999", f"<small>{_words(r, 2, 5)} <a href=/m>{_word(r)}</a></small>", links()]), f" colspan={len(row)}")])
    return "<table>" + "".join("<tr>" + "".join(c) + r.choice(["</tr>", ""]) for c in rows) + "</table>"


def _headed(r: random.Random, content: str) -> str:
    """The article's title in a header of its own, perhaps with a byline."""
    end = content.find("</h1>") + 5
    byline = r.choice(["", f"<p{r.choice(['', ' class=meta', ' class=byline'])}>{_words(r, 1, 3)}, <time>2020-01-0{r.randint(1, 9)}</time></p>", f"<div><a href=/{_word(r)}>{_words(r, 1, 2)}</a></div>"])
    return f"<header{r.choice(['', ' class=entry-header', f' class={_word(r)}'])}>{content[:end]}{byline}</header>{content[end:]}" if end > 4 else content


def page(r: random.Random, mark: str = ' data-k="1"') -> str:
    make = r.random()
    head = f"<head><title>{_words(r, 1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>" + r.choice(["</head>", "</head>", ""])
    end = r.choice(["</body></html>", "</body></html>", ""])
    if make < 0.1:
        body = "".join(_strange(r) for _ in range(r.choice([0, 0, 1]))) + _table_page(r, mark) + "".join(_strange(r) for _ in range(r.choice([0, 0, 1])))
        return f"<html>{head}<body{_attributes(r, None)}>{body}{end}"
    content = _article(r, mark)
    if make < 0.25:  # nothing but shape to go by
        if r.random() < 0.4:
            content = f"<article{_attributes(r, None)}>{_headed(r, content)}</article>"
        elif r.random() < 0.8:
            content = f"<{(t := r.choice(['div', 'main', 'section', 'div']))}{_attributes(r, None)}>{content}</{t}>"
        body = "".join(_strange(r) for _ in range(r.randint(0, 3))) + content + "".join(_strange(r) for _ in range(r.randint(0, 3)))
        if r.random() < 0.3:
            body = f"<div{_attributes(r, None)}>{body}</div>"
        return f"<!DOCTYPE html><html>{head}<body{_attributes(r, None)}>{body}{end}"
    inside = [_boilerplate(r, r.choice(KINDS[3:])) for _ in range(r.choice([0, 0, 0, 1, 2]))]
    if inside:  # some of it in the middle of the article
        cut = content.find("<p", len(content) // 2)
        content = content[:cut] + inside[0] + content[cut:] + "".join(inside[1:]) if cut > 0 else content + "".join(inside)
    if make < 0.4:
        content = f"<article{_attributes(r, 9, 0.6)}>{_headed(r, content)}</article>"
    elif make < 0.62:
        content = f"<article{_attributes(r, 9, 0.6)}>{content}</article>"
    elif make < 0.74:
        content = f"<main>{r.choice([content, f'<article>{content}</article>'])}</main>"
    elif make < 0.92:
        t = r.choice(["div", "section", "div"])
        content = f"<{t}{_attributes(r, 9, 0.35)}>{content}</{t}>"
    if r.random() < 0.3:
        content = f"<div{_attributes(r, None)}>{content}{_boilerplate(r, 'sidebar') * (r.random() < 0.4)}</div>"
    before = [_boilerplate(r, k) for k in ("header", "menu", "notice", "advert", "form", "sidebar", "menu") if r.random() < 0.4]
    after = [_boilerplate(r, k) for k in ("comments", "sidebar", "share", "advert", "form", "notice", "menu") if r.random() < 0.3]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.8:
        after.append(_boilerplate(r, "footer"))
    body = "".join(before) + content + "".join(after)
    return f"<!DOCTYPE html><html>{head}<body{_attributes(r, None)}>{body}{end}"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[str]:
    r = random.Random(seed)
    for _ in range(pages):
        yield page(r)
