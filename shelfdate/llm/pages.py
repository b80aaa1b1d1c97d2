"""Operator 5: main text of raw HTML by minimum-cut labelling.

A page is read into blocks of text. A logistic classifier on each block's own features (its containers' names, links,
length, punctuation) gives the costs of calling it content or boilerplate, which become capacities to the two terminals;
edges between neighbours in page order and between neighbours within a container make unlike labels cost. The minimum cut
labels the blocks. Blocks whose terminal capacity is more than all their edges are settled first, which doesn't change the
cut, and the rest goes through max-flow. The classifier is trained on pages made by rule, whose main blocks are known.

Cases: null html is empty and gives an empty text, as does a page without content; unclosed and cut-off markup is read as
far as it goes; rows are independent, so repeated rows and null ids give a row each; empty tables give no rows; other
columns are ignored. A br is white space inside its block.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, pick

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+)|<", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = frozenset("script style noscript template title textarea select button svg iframe object canvas audio video xmp noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup head hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 hr dt dd pre".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of containers, by what they say about their text.
BAD = frozenset("nav navigation menu navbar header masthead footer foot aside sidebar side rail ad ads advert advertisement adverts banner promo promoted sponsor sponsored cookie cookies consent notice alert gdpr popup modal overlay form login signin signup subscribe subscription newsletter search comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendation breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer skip hidden tags dialog complementary contentinfo contact".split())
GOOD = frozenset("article main content post entry story text body articlebody maincontent page".split())
_BAD_TAGS = {"nav": 1, "header": 1, "footer": 1, "aside": 1, "form": 1, "menu": 1, "dialog": 1, "fieldset": 1, "search": 1}
N_FEATURES = 14
#: Smoothness: of neighbours in page order, of neighbours within a container, and where the container changes.
ORDER, INSIDE, ACROSS = 0.6, 0.8, 0.1


def _names(attributes: str) -> tuple[bool, bool]:
    bad = good = False
    for m in _NAMED.finditer(attributes):
        words = {w.lower() for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
        bad, good = bad or bool(words & BAD), good or bool(words & GOOD)
    return bad, good


class Block:
    __slots__ = ("bad", "good", "home", "item", "linked", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, home: int, bad: bool, good: bool, item: bool):
        self.text, self.linked, self.tag, self.home, self.bad, self.good, self.item = text, linked, tag, home, bad, good, item


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, without markup, scripts and styles; character references decoded."""
    out: list[Block] = []
    # of each open container: tag, number, whether a bad name is on the way to it, a good one, an item of a list
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    serial, parts, linked, links, tag = 0, [], 0, 0, ""

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                _, home, bad, good, item = stack[-1]
                out.append(Block(text, linked, tag, home, bad, good, item))
            parts = []
        linked = 0

    at, low = 0, None
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            parts.append(m[4])
            if links:
                linked += len(m[4])
            continue
        if m[2] is None:
            if m[0] == "<":
                parts.append("<")
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in _RAW and not ends:
            if m[3].endswith("/") and name in ("svg",):
                continue
            low = page.lower() if low is None else low
            stop = low.find(f"</{name}", at) if len(low) == len(page) else -1
            if stop < 0:
                found = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
                stop = found.start() if found else len(page)
            at = stop
        elif name == "a":
            links = 0 if ends else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            close()
            links = 0
            if ends:
                tag = ""
                if name not in _LEAF:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
            else:
                tag = name
                if name not in _LEAF and name not in _VOID:
                    bad, good = _names(m[3]) if "=" in m[3] else (False, False)
                    above = stack[-1]
                    if name in ("li", "tr", "td", "th", "option") and above[0] == name:
                        stack.pop()
                        above = stack[-1]
                    serial += 1
                    top = name in ("article", "main")
                    if name == "header" and above[3]:
                        bad_tag = False  # an article's own heading
                    else:
                        bad_tag = name in _BAD_TAGS
                    wrap = name in ("html", "body")
                    stack.append((name, serial, above[2] or (bad and not wrap) or bad_tag, (above[3] or good or top) and not wrap, above[4] or name == "li"))
                elif name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre") and "=" in m[3]:
                    bad, good = _names(m[3])
                    if bad:
                        tag = "bad"
    close()
    return out


def _features(found: list[Block]) -> list[list[float]]:
    rows = []
    for b in found:
        n = len(b.text)
        rows.append([
            1.0, b.bad or b.tag == "bad", b.good and not b.bad, min(1.0, b.linked / n), math.log1p(n) / 6, b.text[-1] in ".!?…:;\"'”»)", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag == "p" or b.tag == "pre",
            b.item, "©" in b.text or "All rights" in b.text, n < 25, n > 120, b.tag in ("td", "th", "tr"), b.item and b.linked > 0.5 * n,
        ])
    return rows


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """Pages made by rule, with the texts of their main blocks."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("etaoinshrdlu"), int(r.integers(2, 9))))
    say = lambda k: " ".join(word() for _ in range(k)).capitalize() + r.choice([".", ".", ".", "!", ""])
    pages = []
    for _ in range(n):
        main: set[str] = set()

        def keep(text: str, into: set[str] = main) -> str:
            into.add(text)
            return text

        menu = "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(int(r.integers(3, 8)))) + "</ul>"
        around = [
            f"<nav>{menu}</nav>", f"<div class='menu'>{menu}</div>", f"<div id='sidebar'><h3>{say(2)}</h3>{menu}</div>", f"<aside><p>{say(12)}</p></aside>", f"<div class='ad'>{say(int(r.integers(3, 20)))}</div>", f"<form><label>{say(3)}</label></form>",
            f"<div class='cookie-notice'><p>{say(25)}</p></div>", f"<section class='comments'><h2>{say(1)}</h2><div><p>{say(40)}</p></div><div><p>{say(8)}</p></div></section>", f"<header><h1>{say(2)}</h1><p>{say(6)}</p></header>", f"<div class='related'>{menu}</div>",
        ]
        foot = f"<footer>&copy; {word()} {say(8)}</footer>" if r.random() < 0.8 else f"<div class='footer'><p>{say(14)}</p></div>"
        body = f"<h1>{keep(say(5))}</h1>" + "".join(f"<p>{keep(say(int(r.integers(1, 80))))}</p>" if r.random() < 0.9 else f"<ul><li>{keep(say(9))}</li><li>{keep(say(4))}</li></ul>" for _ in range(int(r.integers(1, 9))))
        if r.random() < 0.3:
            body += around[4]
        shell = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div>", "</div>"), ("<article><div class='post-body'>", "</div></article>")][int(r.integers(5))]
        some = [around[i] for i in r.permutation(len(around))[: int(r.integers(2, 7))]]
        cut = int(r.integers(0, len(some) + 1))
        pages.append((f"<html><head><title>{say(4)}</title></head><body>{''.join(some[:cut])}{shell[0]}{body}{shell[1]}{''.join(some[cut:])}{foot}</body></html>", {" ".join(t.split()) for t in main}))
    return pages


def train(n: int = 300, seed: int = 5, rounds: int = 400) -> np.ndarray:
    """Weights of the block classifier."""
    x, y = [], []
    for page, main in labelled_pages(n, seed):
        found = blocks(page)
        x += _features(found)
        y += [b.text in main and not b.bad for b in found]
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(N_FEATURES)
    for _ in range(rounds // 20):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (p - y) + 0.05 * w)
    return w


def cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Of each node, whether it is on the source's side of the minimum cut. terminal: capacity from the source, or to the sink if under 0."""
    near: list[dict[int, float]] = [{} for _ in terminal]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    t, side = list(terminal), [None] * len(terminal)
    todo = deque(range(len(t)))
    while todo:  # nodes that outweigh their edges
        i = todo.popleft()
        if side[i] is None and abs(t[i]) >= sum(near[i].values()):
            side[i] = t[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    t[j] += c if side[i] else -c
                    del near[j][i]
                    todo.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        source, sink = len(t), len(t) + 1
        flow: dict[int, dict[int, float]] = {i: {j: c for j, c in near[i].items() if side[j] is None} for i in rest}
        flow[source], flow[sink] = {}, {}
        for i in rest:
            flow[source][i], flow[i][source] = max(t[i], 0.0), 0.0
            flow[i][sink], flow[sink][i] = max(-t[i], 0.0), 0.0
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                i = queue.popleft()
                for j, c in flow[i].items():
                    if c > 1e-9 and j not in level:
                        level[j] = level[i] + 1
                        queue.append(j)
            if sink not in level:
                break
            open_ = {i: iter(list(flow[i])) for i in level}
            path = [source]
            while path:
                i = path[-1]
                if i == sink:
                    least = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                    for a, b in zip(path, path[1:], strict=False):
                        flow[a][b] -= least
                        flow[b][a] = flow[b].get(a, 0.0) + least
                    path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if flow[a][b] <= 1e-9) + 1]
                    continue
                for j in open_[i]:
                    if flow[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                        path.append(j)
                        open_.setdefault(j, iter(()))
                        break
                else:
                    path.pop()
        for i in rest:
            side[i] = i in level
    return [bool(s) for s in side]


def label(found: list[Block], scores: np.ndarray) -> list[bool]:
    """Which blocks are content. A score is the classifier's log odds: the difference of the two costs."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            same = found[i - 1].home == b.home and found[i - 1].bad == b.bad
            edges.append((i - 1, i, ORDER if same else ACROSS))
        if b.home in last and last[b.home] < i - 1:
            edges.append((last[b.home], i, INSIDE))
        last[b.home] = i
    return cut([float(s) for s in np.clip(scores, -12, 12)], edges)


def extract(pages: list[str | None], weights: np.ndarray) -> list[str]:
    parsed = [blocks(p or "") for p in pages]
    rows = [f for found in parsed for f in _features(found)]
    scores = np.array(rows, float).reshape(-1, N_FEATURES) @ weights
    out, at = [], 0
    for found in parsed:
        kept = label(found, scores[at : at + len(found)])
        at += len(found)
        out.append("\n".join(b.text for b, k in zip(found, kept, strict=True) if k))
    return out


def extract_pages(df: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    held = df.sparkSession.sparkContext.broadcast(train() if weights is None else weights)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = extract(batch.column(2).to_pylist(), held.value)
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return map_rows(pick(df, page_id="long", url="string", html="string"), make, "page_id long, url string, text string, n_chars long")
