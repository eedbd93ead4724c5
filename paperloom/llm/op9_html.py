"""Main text of web pages as the maximum-scoring contiguous region of words and tags.

A page becomes a stream: each word outside discarded containers scores by its surroundings (article or not, link,
heading, list, length and link share of its block), each tag and each discarded container scores negative by its kind.
The weights are learned by logistic regression on labelled pages, made here from templates with a fixed seed. One linear
scan finds the contiguous region of greatest sum; its blocks, without discarded containers, are the text.

Discarded in any case is what HTML itself says is no text of the article: scripts, styles and other raw elements,
navigation, asides, forms, footers, page headers (a header inside an article is text), hidden elements and roles that
say the same. Elements whose class or id names such a thing (an advert, a share bar, readers' comments) are judged by a
second learned model, which weighs the words of the name (their log odds in the labelled pages) against other words in
it, the tag, the place, the length, the links and the sentences inside: "share-bar" goes, "legal-history" stays. Labels,
buttons and options in running text are text; a block of nothing else is a form.

Reading is linear in the page, however broken or deep: a tag without an end stops before the next one, and nothing is
read twice. A null or empty page gives an empty text; so does one whose words all score negative. A null page_id or url
stays null; repeated rows give a row each; only page_id, url and html are read, so other columns cannot clash. Whole
pages are read, however long.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, ship, table

#: The rest of a tag: quotes count only as values; none of it is read twice.
_TAIL = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_NAME = re.compile(r"[a-z][^\s/>]*+", re.I)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
RAW = frozenset("script style noscript template textarea title iframe svg noembed xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DISCARD = frozenset("nav footer aside form menu head object audio video canvas dialog datalist".split())
CONTROLS = frozenset("button select option label optgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_KEEP = frozenset("html body main article".split())
_OWN = frozenset("article post entry story main content body text".split())
#: Words of names that say where or how, not what.
_PLACE = frozenset("wrapper wrap container box block inner outer area list item items row col column left right top bottom site page global section group content main post entry article body module unit slot zone panel bar id js the".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIERS = frozenset("ul ol dl table tbody thead tfoot div nav section".split()) | frozenset(x for v in _CLOSES.values() for x in v)
#: Features of a word: constant, inside article or main, outside though the page has one, container named as text, link words inside article or main, heading, list item, paragraph, log2 of the block's words, its share of link words.
FEATURES = 10
TAGS = ("p", "h", "div", "li", "a", "td", "discarded", "inside", "other")


def _names(value: str) -> list[str]:
    return [x for x in re.split(r"[^a-z]+", re.sub(r"\b(?:no|has|with|without)[-_][a-z]+", "", value)) if x]


class Page:
    """Blocks, events and named containers of a page, in one linear pass.

    A block: (parts, features of its place), a part: (text, in a link, in a control, container). An event: (index of a block
    or -1, tag kind, container). A container, which a name or the HTML itself discards: [the one around it or -1, words of
    the name (None: discarded in any case), features, words, link words, blocks, blocks that are sentences].
    """

    def __init__(self, page: str):
        self.blocks: list[tuple] = []
        self.events: list[tuple[int, str, int]] = []
        self.containers: list[list] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, own, container around it, core
        self.count: Counter[str] = Counter()
        self.marks: list[int] = []  # places in the stack of tags that end others
        self.parts: list[tuple[str, bool, bool, int]] = []
        self.own = self.link = self.control = self.core = self.off = 0
        self.inside = -1
        self.low = page.translate(_ASCII_LOWER)
        self.has_article = "<article" in self.low or "<main" in self.low or 'role="main"' in self.low
        self._read(page)
        self._flush()
        for c in reversed(self.containers):
            if c[0] >= 0:
                up = self.containers[c[0]]
                for k in range(3, 7):
                    up[k] += c[k]

    def discarded(self, judge: "Judge | None") -> list[bool]:
        """Which containers go, by themselves or with one around them."""
        out: list[bool] = []
        bad = judge.bad(self.containers) if judge else [c[1] is None for c in self.containers]
        for c, own in zip(self.containers, bad):
            out.append(own or (c[0] >= 0 and out[c[0]]))
        return out

    def left(self, gone: list[bool]) -> tuple[list[tuple], list[tuple[int, str]]]:
        """(text, words, features) blocks and (index of a block or -1, tag kind) events without discarded containers."""
        blocks: list[tuple] = []
        events: list[tuple[int, str]] = []
        for k, kind, c in self.events:
            if c >= 0 and gone[c]:
                if kind == "discarded" and not (self.containers[c][0] >= 0 and gone[self.containers[c][0]]):
                    events.append((-1, kind))
                continue
            if k < 0:
                events.append((-1, kind))
                continue
            parts, place = self.blocks[k]
            parts = [p for p in parts if p[3] < 0 or not gone[p[3]]]
            text = " ".join("".join(p[0] for p in parts).split())
            if not text or all(p[2] or not p[0].strip() for p in parts):
                continue
            n = text.count(" ") + 1
            linked = min(n, sum(len(p[0].split()) for p in parts if p[1]))
            core = place[0]
            events.append((len(blocks), ""))
            blocks.append((text, n, [1.0, core, self.has_article and not core, place[1], linked / n if core else 0.0, *place[2:], min(np.log2(n + 1), 8) / 4, linked / n]))
        return blocks, events

    def _read(self, page: str) -> None:
        i, n, low = 0, len(page), self.low
        closed = True  # whether tags end with a ">" so far
        while i < n:
            j = page.find("<", i)
            if j < 0:
                j = n
            if j > i:
                self._text(page[i:j])
            if j == n:
                return
            i = j
            after = low[i + 1 : i + 2]
            if low.startswith("<!--", i):
                end = page.find("-->", i + 4)
                i = end + 3 if end >= 0 else n
            elif low.startswith("<![cdata[", i):
                end = page.find("]]>", i)
                i = end + 3 if end >= 0 else n
            elif after in ("!", "?"):
                end = page.find(">", i)
                i = end + 1 if end >= 0 else n
            elif "a" <= after <= "z" or (after == "/" and "a" <= low[i + 2 : i + 3] <= "z"):
                closing = after == "/"
                name = _NAME.match(low, i + 1 + closing)
                tail = _TAIL.match(page, name.end()) if closed else None
                if tail:
                    end, stop = tail.end(), tail.end() - 1
                else:
                    closed = False
                    end = next((x for x in (page.find("<", i + 1), page.find(">", i) + 1 or -1) if x >= 0), n)
                    more = page.find(">", i, end)
                    end, stop = (more + 1, more) if more >= 0 else (end, end)
                tag, i = name[0], end
                if closing:
                    self._close(tag)
                    continue
                attrs = page[name.end() : stop]
                if tag in RAW:
                    at = low.find(f"</{tag}", i)
                    if at < 0:
                        i = n
                    else:
                        end = page.find(">", at)
                        i = end + 1 if end >= 0 else n
                    continue
                self._open(tag, attrs)
            else:
                self._text("<")
                i += 1

    def _text(self, text: str) -> None:
        if not self.off:
            text = _html.unescape(text)
            self.parts.append((text, self.link > 0, self.control > 0, self.inside))
            if self.inside >= 0:
                n = len(text.split())
                self.containers[self.inside][3] += n
                self.containers[self.inside][4] += n * (self.link > 0)

    def _flush(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        first = next((p for p in parts if p[0].strip()), None)
        if first is None:
            return
        near = [t for t, *_ in self.stack[-6:]]
        self.events.append((len(self.blocks), "", -1))
        self.blocks.append((parts, [self.core > 0, self.own > 0 and not self.core, any(t[0] == "h" and len(t) == 2 for t in near), "li" in near or "td" in near, "p" in near]))
        if first[3] >= 0:
            c = self.containers[first[3]]
            c[5] += 1
            c[6] += "".join(p[0] for p in parts).rstrip().endswith((".", "!", "?", ":", "…", "。", "\"", "”"))

    def _pop_to(self, i: int) -> None:
        for t, o, _, core in self.stack[i:]:
            self.own -= o
            self.link -= t == "a"
            self.control -= t in CONTROLS
            self.core -= core
            self.count[t] -= 1
        while self.inside != self.stack[i][2]:
            c = self.containers[self.inside]
            self.off -= c[1] is None
            self.inside = c[0]
        del self.stack[i:]
        while self.marks and self.marks[-1] >= i:
            self.marks.pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self.count[tag] > 0:
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self._pop_to(i)

    def _open(self, tag: str, attrs: str) -> None:
        block, heading = tag in BLOCKS, tag[0] == "h" and len(tag) == 2 and tag[1].isdigit()
        if block:
            self._flush()
        if tag == "br" and not self.off:
            self.parts.append((" ", False, True, self.inside))
        if block and self.stack and tag not in _CLOSES and self.stack[-1][0] == "p":
            self._pop_to(len(self.stack) - 1)
        elif tag in _CLOSES:
            while self.marks and self.stack[self.marks[-1]][0] in _CLOSES[tag]:
                self._pop_to(self.marks[-1])
        core = tag in ("article", "main")
        discard, own, names = tag in DISCARD or (tag == "header" and not (self.core or self.own)), core, []
        for m in _ATTR.finditer(attrs) if attrs else ():
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names += _names(value)
            elif key == "role":
                discard |= value in _ROLES and tag not in _KEEP
                own |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                discard |= tag not in _KEEP
        own |= not _OWN.isdisjoint(names)
        around, off = self.inside, self.off
        holds = tag not in VOID and not attrs.endswith("/")
        what = [n for n in names if n not in _PLACE]
        if holds and (discard or (what and tag not in ("html", "body", "main"))):
            small = heading or not block or tag in ("p", "li", "td", "dd", "dt", "blockquote")
            self.containers.append([around, None if discard else what, [float(self.core > 0), float(small), float(tag == "article")], 0, 0, 0, 0])
            self.inside = len(self.containers) - 1
            self.off += discard
        if not off:
            self.events.append((-1, "discarded" if discard else "inside" if self.core else "h" if heading else tag if tag in TAGS else "other", self.inside if discard else around))
        if holds:
            if tag in _BARRIERS:
                self.marks.append(len(self.stack))
            self.stack.append((tag, own, around, core))
            self.count[tag] += 1
            self.own += own
            self.core += core
            self.link += tag == "a"
            self.control += tag in CONTROLS


class Judge:
    """Logistic regression on named containers; the words of names weigh by their log odds in the labelled pages."""

    def __init__(self, containers: list[list], labels: list[bool], rounds: int = 100):
        seen = [Counter(), Counter()]
        for c, y in zip(containers, labels):
            seen[y].update(set(c[1]))
        self.words = {w: float(np.log((seen[1][w] + 0.5) / (seen[0][w] + 0.5))) for w in {*seen[0], *seen[1]}}
        self.w = np.zeros(9)
        self.w = _logistic(np.array([self._features(c) for c in containers]), np.array(labels, float), np.ones(len(labels)), 0.1, rounds)

    def _features(self, c: list) -> list[float]:
        odds = [self.words.get(w, -1.0) for w in c[1]]
        n = max(1, c[3])
        return [1.0, max(odds), sum(odds) / len(odds), min(odds), *c[2], c[4] / n, min(np.log2(n + 1), 8) / 4]

    def bad(self, containers: list[list]) -> list[bool]:
        return [c[1] is None or float(np.dot(self._features(c), self.w)) > 0 for c in containers]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def best_run(values: list[float]) -> tuple[int, int]:
    """Half-open range of the contiguous run of greatest positive sum, the first such; (0, 0) where none is positive."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def region(page: str, model: "Model") -> str:
    """Main text of a page by one linear scan."""
    read = Page(page)
    blocks, events = read.left(read.discarded(model.judge))
    if not blocks:
        return ""
    scores = np.array([b[2] for b in blocks], float) @ model.words * np.array([b[1] for b in blocks])
    a, z = best_run([scores[k] if k >= 0 else model.tags[kind] for k, kind in events])
    return "\n\n".join(blocks[k][0] for k, _ in events[a:z] if k >= 0)


@dataclass
class Model:
    """What the labelled pages teach: the judge of named containers, weights of a word's features, scores of tags."""

    judge: Judge
    words: np.ndarray
    tags: dict[str, float]


#: Names of what is no text, and names of text that share words with them.
BOILERPLATE = (
    "ad ads advert advertisement ad-slot adbox ad-banner sponsored sponsor promo promo-box promotion banner top-banner navbar nav main-nav site-nav navigation menu main-menu breadcrumb breadcrumbs site-header masthead topbar page-footer footer site-footer "
    "sidebar left-sidebar sidebar-right side-bar rail widget widget-area comments comment comment-list reader-comments post-comments replies reply discussion disqus respond comments-section notice notices site-notice cookie cookie-notice cookies cookie-banner consent gdpr "
    "popup modal overlay newsletter newsletter-signup subscribe subscription-box signup login share share-bar share-buttons sharing social social-links social-share related related-posts recommended recommendations popular popular-posts trending more-stories read-next "
    "pagination pager search search-form search-box form toolbar copyright legal disclaimer alert alert-box tags tag-list teaser teasers outbrain taboola skip skip-link paywall feedback donate"
).split()
TEXT_NAMES = (
    "legal-history search-methods form-of-government side-effects popular-culture alert-levels comment-on-law read-more tags-explained share-prices social-contract menu-of-the-day header-file notice-period related-work promo-era cookie-recipe newsletter-history "
    "login-flow discussion-of-results legal-notice-history intro lead lede summary abstract story-lead first-paragraph dropcap chapter verse quote pullquote caption figure-text note footnote highlight important text-large entry-content post-body article-body story-text content-text prose "
    "rich-text section-title headline title subtitle byline-text paragraph para body-copy copy answer question solution recipe method steps ingredients definition example theorem poem lyrics transcript interview review history background results conclusion more-details more-about"
).split()


def labelled_pages(n: int = 400, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages from templates, each with the blocks of its main text."""
    rng = random.Random(seed)
    letters = "aeioulnrstdm"

    def words(a: int, z: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, z)))

    def links(k: int, item: str) -> str:
        return "".join(f"<{item}><a href='/{i}'>{words(1, 4)}</a></{item}>" for i in range(k))

    def named(tag: str, names: list[str]) -> str:
        return f"{tag} {rng.choice(['class', 'class', 'class', 'id'])}='{' '.join(rng.sample(names, rng.choice([1, 1, 1, 2])))}'"

    def junk(tag: str = "div") -> str:
        return f"<{named(tag, BOILERPLATE)}>{rng.choice([words(3, 30) + '.', words(1, 6), links(rng.randint(1, 5), 'span'), '<p>' + words(3, 40) + '.</p>'])}</{tag}>"

    out = []
    for _ in range(n):
        truth: list[str] = []

        def own(tag: str, a: int, z: int, truth: list[str] = truth) -> str:
            t = words(a, z) + rng.choice(["", ".", "."])
            truth.append(t)
            if rng.random() < 0.08:
                t = f"<a href='#'>{t}</a>"
            elif rng.random() < 0.2 and len(t.split()) > 6:
                w = t.split()
                t = " ".join([*w[:3], f"<a href='#'>{' '.join(w[3:5])}</a>", *w[5:]])
            if rng.random() < 0.25:
                inner = f"<{named(tag, TEXT_NAMES)}>{t}</{tag}>"
                return inner if rng.random() < 0.5 else f"<{named('div', TEXT_NAMES)}><{tag}>{t}</{tag}></div>"
            return f"<{tag}>{t}</{tag}>"

        body = own("h1", 2, 10)
        for _ in range(rng.choice([1, 1, 2, 3, 6, 12])):
            body += own(rng.choice(["p", "p", "p", "p", "h2", "blockquote", "li"]), *rng.choice([(1, 5), (8, 30), (30, 90)]))
            if rng.random() < 0.25:
                body += junk(rng.choice(["div", "div", "section", "p", "ul"]))
        shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post'>{}</div>", "<div>{}</div>", "<section>{}</section>"])
        top = rng.choice(["<nav><ul>{}</ul></nav>", "<ul>{}</ul>", "<div>{}</div>"]).format(links(rng.randint(2, 9), rng.choice(["li", "span"])))
        top += rng.choice(["", f"<header><p>{words(2, 8)}</p></header>", f"<div>{words(1, 4)}</div>", junk()])
        end = rng.choice(["", junk(), junk() + junk("section")])
        end += rng.choice(["<footer>{}</footer>", "<div>{}</div>", "<p>{}</p>"]).format(links(rng.randint(2, 8), "span") + f"&copy; <a href='/'>{words(1, 3)}</a>")
        out.append((f"<html><head><title>{words(2, 6)}</title></head><body>{top}{shell.format(body)}{end}</body></html>", truth))
    return out


@lru_cache(1)
def learn(rounds: int = 400) -> Model:
    """Learn from the labelled pages: first the judge of names, then weights of words and tags; tags are kept negative."""
    pages = [(Page(page), {*truth}) for page, truth in labelled_pages()]
    named, bad = [], []
    for page, truth in pages:
        text: dict[int, set[str]] = {}
        for parts, _ in page.blocks:
            c = next(p[3] for p in parts if p[0].strip())
            t = " ".join("".join(p[0] for p in parts).split())
            while c >= 0:
                text.setdefault(c, set()).add(t)
                c = page.containers[c][0]
        for c, own in text.items():
            if page.containers[c][1] is not None:
                named.append(page.containers[c])
                bad.append(own.isdisjoint(truth))
    judge = Judge(named, bad)
    x, y, size = [], [], []
    tags: dict[str, list[int]] = {k: [1, 1] for k in TAGS}
    for page, truth in pages:
        blocks, events = page.left(page.discarded(judge))
        real = [b[0] in truth for b in blocks]
        at = [i for i, (k, _) in enumerate(events) if k >= 0 and real[k]]
        for i, (k, kind) in enumerate(events):
            if k >= 0:
                x.append(blocks[k][2])
                y.append(real[k])
                size.append(min(blocks[k][1], 20))
            else:
                tags[kind][int(bool(at) and at[0] <= i <= at[-1])] += 1
    w = _logistic(np.array(x, float), np.array(y, float), np.array(size, float), 0.5, rounds)
    return Model(judge, w, {k: -min(2.0, max(0.05, float(np.log(out / inside)) + 0.3)) for k, (out, inside) in tags.items()})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    model = learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [region(t.decode("utf-8", "replace"), model) for t in as_bytes(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
