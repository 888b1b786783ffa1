"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable, content or not. A node potential comes from its tag, its class and id words, its
text and its links; a potential for each parent and child connects them. Messages pass from the leaves up and from the
root down, which on a tree gives exact marginals; training on labelled pages follows the exact gradient of the
likelihood, from the same messages. Text whose element is content with a marginal of over one half is kept.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .html_pages import labelled_pages

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, whatever it holds; without one up to the end of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content isn't text of the page. Foreign ones end at a tag that can't be in them.
FOREIGN = frozenset("svg math".split())
HIDDEN = FOREIGN | frozenset("template noscript object select canvas audio video datalist".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("button caption label legend option optgroup td th tr tbody thead tfoot body html li dd dt summary p".split()) | {"p"}
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: A comment (which ``--!>`` ends as well), a section of character data, another declaration, or a tag; quotes count only after an equals sign.
MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r'data-y="([01])"')
WORD = re.compile(r"[a-z]+")
PARTS = frozenset("nav header footer aside form".split())
#: Words that tell what short texts are about.
TELLING = frozenset(
    "about account ad add advert advertisement advertising archive archives blog browse cart categories category checkout comment comments contact cookie cookies copyright customer email facebook faq forgot forum help home "
    "impressum inc instagram legal linkedin log login logout ltd mail menu navigation news newsletter notice password policy popular posted powered privacy published recent recommended register related "
    "replies reply reserved rights rss search settings share shop sign signup sitemap skip sponsored subscribe tag tagged tags terms toggle topics trending twitter username website welcome".split()
)
#: Own texts of more characters than this aren't looked at for telling words.
SHORT = 160


class Page:
    """Elements in order of their opening tags, and the blocks of text between block boundaries."""

    def __init__(self, html: str, labels: bool = False):
        self.tag, self.parent, self.names, self.label = ["#page"], [-1], [()], [0]
        self.text, self.linked, self.before = [0], [0], [0]
        self.short: dict[int, str] = {}
        self.stops: dict[int, bool] = {}
        self.blocks: list[list[tuple[int, str]]] = []
        self._run: list[tuple[int, str]] = []
        self._read(html, labels)
        self._flush()
        if labels:  # text outside all elements is the article's
            self.label[0] = int(self.text[0] > 0)

    def _flush(self) -> None:
        if self._run:
            self.blocks.append(self._run)
            self._run = []

    def _read(self, html: str, labels: bool) -> None:
        stack, pos, end, total = [0], 0, len(html), 0
        tag_of, search = self.tag, MARKUP.search
        open_: dict[str, int] = {}  # how many elements of a tag are open
        last_end: dict[str, int] = {}  # where the last end tag of a hidden element is
        hidden = link = 0

        def close(i: int) -> None:
            nonlocal hidden
            for k in stack[i:]:
                open_[tag_of[k]] -= 1
                hidden -= tag_of[k] in HIDDEN
            del stack[i:]

        def close_nearest(ends, until) -> None:
            if any(open_.get(t) for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[i]] in ends:
                        close(i)
                    elif tag_of[stack[i]] in until:
                        break

        def add(name: str, names=(), label: int = 0, inside: bool = True) -> None:
            tag_of.append(name)
            self.parent.append(stack[-1])
            self.names.append(names)
            self.text.append(0)
            self.linked.append(0)
            self.before.append(total)
            self.label.append(label)
            if inside:
                stack.append(len(tag_of) - 1)
                open_[name] = open_.get(name, 0) + 1

        while pos < end:
            m = search(html, pos)
            stop = m.start() if m else end
            if stop > pos and not hidden:
                text = unescape(html[pos:stop])
                if n := len(text) - text.count(" "):
                    at = stack[-1]
                    self.text[at] += n
                    total += n
                    if link:
                        self.linked[at] += n
                    if self.text[at] <= SHORT:
                        self.short[at] = self.short.get(at, "") + " " + text
                    if mark := text.rstrip()[-1:]:
                        self.stops[at] = mark in ".!?:…。"
                self._run.append((stack[-1], text))
            if not m:
                break
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA[") and not hidden:
                    self._run.append((stack[-1], m[0][9:].removesuffix("]]>")))
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name == "br" and not hidden:
                self._run.append((stack[-1], " "))
                continue
            if closing:
                if name == "a":
                    link = 0
                if name in BLOCK and not hidden:
                    self._flush()
                if open_.get(name) and name not in ("body", "html"):
                    for i in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[i]] == name:
                            close(i)
                            break
                        if name == "p" and tag_of[stack[i]] in ("td", "li", "div", "article", "section"):
                            break
                continue
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = found.end() if found else end
                continue
            if name == "head":
                found = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(html, pos)
                pos = (found.start() if found[0][1] != "/" else found.end()) if found else pos
                continue
            if hidden and name in BLOCK and tag_of[stack[-1]] in FOREIGN:
                close_nearest(FOREIGN, ())
            if name in HIDDEN:
                # An element that never ends, or ends in itself, has nothing in it.
                if name not in last_end:
                    last_end[name] = max((x.start() for x in re.compile(rf"</{name}\b", re.I).finditer(html)), default=-1)
                if last_end[name] > pos and not (name in FOREIGN and attrs.rstrip().endswith("/")):
                    add(name)
                    hidden += 1
                continue
            if name == "a":
                link = 1
            if hidden and name not in BLOCK:
                continue
            found = NAMES.findall(attrs) if attrs else ()
            if name in VOID:
                if name in BLOCK:
                    self._flush()
                continue
            if name in INLINE and not found and not (labels and LABEL.search(attrs)):
                continue
            if name in BLOCK:
                if not hidden:
                    self._flush()
                if name in CLOSES_P and open_.get("p"):
                    close_nearest({"p"}, BLOCK)
                if name in IMPLIED:
                    close_nearest(*IMPLIED[name])
            if name in ("html", "body") and name in tag_of[:3]:
                continue
            y = LABEL.search(attrs) if labels else None
            names = tuple(dict.fromkeys(WORD.findall(" ".join(x for t in found for x in t if x).lower()))) if found else ()
            add(name, names, int(y[1]) if y else 0, not attrs.endswith("/") or name in BLOCK)

    def features(self) -> tuple[list[int], list[list[str]]]:
        """The elements that hold any text (and the page itself), and names of the features that each of them has.

        An element without text says nothing about what it stands in, however many there are.
        """
        n = len(self.tag)
        size, linked = self.text[:], self.linked[:]
        headed, alike = [False] * n, {}
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            if self.tag[i] == "h1":
                headed[p] = True
            if size[i]:
                alike[p, self.tag[i]] = alike.get((p, self.tag[i]), 0) + 1
        total = size[0] or 1
        region = "article" if "article" in self.tag else "main" if "main" in self.tag else "none"
        # A page without links, names and tags of parts is text alone, as far as one can see.
        bare = not (linked[0] or region != "none" or any(self.names) or PARTS.intersection(self.tag))
        out, kept = [], [i for i in range(n) if size[i] or not i]
        for i in kept:
            own, all_, tag, p = self.text[i], size[i], self.tag[i], max(self.parent[i], 0)
            share = 4 * linked[i] // all_ if all_ else 5
            part = (all_ * 50 // total).bit_length() if all_ else -1
            after = total - self.before[i] - all_
            place = "first" if all_ and not self.before[i] else "last" if all_ and after <= 0 else str(4 * self.before[i] // total)
            one = [
                "bias", f"tag {tag}", f"own {own.bit_length() // 2}", f"all {all_.bit_length()}", f"links {share}", f"in {self.tag[p]} {tag}", f"headed {headed[i]} {tag}", f"part {part}", f"whole {all_ == total} {tag}", f"holds {own > 0} {tag}", f"mine {4 * own // total} {tag}",
                f"place {place} {bare}", f"place {place} {bare} {tag}", f"region {region} {bare} {tag}", f"alike {min(3, alike.get((p, tag), 0))} {tag}", f"{tag} {all_.bit_length() // 2} {share}",
                f"stop {self.stops.get(i)} {min(own.bit_length(), 7)}", *(f"name {w}" for w in self.names[i]),
            ]
            if 0 < own <= SHORT and i in self.short:
                told = set(WORD.findall(self.short[i].lower())) & TELLING
                one += [f"word {w}" for w in told]
                if told:
                    one.append(f"telling {min(3, len(told))} {min(own.bit_length(), 8)}")
                    one.append(f"telling {bare} {region} {tag}")
                if "©" in self.short[i]:
                    one.append("word copyright")
            out.append(one)
        return kept, out


class TreeModel:
    """``weights``: log-odds of content of each feature. ``edge``: potentials of (parent, child) as logs."""

    def __init__(self, weights: dict[str, float] | None = None, edge=((0.0, 0.0), (0.0, 0.0))):
        self.weights, self.edge = dict(weights or {}), [list(r) for r in edge]

    def marginals(self, parent: list[int], scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Of content for each element, and expected counts of (parent, child) labels, by one pass up and one down."""
        (e00, e01), (e10, e11) = ([math.exp(x) for x in r] for r in self.edge)
        n = len(parent)
        up, message = scores[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            a = math.exp(min(up[i], 500.0))
            message[i] = math.log((e10 + e11 * a) / (e00 + e01 * a))
            up[parent[i]] += message[i]
        out, pairs = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
        total = up[:]
        out[0] = 1 / (1 + math.exp(-max(-500.0, min(500.0, total[0]))))
        for i in range(1, n):
            p = parent[i]
            b = math.exp(max(-500.0, min(500.0, total[p] - message[i])))
            total[i] += math.log((e01 + e11 * b) / (e00 + e10 * b))
            out[i] = 1 / (1 + math.exp(-max(-500.0, min(500.0, total[i]))))
            a = math.exp(max(-500.0, min(500.0, up[i])))
            w00, w01, w10, w11 = e00, e01 * a, e10 * b, e11 * a * b
            z = w00 + w01 + w10 + w11
            pairs[0][0] += w00 / z
            pairs[0][1] += w01 / z
            pairs[1][0] += w10 / z
            pairs[1][1] += w11 / z
        return out, pairs

    def score(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in features]

    def content(self, page: Page) -> list[float]:
        kept, features = page.features()
        place = {k: i for i, k in enumerate(kept)}
        out = [0.0] * len(page.tag)
        for k, q in zip(kept, self.marginals([place.get(page.parent[k], -1) for k in kept], self.score(features))[0], strict=True):
            out[k] = q
        return out

    def train(self, pages: list[Page], rounds: int = 60, rate: float = 0.5, decay: float = 1e-5) -> TreeModel:
        """Gradient ascent of the log-likelihood of the labels, with a step for each weight that its past gradients shrink.

        All pages are one forest, whose messages pass level by level.
        """
        known: dict[str, int] = {}
        at, of, parent, label, depth = [], [0], [], [], []
        for page in pages:
            kept, all_features = page.features()
            place = {-1: -1} | {k: len(parent) + i for i, k in enumerate(kept)}
            for k, features in zip(kept, all_features, strict=True):
                at += [known.setdefault(f, len(known)) for f in features]
                of.append(len(at))
                parent.append(place[page.parent[k]])
                label.append(page.label[k])
                depth.append(depth[parent[-1]] + 1 if k else 0)
        at, of, parent, label, depth = (np.array(x, np.int64) for x in (at, of, parent, label, depth))
        count, below = len(parent), np.flatnonzero(parent >= 0)
        levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        seen = np.bincount(label[parent[below]] * 2 + label[below], minlength=4)
        w = np.zeros(len(known) + 4)
        w[: len(known)] = [self.weights.get(f, 0.0) for f in known]
        w[-4:] = np.array(self.edge).ravel()
        past = np.full(len(w), 1e-8)
        width = np.diff(of)
        for _ in range(rounds):
            e00, e01, e10, e11 = np.exp(w[-4:])
            up = np.add.reduceat(w[at], of[:-1])
            message = np.zeros(count)
            for level in reversed(levels):
                a = np.exp(np.clip(up[level], -500, 500))
                message[level] = np.log((e10 + e11 * a) / (e00 + e01 * a))
                np.add.at(up, parent[level], message[level])
            total = up.copy()
            for level in levels:
                b = np.exp(np.clip(total[parent[level]] - message[level], -500, 500))
                total[level] += np.log((e01 + e11 * b) / (e00 + e10 * b))
            got = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            a, b = np.exp(np.clip(up[below], -300, 300)), np.exp(np.clip(total[parent[below]] - message[below], -300, 300))
            pairs = np.stack([np.full(len(below), e00), e01 * a, e10 * b, e11 * a * b])
            pairs = (pairs / pairs.sum(axis=0)).sum(axis=1)
            g = np.concatenate([np.bincount(at, np.repeat(label - got, width), len(known)), seen - pairs]) / count
            past += g * g
            w += rate * (g - decay * w) / np.sqrt(past)
        self.weights = dict(zip(known, w.tolist(), strict=False))
        self.edge = w[-4:].reshape(2, 2).tolist()
        return self


#: Labelled pages that the model is trained on, and rounds.
TRAINING_PAGES, TRAINING_ROUNDS = 2000, 250


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return TreeModel().train([Page(h, labels=True) for h in labelled_pages(TRAINING_PAGES)], TRAINING_ROUNDS)


def main_text(html: str | None, model: TreeModel) -> str:
    """Content blocks in page order, joined by newlines; white space inside a block is one space."""
    if not html:
        return ""
    page = Page(html)
    content = model.content(page)
    lines = (" ".join("".join([t for i, t in run if content[i] > 0.5]).split()) for run in page.blocks)
    return "\n".join([x for x in lines if x])


def extract(pages: DataFrame, html: str = "html", model: TreeModel | None = None) -> DataFrame:
    """All columns but ``html``, with ``text`` and ``n_chars`` (code points).

    Null or empty pages and pages without content give an empty text. Pages go through whole. Unclosed, misnested and cut
    markup is read much as browsers do: an element ends with its parent, and only scripts, styles and the like run to the
    end of the page. Columns named text or n_chars are replaced. Repeated rows stay; no shuffle.
    """
    model = model or default_model()
    book = pages.sparkSession.sparkContext.broadcast((model.weights, model.edge))
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string", "n_chars long"])

    def run(batches):
        model = TreeModel(*book.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h, model) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
