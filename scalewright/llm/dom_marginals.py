"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in it is a node that is content or isn't.  A node potential comes
from what the node looks like (tag, words of its class and id, length, share of link text, punctuation), a
parent-child potential from how often a content parent has content children.  Sum-product messages go up the
tree and down again; a run of text is kept when its marginal probability of being content is at least 1/2.

The potentials are counts over labelled pages.  A page labels itself if it has an ``article`` or ``main``
element: what is inside, but not in one of the elements or classes listed below, is content.  At most about
``TRAIN_PAGES`` pages, chosen by a hash of their id, are used for that, each as it is and once more with a
``div`` in place of those elements; the model then applies to all pages, with or without them.  Counts set by
hand stand in only where no page of the sample labels itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 4000

# Names of HTML.
BLOCKS = set("html body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset details summary dialog hgroup search menu".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("script style noscript template head title svg iframe select option textarea button label".split())
#: Dropped elements that end only with their own end tag, and what a head may hold.
RAW = {"script", "style", "title", "textarea", "iframe"}
IN_HEAD = set("html head base link meta title style script noscript template basefont bgsound".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "thead", "tbody", "tfoot", "dt", "dd", "caption"}
#: Elements that end an open one of the same group.
SIBLINGS = (("li",), ("tr",), ("td", "th"), ("dt", "dd"))
#: Elements that are never content, and stems of classes and ids that say so.
BOILERPLATE = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "search"}
HINTS_AGAINST = "ad ads advert advertisement banner promo sponsor sponsored cookie consent notice nav navbar menu breadcrumb footer header sidebar widget share social related recommend newsletter subscribe comment comments reply disqus popup modal login signup toolbar pagination copyright".split()
HINTS_FOR = "article content main post story entry body text".split()
#: Counts of the lists above where no page labels itself.
PRIOR = 50.0


#: Kinds of children, each with its own parent-child potential: anything below boilerplate, runs of text,
#: elements that open an article, other elements.
KINDS = ("barred", "text", "opening", "element")
#: Counts of (kind, parent, child) where no page labels itself.
PAIR_PRIOR = {"barred": ((200, 0.2), (40, 1)), "text": ((100, 1), (1, 100)), "opening": ((1, 4), (1, 20)), "element": ((50, 5), (20, 100))}
#: The most that the looks of one node count for, as log odds.
STRONGEST = 5.0


def is_barrier(tag: str, hints: tuple) -> bool:
    return tag in BOILERPLATE or any(h in HINTS_AGAINST for h in hints)


class Tree(HTMLParser):
    """Block elements and runs of text, in page order: parent, kind, hints, text, characters in links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.hints, self.text, self.linked = [-1], ["root"], [()], [None], [0]
        self.kind, self.barred = ["element"], [False]
        self.open: list[tuple[str, int]] = [("root", 0)]
        #: Positions in ``open`` of every tag, outermost first, so that no search runs over all open elements.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.pieces: list[str] = []
        self.in_link = self.link_chars = 0
        #: Open elements from the outermost dropped one inwards; nothing is kept while there are any.
        self.skipped: list[str] = []
        self.n_skipped: Counter = Counter()

    def _node(self, tag: str, hints: tuple, text: str | None = None, linked: int = 0) -> int:
        for column, value in zip((self.parent, self.tag, self.hints, self.text, self.linked), (self.open[-1][1], tag, hints, text, linked)):
            column.append(value)
        barred = self.barred[self.open[-1][1]]
        self.kind.append("barred" if barred else "text" if text is not None else "opening" if tag in ("article", "main") else "element")
        self.barred.append(barred or is_barrier(tag, hints))
        return len(self.parent) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self._node("#text", (), text, self.link_chars)
        self.pieces, self.link_chars = [], 0

    def _pop(self, tag: str) -> None:
        """End the innermost open ``tag`` and all inside it."""
        self.flush()
        at = self.places[tag][-1]
        while len(self.open) > at:
            self.places[self.open.pop()[0]].pop()

    def _skip(self, tag: str) -> None:
        self.skipped.append(tag)
        self.n_skipped[tag] += 1

    def _unskip(self, tag: str) -> None:
        """End the innermost dropped ``tag`` and all inside it."""
        found = None
        while found != tag:
            found = self.skipped.pop()
            self.n_skipped[found] -= 1

    def _unskip_all(self) -> None:
        self.skipped.clear()
        self.n_skipped.clear()

    def _end_skipped_before(self, tag: str) -> None:
        """End the dropped elements whose end tag may be left out before ``tag``."""
        last, count = self.skipped[-1], self.n_skipped
        if last in RAW:
            return
        if last == "head" and tag not in IN_HEAD or last == "option" and tag in ("option", "optgroup") or last == "svg" and tag in BLOCKS:
            self._unskip(last)
        elif tag in ("button", "label") and count[tag]:
            while count[tag]:
                self._unskip(tag)
        elif last in ("select", "option") and (tag in ("select", "input", "textarea") or tag in BLOCKS - {"div"}):
            outer = "select" if count["select"] else last
            while count[outer]:
                self._unskip(outer)
        elif count["label"] == len(self.skipped):
            outer = self.open[-1][0]
            if outer == "p" and tag in CLOSES_P or any(outer in same and tag in same for same in SIBLINGS):
                self._unskip_all()

    def _end_sibling_before(self, tag: str) -> None:
        """End the open element whose end tag may be left out before ``tag``, unless a list or table lies between."""
        if tag in CLOSES_P:
            if self.open[-1][0] == "p":
                self._pop("p")
            return
        same = next((s for s in SIBLINGS if tag in s), ())
        at, which = max(((self.places[t][-1], t) for t in same if self.places[t]), default=(0, ""))
        if at > max((self.places[t][-1] for t in ("ul", "ol", "table", "dl") if self.places[t]), default=0):
            self._pop(which)

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self._end_skipped_before(tag)
        if self.skipped or tag in DROPPED:
            if tag in DROPPED or tag in BLOCKS or tag == "foreignobject":
                self._skip(tag)
            return
        if tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.in_link = 1
        elif tag in BLOCKS:
            self._end_sibling_before(tag)
            self.flush()
            said = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
            node = self._node(tag, tuple(sorted(set(re.split(r"[^a-z]+", said)))))
            self.places[tag].append(len(self.open))
            self.open.append((tag, node))

    def handle_endtag(self, tag):
        if self.skipped:
            if self.n_skipped[tag]:
                if self.skipped[-1] not in RAW - {tag}:
                    self._unskip(tag)
                return
            # The end of an element around the dropped ones ends them too.
            if self.skipped[-1] in RAW or self.n_skipped["template"] or tag not in BLOCKS or not self.places[tag]:
                return
            self._unskip_all()
        if tag == "a":
            self.in_link = 0
        elif tag in BLOCKS and self.places[tag]:
            self._pop(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.skipped == ["head"] and data.strip():
            self._unskip_all()
        if not self.skipped:
            self.pieces.append(data)
            if self.in_link:
                self.link_chars += len(data.strip())


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    if tree.rawdata:  # an unfinished tag at the end of the page
        tree.close()
    tree.flush()
    return tree


def looks(tree: Tree, i: int) -> list[str]:
    """What node ``i`` looks like, as a few features of a small fixed vocabulary."""
    text = tree.text[i]
    if text is None:
        found = ["tag:" + tree.tag[i]]
        if is_barrier(tree.tag[i], tree.hints[i]):
            found.append("barrier")
        found += ["against:" + h for h in tree.hints[i] if h in HINTS_AGAINST]
        return found + ["for:" + h for h in tree.hints[i] if h in HINTS_FOR]
    share = tree.linked[i] / len(text)
    return [f"length:{min(8, len(text).bit_length())}", f"links:{0 if share == 0 else 1 if share < 0.5 else 2}", f"ends:{text[-1] in '.!?'}"]


def self_labels(tree: Tree) -> list[int] | None:
    """Whether each node is content, for a page that marks its article; None for others."""
    if not any(t in ("article", "main") for t in tree.tag):
        return None
    inside = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] in ("article", "main")
    return [int(a and not b) for a, b in zip(inside, tree.barred)]


def unmarked(tree: Tree) -> Tree:
    """The tree as if its article were any ``div``."""
    tree.tag = ["div" if t in ("article", "main") else t for t in tree.tag]
    tree.kind = ["element" if k == "opening" else k for k in tree.kind]
    return tree


def prior_counts() -> Counter:
    counts: Counter = Counter()
    for name, content in [*(("tag:" + t, 0) for t in BOILERPLATE), *(("against:" + h, 0) for h in HINTS_AGAINST), *(("for:" + h, 1) for h in HINTS_FOR), ("tag:article", 1), ("tag:main", 1)]:
        counts[name, content] += PRIOR
    for kind, table in PAIR_PRIOR.items():
        for parent in (0, 1):
            for child in (0, 1):
                counts[f"pair:{kind}:{parent}", child] += table[parent][child]
    return counts


class Potentials:
    """Logarithms of node and parent-child potentials from counts of (feature, label)."""

    def __init__(self, counts: Counter):
        total = [sum(n for (f, c), n in counts.items() if c == k and f.startswith(("tag:", "length:"))) + 1 for k in (0, 1)]
        self.node = {f: [math.log((counts[f, k] + 0.5) / total[k]) for k in (0, 1)] for f in {f for f, _ in counts if not f.startswith("pair:")}}
        self.pair = {}
        # Where a kind was hardly seen below a parent of some label, the share over all kinds stands in.
        pooled = [[1 + sum(counts[f"pair:{kind}:{p}", c] for kind in KINDS) for c in (0, 1)] for p in (0, 1)]
        for kind in KINDS:
            n = [[counts[f"pair:{kind}:{p}", c] + 0.5 + 2 * pooled[p][c] / sum(pooled[p]) for c in (0, 1)] for p in (0, 1)]
            self.pair[kind] = [[n[p][c] / sum(n[p]) for c in (0, 1)] for p in (0, 1)]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content for every node: messages from leaves to root, then back."""
        n = len(tree.tag)
        own, up = [], [(1.0, 1.0)] * n
        for i in range(n):
            scores = [self.node[f] for f in looks(tree, i) if f in self.node] if i else []
            odds = max(-STRONGEST, min(STRONGEST, sum(s[1] - s[0] for s in scores)))
            own.append([1 / (1 + math.exp(odds)), 1 / (1 + math.exp(-odds))] if i else [0.7, 0.3])
        belief, pairs = [list(x) for x in own], [self.pair[k] for k in tree.kind]
        for i in range(n - 1, 0, -1):  # children follow their parents, so the reverse order goes up
            b, pair = belief[i], pairs[i]
            m0, m1 = pair[0][0] * b[0] + pair[0][1] * b[1], pair[1][0] * b[0] + pair[1][1] * b[1]
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = belief[tree.parent[i]]
            p[0], p[1] = p[0] * up[i][0], p[1] * up[i][1]
            s = p[0] + p[1]
            p[0], p[1] = p[0] / s, p[1] / s
        for i in range(1, n):
            p, u = belief[tree.parent[i]], up[i]
            r0, r1 = p[0] / max(u[0], 1e-300), p[1] / max(u[1], 1e-300)  # the parent without this child
            b, pair = belief[i], pairs[i]
            b[0], b[1] = b[0] * (r0 * pair[0][0] + r1 * pair[1][0]), b[1] * (r0 * pair[0][1] + r1 * pair[1][1])
            s = b[0] + b[1]
            b[0], b[1] = b[0] / s, b[1] / s
        return [b[1] for b in belief]


def count_labels(tree: Tree, labels: list[int], counts: Counter) -> None:
    for i in range(1, len(labels)):
        counts.update((f, labels[i]) for f in looks(tree, i))
        counts[f"pair:{tree.kind[i]}:{labels[tree.parent[i]]}", labels[i]] += 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for html in batch.column("html"):
            tree = parsed(html.as_py() or "")
            labels = self_labels(tree)
            if labels is None:
                continue
            count_labels(tree, labels, counts)
            count_labels(unmarked(tree), labels, counts)
    rows = [(f, c, n) for (f, c), n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.int64()))], ["feature", "content", "n"])


def trained(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = TRAIN_PAGES) -> Potentials:
    """Potentials from the self-labelled pages of a sample by hash of the id; a few hundred counts reach the driver."""
    sample = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{html}`").alias("html"))
    share = max(1, sample.count() // most)
    sample = sample.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("html")
    counts: Counter = Counter()
    for r in sample.mapInArrow(_count, "feature string, content int, n long").groupBy("feature", "content").agg(F.sum("n").alias("n")).collect():
        counts[r["feature"], r["content"]] += r["n"]
    return Potentials(counts or prior_counts())


def main_text(html: str, potentials: Potentials) -> str:
    tree = parsed(html)
    marginals = potentials.marginals(tree)
    return "\n".join(text for text, m in zip(tree.text, marginals) if text is not None and m >= 0.5)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if there is none), n_chars.

    Null html counts as empty.  Pages are read whole and each on its own; repeated rows give equal rows.  A
    map without a shuffle, after a count and the training pass over the sample.
    """
    model = trained(pages, page_id, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
