"""Main text of pages by a linear-chain conditional random field over the leaf blocks of the page.

A leaf block is the text between two starts or ends of block elements; inline markup is dropped, character references
are decoded, white space becomes one space. A block is described by its ancestors' tags, by the words in their classes
and ids, and by its text (length, share of links, punctuation, signs of boilerplate). The field, trained on labelled
pages by maximum likelihood, labels the blocks of a page as main text or not, and Viterbi finds the best sequence. Main
blocks are joined in page order by an empty line. A head ends where its end tag is left out; formulas give the text of
their visible elements, not that of their annotations. A closing slash ends an element only in drawings and formulas, and an
element that these cannot hold ends them.

The whole page is read, however long, in time that grows with its length and not with the depth of its elements. A null
or empty page has no text: an empty string. Pages are judged one by one, so repeated rows and ids keep their own
results; an empty table gives no rows.
"""

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terracell.llm.labelled_pages import PAGES

# Element names of the HTML standard.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section
    select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("annotation annotation-xml head iframe noscript object script select style svg template textarea title".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)
}
KEEPS_INSIDE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOT_IN_P = BLOCKS - {"button", "label", "option", "legend", "caption"}
FOREIGN = frozenset(("svg", "math"))
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml".split())  # what lies in these is HTML again
ENDS_FOREIGN = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre
    ruby s small span strong strike sub sup table tt u ul var""".split()
)


class Element:
    """An open element with what its blocks take from all elements around it."""

    __slots__ = ("tag", "mark", "leaf", "names")

    def __init__(self, tag, mark, leaf, names):
        self.tag, self.mark, self.leaf, self.names = tag, mark, leaf, names


ROOT = Element("", None, None, frozenset())


class Blocks(HTMLParser):
    """Leaf blocks of a page: (text, link characters, element). ``known`` names the features of elements to keep, None all."""

    def __init__(self, known=None):
        super().__init__(convert_charrefs=True)
        self.known, self.stack, self.found = known, [], []
        self.places = {}  # per tag the places of its open elements in the stack, so that none is searched for
        self.silent = 0
        self.text, self.linked, self.above = [], 0, None

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((text, self.linked, self.above))
        self.text, self.linked, self.above = [], 0, None

    def push(self, tag, attrs):
        above = self.stack[-1] if self.stack else ROOT
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "data-main")}
        words = re.findall(r"[a-z]+", " ".join(named.get(k, "") for k in ("class", "id", "role")).lower())
        # words that begin alike (comment, comments, commentlist) mostly mean the same
        names = {f"word:{w}" for w in words} | {f"stem:{w[:5]}" for w in words if len(w) >= 5}
        if tag in BLOCKS:
            names.add(f"tag:{tag}")
        if self.known is not None:
            names &= self.known
        # most elements add nothing and share the set of the element around them
        both = above.names if names <= above.names else above.names | names
        self.places.setdefault(tag, []).append(len(self.stack))
        self.silent += tag in SILENT
        self.stack.append(Element(tag, named.get("data-main", above.mark), tag if tag in BLOCKS else above.leaf, both))

    def pop_to(self, at):
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            self.silent -= tag in SILENT

    def last(self, tags, until=()):
        """Place of the innermost open element of ``tags`` that no element of ``until`` separates from here."""
        inner = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)
        at = inner(tags)
        return at if at >= 0 and at > inner([t for t in until if t not in tags]) else None

    def foreign(self):
        """Place of the drawing or formula whose content is read, if any."""
        return self.last(FOREIGN, HTML_INSIDE)

    def leave_head(self):
        """End an open head whose end tag is left out, unless an element is open whose content is not page content."""
        if self.places.get("head") and (at := self.last(("head",), SILENT - {"head"} | {"noframes"})) is not None:
            self.pop_to(at)

    def handle_starttag(self, tag, attrs, closed=False):
        if tag not in IN_HEAD:
            self.leave_head()
        if (at := self.foreign()) is not None:
            if tag in ENDS_FOREIGN:
                self.pop_to(at)
            elif closed:
                return
        elif closed and tag in FOREIGN:
            return
        if tag in BLOCKS:
            self.flush()
            if tag in NOT_IN_P and (at := self.last(("p",), ("td", "th", "button", "table"))) is not None:
                self.pop_to(at)
            if tag in CLOSED_BY and (at := self.last(CLOSED_BY[tag], KEEPS_INSIDE[tag])) is not None:
                self.pop_to(at)
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        # a closing slash means nothing outside void, drawn and formula elements
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        if tag in ("body", "html", "br"):
            self.leave_head()
        if tag in BLOCKS:
            self.flush()
        at = self.last((tag,))
        if at is not None:
            self.pop_to(at)

    def handle_data(self, data):
        blank = data.isspace()
        if not blank:
            self.leave_head()
        if self.silent:
            return
        if self.above is None and not blank:
            self.above = self.stack[-1] if self.stack else ROOT
        self.text.append(data)
        if self.places.get("a"):
            self.linked += len(data)


def blocks(html, known=None):
    parser = Blocks(known)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def features(found):
    """Names of the features of each block of a page."""
    out = []
    for text, linked, above in found:
        names = {"bias", *above.names}
        if above.leaf:
            names.add(f"leaf:{above.leaf}")
        words = text.split()
        names.add(f"words:{min(6, int(math.log2(len(words) + 1)))}")
        names.add(f"links:{min(3, int(4 * linked / max(1, len(text))))}")
        if text[-1] in ".!?:;\"'»”…":
            names.add("sentence end")
        if re.search(r"©|\(c\)", text):
            names.add("sign")
        out.append(sorted(names))
    if len(out) > 3:
        out[0].append("first")
        out[-1].append("last")
    return out


def marks(found):
    """Labels of a labelled page's blocks: the nearest mark above each."""
    return [int(above.mark or "0") for _, _, above in found]


class Field:
    """A two-label linear-chain conditional random field over named features."""

    def __init__(self, names, weights, moves):
        self.names, self.weights, self.moves = names, weights, moves
        self.known = frozenset(names)

    def placed(self, page):
        """The known features of a page as (block, feature) numbers."""
        pairs = [(i, self.names[f]) for i, block in enumerate(page) for f in block if f in self.names]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return len(page), at[:, 0], at[:, 1]

    def scores(self, page):
        n, block, feature = self.placed(page) if isinstance(page, list) else page
        return np.bincount(block, self.weights[feature], minlength=n)

    def viterbi(self, page):
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, g in enumerate(self.scores(page).tolist()):
            if i:
                from_zero, from_one = (zero + m00 < one + m10), (zero + m01 < one + m11)
                back.append((int(from_zero), int(from_one)))
                zero, one = (one + m10 if from_zero else zero + m00), (one + m11 if from_one else zero + m01)
            one += g
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def gradient(self, page, truth):
        """Of the log likelihood: expected against seen labels and moves, by forward and backward sums."""
        n = len(truth)
        gain = np.stack((np.zeros(n), self.scores(page)), axis=1)
        # sums over both labels in plain floats: a page has few blocks, and arrays of two cost more than they save
        out = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        (m00, m01), (m10, m11) = self.moves.tolist()
        rows = gain.tolist()
        alpha, beta = [rows[0]], [[0.0, 0.0]]
        for g0, g1 in rows[1:]:
            a0, a1 = alpha[-1]
            alpha.append([g0 + out(a0 + m00, a1 + m10), g1 + out(a0 + m01, a1 + m11)])
        for g0, g1 in rows[:0:-1]:
            b0, b1 = beta[-1]
            beta.append([out(m00 + g0 + b0, m01 + g1 + b1), out(m10 + g0 + b0, m11 + g1 + b1)])
        alpha, beta = np.array(alpha), np.array(beta[::-1])
        total = np.logaddexp(*alpha[-1])
        labels = np.exp(alpha + beta - total)[:, 1]
        moves = np.zeros((2, 2))
        if n > 1:
            moves -= np.exp(alpha[:-1, :, None] + self.moves + (gain + beta)[1:, None, :] - total).sum(axis=0)
            np.add.at(moves, (truth[:-1], truth[1:]), 1)
        return np.array(truth) - labels, moves


def train(pages=PAGES, rounds=500, rate=0.5, decay=0.005):
    """Fit a field to labelled pages (a fixed number of them) by gradient ascent with decay of the weights."""
    found = [blocks(p) for p in pages]
    rows, truths = [features(f) for f in found], [marks(f) for f in found]
    names = {n: i for i, n in enumerate(sorted({n for page in rows for b in page for n in b}))}
    field = Field(names, np.zeros(len(names)), np.zeros((2, 2)))
    pages_at = [field.placed(page) for page in rows]
    for _ in range(rounds):
        step, moves = -decay * field.weights, -decay * field.moves
        for page, truth in zip(pages_at, truths):
            off, moved = field.gradient(page, truth)
            step = step + np.bincount(page[2], off[page[1]], minlength=len(names))
            moves = moves + moved
        field.weights += rate / len(pages) * step
        field.moves += rate / len(pages) * moves
    return field


def main_text(html, field):
    found = blocks(html, field.known)
    return "\n\n".join(b[0] for b, keep in zip(found, field.viterbi(features(found))) if keep) if found else ""


def _extract(field):
    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", field) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def extract(pages, id="page_id", url="url", html="html", field=None):
    """One row per page: id, url, ``text`` and ``n_chars``."""
    row = F.struct(F.col(id).alias(id), F.col(url).alias(url)).alias("row")
    held = pages.select(row, F.col(html).alias("html"))
    out = held.mapInArrow(_extract(field or train()), f"row {held.schema['row'].dataType.simpleString()}, text string")
    return out.select(F.col("row")[id].alias(id), F.col("row")[url].alias(url), "text", F.length("text").cast("long").alias("n_chars"))
