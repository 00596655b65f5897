"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its word count and link density, those of its neighbours,
whether running text stands before and after it with no block of links in between, and what the nearest telling container around it says (article or content: 1; menu, footer, advert, comments and the like: -1;
nothing: 0). Class names that say what a page or part has or lacks (has-sidebar, comments-open) say nothing of the element itself; html, body
and main are never unwanted by their names, article only by a name like comment without one like post beside it; main, and an article
not within another one, end what the names of containers around them said. A decision tree fitted on the labelled table below keeps or drops each block.

Results: a null page, one without text and one whose blocks are all dropped give the empty string; every row gives one row, repeated
rows too; an empty table gives an empty table; columns other than id, url and html are not read. Unclosed and stray tags are
tolerated; white space is what str.split() takes as such, so it includes no-break spaces.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import chunks

# Element names of the HTML standard by their role here.
SKIPPED = set("script style noscript template svg math head title form select option button textarea iframe object audio video canvas".split())
RAW = set("script style textarea title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer h1 h2 h3 h4
h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
OUTSIDE = set("nav footer aside menu dialog".split())
INSIDE = set("article main".split())
# Names that speak of unwanted parts, of main text, and of structure only; a class token counts by its parts between hyphens and underscores.
BAD = set("""ad ads advert adverts advertisement advertising banner promo promotion promotions sponsor sponsored sponsors cookie cookies notice notices
consent gdpr alert alerts popup modal side sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead comment
comments disqus respond reply replies share sharing social related recommend recommended recommendations newsletter subscribe subscription login signup
pagination pager toolbar copyright disclaimer""".split())
GOOD = set("article content post entry story main body text".split())
NEUTRAL = set("""box bar block blocks wrapper wrap container list lists item items section sections area panel col column columns holder inner outer unit slot
button buttons link links form top bottom left right site page pages layout group row post posts article articles body text main global primary
secondary header footer title icon icons area zone module thread form count tools""".split())
STATE = set("has with without no open closed enabled disabled".split())
# as in the tokenizer of the HTML standard, quotes delimit only a value right behind its equals sign; an open quote is part of a name or value
ATTRIBUTES = r"(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+|=)*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)", re.S)
HREF = re.compile(r"(?<![^\s/\"'])href\s*=", re.I)
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

FEATURES = ["zone", "words", "links", "words_before", "links_before", "words_after", "links_after", "between"]
#: Labelled blocks: the first seven features, then 1 for main text; `between` is 0 for these, read off the words beside them where these decide.
LABELLED = [
    (1, 62, 0.0, 8, 0.0, 75, 0.0, 1), (1, 1, 0.0, 40, 0.0, 55, 0.0, 1), (1, 2, 0.0, 1, 0.0, 1, 0.0, 1), (1, 9, 0.0, 8, 0.0, 62, 0.0, 1),
    (1, 12, 0.0, 0, 0.0, 0, 0.0, 1), (1, 48, 0.06, 10, 0.0, 5, 0.0, 1), (1, 30, 0.2, 25, 0.1, 40, 0.0, 1), (1, 4, 0.0, 90, 0.0, 12, 0.0, 1),
    (1, 210, 0.01, 31, 0.0, 0, 0.0, 1), (1, 3, 0.0, 0, 0.0, 9, 0.0, 1), (1, 6, 0.0, 120, 0.0, 5, 1.0, 1), (1, 17, 0.4, 60, 0.0, 33, 0.0, 1),
    (1, 4, 0.0, 2, 1.0, 3, 1.0, 1), (1, 2, 0.0, 0, 0.0, 2, 0.0, 1), (1, 1, 0.0, 1, 1.0, 2, 0.0, 1), (1, 7, 0.0, 3, 0.0, 2, 0.0, 1),
    (1, 8, 0.0, 2, 0.0, 4, 0.0, 1), (1, 3, 0.0, 4, 0.9, 6, 0.0, 1), (1, 6, 0.2, 5, 1.0, 0, 0.0, 1), (1, 1, 0.0, 0, 0.0, 3, 1.0, 1),
    (1, 5, 1.0, 40, 0.0, 3, 1.0, 0), (1, 2, 1.0, 5, 1.0, 4, 1.0, 0), (1, 7, 1.0, 80, 0.0, 0, 0.0, 0), (1, 3, 1.0, 2, 1.0, 50, 0.0, 0),
    (1, 4, 0.9, 66, 0.0, 4, 0.9, 0), (1, 1, 1.0, 1, 1.0, 1, 1.0, 0),
    (-1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (-1, 8, 0.0, 1, 1.0, 12, 0.0, 0), (-1, 55, 0.0, 0, 0.0, 40, 0.0, 0), (-1, 120, 0.0, 80, 0.0, 33, 0.0, 0),
    (-1, 14, 0.1, 70, 0.0, 0, 0.0, 0), (-1, 25, 0.5, 3, 1.0, 6, 0.3, 0), (-1, 3, 0.0, 200, 0.0, 2, 0.0, 0), (-1, 40, 0.0, 6, 0.0, 90, 0.0, 0),
    (-1, 2, 0.0, 0, 0.0, 60, 0.0, 0), (-1, 300, 0.0, 10, 0.0, 11, 0.0, 0), (-1, 9, 0.0, 9, 0.0, 9, 0.0, 0), (-1, 33, 0.2, 45, 0.0, 20, 0.0, 0),
    (0, 70, 0.0, 10, 0.0, 65, 0.0, 1), (0, 35, 0.05, 60, 0.0, 44, 0.1, 1), (0, 8, 0.0, 60, 0.0, 75, 0.0, 1), (0, 4, 0.0, 45, 0.0, 52, 0.0, 1),
    (0, 24, 0.0, 5, 0.9, 80, 0.0, 1), (0, 110, 0.1, 2, 1.0, 3, 1.0, 1), (0, 18, 0.0, 90, 0.0, 30, 0.0, 1), (0, 50, 0.2, 33, 0.0, 0, 0.0, 1),
    (0, 6, 0.0, 1, 1.0, 48, 0.0, 1), (0, 11, 0.0, 38, 0.0, 41, 0.0, 1), (0, 27, 0.0, 70, 0.0, 2, 1.0, 1), (0, 90, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 2, 1.0, 3, 1.0, 2, 1.0, 0), (0, 5, 0.8, 60, 0.0, 4, 1.0, 0), (0, 4, 0.0, 2, 1.0, 3, 1.0, 0), (0, 12, 0.7, 30, 0.0, 5, 0.6, 0),
    (0, 3, 0.0, 4, 0.9, 6, 0.0, 0), (0, 30, 0.9, 40, 0.0, 8, 1.0, 0), (0, 7, 0.0, 3, 0.0, 2, 0.0, 0), (0, 6, 0.2, 5, 1.0, 0, 0.0, 0),
    (0, 9, 0.6, 100, 0.0, 60, 0.0, 0), (0, 1, 0.0, 0, 0.0, 3, 1.0, 0), (0, 45, 0.8, 3, 1.0, 20, 0.5, 0), (0, 8, 0.0, 2, 0.0, 4, 0.0, 0),
]
#: Labelled blocks within runs of short ones: all eight features, then the label.
RUNS = [
    (0, 1, 0.0, 2, 0.0, 1, 0.0, 1, 1), (0, 3, 0.0, 1, 0.0, 2, 0.0, 1, 1), (0, 2, 0.0, 30, 0.0, 2, 0.0, 1, 1), (0, 6, 0.0, 5, 0.0, 4, 0.0, 1, 1),
    (0, 4, 0.0, 3, 0.2, 60, 0.0, 1, 1), (0, 9, 0.1, 8, 0.0, 9, 0.0, 1, 1), (0, 2, 0.3, 2, 0.0, 3, 0.0, 1, 1), (0, 8, 0.0, 7, 0.0, 5, 0.0, 1, 1),
    (0, 2, 0.0, 1, 1.0, 2, 0.0, 0, 0), (0, 3, 0.0, 2, 0.0, 3, 0.0, 0, 0), (0, 5, 0.0, 4, 1.0, 6, 0.0, 0, 0), (0, 1, 0.0, 3, 0.0, 0, 0.0, 0, 0),
    (0, 2, 1.0, 3, 0.0, 2, 0.0, 1, 0), (0, 3, 1.0, 40, 0.0, 3, 1.0, 1, 0), (0, 8, 0.9, 9, 0.0, 30, 0.0, 1, 0), (0, 4, 0.0, 2, 0.0, 2, 1.0, 0, 0),
    (0, 1, 0.0, 0, 0.0, 25, 0.0, 0, 1), (0, 3, 0.0, 0, 0.0, 40, 0.0, 0, 1), (0, 1, 0.0, 1, 0.0, 25, 0.0, 0, 0), (0, 2, 0.0, 2, 1.0, 40, 0.0, 0, 0),
    (-1, 3, 0.0, 2, 0.0, 3, 0.0, 1, 0), (-1, 60, 0.0, 30, 0.0, 30, 0.0, 1, 0), (1, 2, 0.0, 2, 0.0, 2, 0.0, 1, 1), (1, 2, 0.0, 1, 1.0, 1, 1.0, 0, 1),
]
TEXT_WORDS = 15                 # words of a block that holds running text, if fewer than a third are links


def table(labelled: list[tuple] = LABELLED, runs: list[tuple] = RUNS) -> np.ndarray:
    """The labelled rows with all features: a block is `between` where running text stands right before and right after it."""
    full = lambda words, links: words >= TEXT_WORDS and links < 1 / 3
    return np.array([(*r[:7], float(full(r[3], r[4]) and full(r[5], r[6])), r[7]) for r in labelled] + list(runs), float)


def names_say(said: str) -> int:
    """1, -1 or 0 for class, id and role tokens: a token is unwanted if its parts are unwanted or structural, at least one unwanted."""
    good = bad = False
    for token in said.lower().split():
        parts = [p for p in re.split("[-_]+", token) if p]
        if STATE & set(parts):                       # what a page or part has or lacks says nothing of the element itself
            continue
        bad |= any(p in BAD for p in parts) and all(p in BAD or p in NEUTRAL or p.isdigit() for p in parts)
        good |= any(p in GOOD for p in parts) and not any(p in BAD for p in parts)
    return -1 if bad else int(good)


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 10) -> tuple | int:
    """A decision tree: (feature, threshold, tree at or below, tree above), or the label of a leaf; split by Gini impurity."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return int(share > 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(len(x) * x.mean() * (1 - x.mean()) for x in (labels[low], labels[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return int(share > 0.5)
    _, f, cut, low = best
    return f, cut, fit_tree(rows[low], labels[low], depth - 1), fit_tree(rows[~low], labels[~low], depth - 1)


def keep(tree: tuple | int, row: tuple) -> bool:
    while tree.__class__ is tuple:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def blocks(page: str) -> Iterator[tuple[int, str, int, int]]:
    """(zone, text, words, words within links) of each flat block, in page order."""
    stack: list[tuple[str, int, bool, bool]] = []    # open elements: name, zone, skipped, within an element of OUTSIDE
    zone, skipped, link, ahead = 0, False, 0, 0      # link: 0 none, 1 until its end tag, 2 until its block ends; ahead: no anchor tag begins before it
    parts: list[str] = []
    linked: list[str] = []

    def end():
        text = " ".join(entities.unescape("".join(parts)).split())
        count = len(entities.unescape("".join(linked)).split())
        parts.clear()
        linked.clear()
        return (zone, text, text.count(" ") + 1, count) if text else None

    at, ends = 0, False
    while at <= len(page):
        tag = TAG.search(page, at)
        data = page[at: tag.start() if tag else len(page)]
        if data and not skipped:
            parts.append(data)
            if link:
                linked.append(data)
        if tag is None:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name, closing = tag[2].lower(), tag[1] == "/"
        if name in BLOCK or name in SKIPPED:
            if (done := end()):
                yield done
            link = link if link == 1 else 0
        if closing:
            if name == "a":
                link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "nav", "footer", "aside", "section", "table") and name in ("p", "li", "b", "i", "span", "a"):
                    break                                # a stray end tag closes nothing outside its section
            zone, skipped = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            continue
        if name == "a":
            link = 0
            if HREF.search(tag[3]):
                if ahead < at:
                    other = ANCHOR.search(page, at)
                    ahead, ends = (other.start(), other[1] == "/") if other else (len(page) + 1, False)
                link = 1 if ends else 2                  # the next anchor tag should be its end tag
        if name in VOID or tag[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCK or name in SKIPPED:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            own, outside = (stack[-1][1], stack[-1][3]) if stack else (0, False)
            if name in OUTSIDE or name == "header" and own == 0:
                own, outside = -1, True
            elif own >= 0 or name in INSIDE and not outside:
                said = " ".join(a or b or c for a, b, c in NAMES.findall(tag[3])) if "=" in tag[3] else ""
                told = names_say(said) if said else 0
                good, bad = told > 0, told < 0
                if name == "article":
                    own = -1 if bad and not GOOD & set(said.lower().split()) or own < 0 and any(e[0] == name for e in stack) else 1
                elif name in ("html", "body"):
                    own = 1 if good else own
                else:
                    own = 1 if name in INSIDE else -1 if bad else 1 if good else own
            stack.append((name, own, name in SKIPPED or bool(stack and stack[-1][2]), outside))
            zone, skipped = own, stack[-1][2]
    if (done := end()):
        yield done


def between(found: list[tuple[int, str, int, int]]) -> list[int]:
    """1 for blocks with running text before and after them in their zone, and no block of links in between."""
    def reached(order) -> list[bool]:
        out, held = [False] * len(found), None
        for i in order:
            zone, _, words, links = found[i]
            out[i] = held == zone
            if links / words >= 1 / 3 or held != zone:
                held = None
            if words >= TEXT_WORDS and links / words < 1 / 3:
                held = zone
        return out

    before, after = reached(range(len(found))), reached(range(len(found) - 1, -1, -1))
    return [int(x and y) for x, y in zip(before, after)]


def main_text(page: str, tree: tuple | int) -> str:
    found = list(blocks(page))
    share = [links / words for _, _, words, links in found]
    middle = between(found)
    kept = []
    for i, (zone, text, words, _) in enumerate(found):
        before = (found[i - 1][2], share[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][2], share[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if keep(tree, (zone, words, share[i], *before, *after, middle[i])):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: list[tuple] = LABELLED) -> DataFrame:
    """(id, url, text) of every page."""
    rows = table(labelled)
    tree = fit_tree(rows[:, :-1], rows[:, -1])
    rows = pages.select(id_col, url_col, html_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(2), 8 << 20):
                texts = [main_text(x or "", tree) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)),
                                                  pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
