"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a run of words and tags.  Words score above zero and tags below, with weights that are
log odds counted over labelled pages; one linear scan finds the contiguous run of the largest total.
Elements that the same log odds call surroundings (menus, adverts, forms, comments ...) count a detour
inside the run and are left out of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled_pages import LABELLED

# Each alternative of an attribute run begins with another character, and none gives back what it took.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content isn't read as markup: of the first none is text, of the others all is.
_DROPPED = frozenset(("script", "style", "noscript", "template", "iframe", "svg"))
_RCDATA = frozenset(("textarea", "title"))
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr option".split())
#: Parts of a formula, which stands within its line.
_FORMULA = frozenset("math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose maction msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd semantics annotation annotation-xml".split())
#: Elements that may hold others and are closed by name; the rest only break blocks.
_HOLDERS = frozenset("html head body div section article main aside nav header footer form ul ol dl table tbody thead tr td figure fieldset details dialog button menu blockquote center select textarea title object".split())
#: Headings belong to what they stand in, whatever their marks; inline elements that may be left out by theirs.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKED = frozenset("span a ins small".split())
#: Those that a header or footer within them belongs to.
_SECTIONS = frozenset(("article", "main", "section"))

#: Elements that may be one thing or the other, so that their text tells something.
_TELLING = frozenset("div section table aside".split())

#: Sums of log odds at or below the first call an element surroundings, above the second content.
SURROUNDINGS, CONTENT = -1.1, 0.9
#: Score of passing over surroundings, and the part of a word's score that a word in a link keeps.
DETOUR, LINKED = -2.0, -0.3
#: Most that an element's text may speak for it, and log odds of its names at or below which it can't: readers'
#: comments are sentences too.
TOLD, CERTAIN = 1.2, -1.8
#: Times the words outside that make an element a wrapper of the page.
WRAPS = 3
#: Added to the counts of features.
_UNSEEN = 0.1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of every token: kind '' is text, '<' a begin tag, '/' an end tag, '-' what is
    dropped whole.

    Time is linear in the page's length.  A tag whose quotes never end ends at the next '>', and so do the
    tags after it.  Content without markup goes to its end tag, or to the end of the page; with '/>', a
    drawing is empty, and another is where no end of theirs comes before the next of their name.
    """
    at, size, tag = 0, len(page), _TAG
    ends: dict[tuple[str, str], int] = {}

    def following(mark: str, name: str, start: int) -> int:
        """Where the next begin or end tag of a name is; each place is looked for once."""
        if ends.get((mark, name), -1) < start:
            m = re.compile(rf"<{mark}{name}[\s/>]", re.I).search(page, start)
            ends[mark, name] = m.start() if m else size
        return ends[mark, name]

    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "", "", page[at:]
            return
        if open_ > at:
            yield "", "", page[at:open_]
        at = open_
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            end = page.find(">", at)
            if end >= 0:
                at = end + 1
                continue
        elif after == "/" or after.isalpha():
            m = tag.match(page, at)
            if not m and tag is _TAG and _LOOSE_TAG.match(page, at):
                tag = _LOOSE_TAG
                m = tag.match(page, at)
            if m:
                name, rest, at = m[2].lower(), m[3], m.end()
                if not m[1] and name in _DROPPED or name in _RCDATA and not m[1]:
                    if rest.endswith("/") and (name == "svg" or following("/", name, at) >= following("", name, at)):
                        yield "-", name, rest
                        continue
                    end = following("/", name, at)
                    if name in _RCDATA:
                        yield "<", name, rest
                        yield "", "", page[at:end]
                        yield "/", name, ""
                    else:
                        yield "-", name, rest
                    close = page.find(">", end)
                    at = size if close < 0 else close + 1
                    continue
                yield "/" if m[1] else "<", name, rest
                continue
            if page.find(">", at) < 0:  # no tag ends any more
                yield "", "", page[at:]
                return
        yield "", "", "<"
        at += 1


#: The end of a sentence in a piece of text, and least words of a piece that sentences are looked for in.
_STOP = re.compile(r"\w[\"')\u201d\u2019]*[.!?\u2026\u3002](?:\s|$)")
_PIECE = 5


def _stops(text: str, words: int) -> int:
    return len(_STOP.findall(text)) if words >= _PIECE else 0


def text_features(words: int, linked: int, stops: int) -> tuple[str, ...]:
    """What an element's text says of it: the share of its words in links together with how many sentences stand
    outside links; nothing for an element without words."""
    if not words:
        return ()
    share = "all" if linked >= 0.9 * words else "most" if 2 * linked >= words else "some" if linked else "none"
    return (f"#{share} in links, {min(stops, 2)} sentences",)


def _marks(rest: str) -> list[str]:
    """The words of an element's class, id and role."""
    return [w for m in _MARK.finditer(rest) for w in (m[1] or m[2] or m[3] or "").split()] if "=" in rest else []


def _parts(word: str) -> list[str]:
    return [p.lower() for p in _PART.findall(word)]


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], dict[str, float], float]:
    """(log odds of element features, scores of tags, score of a word), counted over ``LABELLED``.

    Features are names ('<nav'), names within a section ('<header|article'), words of class, id or role
    ('site-footer') and their parts ('~footer').  An element is content or surroundings if most of its words
    are by far; others tell nothing.  A feature's log odds say how much commoner it is in content.  Tags: the log odds of
    their names, shifted to lie below zero.  A word: the log odds that a word of a page is content.
    """
    counts, words = (Counter(), Counter()), [0, 0]  # of surroundings and of content
    for page in LABELLED:
        content, path, link = 0, [], False
        for kind, name, rest in tokens(page.replace("{{", "\1").replace("}}", "\2")):
            link = kind == "<" if name == "a" else link
            if not kind:
                for piece in re.split("([\1\2])", rest):
                    content = {"\1": 1, "\2": 0}.get(piece, content)
                    n = len(piece.strip("\1\2").split())
                    words[content] += n
                    for _, _, own, said in path:
                        own[content] += n
                        said[0] += n if link else 0
                        said[1] += 0 if link else _stops(piece, n)
            elif kind == "<":
                within = next((n for n, *_ in reversed(path) if n in _SECTIONS), "")
                marks = _marks(rest)
                found = {f"<{name}", f"<{name}|{within}", *marks, *(f"~{p}" for w in marks for p in _parts(w))}
                if name in _HOLDERS:
                    path.append((name, found, [0, 0], [0, 0]))
                else:
                    counts[content].update(found)
            elif any(n == name for n, *_ in path):
                while True:
                    n, found, own, said = path.pop()
                    if 5 * min(own) < max(own):
                        counts[own[1] > own[0]].update(found)
                        if n in _TELLING:
                            counts[own[1] > own[0]].update(text_features(sum(own), *said))
                    if n == name:
                        break
    total = [sum(v for f, v in c.items() if f[0] == "<" and "|" not in f) for c in counts]
    odds = {f: math.log((counts[1][f] + _UNSEEN) / (counts[0][f] + _UNSEEN) * total[0] / total[1]) for f in counts[0] | counts[1]}
    top = max(v for f, v in odds.items() if f[0] == "<" and "|" not in f)
    tags = {f[1:]: min(-0.05, 0.05 * (v - top)) for f, v in odds.items() if f[0] == "<" and "|" not in f}
    return odds, tags, max(1.0, math.log(words[1] / words[0]))


@lru_cache(maxsize=1 << 16)
def _mark_odds(word: str) -> float:
    """Log odds of a word of a class: its own where the labelled pages have it, else those of its last part,
    which names the thing, else its parts' mean."""
    odds = weights()[0]
    parts = [f"~{p}" for p in _parts(word)]
    for known in (word, *parts[-1:]):
        if known in odds:
            return odds[known]
    return sum(odds.get(p, 0.0) for p in parts) / max(1, len(parts))


@lru_cache(maxsize=1 << 16)
def element_odds(name: str, within: str, rest: str) -> float:
    """Log odds that an element holds content: its name's, in its section where that is known, and those
    of the words of its class, id and role."""
    odds = weights()[0]
    return odds.get(f"<{name}|{within}", odds.get(f"<{name}", 0.0)) + sum(map(_mark_odds, dict.fromkeys(_marks(rest))))


def best_run(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last of the run of largest total, from (score before it, own score) of each block; what
    stands before the first block of a run doesn't count.  Of equal runs, the one that ends first, and of
    those the shortest."""
    best, total, first, at, last = -math.inf, -math.inf, 0, 0, -1
    for k, (before, own) in enumerate(scores):
        if total + before > 0:
            total += before + own
        else:
            total, first = own, k
        if total > best:
            best, at, last = total, first, k
    return at, last


@dataclass(slots=True)
class _Element:
    name: str
    odds: float
    up: int  # the element around it
    words: int = 0  # not counting surroundings inside it
    linked: int = 0  # words in links, and ends of sentences outside them, of the whole element
    stops: int = 0
    first: int = 0  # event at which it begins
    last: int = 0
    away: bool = False  # surroundings


def _elements(page: str) -> tuple[list[tuple[str, str, str, int]], list[_Element]]:
    """(events, elements): tokens with the element that each lies in, and the elements in order of their
    beginnings; the first stands for the page."""
    events, all_, path, sections = [], [_Element("", 0.0, -1)], [0], [""]
    where: dict[str, list[int]] = {}  # places on the path by name
    link = False
    for kind, name, rest in tokens(page):
        if name in _HOLDERS:
            link = False
        if kind == "<" and name in _HOLDERS and not rest.endswith("/"):
            all_.append(_Element(name, element_odds(name, sections[-1], rest) if len(rest) < 400 else sum(map(_mark_odds, dict.fromkeys(_marks(rest)))), path[-1], first=len(events)))
            where.setdefault(name, []).append(len(path))
            path.append(len(all_) - 1)
            if name in _SECTIONS:
                sections.append(name)
        elif kind == "/" and name in _HOLDERS and where.get(name):
            place = where[name][-1]
            for e in path[place:]:
                all_[e].last = len(events)
                where[all_[e].name].pop()
                if all_[e].name in _SECTIONS:
                    sections.pop()
            events.append((kind, name, rest, path[place]))
            del path[place:]
            continue
        elif not kind:
            n = len(rest.split())
            inner = all_[path[-1]]
            inner.words += n
            inner.linked += n if link else 0
            inner.stops += 0 if link else _stops(rest, n)
        elif name == "a":
            link = kind == "<"
        events.append((kind, name, rest, path[-1]))
    for e in path:
        all_[e].last = len(events)
    odds, total = weights()[0], [e.words for e in all_]
    for k in range(len(all_) - 1, 0, -1):  # inner elements first
        e = all_[k]
        total[e.up] += total[k]
        all_[e.up].linked += e.linked
        all_[e.up].stops += e.stops
        if e.name in _TELLING:
            told = sum(odds.get(f, 0.0) for f in text_features(total[k], e.linked, e.stops))
            e.odds += min(TOLD if e.odds > CERTAIN else 0.0, told)
    return events, all_


def _judge(all_: list[_Element]) -> None:
    """Mark the elements that are surroundings: those whose log odds say so, unless one holds ``WRAPS`` times
    the words that stand outside all surroundings, and nothing outside it is called content.  Such an
    element wraps the page, so its marks tell nothing."""
    for e in reversed(all_):  # inner elements first
        if e.up >= 0 and e.odds > SURROUNDINGS:
            all_[e.up].words += e.words
    content = [e for e in all_ if e.odds > CONTENT and e.words]
    done, begun = min((e.last for e in content), default=math.inf), max((e.first for e in content), default=-1)
    kept = all_[0].words  # those outside all surroundings; those of a candidate come on top
    buried = [False]
    for e in all_[1:]:  # outer elements first
        inside = buried[e.up] or all_[e.up].away
        buried.append(inside)
        e.away = e.odds <= SURROUNDINGS
        if e.away and not inside and e.words > WRAPS * kept and done > e.first and begun < e.last:
            e.away = False
            kept += e.words


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by newlines; empty if there is none.

    Markup may be broken: what is never closed ends with the page, stray ends are passed over.
    """
    if not page:
        return ""
    odds, tags, word = weights()
    events, all_ = _elements(page)
    _judge(all_)
    blocks: list[str] = []
    scores: list[tuple[float, float]] = []
    begins: dict[int, int] = {}  # by content-like element, its first block
    spans: list[tuple[int, int]] = []  # first and last block of content-like elements
    cost, linked, link, muted, until = 0.0, 0, False, 0.0, -1
    hidden, deep = "", 0  # an inline element that is left out, and how many of its name are open
    text: list[str] = []

    def close_block() -> None:
        nonlocal cost, linked, muted
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            n = whole.count(" ") + 1
            told = muted and sum(odds.get(f, 0.0) for f in text_features(n, linked, _stops(whole, n)))
            if whole and not (muted and muted + told <= SURROUNDINGS):
                blocks.append(whole)
                scores.append((cost, word * (n - (1 - LINKED) * min(n, linked))))
                cost = 0.0
        text.clear()
        linked, muted = 0, 0.0

    for k, (kind, name, rest, e) in enumerate(events):
        if k < until:
            continue
        if hidden and (name in _INLINE or not kind):
            deep += (kind == "<") - (kind == "/") if name == hidden else 0
            if not deep:
                hidden = ""
                text.append(" ")
            continue
        hidden, deep = "", 0  # a block ends what an inline element has left open
        if kind == "<" and name in _MARKED and "=" in rest and any(odds.get(w, 0.0) <= 2 * SURROUNDINGS for w in _marks(rest)):
            hidden, deep = name, 1
            continue
        if not kind:
            text.append(rest)
            linked += len(rest.split()) if link else 0
        elif kind == "-":
            text.append(" ")
        elif name in _HOLDERS:
            close_block()
            link = False
            cost += tags.get(name, -0.1)
            own = all_[e]
            if kind == "<" and own.first == k and e:
                if own.away:
                    until, cost = own.last, cost + DETOUR
                elif own.odds > CONTENT:
                    begins[e] = len(blocks)
            elif kind == "/" and e in begins:
                spans.append((begins.pop(e), len(blocks) - 1))
        elif name in _FORMULA:
            if name in ("mtr", "mtd", "mspace"):
                text.append(" ")
        else:
            if name not in _INLINE:
                close_block()
                muted = min(0.0, sum(map(_mark_odds, dict.fromkeys(_marks(rest))))) if kind == "<" and "=" in rest and name not in _HEADINGS else 0.0
            elif name in ("br", "img", "option"):
                text.append(" ")
            elif name == "a":
                link = kind == "<"
            cost += tags.get(name, -0.1)
    close_block()
    spans += [(b, len(blocks) - 1) for b in begins.values()]
    if not blocks:
        return ""
    at, last = best_run(scores)
    # the innermost content-like element that holds the run, if there is one, is taken whole
    whole = min((s for s in spans if s[0] <= at and last <= s[1]), key=lambda s: s[1] - s[0], default=(at, last))
    return "\n".join(blocks[whole[0] : whole[1] + 1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row: main text and its number of code points.

    Null html is as empty and gives an empty text.  Whole pages are read, however long, in time linear in
    their length; of runs of equal score ``best_run`` says which one counts.  Repeated rows are read each;
    rows are neither dropped nor merged; an empty table gives an empty result; further columns aren't
    looked at.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
