"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by its density of stop words, its length, its
link density and by where it stands: menus, footers, sidebars and comments are boilerplate, and forms, headers and
elements named like notices or adverts are taken for it. Such a name or element counts for nothing if most stop words of the page
are in it and the prose is (a form around the whole page); an article element counts for nothing if the prose is outside.
Blocks that none of this decides are ambiguous; the second pass gives each the label of its nearest decided
neighbour. Pages are independent of each other, so each is worked on as a whole within a task.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their meaning in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "img"}
BOILERPLATE = {"nav", "footer", "aside", "head", "button", "select", "option", "svg", "canvas", "object", "dialog",
               "menu", "audio", "video", "map"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
         "menubar", "toolbar"}
# Words in class and id names of parts that are not the article.
HINTS = set("""ad ads adbox adsense advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs byline-share
consent cookie cookies copyright disclaimer disqus dropdown footer footnav gdpr header login
masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion
recommend recommended related search share sharing sidebar signin signup skip social sponsor sponsored
subscribe tags teaser toolbar topbar widget widgets""".split())
# Names of reader comments.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
# Parts of names that tell of a state or a setting, or of the article's own parts, not of what the element is.
STATES = {"has", "with", "without", "no", "not", "is", "show", "hide", "enable", "enabled", "disabled", "open", "closed", "active",
          "entry", "post", "article"}
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = set("""the of and to in a is that it was for on are as with his they at be this from have or by one had not but
what all were when we there can an your which their said if do will each about how up out them then she many some so these
would other into has more her two him see than been who its now
le la les de des du un une et est que qui dans pour pas sur par plus avec ce il elle au aux en sont ne se son sa ses ou
mais nous vous ils cette comme ont
der die das und ist von den mit zu im nicht ein eine auf für sich dem des es an als auch er so dass sie wird bei oder
einer um am sind noch wie einem über einen hat nach
el los las del y por con para una su al lo como más pero sus este ya o fue ha sí porque esta son entre cuando muy sin
sobre también me hasta hay donde quien""".split())

LONG_CHARS, SHORT_CHARS = 140, 70
LINKED, STOPPED = 0.33, 0.25
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: float
    boilerplate: bool
    vote: int  # the nearest element around it that is taken for boilerplate, 0 for none
    main: int
    heading: bool
    label: bool | None = field(default=None)
    stops: int = 0
    density: float = 0.0
    prose: bool = False


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the ``>`` that ends the tag at ``at``, past quoted attribute values; -1 if the tag never ends."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quote = min((q for q in (page.find('="', at, end), page.find("='", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        mark = page[quote + 1]
        if quote + 2 > last[mark]:
            return end  # an opened quote that nothing closes ends nothing
        at = page.find(mark, quote + 2) + 1


def _names(attributes: dict[str, str]) -> set[str]:
    """What the class and id names call an element: the first and last part of each whole name that tells of no state."""
    out = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [part for part in re.split(r"[^a-z0-9]+", name) if part]
        if parts and STATES.isdisjoint(parts):
            out |= {parts[0], parts[-1]}
    return out


def _is_boilerplate(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is boilerplate whatever is in it."""
    if name in BOILERPLATE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if "none" in attributes.get("style", "") and re.search(r"display\s*:\s*none", attributes["style"]):
        return True
    if name in ("html", "body"):
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return not COMMENTS.isdisjoint(named) or not COMMENTS.isdisjoint(_names(attributes))


def blocks_of(page: str | None) -> tuple[list[Block], list[int]]:
    """The blocks with text of a page, in order, and for every vote (numbered from 1) the vote around it."""
    page = page or ""
    last = {mark: page.rfind(mark) for mark in "\"'"}
    out: list[Block] = []
    around = [0]
    # open block elements: name, within boilerplate, nearest vote or 0, number of the main part or 0
    stack: list[tuple[str, bool, int, int]] = []
    texts: list[str] = []
    linked, in_link, breaks, mains, heading = 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, breaks
        text = SPACE.sub(" ", references.unescape("".join(texts))).strip()
        if text:
            bad, vote, main = stack[-1][1:] if stack else (False, 0, 0)
            out.append(Block(text, linked / len(text), bad, vote, main, heading))
        texts.clear()
        linked, breaks = 0, 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            texts.append(text)
            if not text.isspace():
                breaks = 0
                if in_link:
                    linked += len(SPACE.sub(" ", references.unescape(text)).strip())

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        named = NAME.match(page, start + 1 + closing)
        if not named:
            add("<")  # a bare character, not a tag
            at = start + 1
            continue
        end = _tag_end(page, named.end(), last)
        if end < 0:
            break  # a tag cut off at the end of the page
        name, inside, at = named[0].lower(), page[named.end():end], end + 1
        if name == "br":
            breaks += 1
            flush() if breaks > 1 else texts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        flush()
        if closing:
            if name.startswith("h") and name[1:].isdigit():
                heading = False
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    in_link = 0
                    break
            continue
        if name in RAW:
            if not inside.endswith("/"):
                stop = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
                close = page.find(">", stop.start()) if stop else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if name in VOID or inside.endswith("/") and name not in MAIN:
            continue
        if name[0] == "h" and name[1:].isdigit():
            heading = True
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(inside)}
        if re.search(r"(?:^|\s)hidden(?:\s|$)", inside):
            attributes["hidden"] = ""
        if name in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()  # these end where the next one begins
        bad, vote, main = stack[-1][1:] if stack else (False, 0, 0)
        own = _is_boilerplate(name, attributes)
        named = name in FORMS or attributes.get("role", "").lower() == "form" or (
            name not in ("html", "body") and not HINTS.isdisjoint(_names(attributes)))
        if name in MAIN and not own and not named:
            mains += 1
            bad, vote, main = False, 0, mains if not main else main
        elif name == "body":
            bad, vote = False, 0
        if named or name == "header" and not main:  # the header of an article is part of it
            around.append(vote)
            vote = len(around) - 1
        stack.append((name, bad or own, vote, main))
    flush()
    return out, around


def _stop_words(text: str) -> tuple[int, float]:
    """Number of stop words and their share of all words."""
    words = WORD.findall(text.lower())
    found = sum(w in STOP_WORDS for w in words)
    return found, found / len(words) if words else 0.0


def _place(blocks: Sequence[Block], around: Sequence[int]) -> bool:
    """Settles the votes on places by where stop words are; True if the page has an article element that counts.

    A vote is void if its element has more than half of the stop words and two blocks of prose at least, and the article
    elements have no prose. Article elements are void if that holds for what is outside of them and of boilerplate.
    """
    held, prose = [0] * len(around), [0] * len(around)
    total, in_main = 0, 0
    for b in blocks:
        if b.boilerplate or b.linked > LINKED:
            continue
        stops, density = _stop_words(b.text)
        b.stops, b.density = stops, density
        b.prose = len(b.text) >= LONG_CHARS and density >= STOPPED
        total += stops
        held[b.vote] += stops
        prose[b.vote] += b.prose
        in_main += b.prose and b.main > 0
    for k in range(len(around) - 1, 0, -1):  # an element within another has the higher number
        held[around[k]] += held[k]
        prose[around[k]] += prose[k]
    counts = [False] * len(around)
    for k in range(1, len(around)):
        void = not in_main and prose[k] >= 2 and 2 * held[k] > total
        counts[k] = counts[around[k]] or not void
    for b in blocks:
        b.boilerplate = b.boilerplate or counts[b.vote]
    has_main = any(b.main and not b.boilerplate for b in blocks)
    outside = [b for b in blocks if not b.main and not b.boilerplate and b.linked <= LINKED]
    if has_main and not in_main and sum(b.prose for b in outside) >= 2 and 2 * sum(b.stops for b in outside) > total:
        for b in blocks:
            b.main = 0
        return False
    return has_main


def classify(blocks: Sequence[Block], around: Sequence[int]) -> None:
    """Sets ``label`` of every block: True for the article."""
    has_main = _place(blocks, around)
    for b in blocks:  # first pass
        if b.boilerplate or b.linked > LINKED and not (b.heading and b.main) or has_main and not b.main:
            b.label = False
        elif len(b.text) >= SHORT_CHARS and b.density >= STOPPED:
            b.label = True
        elif len(b.text) >= (SHORT_CHARS if b.main else LONG_CHARS) and b.linked == 0:
            b.label = True  # long prose of another language, tables, code
    decided = [b.label for b in blocks]
    before, nearest = [(None, 0)] * len(blocks), [(None, 0)] * len(blocks)
    for direction, found in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), nearest)):
        seen, distance, part = None, 0, None
        for i in direction:
            if blocks[i].main and blocks[i].boilerplate:
                continue  # asides and forms within an article say nothing about its flow
            if blocks[i].main != part:
                seen, part = None, blocks[i].main  # neighbours are those of the same part of the page
            distance += 1
            if decided[i] is not None:
                seen, distance = decided[i], 0
            found[i] = (seen, distance)
    for i, b in enumerate(blocks):  # second pass
        if b.label is None:
            (left, l), (right, r) = before[i], nearest[i]
            sides = [(d, label) for label, d in ((left, l), (right, r)) if label is not None]
            if not sides:
                b.label = bool(b.main)
            elif len(sides) == 2 and l == r and left != right:
                b.label = bool(b.main) or b.heading
            else:
                b.label = min(sides)[1]
    if not has_main and not any(b.label for b in blocks):  # nothing is decided for an article: whatever is no boilerplate
        for b in blocks:
            b.label = not b.boilerplate and b.linked <= LINKED


def main_text(page: str | None) -> str:
    """The article's blocks, one per line."""
    blocks, around = blocks_of(page)
    classify(blocks, around)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, html: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``_carry`` and ``text`` per page; null or empty pages, and pages without an article, have an empty text.

    Broken markup is read as far as it goes: unclosed elements end with the page or where an article starts, a tag cut off
    at the end is left out, a lone ``<`` is text. Repeated pages are extracted each; an empty table gives no rows.
    """
    packed = pages.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = pa.array([main_text(page.as_py()) for page in part.column("_html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("_carry"), texts], names=["_carry", "text"])

    return packed.mapInArrow(run, f"_carry {packed.schema['_carry'].dataType.simpleString()}, text string")
