"""Main text of web pages by two passes over blocks.

Pass one weighs each block by link density, length and the density of stop words: a block is text, is none, or
is undecided.  What the page itself marks as foreign is taken out before: navigation, footers, asides, menus,
dialogs, forms, what is hidden, and regions whose whole name says reader comments, advert, sidebar or notice
(comments, ad; not has-sidebar).  Other regions are evidence: in one that says that it is the article no
block is refused but for its links; in one whose name is foreign (promo, has-sidebar ...) a block must
be long to be text; in an article within a foreign region the densities decide alone, as where nothing is said.
Pass two gives the undecided blocks the label of the nearest decided neighbours; where there is evidence, of
those in the same region, and that of the evidence if there are none or, in a foreign region, if less than half
of it is text that stays.  In an article a list of links takes no block without links along.

The page is read once from left to right, in time that grows with its length whatever it holds."""
from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import texts_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in
into is it its just more most my no not of on one only or other our out over she so some such than that the their them then
there these they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für
hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor
war was wenn werden wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et être eux fait il ils je la le les leur lui mais même mon ne nos
notre nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y
al algo como con cuando del desde donde él el ella en entre era es esta este fue ha hay hasta la las le lo los más me mi muy
no nos o para pero por porque que quien se ser si sin sobre son su sus también tiene un una uno y ya yo
""".split())

#: Elements whose text isn't the page's.  RAW ones, unclosed, go on to the end as in HTML; the others are dropped
#: only if they are closed, and by the first closing tag; all but NESTING ones also end where one of their kind opens.
RAW = frozenset("script style textarea".split())
DROPPED = frozenset("noscript template svg math iframe object canvas audio video select button title".split())
NESTING = frozenset("template svg math object".split())
SAME = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in DROPPED | {"form"} | set(RAW)}
OPTIONS = re.compile(r"(?:\s*</?(?:option|optgroup)\b[^>]*>[^<]*)*", re.I)
OPEN = re.compile(r"<(?:!--|!\[CDATA\[|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])", re.I)
#: What matters inside a tag: its end, and a value in quotes.
STOP = re.compile(r">|=\s*[\"']")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose region matters to what is inside them.
REGION = frozenset("article aside blockquote body details dialog div dl figure footer form header html main menu nav ol section table td ul p span".split())
#: Tags that end an open cell of their table.
CELL = frozenset("td th tr tbody thead tfoot".split())
VOID = frozenset("br hr img input link meta wbr col area base embed source track".split())
#: Names, in class, id or role, of regions that aren't the article.
FOREIGN_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert[^\W_]*|banner|breadcrumbs?|byline|captcha|comments?(?:list|section|area)?|consent|contentinfo|cookies?|copyright|dialog|disqus|disclaimer|dropdown|footer|footnav|gdpr|"
    r"header|hidden|login|masthead|menu[^\W_]*|modal|nav[^\W_]*|newsletter|notice|notices|notification|overlay|pagination|pager|popup|promo[^\W_]*|recommend[^\W_]*|related|replies|reply|respond|search|share|sharing|"
    r"sidebar[^\W_]*|signup|skip|social|sponsor[^\W_]*|subscribe|tags?|teaser|toolbar|topbar|widget[^\W_]*|complementary|navigation|alert|responses|discussion)(?:$|[\s_-])", re.I)
OWN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|body|text)(?:$|[\s_-])", re.I)
#: Whole names of regions of reader comments, and of adverts, sidebars and notices.
COMMENTS = re.compile(r"(?:(?:reader|user|article|post|page)[-_]?)?comments?(?:[-_]?(?:list|area|section|threads?|container|wrapper|body|content|block|box|feed|item|text))?|disqus(?:[-_]thread)?", re.I)
ASIDE = re.compile(r"ads?|adverts?|advertisements?|advertising|ad[-_](?:slot|unit|container|banner|box|wrapper|block)|banner[-_]ad|sponsored|side[-_]?bar|(?:site|cookie|privacy|gdpr|consent)[-_](?:notice|banner|bar|consent|popup|message)|notices?", re.I)
ROLES = frozenset("navigation contentinfo complementary menu menubar dialog alertdialog search".split())
#: Elements that such a name takes out whole; an article's own mark goes before ASIDE and ROLES.
NAMED = frozenset("div section ol ul dl table td details blockquote".split())
HEADING = re.compile(r"(?:entry|article|post|story)[-_]?(?:header|head|title)", re.I)
NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")

#: Lengths in characters, densities as shares of words or characters.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINK_HIGH, LINK_MOST = 70, 200, 0.05, 0.12, 0.35, 0.8
GOOD, BAD, UNSURE = 1, 0, -1
#: The region of a form, whose blocks are left out.
GONE = -2
#: The region of an advert, a sidebar or a notice: its blocks are BAD, but an article in it is looked at.
ASIDES = -3
#: The first number of a foreign region.
FOREIGN = 2


def region_of(tag: str, attributes: str, outer: int | None, fresh: int) -> int | None:
    """What a region says of its blocks: BAD (then all inside is), ASIDES, GOOD, None (nothing), or from FOREIGN on the
    number of a foreign region: fresh, which is even, or an odd one if an article is in it."""
    if outer in (BAD, GONE):
        return outer
    if tag in ("nav", "footer", "aside", "menu", "dialog"):
        return BAD
    if outer == ASIDES and tag in ("article", "main"):
        return fresh + 1
    contested = outer is not None and outer >= FOREIGN and outer % 2 == 1
    aside, own, foreign = False, tag in ("article", "main"), tag == "header" and outer != GOOD and not contested
    if attributes:
        for name, value in NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return BAD
            names = value.split()
            if (tag in NAMED or tag == "article") and name != "role" and any(map(COMMENTS.fullmatch, names)):
                return BAD
            if tag in NAMED and (any(map(ASIDE.fullmatch, names)) if name in ("class", "id") else name == "role" and value.lower() in ROLES):
                aside = True
            if name in ("class", "id", "role") and tag not in ("body", "html") and FOREIGN_NAME.search(HEADING.sub("", value)):
                foreign = True
            if tag in ("div", "section", "td") and name in ("class", "id", "role", "itemprop") and OWN.search(value):
                own = True
    if aside or outer == ASIDES:
        return ASIDES
    if foreign:
        return fresh + (tag == "main" or tag == "article" and outer is None)
    if not own or outer == GOOD or contested:
        return outer
    return GOOD if outer is None else fresh + 1


class Tags:
    """Finds where tags end, each part of the page being looked at once."""

    def __init__(self, page: str):
        self.page, self.last, self.dead = page, page.rfind(">"), set()
        self.stop: re.Match | None = None
        self.since = 0

    def end(self, at: int) -> int:
        """The index behind the tag whose name ends at `at`.  Quoted values may hold any character; if a quote is
        never closed the tag ends at the next >, and if there is none, with the page."""
        begin, passed = at, []
        while at <= self.last:
            if self.stop is None or not self.since <= at <= self.stop.start():
                self.stop, self.since = STOP.search(self.page, at), at
            stop = self.stop
            if stop[0] == ">":
                return stop.end()
            if stop.start() in self.dead:
                break
            passed.append(stop.start())
            close = self.page.find(stop[0][-1], stop.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        plain = self.page.find(">", begin) if begin <= self.last else -1
        return plain + 1 if plain >= 0 else len(self.page)


def blocks(page: str) -> list[tuple[str, int, int | None]]:
    """(text, characters in links, region) of each block with text, in page order; none of a form's."""
    out: list[tuple[str, int, int | None]] = []
    stack: list[tuple[str, int | None]] = []
    opened: dict[str, list[int]] = defaultdict(list)  # tag -> its places in the stack
    unclosed: set[str] = set()
    fresh = count(FOREIGN, 2)
    region: int | None = None
    parts: list[str] = []
    linked, in_link, at, tags = 0, False, 0, Tags(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts)).replace("\x00", " ")).strip()
            if text and region != GONE:
                out.append((text, linked, BAD if region == ASIDES else region))
            parts, linked = [], 0

    def leave(i: int) -> None:
        nonlocal region
        while len(stack) > i:
            opened[stack.pop()[0]].pop()
        region = stack[-1][1] if stack else None

    def closed(tag: str) -> int:
        """Where the element that opened just before at is closed, or -1."""
        if tag in unclosed:
            return -1
        end = SAME[tag].search(page, at)
        while end and not end[1] and tag in NESTING:
            end = SAME[tag].search(page, end.end())
        if end is None:
            unclosed.add(tag)
        return tags.end(end.end()) if end and end[1] else -1

    while m := OPEN.search(page, at):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(raw)
            if in_link:
                linked += len(SPACE.sub(" ", html.unescape(raw)).strip())
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            mark = {"<!--": "-->", "<![cdata[": "]]>"}.get(m[0].lower(), ">")
            end = page.find(mark, m.end())
            at = end + len(mark) if end >= 0 else len(page)
            continue
        at = tags.end(m.end())
        attributes = page[m.end() : at - 1]
        if tag in RAW:
            end = SAME[tag].search(page, at) if not closing else None
            while end and not end[1]:
                end = SAME[tag].search(page, end.end())
            at = at if closing else tags.end(end.end()) if end else len(page)
            parts.append(" ") if parts else None
            continue
        if tag in DROPPED:
            if not closing and not (tag in ("svg", "math") and attributes.rstrip().endswith("/")):
                end = closed(tag)
                at = end if end >= 0 else OPTIONS.match(page, at).end() if tag == "select" else at
            parts.append(" ") if parts else None
            continue
        if tag in BLOCK:
            close()
            if not closing and opened["p"]:
                leave(opened["p"][-1])
        elif tag in ("br", "img", "wbr"):
            parts.append(" ") if tag == "br" else None
        if tag == "a":
            in_link = not closing
        if tag in CELL:
            if opened["td"] and opened["td"][-1] > (opened["table"][-1] if opened["table"] else -1):
                leave(opened["td"][-1])
                in_link = False
            if closing:
                continue
        if tag in REGION and tag not in VOID:
            if closing:
                if opened[tag] and (tag != "span" or opened[tag][-1] == len(stack) - 1):
                    i = opened[tag][-1]
                    if tag == "span" and stack[i][1] != (stack[i - 1][1] if i else None):
                        close()
                    leave(i)
                    in_link = False if tag != "span" else in_link
            elif not attributes.rstrip().endswith("/"):
                inner = GONE if tag == "form" and region != GONE and closed(tag) >= 0 else region_of(tag, attributes, region, next(fresh))
                if tag == "span" and inner != region:
                    close()
                opened[tag].append(len(stack))
                stack.append((tag, inner))
                region = inner
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def density_label(text: str, linked: int) -> int:
    if linked > LINK_HIGH * len(text):
        return BAD
    if "©" in text and len(text) < LONG:
        return BAD
    if len(text) < SHORT:
        return UNSURE
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH:
        return GOOD
    return UNSURE if stops >= STOP_LOW or len(text) >= LONG else BAD


def first_label(text: str, linked: int, region: int | None) -> int:
    if region == BAD or linked > LINK_MOST * len(text):
        return BAD
    label = density_label(text, linked)
    if region == GOOD:
        return label if label == GOOD else UNSURE
    if region is None or region % 2 == 1:
        return label
    return UNSURE if label == GOOD and len(text) < LONG else label


def settled(first: list[int], otherwise: int) -> list[int]:
    """Undecided blocks take their decided neighbours' label, where they differ the nearer one's, and at equal
    distance that of the block before; otherwise is the label if no block is decided."""
    left: list[tuple[int, int] | None] = []
    seen = None
    for i, x in enumerate(first):
        seen = (i, x) if x != UNSURE else seen
        left.append(seen)
    out, seen = [0] * len(first), None
    for i in range(len(first) - 1, -1, -1):
        seen = (i, first[i]) if first[i] != UNSURE else seen
        a, b = left[i], seen
        if first[i] != UNSURE:
            out[i] = first[i]
        elif a is None or b is None:
            out[i] = (a or b or (0, otherwise))[1]
        else:
            out[i] = a[1] if i - a[0] <= b[0] - i else b[1]
    return out


def labels(found: list[tuple[str, int, int | None]]) -> list[int]:
    """Final labels: undecided blocks follow the page's blocks where no region speaks, and else their region's."""
    first = [first_label(*b) for b in found]
    out = settled(first, BAD)
    regions: dict[int, list[int]] = defaultdict(list)
    for i, (_, _, region) in enumerate(found):
        if region is not None and region != BAD:
            regions[region].append(i)
    for region, own in regions.items():
        kept = sum(len(found[i][0]) for i in own if first[i] == GOOD)
        follow = region == GOOD or 2 * kept >= sum(len(found[i][0]) for i in own)
        for i, label in zip(own, settled([first[i] if follow or first[i] != UNSURE else BAD for i in own], GOOD if region == GOOD else BAD), strict=True):
            out[i] = GOOD if region == GOOD and not found[i][1] else label
    return out


def decided(page: str) -> tuple[int, int, int]:
    """How many blocks the page's own marks took out, how many pass one decided and how many pass two."""
    found = blocks(page)
    marked = sum(region == BAD for _, _, region in found)
    unsure = sum(first_label(*b) == UNSURE for b in found)
    return marked, len(found) - marked - unsure, unsure


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(text for (text, _, _), label in zip(found, labels(found), strict=True) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text per page.  A null or empty html, or one without main text, gives an empty text; a
    null url stays null.  Repeated rows are read each; an empty table gives no rows; other columns are not
    looked at.  A page is read whole, however long, in time that grows with its length."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((main_text(x) for x in texts_of(batch.column(2))), pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    return map_arrow(rows, run, f"page_id {rows.schema[0].dataType.simpleString()}, url string, text string")


def extract_report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
