"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
link density, length and stop-word density: good, bad, or ambiguous when it is
too short to tell. What a block sits in counts too: menus, headers and footers of
the page, sidebars, dialogs, hidden parts, and elements with a class or id
that names nothing but adverts, notices, comments and the like (BAD_WORDS, with
CARRIERS such as "box" or "list" beside them: "share-buttons", not "related-work")
are bad, and so is outside articles a part that starts with a heading such as "3 comments"; a main part, or an article
whose own class and id don't name such, is judged anew in a form and in what only a class or id
marks, other than as comments. A form is bad unless it holds the larger part of the page's good words,
as one around a whole page does; articles judged anew don't count for it. Inside articles and main parts links don't
make a block bad. A head without end tag ends where the body's content starts. Pass two gives each
ambiguous block the label of the nearest decided block of its own section; on
equal distance good wins, and the edges of an article or main part count as good.
Elsewhere a section without any decided block is bad. Where a page has no good block at all, pass two
takes ambiguous ones that end like a sentence, or have words enough, as good. In scripts
without spaces two letters count as a word, and common particles as stop words.

Scripts, styles, comments and markup go, and so do fallbacks of frames and media and
the notes of formulas; what noscript holds counts inside an article or main part only.
Character references are decoded; white
space inside a block becomes one space. Nothing is cut off or capped. Tags are read
in linear time: attributes are pairs of name and value, quotes count behind "=", and
once a tag has no end outside of quotes, quotes don't count for the rest of the page. Null and
empty pages give an empty text. A page's work depends on that page alone, so
there is no shuffle, and repeated rows give equal results.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that start and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style template iframe canvas audio video textarea title annotation annotation-xml".split())
BAD_TAGS = frozenset("nav footer aside menu button select dialog head datalist search".split())
#: What can stand in a head; anything else ends it.
HEAD_TAGS = frozenset("html head base link meta noscript script style template title".split())
MAIN_TAGS = frozenset(["article", "main"])
LIST_TAGS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION_TAGS = MAIN_TAGS | {"body", "section", "aside", "nav", "header", "footer", "form"}
#: Parts of class and id names that mark boilerplate, and what may stand beside them in a name that does.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup "
    "promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
CARRIERS = frozenset(
    "alert area articles bar block body bottom box button buttons card center container content header holder icon icons info inner item items law left link "
    "links list main message mobile outer page panel post posts primary reader readers right rows secondary section site slot small sticky stories thread top "
    "unit user wrap wrapper x".split()
)
#: Those of them that mark what readers wrote.
COMMENT_WORDS = frozenset("comment comments disqus feedback replies reply respond".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Very common words of the languages handled.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can do for from had has have he her his if in into is it its more no not of on "
    "one or our she so that the their there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann "
    "mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war werden wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et été il ils je la le les leur lui mais même ne nous on ou où par pas plus "
    "pour qu que qui sa se ses son sont sur tout un une vous "
    "al como con del desde donde el ella entre era esta este ha hay las lo los más me muy ni o para pero por porque sin sobre su sus "
    "también te tiene una y ya".split()
)

#: Particles of scripts without spaces that count as stop words.
PARTICLES = frozenset("的了是在和有不这我们他她它也就都而及与以为 のにはをがでともへやからまでした")
_UNSPACED = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
#: What heads a part that readers wrote.
_COMMENTS = re.compile(r"\s*(?:\d+\s+)?(?:(?:reader|readers'|user)\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\s*(?:\(\d+\)|:)?\s*", re.I)
_SENTENCE = re.compile(r"[.!?。！？…][\"'»”’)）」]*$")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTRIBUTE = re.compile(r"([^\s>/=][^\s>/=]*+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass; densities are shares of characters in links and of stop words."""

    max_link_density: float = 0.33
    min_words: int = 12
    long_words: int = 40
    min_stop_density: float = 0.2
    long_stop_density: float = 0.12


class TextBlock:
    """A piece of a page: raw text, characters in links, section number, whether in an article, number of its form (0: none)."""

    __slots__ = ("form", "in_main", "label", "linked", "section", "text")

    def __init__(self, text: str, linked: int, section: int, in_main: bool, form: int = 0):
        self.text, self.linked, self.section, self.in_main, self.form = text, linked, section, in_main, form
        self.label = ""


def _named(value: str, in_main: bool) -> int:
    """Whether one of the names in a class or id is that of boilerplate: 2 if of comments."""
    found = 0
    for name in value.split():
        parts = {x.lower() for x in _PART.findall(name)}
        if parts & BAD_WORDS and parts <= BAD_WORDS | CARRIERS:
            found = max(found, 2 if parts & COMMENT_WORDS else 1)
        elif not in_main and "header" in parts and parts <= CARRIERS:
            found = max(found, 1)
    return found


def _attributes(text: str) -> dict[str, str]:
    """Names in small letters with their values; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        quoted = value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1
        out.setdefault(name.lower(), _html.unescape(value[1:-1] if quoted else value))
    return out


def _marked(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """Whether an element marks what it holds as boilerplate: 1 only by its class or id, 2 otherwise and as comments."""
    if tag in BAD_TAGS or tag in ("header", "noscript") and not in_main:
        return 2
    if not attributes or tag in ("html", "body") or tag in MAIN_TAGS:
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in BAD_ROLES:
        return 2
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return 2
    return max(_named(attributes.get(k, ""), in_main) for k in ("class", "id"))


def _starts_anew(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is judged anew inside a form or a part that only a class or id marks."""
    return tag == "main" or tag == "article" and not any(_named(attributes.get(k, ""), True) for k in ("class", "id"))


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """What markup there is: begin, end, name of the tag in small letters ("" for comments and the like), whether it closes, its attributes. Send a position to go on from there."""
    pos, plain, last = 0, False, page.rfind(">")
    while (at := page.find("<" if pos < last else "<!--", pos)) >= 0:
        if at > last and not page.startswith("<!--", at):  # no tag ends from here on
            pos = at
            last = -1
            continue
        go = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = len(page) if end < 0 else end + 3
            go = yield at, pos, "", False, ""
        elif m := _NAME.match(page, at + 1):
            rest = None if plain else _REST.match(page, m.end())
            plain = rest is None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            pos = end
            go = yield at, pos, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        elif page[at + 1 : at + 2] in ("!", "?", "/") and (end := page.find(">", at + 2)) > at + 2:
            pos = end + 1
            go = yield at, pos, "", False, ""
        else:
            pos = at + 1
        pos = pos if go is None else go


def page_blocks(page: str) -> list[TextBlock]:
    """The blocks of a page in order, unlabelled, without what lies in parts marked as boilerplate."""
    out: list[TextBlock] = []
    # tag, blocks before it, then its place: mark (see _marked), in main, section, whether a list has begun since the last open item, form
    stack: list[tuple[str, int, int, bool, int, bool, int]] = []
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = sections = forms = pos = 0
    nowhere = (0, False, 0, False, 0)
    state = nowhere

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(TextBlock(text, linked, state[2], state[1], state[4]))
            parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not state[0]:
            piece = _html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if open_tags.get("a"):
                linked += len(piece.strip())

    def close(tag: str) -> None:
        nonlocal state
        while stack:
            name = stack.pop()[0]
            open_tags[name] -= 1
            if name == tag:
                break
        state = stack[-1][2:] if stack else nowhere

    def end_head() -> None:
        if open_tags.get("head"):
            end_block()
            while open_tags.get("head"):
                close("head")

    tags = _tags(page)
    go = None
    while True:
        try:
            begin, end, tag, closing, text = tags.send(go)
        except StopIteration:
            break
        go = None
        piece = page[pos:begin]
        if piece.strip():
            end_head()
        add(piece)
        pos = end
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if open_tags.get(tag):
                heads = tag in HEADINGS and len(stack) > 1 and stack[-1][0] == tag and stack[-2][0] in ("section", "div", "aside") and stack[-1][1] == stack[-2][1] == len(out) - 1
                close(tag)
                if heads and not state[1] and _COMMENTS.fullmatch(out[-1].text):
                    out.pop()
                    stack[-1] = (*stack[-1][:2], 2, *stack[-1][3:])
                    state = stack[-1][2:]
            continue
        if tag not in HEAD_TAGS:
            end_head()
        if tag in RAW_TAGS and not text.endswith("/"):
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            go = pos = over.end() if over else len(page)
            continue
        if tag in VOID_TAGS or text.endswith("/"):
            continue
        if tag in ("p", "li", "option", "a") and open_tags.get(tag) and (tag != "li" or not state[3]):
            close(tag)  # these end where the next one starts
        elif tag in BLOCK_TAGS and open_tags.get("p") and tag != "p":
            close("p")
        attributes = _attributes(text) if text else {}
        bad, main, section, listed, form = state
        if bad < 2 and (bad or form) and _starts_anew(tag, attributes):
            bad = form = 0
        else:
            bad = max(bad, _marked(tag, attributes, main))
        if tag == "form":
            forms += 1
            form = forms
        main = main or tag in MAIN_TAGS
        if tag in SECTION_TAGS:
            sections += 1
            section = sections
        listed = tag in LIST_TAGS or listed and tag != "li"
        state = (bad, main, section, listed, form)
        stack.append((tag, len(out), *state))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if page[pos:].strip():
        end_head()
    add(page[pos:])
    end_block()
    return out


def words_of(text: str) -> tuple[int, int]:
    """Words of a text, and stop words among them."""
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if text.isascii() or not (letters := _UNSPACED.findall(text)):
        return len(words), stops
    return len(words) + len(letters) // 2, stops + sum(c in PARTICLES for c in letters)


def decide(block: TextBlock, rules: BlockRules) -> str:
    """First pass: good, bad or ambiguous."""
    if not block.in_main and block.linked > rules.max_link_density * len(block.text):
        return "bad"
    words, stops = words_of(block.text)
    if words < rules.min_words:
        return "ambiguous"
    if stops >= (rules.long_stop_density if words >= rules.long_words else rules.min_stop_density) * words:
        return "good"
    return "ambiguous" if block.in_main or words < rules.long_words else "bad"


def judge_forms(blocks: list[TextBlock]) -> None:
    """Blocks of forms become bad, but for forms that hold more good words than what is outside of forms."""
    if any(b.form for b in blocks):
        good: dict[int, int] = {}
        for b in blocks:
            good[b.form] = good.get(b.form, 0) + (words_of(b.text)[0] if b.label == "good" else 0)
        for b in blocks:
            if b.form and good[b.form] <= good.get(0, -1):
                b.label = "bad"


def label(blocks: list[TextBlock], rules: BlockRules) -> None:
    """Both passes, in place."""
    sections: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        b.label = decide(b, rules)
        sections.setdefault(b.section, []).append(i)
    judge_forms(blocks)
    if not any(b.label == "good" for b in blocks):
        for b in blocks:
            if b.label == "ambiguous" and (_SENTENCE.search(b.text) or words_of(b.text)[0] >= rules.min_words):
                b.label = "good"
    for at in sections.values():
        distance: dict[int, tuple[int, bool]] = {}
        for order in (at, at[::-1]):
            last = (-1, False) if blocks[order[0]].in_main else None  # an article's edges count as good
            for k, i in enumerate(order):
                if blocks[i].label != "ambiguous":
                    last = (k, blocks[i].label == "bad")
                elif last:
                    distance[i] = min(distance.get(i, (1 << 60, True)), (k - last[0], last[1]))
        for i in at:
            if blocks[i].label == "ambiguous":
                _, bad = distance.get(i, (0, not blocks[i].in_main))
                blocks[i].label = "bad" if bad else "good"


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The good blocks of a page, one to a line."""
    blocks = page_blocks(page or "")
    label(blocks, rules)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, rules: BlockRules = BlockRules(), html: str = "html") -> DataFrame:
    """pages with the columns text and n_chars (its code points) in place of the html column."""

    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x, rules) for x in column.to_pylist()], pa.string())

    own = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    out = pages.select(*own, F.arrow_udf(texts, "string")(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
