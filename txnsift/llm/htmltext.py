"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its block elements, told apart by their path (names and classes from the root), and its texts, told
apart by path and wording. Over the pages of one layout of a host (pages of the same elements down to `LAYOUT_DEPTH`), and
for elements also over all its pages, the occurrence vector of a token (how often it is on each page) is kept as a sum of hashes of
(page, count): equal vectors have equal sums, and any number of pages is gathered by one grouped sum. Tokens of one vector are an
equivalence class. A class is valid when it has `CLASS_TOKENS` tokens on `CLASS_PAGES` pages and nests: the parents of
all its elements and texts but one are in the class.

* The class that is once on every page is the root of the template. Its texts, on `TEXT_PAGES` pages, are the frame; what lies
  between its tokens are the open slots. The deepest root element that holds most of the text holds the slots of the result; it
  widens to an article or main element around it, or to the smallest root element that adds a main heading and little else.
* Valid classes below it that hold texts of their own are records with a fixed wording (a reader comment and its "Reply"). The wording goes; the
  whole record goes if it lies outside article and main and is no table row, figure or quotation.

Extraction walks a page once more and returns the open slots below the template's element, without records. Names only
break ties: elements that HTML defines as head, menus, footers, asides, forms and scripts are closed everywhere; class and id words
(the last word of a name that is not a structural one, so that `comments-open` or `share-price` close nothing) close an
element unless the template's element lies in it; an article inside the template's element narrows it when it holds most of
the text. Hosts of fewer pages, and pages that lack the template's element, rely on names alone: text inside article or main
elements, else all open text, else (nothing is open) what class words closed. Character references are decoded, white space inside a block
becomes one space, blocks are joined by one space; nothing else is changed. Template text stays where it is most of
a page's text: such pages are copies of each other.

Null and empty pages, and pages without text, give an empty text; null urls share the empty host; pages without elements
take no part in templates. Repeated rows are extracted each (they count as pages). Broken markup is read as far as it goes. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.llm.urlfilter import url_host
from txnsift.session import materialize

#: Tokens and pages of a valid class; pages on which a text of the template has to stand; share of the text.
CLASS_TOKENS, CLASS_PAGES, TEXT_PAGES, MAIN_SHARE = 3, 4, 20, 0.6
#: Depth of the elements that tell layouts apart: html, body and what lies directly in it.
LAYOUT_DEPTH = 3
#: Values (rows and template slots) up to which the templates of all hosts are broadcast.
BROADCAST_VALUES = 500_000
#: Pieces into which each host is split where templates are joined.
SALT = 16

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img script style template noscript".split()
)
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_CLOSED = frozenset(
    "head script style template noscript nav footer aside form button select option textarea iframe object svg canvas "
    "dialog menu audio video map datalist noembed noframes".split()
)
_MAIN = frozenset(["article", "main"])
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ENDS_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
# Words in a class or id, and roles, that close an element.
_CLOSED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login "
    "share sharing social related recommended comment comments disqus respond reply replies footer masthead copyright "
    "pagination pager skip toolbar widget response responses discussion reactions legal disclaimer topbar".split()
)
# Words of structure that may follow the word of a class or id that says what an element is.
_STRUCTURE = frozenset(
    "area bar block body box button buttons container content cta group header heading icons inner item items label link links list "
    "media panel posts region row section slot stories text thread title tools top bottom left right main unit wrap wrapper".split()
)
# First words of names that say what a page has or lacks.
_NEGATIONS = frozenset("has hide is no show with without".split())
# Elements that hold data in rows of their own, so that a repeated wording in them makes no frame of them.
_DATA = frozenset("blockquote dd dt figure li pre table td th tr".split())
#: What an element's name says to the choice of the template's element, as bits.
ARTICLE, HEADING, DATA = 1, 2, 4
_CLOSED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[^a-z0-9]+")


def _closes(value: str) -> bool:
    """Whether a class or id, in lower case, names something that is no main text."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if parts and parts[0] in _NEGATIONS:
            continue
        while len(parts) > 1 and (parts[-1] in _STRUCTURE or parts[-1][0].isdigit()):
            parts.pop()
        if parts and parts[-1].rstrip("0123456789") in _CLOSED_WORDS:
            return True
    return False


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def _attributes(name: str, rest: str) -> tuple[str, bool, bool]:
    """The label of an element (name and class words), whether it is closed by a class or id, and by other attributes."""
    if not rest or rest.isspace():
        return name, False, False
    label, worded, closed = name, False, False
    for key, *values in _ATTRIBUTE.findall(rest):
        value, key = "".join(values).lower(), key.lower()
        words = _WORDS.findall(value)
        if key in ("class", "id"):
            worded = worded or _closes(value)
            if key == "class" and words:
                label += "." + ".".join(sorted(set(words)))
        elif key == "role":
            closed = closed or not _CLOSED_ROLES.isdisjoint(words)
        else:
            closed = closed or key == "hidden" or value == "true"
    return label, worded, closed


class _Open:
    """An open element: its name, token of its path, depth, and what it means for text inside it.

    `soft` is the token of the innermost block that a class or id word closes, or 0.
    """

    __slots__ = ("closed", "depth", "hard", "main", "name", "soft", "token")

    def __init__(self, name: str, token: int, depth: int, closed: bool, main: int, hard: bool = False, soft: int = 0):
        self.name, self.token, self.depth, self.closed, self.main, self.hard = name, token, depth, closed, main, hard
        self.soft = soft


def walk(page: str, tokens: dict[tuple[int, str], int]):
    """Events of a page in order: ("element", token, depth, token of its parent, bits of its name) and, for text that no
    element name closes, ("text", path of tokens, text, main, soft).

    main is 2 inside an article or main element, 1 if a class or id word closes what encloses that, else 0. soft is the
    innermost element of the path that such a word closes, or 0.
    `tokens` remembers the numbers of paths between pages.
    """
    root = _Open("", 0, 0, False, 0)
    stack, parts, at = [root], [], 0
    opened: dict[str, int] = {}

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            yield "text", [e.token for e in stack if e.name not in _INLINE], text, top.main, top.soft

    def push(element):
        stack.append(element)
        opened[element.name] = opened.get(element.name, 0) + 1

    def end(names, until=frozenset(), stops_at_block=False):
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                for element in stack[i:]:
                    opened[element.name] -= 1
                del stack[i:]
                return
            if stack[i].name in until or (stops_at_block and stack[i].name not in _INLINE):
                return

    while at <= len(page):
        tag = _TAG.search(page, at)
        if not tag:
            if not stack[-1].closed:
                parts.append(html.unescape(page[at:]))
            break
        if tag.start() > at and not stack[-1].closed:
            parts.append(html.unescape(page[at : tag.start()]))
        at = max(tag.end(), at + 1)
        if not tag[2]:
            continue
        name = tag[2].lower()
        block = name not in _INLINE
        if block:
            yield from flush()
        if tag[1]:
            end({name}, stops_at_block=not block)
            continue
        if name in _ENDS_P:
            end({"p"}, frozenset(["table", "button", "object", "td", "th"]))
        if name in _ENDS_SAME:
            end(_ENDS_SAME[name], frozenset(["ul", "ol", "dl", "table", "select"]))
        top = stack[-1]
        label, worded, hard = _attributes(name, tag[3])
        hard = (hard and name not in ("html", "body")) or top.hard or name in _CLOSED or (name == "header" and not top.main)
        # words close neither html, body and main nor articles, but for articles inside another one (comments)
        worded = worded and name not in ("html", "body", "main") and not (name == "article" and not opened.get("article"))
        main, soft = top.main, top.soft
        # a word closes a block softly, so that the template may open it; inline elements and their text go
        closed = hard or top.closed or (worded and not block)
        if name in _MAIN and not hard and not worded:
            main = 1 if soft else (main or 2)
        elif block and (worded or (soft and main != 1)):
            main = 0
        if block:
            parent = top.token
            token = tokens.get((parent, label))
            if token is None:
                token = tokens[parent, label] = _hash(f"{parent}/{label}")
            bits = (ARTICLE if main and name in _MAIN else 0) | (HEADING if name == "h1" else 0) | (DATA if name in _DATA else 0)
            yield "element", token, top.depth + 1, parent, bits
            soft = token if worded else soft
        else:
            token = top.token
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else len(page)
            if not closed:
                parts.append(html.unescape(page[at:stop]))
            at = stop
            if close:
                push(_Open(name, token, top.depth + block, closed, top.main, hard, soft))
            else:
                break
        elif name not in _VOID:
            push(_Open(name, token, top.depth + block, closed, 0 if closed else main, hard, soft))
    yield from flush()


def _layout(shallow: set[int]) -> int:
    """The number of the layout of a page: of its distinct elements down to `LAYOUT_DEPTH`. 0 is all pages of a host."""
    return _hash(",".join(map(str, sorted(shallow)))) or 1


def _page_counts(page: str, tokens: dict) -> tuple[dict, dict, int]:
    """Of one page: elements {token: [count, depth, chars below, parent, bits]}, texts {token: [count, depth, chars, parent, bits]}, layout."""
    elements, texts, shallow = {0: [1, 0, 0, 0, 0]}, {}, set()
    for event in walk(page, tokens):
        if event[0] == "element":
            _, token, depth, parent, bits = event
            elements.setdefault(token, [0, depth, 0, parent, bits])[0] += 1
            if depth <= LAYOUT_DEPTH:
                shallow.add(token)
        else:
            path, text = event[1], event[2]
            for token in set(path):
                elements[token][2] += len(text)
            texts.setdefault(_text_token(path[-1], text), [0, len(path), 0, path[-1], ARTICLE if event[3] == 2 else 0])[0] += 1
    return elements, texts, _layout(shallow)


def _text_token(parent: int, text: str) -> int:
    return _hash(f"{parent}#{text}")


_COUNTS = (
    "host string, layout bigint, is_text boolean, token bigint, pages bigint, low bigint, high bigint, total bigint, chars bigint, "
    "depth bigint, parent bigint, bits bigint"
)
_VECTOR = ("pages", "low", "high", "total")


def _count(batches):
    """Sums over the pages of a partition, one row per host, layout (elements also 0 for all) and token. Pages without elements leave."""
    tokens: dict = {}
    sums: dict[tuple, list] = {}

    def rows():
        columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True))
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _COUNTS.split(", ")])

    for batch in batches:
        for host, page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = page.as_py()
            own = xxhash.xxh64_intdigest(f"{page_id}/{len(text)}")
            elements, texts, layout = _page_counts(text, tokens)
            if len(elements) == 1:
                continue
            marks: dict[int, int] = {}
            for is_text, groups, found in ((False, (0, layout), elements), (True, (layout,), texts)):
                for token, (n, depth, chars, parent, bits) in found.items():
                    mark = marks.get(n)
                    if mark is None:
                        mark = marks[n] = xxhash.xxh64_intdigest(f"{own}/{n}")
                    for group in groups:
                        _add(sums, (host, group, is_text, token), mark, n, chars, (depth, parent, bits))
            if len(tokens) > 100_000:
                tokens.clear()
            if len(sums) > 200_000:
                yield rows()
    if sums:
        yield rows()


def _add(sums: dict, key: tuple, mark: int, n: int, chars: int, fixed: tuple) -> None:
    found = sums.get(key)
    if found is None:
        sums[key] = [1, mark & 0x7FFFFFFF, mark >> 33, n, chars, *fixed]
    else:
        found[0] += 1
        found[1] += mark & 0x7FFFFFFF
        found[2] += mark >> 33
        found[3] += n
        found[4] += chars


def choose_main(elements: list[tuple[int, int, int, int, int]]) -> int | None:
    """The element that holds the slots of the result, of a root class (token, parent, depth, chars, bits) with the page itself (token 0)."""
    known = {e[0]: e for e in elements}

    def above(token):
        while token in known and token != 0:
            token = known[token][1]
            yield token

    whole = known[0][3]
    holds = [e for e in elements if whole and e[3] >= MAIN_SHARE * whole]
    if not holds:
        return None
    best = max(holds, key=lambda e: (e[2], e[3], e[0]))
    around = [t for t in (best[0], *above(best[0])) if t in known and known[t][4] & ARTICLE]
    if around:
        return around[-1]
    within = {best[0], *above(best[0])}
    for heading in sorted((e for e in elements if e[4] & HEADING and e[3]), key=lambda e: (-e[3], e[0])):
        meet = next((t for t in above(heading[0]) if t in within), None)
        if meet in known and known[meet][2] < best[2] and known[meet][3] <= best[3] + heading[3] + best[3] // 2:
            return meet
    return best[0]


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, templates): of each layout and of all pages (0) the element that holds the text, the frame's texts and wordings of records, and records.

    `pages` has host, page_id and html (not null). Hosts and layouts without a valid root class have none.
    """
    counted = arrow_map(pages.select("host", "page_id", "html"), _count, _COUNTS)
    sums = counted.groupBy("host", "layout", "is_text", "token").agg(
        *[F.sum(c).alias(c) for c in (*_VECTOR, "chars")], *[F.min(c).alias(c) for c in ("depth", "parent", "bits")]
    )
    # tokens of too few pages are in no valid class
    sums = materialize(sums.filter(F.col("pages") >= CLASS_PAGES), "tokens")
    # token 0 is the page itself: its vector is the root class
    roots = sums.filter("not is_text and token = 0").select("host", "layout", *[F.col(c).alias(f"root_{c}") for c in _VECTOR])
    in_root = F.lit(True)
    for c in _VECTOR:
        in_root = in_root & (F.col(c) == F.col(f"root_{c}"))
    marked = sums.join(roots, ["host", "layout"]).withColumn("in_root", in_root)
    # no more than the shortest page of the layout has
    root = marked.filter("in_root").groupBy("host", "layout").agg(
        F.collect_list(F.when(~F.col("is_text"), F.struct("token", "parent", "depth", "chars", "bits"))).alias("elements"),
        F.collect_list(F.when(F.col("is_text") & (F.col("pages") >= TEXT_PAGES), F.col("token"))).alias("texts"),
    )
    other = marked.filter("not in_root")
    held = other.filter("not is_text").select("host", "layout", *_VECTOR, F.col("token").alias("parent"), F.lit(True).alias("nested"))
    classes = other.join(held, ["host", "layout", *_VECTOR, "parent"], "left").groupBy("host", "layout", *_VECTOR).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("nested").alias("n_nested"),
        F.min(F.when(F.col("nested").isNull(), F.struct("is_text", "token", "bits"))).alias("top"),
        F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("wording"),
        F.max(F.when(F.col("is_text"), F.col("bits").bitwiseAND(F.lit(ARTICLE)))).alias("inside"),
    )
    valid = classes.filter(
        (F.col("n") >= CLASS_TOKENS) & (F.col("n_nested") == F.col("n") - 1) & ~F.col("top.is_text") & (F.col("pages") >= TEXT_PAGES)
    ).filter(F.size("wording") > 0)
    frame = (F.col("inside") == 0) & (F.col("top.bits").bitwiseAND(F.lit(DATA)) == 0)
    records = valid.groupBy("host", "layout").agg(  # a class has three tokens on four pages
        F.flatten(F.collect_list("wording")).alias("wordings"), F.collect_list(F.when(frame, F.col("top.token"))).alias("records")
    )
    none = F.expr("cast(array() as array<bigint>)")
    own = root.filter(F.size("elements") >= CLASS_TOKENS).join(records, ["host", "layout"], "left")
    own = own.select("host", "layout", "elements", F.concat("texts", F.coalesce("wordings", none)).alias("texts"), F.coalesce("records", none).alias("records"))

    def decide(batches):
        for batch in batches:
            found = [
                choose_main([tuple(e[c] for c in ("token", "parent", "depth", "chars", "bits")) for e in elements])
                for elements in batch.column(2).to_pylist()
            ]
            columns = [*batch.columns[:2], pa.array(found, pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "main", "texts", "records"])

    decided = arrow_map(own, decide, "host string, layout bigint, main bigint, texts array<bigint>, records array<bigint>")
    # at most one layout for CLASS_PAGES pages
    templates = decided.groupBy("host").agg(F.collect_list(F.struct("layout", "main", "texts", "records")).alias("templates"))
    return materialize(templates, "templates")


def _size(found: list[tuple[str, bool]]) -> int:
    return sum(len(t) for t, _ in found)


def main_text(
    page: str | None, main: int | None, texts: frozenset, tokens: dict, layouts: dict | None = None, records: frozenset = frozenset()
) -> str:
    """The text of one page under the template of its host and, by `layouts` {number: (main, texts, records)}, of its layout."""
    inside, enclosed, shut, slots, narrow, anywhere = [], [], [], [], [], []
    events = list(walk(page or "", tokens))
    if layouts:
        own = layouts.get(_layout({e[1] for e in events if e[0] == "element" and e[2] <= LAYOUT_DEPTH}))
        if own:
            main, texts, records = own
    for event in events:
        if event[0] == "element":
            continue
        _, path, text, in_main, soft = event
        if not records.isdisjoint(path):
            continue
        found = text, _text_token(path[-1], text) in texts
        opened = not soft
        if main is not None and main in path:
            opened = opened or path.index(soft) <= path.index(main)
            if opened:
                slots.append(found)
                if in_main:
                    narrow.append(found)
        if soft:
            (enclosed if in_main == 1 else shut).append(found)
            continue
        anywhere.append(found)
        if in_main:
            inside.append(found)
    if slots:
        chosen = narrow if 2 * _size(narrow) > _size(slots) else slots
    else:
        chosen = inside or (enclosed if _size(enclosed) > _size(anywhere) else anywhere) or shut
    if 2 * _size([c for c in chosen if c[1]]) <= _size(chosen):
        chosen = [c for c in chosen if not c[1]]
    return " ".join(t for t, _ in chosen)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, text and n_chars (code points) of every page."""
    slim = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        url_host(F.col(url)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    templates = deduce_templates(slim)
    size = templates.agg(F.sum(F.aggregate("templates", F.lit(1), lambda n, t: n + 2 + F.size(t["texts"]) + F.size(t["records"])))).first()[0] or 0
    if size <= BROADCAST_VALUES:
        found = slim.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        own = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        found = own.join(salted, ["host", "salt"], "left")

    def extract(batches):
        tokens: dict = {}
        known: dict[str, dict] = {}
        for batch in batches:
            ids, urls, pages_, hosts, templates = (batch.column(i) for i in range(5))
            out = []
            for page, host, own in zip(pages_, hosts.to_pylist(), templates, strict=True):
                layouts = known.get(host)
                if layouts is None:
                    if len(known) > 100:
                        known.clear()
                    layouts = known[host] = {
                        t["layout"]: (t["main"], frozenset(t["texts"]), frozenset(t["records"])) for t in own.as_py() or ()
                    }
                main, texts, records = layouts.get(0, (None, frozenset(), frozenset()))
                out.append(main_text(page.as_py(), main, texts, tokens, layouts, records))
                if len(tokens) > 100_000:
                    tokens.clear()
            sizes = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), sizes], [page_id, url, "text", "n_chars"])

    id_type = pages.schema[page_id].dataType.simpleString()
    schema = f"`{page_id}` {id_type}, `{url}` string, text string, n_chars bigint"
    return arrow_map(found.select("page_id", "url", "html", "host", "templates"), extract, schema)
