"""Main text of web pages by wrappers: union-free regular expressions learnt from the pages of a host.

1. A page becomes a stream of tokens: block elements open and close, and between them stand texts.
   Inline markup is part of a text; scripts, styles, comments and the like are skipped.
2. A stream is an expression of its own: an element is its tag with its class words, and what it
   holds is a sequence of elements and texts. Equal neighbours become a repeated part, an element
   that comes back after others turns the sequence into a repeated group of optional parts.
3. Expressions of a host are aligned one after the other. Parts that only one side has become
   optional, parts in another order make a repeated group, texts that differ become slots and texts
   that don't stay constant. There are no alternatives, so each text has one place in the result.
4. In the result the slots of the main text are chosen: inside article or main elements where there
   are any, else in the whole body, without boilerplate (navigation, notices, adverts, reader comments ...),
   lists of links, and texts that stay the same on all pages while the rest changes.
5. Each page's texts in chosen slots are its main text. A page that has none, since it marks no article
   where its host's others do, is read by the slots chosen without marks, else by its own expression.

Expressions merge like counts: first within a partition, then in rounds of a bounded number of parts, so
a host with a third of the pages never is one task. Equal pages of a partition count once.

Defined results: a null or empty page, or one without main text, gives an empty text; a page without a host
in its url shares the expressions of the other ones without. Repeated rows each give their text, null ids
stay null. Very long pages are read whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage


@dataclass(frozen=True)
class WrapperConfig:
    #: Elements deeper than this are aligned as one.
    depth: int = 48
    #: Differently marked elements of a tag in one sequence; beyond, they are aligned as one.
    marks: int = 64
    #: Pages that a text has to stay the same on to be a constant.
    constant_pages: int = 5
    #: Constants and lists of links are left out while the rest has this share of the characters.
    rest: float = 0.8
    #: Share of the page's characters outside links that an article has at least.
    marked: float = 0.3
    #: Share of characters in links that makes a slot a list of links, where no article is marked.
    linked: float = 0.5
    #: Hosts that a task holds before it hands them on.
    held: int = 2000
    #: Parts of a host that are merged in one step.
    fan_in: int = 64
    #: A host with more than one in so many pages is dealt into ``salts`` parts.
    hot: int = 1000
    salts: int = 64


INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
#: Elements whose content is no text of the page.
SKIPPED = {
    tag: re.compile(f"</{tag}\\s*>", re.I)
    for tag in "script style template noscript textarea title iframe noembed noframes select button object svg canvas audio video datalist".split()
}
#: What an opening element closes, up to the element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Elements that are boilerplate by their tag; header only outside an article.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist tooltip status".split())
#: Class and id words of boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted sidebar sidenav aside rail menu "
    "nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup signin login register paywall social share sharing sharethis follow related recommended "
    "recommendations teaser teasers trending popular widget widgets pagination pager paging comment comments commentlist disqus respond reply replies "
    "responses feedback skip hidden copyright disclaimer legal tags tagcloud rating search searchform outbrain taboola".split()
)
#: The part of them that also counts on an article element.
NOT_AN_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser recommended".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
TEXT = "#"


def _element(tag: str, attributes: str, in_article: bool) -> str:
    """The key of an element: its tag and class words, with ``!`` before it if it is boilerplate."""
    tag = tag.lower()
    marks, roles, hidden = [], set(), False
    if attributes:
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                marks += [w for part in value.split() for w in [".".join(WORD.findall(part))] if w]
            elif name == "role":
                roles.update(value.split())
            elif name == "itemprop" and value == "articlebody":
                roles.add("article")
            hidden |= bool(bare) or (name == "hidden") or (name == "aria-hidden" and value == "true")
            hidden |= name == "style" and "display:none" in value.replace(" ", "")
    words = {w for m in marks for w in m.split(".")}
    if tag == "article" or "article" in roles or tag == "main" or "main" in roles:
        kind = "article" if tag == "article" or "article" in roles else "main"
        poor = hidden or bool(words & NOT_AN_ARTICLE)
        return ("!" if poor else "") + kind
    if tag in ("html", "body"):
        return tag
    poor = hidden or tag in BOILERPLATE_TAGS or bool(roles & ROLES) or bool(words & BOILERPLATE_WORDS) or (tag == "header" and not in_article)
    return ("!" if poor else "") + ".".join([tag, *sorted(set(marks))])


Found = tuple[tuple[str, ...], tuple[int, ...], str, int]


def blocks(page: str, depth: int = 48) -> Iterator[Found]:
    """Each text of a page in order: element keys from the root, their numbers in the page, the text with
    white space made one space, and its characters in links."""
    path: list[str] = []
    numbers: list[int] = []
    tags: list[str] = []  # all open elements; those beyond ``depth`` have no place in the path
    held: list[str] = []
    in_link = linked = serial = 0

    def text_before() -> Iterator[Found]:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                yield tuple(path), tuple(numbers), text, min(linked, len(text))
            held.clear()
        linked = 0

    def close(n: int) -> None:
        del tags[n:], path[n:], numbers[n:]

    def enter(tag: str, attributes: str) -> None:
        nonlocal serial
        if len(tags) < depth:
            serial += 1
            path.append(_element(tag, attributes, any(k in ("article", "main") for k in path)))
            numbers.append(serial)
        tags.append(tag)

    end, last = 0, page.rfind(">")
    at = page.find("<")
    while 0 <= at < last:
        m = TOKEN.match(page, at)
        if not m:
            at = page.find("<", at + 1)
            continue
        if at > end:
            held.append(page[end:at])
            if in_link:
                linked += len(page[end:at].strip())
        end = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        closing, attributes = m.group(1) or m.group(4), (m.group(3) or m.group(6) or "").strip()
        if tag in SKIPPED and not closing:
            if tag not in ("script", "style", "noscript", "template"):
                yield from text_before()
            if not (tag == "svg" and attributes.endswith("/")):
                stop = SKIPPED[tag].search(page, end)
                end = stop.end() if stop else len(page)
        elif tag in INLINE:
            if tag == "br" or tag == "img":
                held.append(" ")
            elif tag == "a":
                in_link = not closing
            if closing and tag in tags:
                yield from text_before()
                close(len(tags) - 1 - tags[::-1].index(tag))
            elif attributes and not closing and tag not in VOID and _element(tag, attributes, True)[0] == "!":
                yield from text_before()
                enter(tag, attributes)
        elif tag and tag not in SKIPPED:
            yield from text_before()
            in_link = 0
            if closing:
                if tag in tags:
                    close(len(tags) - 1 - tags[::-1].index(tag))
            elif tag == "html" or tag == "body":
                if tag not in tags:
                    close(0 if tag == "html" else min(len(tags), 1))
                    enter(tag, attributes)
            elif tag not in VOID:
                shut, bound = CLOSES.get(tag, ((), ()))
                for n in range(len(tags) - 1, -1, -1):
                    if tags[n] == "p" or tags[n] in shut:
                        close(n)
                    elif not bound or tags[n] in bound:
                        break
                enter(tag, attributes)
        at = page.find("<", end)
    tail = page[end:]
    broken = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that the page's end cuts off
    held.append(tail[: broken.start()] if broken else tail)
    yield from text_before()


class Part:
    """An element or a slot of an expression with what all pages of it hold."""

    __slots__ = ("pages", "many", "loop", "last", "kids", "chars", "linked", "value")

    def __init__(self):
        self.pages, self.many, self.loop, self.last = 1, False, False, None
        self.kids: dict[str, Part] = {}
        self.chars = self.linked = 0
        self.value = None  # hash of a text that is the same everywhere, 0 once it differs

    def plain(self) -> list:
        kids = {k: p.plain() for k, p in self.kids.items()}
        return [self.pages, self.many, self.loop, self.chars, self.linked, self.value, kids]

    @classmethod
    def of(cls, plain: list) -> Part:
        part = cls()
        part.pages, part.many, part.loop, part.chars, part.linked, part.value, kids = plain
        part.kids = {k: cls.of(p) for k, p in kids.items()}
        return part

    def step(self, key: str) -> Part:
        """The part that the next token of the stream belongs to."""
        part = self.kids.get(key)
        if part is None:
            part = self.kids[key] = Part()
        elif self.last == key:
            part.many = True
        elif self.last is not None and self._before(key, self.last):
            self.loop = True
        part.last = None
        self.last = key
        return part

    def _before(self, a: str, b: str) -> bool:
        return next(k for k in self.kids if k in (a, b)) == a


def expression(found: list[Found]) -> Part:
    """The expression of one page."""
    root = Part()
    before: tuple[int, ...] = ()
    for path, numbers, text, linked in found:
        part = root
        for k, key in enumerate(path):
            entered = k < len(before) and before[k] == numbers[k]
            part = part.kids[key] if entered else part.step(key)
        part = part.step(TEXT)
        part.chars += len(text)
        part.linked += linked
        value = xxhash.xxh64_intdigest(text) or 1
        part.value = value if part.value is None else 0
        before = numbers
    return root


def align(x: Part, y: Part, config: WrapperConfig = WrapperConfig()) -> Part:
    """The expression of the pages of both; ``x`` is changed. Its depth is bounded by config.depth."""
    x.pages += y.pages
    x.many |= y.many
    x.loop |= y.loop
    x.chars += y.chars
    x.linked += y.linked
    x.value = x.value if x.value == y.value else 0
    if list(x.kids) == list(y.kids):
        for key, kid in y.kids.items():
            align(x.kids[key], kid, config)
        return x
    # shared parts in another order make a repeated group
    x.loop |= [k for k in x.kids if k in y.kids] != [k for k in y.kids if k in x.kids]
    order, rest = [], list(x.kids)
    for key in y.kids:  # parts that only one side has are optional and keep their neighbours
        if key not in x.kids:
            order.append(key)
        elif key in rest:
            n = rest.index(key) + 1
            order += rest[:n]
            del rest[:n]
    both = {}
    for key in [*order, *rest]:
        mine, other = x.kids.get(key), y.kids.get(key)
        both[key] = align(mine, other, config) if mine and other else mine or other
    x.kids = both
    _generalise(x, config)
    return x


def _generalise(part: Part, config: WrapperConfig) -> None:
    """Elements of one tag with more than config.marks different marks become one repeated part."""
    if len(part.kids) <= config.marks:
        return
    by_tag: dict[str, list[str]] = {}
    for key in part.kids:
        by_tag.setdefault(key.partition(".")[0], []).append(key)
    for tag, keys in by_tag.items():
        marked = [k for k in keys if k != tag]
        if len(marked) > config.marks:
            one = part.kids.pop(tag, None) or part.kids.pop(marked.pop())
            for key in marked:
                align(one, part.kids.pop(key), config)
            one.many = True
            part.kids[tag], part.loop = one, True


def render(part: Part, key: str = "", pages: int | None = None) -> str:
    """The expression as text: ``?`` optional, ``+`` repeated, ``#`` a slot and ``"#"`` a constant text."""
    inner = " ".join(render(p, k, part.pages) for k, p in part.kids.items())
    inner = f"({inner})+" if part.loop else inner
    out = ('"#"' if part.value else "#") if key == TEXT else f"<{key}>{inner}</{key}>" if key else inner
    return out + ("+" if part.many else "") + ("?" if pages is not None and part.pages < pages else "")


def main_slots(root: Part, config: WrapperConfig = WrapperConfig(), marks: bool = True) -> list[tuple[str, ...]]:
    """Paths of the slots that hold the main text; without ``marks``, of pages that mark no article on such a host."""
    found: list[tuple[tuple[str, ...], Part]] = []
    stack: list[tuple[tuple[str, ...], Part]] = [((), root)]
    while stack:
        path, part = stack.pop()
        for key, kid in part.kids.items():
            if key == TEXT:
                found.append((path, kid))
            else:
                if marks or key.lstrip("!") not in ("article", "main"):
                    stack.append(((*path, key), kid))

    def poor(keys):
        return any(k.startswith("!") for k in keys)

    def inside(kind, strict):
        """Slots in elements of a kind and not in boilerplate there; ``strict``: nor in boilerplate around it."""
        at = {path: path.index(kind) for path, _ in found if kind in path}
        return [(path, part) for path, part in found if path in at and not poor(path if strict else path[at[path] :])]

    def amount(slots):
        return sum(part.chars - part.linked for _, part in slots)

    kept = [(path, part) for path, part in found if not poor(path)]
    most, marked = amount(kept), False
    for kind, strict in (("article", True), ("main", True), ("article", False), ("main", False)):
        slots = inside(kind, strict)
        if slots and amount(slots) >= config.marked * (most if strict else 0):
            kept, marked = slots, True
            break
    if not kept:  # a form around the whole page
        kept = [(path, part) for path, part in found if not poor(k for k in path if not k.startswith("!form"))]
    total = sum(part.chars for _, part in kept)

    def heading(path):
        return any(re.fullmatch(r"h[1-6](\..*)?", k) for k in path)

    if not marked:
        plain = [(path, part) for path, part in kept if part.linked <= config.linked * part.chars or heading(path)]
        kept = plain if sum(p.chars for _, p in plain) >= config.rest * total or plain else kept
        total = sum(part.chars for _, part in kept)
    least = config.constant_pages
    varying = [(path, part) for path, part in kept if not part.value or part.pages < least or heading(path)]
    if sum(part.chars for _, part in varying) >= config.rest * total:
        kept = varying
    return sorted(path for path, _ in kept)


def _host() -> Column:
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def expressions(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """host and expression (JSON): one row per host, from all its pages."""
    schema = "host string, expression string"

    def packed(held):
        columns = [pa.array(list(held), pa.string()), pa.array([json.dumps(e.plain()) for e in held.values()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "expression"])

    def read(batches):
        held, seen = {}, set()
        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"]):
                page = page.as_py()
                key = (host, xxhash.xxh128_digest(page))
                if key in seen:  # an equal page says nothing new
                    continue
                seen.add(key)
                new = expression(list(blocks(page, config.depth)))
                held[host] = align(held[host], new, config) if host in held else new
                if len(held) > config.held or len(seen) > 1 << 18:
                    yield packed(held)
                    held, seen = {}, set()
        if held:
            yield packed(held)

    def merge(table: pa.Table) -> pa.Table:
        # the order of the parts decides only the order of optional parts, so it is made the same in every run
        parts = [Part.of(json.loads(p)) for p in sorted(table["expression"].to_pylist())]
        for part in parts[1:]:
            align(parts[0], part, config)
        return pa.table({"host": table["host"][:1], "expression": pa.array([json.dumps(parts[0].plain())], pa.string())})

    narrow = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).where("html <> ''")
    parts = cut_lineage(narrow.mapInArrow(read, schema))
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts
        several = -(-most // config.fan_in)
        dealt = parts.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(several)))
        parts = cut_lineage(dealt.groupBy("host", "part").applyInArrow(merge, schema))


def wrappers(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """host, n_pages (different ones), wrapper (the expression as text), slots (paths of the main text, as text)
    and unmarked (those of pages that mark no article)."""

    def run(batches):
        for batch in batches:
            parts = [Part.of(json.loads(p)) for p in batch["expression"].to_pylist()]
            columns = [
                batch["host"],
                pa.array([p.pages for p in parts], pa.int64()),
                pa.array([render(p) for p in parts], pa.string()),
                *(pa.array([["/".join(s) for s in main_slots(p, config, marks)] for p in parts], pa.list_(pa.string())) for marks in (True, False)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "n_pages", "wrapper", "slots", "unmarked"])

    found = expressions(pages, config)
    return found.mapInArrow(run, "host string, n_pages long, wrapper string, slots array<string>, unmarked array<string>")


def main_text(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """page_id, url, text and n_chars of every page: its blocks in main slots, joined by two line feeds.

    Slots are few bytes a host, pages are many: a host with more than one in config.hot pages (there
    are at most config.hot such hosts) has its pages dealt into salted parts, so that none is one task.
    """
    slots = cut_lineage(wrappers(pages, config).select("host", "slots", "unmarked"))
    narrow = pages.select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    counts = cut_lineage(narrow.groupBy("host").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * config.hot > total).select("host", F.lit(config.salts).alias("salts")))
    salted = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    rules = cut_lineage(slots.join(hot, "host", "left").select(F.col("host").alias("_host"), "slots", "unmarked", salted.alias("_salt")))
    dealt = narrow.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = dealt.join(rules, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")

    def run(batches):
        for batch in batches:
            texts = []
            for page, *choices in zip(batch["html"], batch["slots"].to_pylist(), batch["unmarked"].to_pylist()):
                found = list(blocks(page.as_py() or "", config.depth))
                for chosen in choices:
                    kept = [text for path, _, text, _ in found if "/".join(path) in (chosen or ())]
                    if kept:
                        break
                if not kept and found:
                    own = set(main_slots(expression(found), config))
                    kept = [text for path, _, text, _ in found if path in own]
                texts.append("\n\n".join(kept))
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    ids = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "slots", "unmarked").mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
