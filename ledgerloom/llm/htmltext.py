"""HTML extraction by template deduction: tokens with equal occurrence vectors over pages of a host form classes.

A group are pages of one host with the same kind of content tags (large hosts are dealt to groups of about GROUP_PAGES and
GROUP_CHARS).  Tokens are tags with their place among the structural tags around them, and whole runs of text; tags that
HTML leaves open are closed where HTML says (a paragraph by the next block, a list item by the next, anything by its
parent's end), so that tags always nest.  Tokens that occur equally often on every page of the group form an equivalence
class; a class is valid if its tokens come in one order on all pages, and classes with larger vectors that stay within one
gap of another nest in it.  The structural tags of the class of tokens that occur once on every page are the template, its
gaps are slots, and only slots are extracted: without a template there is no text.  Slots inside the template's furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments) are left out, then those outside its article where it
has one; else those with the most text outside links, all between them and all whose text changes from page to page are
kept.  Left out of the kept slots are lists of links, nested classes whose blocks are lists of links or end in the same link
each time ("Reply", "Read more"), and furniture that only some pages have; other nested classes are the article's own
paragraphs, lists and sections and stay, as does text that all pages share.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, wide

#: Pages, and characters, of a group; a longer page stands alone.
GROUP_PAGES, GROUP_CHARS = 256, 8 << 20
#: Groups that one task reads, about.
TASK_GROUPS = 16
#: A class must occur on this share of a group's pages.
SUPPORT = 0.5
#: Fewer pages tell nothing of what recurs.
LEAST_PAGES = 3

#: Quoted values may hold what they like; with a "<" in them, so much of it that broken quotes cost no more than a page's length.
_QUOTED = r"(?:\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,4096}\"|'[^']{0,4096}')"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|textarea|title|iframe|xmp|noframes)\b(?:[^<>\"']|{_QUOTED})*+>.*?(?:</\1\s*>|\Z)"
    rf"|</?[a-zA-Z][^\s/<>]*+(?:[\s/]++|[^\s/<>=]++(?:\s*+=\s*+(?:{_QUOTED}|[^\s\"'<>][^\s<>]*+|(?=[>\"'])))?+|=)*+>|<[!?][^<>]*>|</?[a-zA-Z][^<>]*>", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
TEXT_BLOCKS = frozenset("p li td th tr dd dt option h1 h2 h3 h4 h5 h6 blockquote pre hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements whose end tag may be left out.
OPEN_ENDED = frozenset("html head body p li dt dd option optgroup tr td th thead tbody tfoot colgroup caption rb rt rp".split())
#: Start tag: the elements it ends, and those beyond which it looks for none.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
    "button": (frozenset(("button",)), frozenset(("td", "th", "table"))),
}
#: End tags and paragraphs look for their start no further than these.
SCOPES = frozenset("table td th caption object marquee template".split())
P_SCOPES = SCOPES | {"button"}
IN_HEAD = frozenset("base link meta title script style noscript template".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select dialog menu head noscript template svg object canvas audio video datalist".split())
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies notice consent popup modal newsletter subscribe sidebar menu nav navigation navbar breadcrumb breadcrumbs footer comment comments disqus replies share social related recommended widget login toolbar complementary contentinfo search".split())
CONTENT_TAGS = ("article", "main")
#: What ends a piece of furniture whose end tag is missing, unless its parent ends first.
RESUMES = HEADINGS | frozenset("p article main section".split())


class Token:
    __slots__ = ("name", "close", "words", "raw", "key", "end", "told", "holds")

    def __init__(self, name: str, close: bool, words: frozenset, raw: str) -> None:
        self.name, self.close, self.words, self.raw, self.key = name, close, words, raw, ""
        #: For a start tag: where its end is, whether its end tag is there or may be left out, and the content tags in it.
        self.end, self.told, self.holds = -1, True, False

    @property
    def furniture(self) -> bool:
        if self.name in FURNITURE_TAGS:
            return not (self.holds and self.name == "form")
        return not self.holds and self.name not in CONTENT_TAGS and not self.words.isdisjoint(FURNITURE_WORDS)


_NONE: frozenset = frozenset()


def tokens(page: str) -> list[Token]:
    """Tags that nest, and runs of text (no name); comments, declarations, scripts and their like are left out."""
    out: list[Token] = []
    open_: list[int] = []  # places of open elements in out
    now: Counter = Counter()  # how many of a name are open

    def end(depth: int, told: bool) -> None:
        """Ends all elements from `depth` on; told: whether the end tag of the one at depth is there."""
        while len(open_) > depth:
            start = out[open_.pop()]
            start.told = (told and len(open_) == depth) or start.name in OPEN_ENDED
            start.end = len(out)
            now[start.name] -= 1
            out.append(Token(start.name, True, start.words, ""))

    def find(names, stop) -> int:
        if not any(now[x] for x in names):
            return -1
        for i in range(len(open_) - 1, -1, -1):
            name = out[open_[i]].name
            if name in names:
                return i
            if name in stop:
                return -1
        return -1

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(Token("", False, _NONE, page[at : m.start()]))
        at = m.end()
        raw = m.group()
        if m.group(1) or raw[1] in "!?":
            continue
        name = _NAME.match(raw).group(1).lower()
        if raw[1] == "/":
            if name in INLINE:
                depth = len(open_) - 1
                while depth >= 0 and out[open_[depth]].name != name and out[open_[depth]].name in INLINE:
                    depth -= 1
                if depth >= 0 and out[open_[depth]].name == name:
                    end(depth, True)
                elif name == "br":
                    out.append(Token(name, False, _NONE, raw))
            else:
                depth = find((name,), SCOPES)
                if depth >= 0:
                    end(depth, True)
                elif name in SCOPES and (depth := find((name,), ())) >= 0:
                    end(depth, True)
            continue
        if name in ENDS_P and (depth := find(("p",), P_SCOPES)) >= 0:
            end(depth, True)
        if name in ENDS and (depth := find(*ENDS[name])) >= 0:
            end(depth, name != "button")
        elif name in HEADINGS and open_ and out[open_[-1]].name in HEADINGS:
            end(len(open_) - 1, True)
        elif open_ and out[open_[-1]].name == "head" and name not in IN_HEAD:
            end(len(open_) - 1, True)
        if "=" in raw:
            found = frozenset(w for g in _MARKS.findall(raw) for w in re.split(r"[\s_-]+", "".join(g).lower()) if w)
        else:
            found = _NONE
        t = Token(name, False, found, raw)
        if name in CONTENT_TAGS or name == "h1":
            for i in open_:
                if name != "h1" or out[i].name == "form":
                    out[i].holds = True
        if name not in VOID:
            open_.append(len(out))
            now[name] += 1
        out.append(t)
    if at < len(page):
        out.append(Token("", False, _NONE, page[at:]))
    end(0, False)
    return out


def _place(pages: list[list[Token]]) -> None:
    """Gives each token its key: what it is, and the structural tags open around it.

    A tag's class and id words count if they stand on enough of the pages: those of one page alone name no role.
    """
    seen: Counter = Counter()
    for page in pages:
        seen.update({(t.name, w) for t in page if t.words and not t.close for w in t.words})
    kept = {k for k, n in seen.items() if n >= SUPPORT * len(pages) and not any(c.isdigit() for c in k[1])}
    signs: dict[tuple, str] = {}
    for page in pages:
        open_: list[str] = []
        paths = [""]
        for t in page:
            path = paths[-1]
            if not t.name:
                text = _SPACE.sub(" ", t.raw).strip()
                t.key = f"{path}|{text}" if text else ""
                continue
            sign = signs.get((t.name, t.words))
            if sign is None:
                own = [] if t.name in CONTENT_TAGS or t.name in ("html", "body") else sorted(w for w in t.words if (t.name, w) in kept)
                sign = signs[t.name, t.words] = ".".join([t.name, *own])
            structural = t.name not in VOID and t.name not in INLINE and t.name not in TEXT_BLOCKS
            if t.close:
                if structural:
                    open_.pop()
                    paths.pop()
                t.key = f"{paths[-1]}|/{sign}"
            else:
                t.key = f"{path}|{sign}"
                if structural:
                    open_.append(sign)
                    paths.append("/".join(open_[-3:]))


class Amount:
    """Text of a slot, or of all blocks of a nested class."""

    __slots__ = ("plain", "linked", "links", "pages", "blocks", "forms", "same", "headed")

    def __init__(self) -> None:
        self.plain = self.linked = self.links = self.pages = self.blocks = 0
        self.forms: set[int] = set()
        self.same: set[str] | None = None
        self.headed = False

    def add(self, text: str, linked: bool) -> None:
        if linked:
            self.linked += len(text)
            self.links += 1
        else:
            self.plain += len(text)

    def end(self, said: set[str]) -> None:
        self.same = said if self.same is None else self.same & said

    @property
    def is_list(self) -> bool:
        """More text in links than outside, two links a page or more."""
        return self.linked > self.plain and self.links >= 2 * self.pages

    @property
    def ends_alike(self) -> bool:
        """Every block has a link of the same words, and none is a section under a heading."""
        return bool(self.same) and not self.headed and self.blocks >= 2 * LEAST_PAGES


class Template:
    """Template and nested classes of a group of pages; without pages it has no slot, and extracts nothing."""

    def __init__(self, pages: list[list[Token]]) -> None:
        _place(pages)
        counts = [Counter(t.key for t in page if t.key) for page in pages]
        seen: Counter = Counter()
        for c in counts:
            seen.update(c.keys())
        vectors: dict[tuple, list[str]] = defaultdict(list)
        for key, n in seen.items():
            if n >= max(1, SUPPORT * len(pages)):
                vectors[tuple(c.get(key, 0) for c in counts)].append(key)
        root = tuple([1] * len(pages))
        self.order = self._ordered(vectors.get(root, []), pages)
        self.rank = {k: i for i, k in enumerate(self.order)}
        #: Opening tags of valid nested classes: classes that recur within one slot of the template, each tag with its end.
        self.nested = self._nested({v: k for v, k in vectors.items() if v != root}, pages)
        self.content, furniture = self._enclosed(pages)
        #: Pages have content tags, but none is in the template: then slots hold more than the content.
        self.parts = not self.content and any(t.name in CONTENT_TAGS for page in pages for t in page)
        slots, blocks = self._amounts(pages)
        #: Slots and nested classes that are left out of the main text.
        self.lists = {s for s, a in slots.items() if len(pages) >= LEAST_PAGES and a.is_list}
        self.left = {k for k, a in blocks.items() if len(pages) >= LEAST_PAGES and (a.is_list or a.ends_alike)}
        self.chosen = self._chosen(slots, len(pages)) - furniture
        self.main = self.chosen - self.lists

    def _ordered(self, keys: list[str], pages: list[list[Token]]) -> list[str]:
        """Of structural tags that occur once a page, the most that come in the first page's order on every page: they bound the slots."""
        if not pages:
            return []
        wanted = {t.key for t in pages[0] if t.name and t.name not in INLINE and t.name not in TEXT_BLOCKS} & set(keys)
        kept = [t.key for t in pages[0] if t.key in wanted]
        for page in pages[1:]:
            place = {t.key: i for i, t in enumerate(page) if t.key in wanted}
            if all(place[a] < place[b] for a, b in zip(kept, kept[1:], strict=False)):
                continue
            tops: list[int] = []  # longest rising run of places
            last: list[int] = []
            before: list[int] = []
            for i, k in enumerate(kept):
                n = bisect_left(tops, place[k])
                before.append(last[n - 1] if n else -1)
                tops[n:n + 1], last[n:n + 1] = [place[k]], [i]
            i, chain = last[-1] if last else -1, []
            while i >= 0:
                chain.append(kept[i])
                i = before[i]
            kept = chain[::-1]
        return kept

    def walk(self, page: list[Token]) -> Iterator[tuple[Token, int]]:
        """(token, slot): the number of template tokens up to it."""
        slot, rank = 0, self.rank
        for t in page:
            at = rank.get(t.key)
            if at is not None:
                slot = at + 1
            yield t, slot

    def _nested(self, classes: dict[tuple, list[str]], pages: list[list[Token]]) -> set[str]:
        wanted = {k: v for v, keys in classes.items() if len(keys) >= 2 for k in keys}
        slots: dict[str, int] = {}
        opened: set[str] = set()
        for page in pages if wanted else []:
            for t, slot in self.walk(page):
                if t.key in wanted:
                    if slots.setdefault(t.key, slot) != slot:
                        del wanted[t.key]
                    elif t.name and not t.close and t.name not in INLINE and t.name not in VOID:
                        opened.add(t.key)
        return {k for k in opened & wanted.keys() if wanted.get("|/".join(k.split("|", 1))) == wanted[k]}

    def _enclosed(self, pages: list[list[Token]]) -> tuple[set[int], set[int]]:
        """Slots within the template's content tags, and those within its furniture."""
        first = {t.key: t for t in pages[0]} if pages else {}
        untold = {t.key for page in pages for t in page if not t.told}  # _kept finds where those end
        content: set[int] = set()
        furniture: set[int] = set()
        for i, key in enumerate(self.order):
            t = first[key]
            until = self.rank.get("|/".join(key.split("|", 1)))
            if t.close or until is None:
                continue
            inside = range(i + 1, until + 1)
            if t.name in CONTENT_TAGS:
                content.update(inside)
            elif t.furniture and key not in untold:
                furniture.update(inside)
        if content:  # headers of the article itself are its own
            for i, key in enumerate(self.order):
                t = first[key]
                until = self.rank.get("|/".join(key.split("|", 1)))
                if t.name == "header" and not t.close and until is not None and i + 1 not in content:
                    furniture.update(range(i + 1, until + 1))
        return content, furniture

    def _kept(self, page: list[Token], left: set[str]) -> Iterator[tuple[int, Token, int, bool]]:
        """(place, token, slot, whether inside a content tag) of a page without furniture that the template does not know of."""
        until, resume, within = -1, False, 0
        for i, (t, slot) in enumerate(self.walk(page)):
            if i < until and not (resume and t.name in RESUMES and not t.close):
                continue
            until = -1
            if t.name in CONTENT_TAGS:
                within += -1 if t.close else 1
            elif t.name and not t.close and t.end >= 0 and t.name not in ("html", "body") and (t.furniture or t.key in left or (t.name == "header" and not within and not t.holds)):
                until, resume = t.end, not t.told
            yield i, t, slot, within > 0

    def _amounts(self, pages: list[list[Token]]) -> tuple[dict[int, Amount], dict[str, Amount]]:
        """Text and links of each slot and of the blocks of each nested class, outside furniture."""
        slots: dict[int, Amount] = defaultdict(Amount)
        blocks: dict[str, Amount] = defaultdict(Amount)
        for page in pages:
            texts: dict[int, list[str]] = defaultdict(list)
            open_: list[tuple[str, int, set[str]]] = []
            heard: set[str] = set()
            linked = False
            for i, t, slot, within in self._kept(page, set()):
                while open_ and i >= open_[-1][1]:
                    blocks[open_[-1][0]].end(open_.pop()[2])
                if not t.name:
                    text = t.raw.strip()
                    if text and (within or not self.parts):
                        slots[slot].add(text, linked)
                        texts[slot].append(text)
                        for key, _, said in open_:
                            blocks[key].add(text, linked)
                            if linked:
                                said.add(_SPACE.sub(" ", text))
                elif t.name == "a":
                    linked = not t.close
                elif not t.close:
                    if t.name in HEADINGS:
                        for key, *_ in open_:
                            blocks[key].headed = True
                    if t.key in self.nested:
                        open_.append((t.key, t.end, set()))
                        blocks[t.key].blocks += 1
                        heard.add(t.key)
            while open_:
                blocks[open_[-1][0]].end(open_.pop()[2])
            for slot, said in texts.items():
                slots[slot].pages += 1
                slots[slot].forms.add(hash(" ".join(said)))
            for key in heard:
                blocks[key].pages += 1
        return slots, blocks

    def _chosen(self, slots: dict[int, Amount], n: int) -> set[int]:
        """Slots with the main text, lists included."""
        if self.content:
            return self.content
        if self.parts:
            return set(slots)
        most = max((a.plain for a in slots.values()), default=0)
        large = {s for s, a in slots.items() if a.plain * 5 >= most and a.plain}
        if not large:
            return {s for s, a in slots.items() if a.linked}
        # a headline or a closing line may be a slot of its own: what changes from page to page is no part of the template
        own = {s for s, a in slots.items() if n < LEAST_PAGES or len(a.forms) > 1 or a.pages < n}
        return large | own | set(range(min(large), max(large) + 1))

    def text(self, page: list[Token]) -> str:
        """Main text of a page: blocks joined by an empty line; a page that holds nothing but lists keeps them."""
        return self._text(page, self.main, self.left) or (self._text(page, self.chosen, set()) if self.lists or self.left else "")

    def _text(self, page: list[Token], wanted: set[int], left: set[str]) -> str:
        out: list[str] = []
        block: list[str] = []
        for _, t, slot, within in self._kept(page, left):
            name = t.name
            if not name:
                if slot in wanted and (within or not self.parts):
                    block.append(html.unescape(t.raw) if "&" in t.raw else t.raw)
            elif name not in INLINE:
                if block:
                    out.append(_SPACE.sub(" ", "".join(block)).strip())
                    block.clear()
            elif name in ("br", "img"):
                block.append(" ")
        out.append(_SPACE.sub(" ", "".join(block)).strip())
        return "\n\n".join(x for x in out if x)


def _layout(page: list[Token]) -> tuple[int, ...]:
    """Pages with none, one, and several of a content tag have different templates."""
    return tuple(min(2, sum(t.name == name and not t.close for t in page)) for name in CONTENT_TAGS)


def extract_group(pages: list[str | None]) -> list[str]:
    """Main text of pages of one host."""
    parsed = [tokens(p or "") for p in pages]
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i, page in enumerate(parsed):
        if page:
            alike[_layout(page)].append(i)
    out = [""] * len(parsed)
    for members in alike.values():
        template = Template([parsed[i] for i in members])
        for i in members:
            out[i] = template.text(parsed[i])
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page_html: str = "html", group_pages: int = GROUP_PAGES, group_chars: int = GROUP_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html counts as empty, its text is empty; pages without a host (null url) form groups of their own; rows that
    repeat keep their rows; hosts of any size are dealt to groups of at most about `group_pages` pages and `group_chars`
    characters, so that none fills a task; a group of one or two pages has slots between all its tags; columns other than
    the three named do not matter, whatever their names; an empty table gives an empty result.
    """
    small_batches(pages)
    at = f"coalesce(`{url}`, '')"
    host = F.lower(F.regexp_extract(F.expr(f"if(instr({at}, '://') > 0, substring({at}, instr({at}, '://') + 3), '')"), r"\A([^/?#]*)", 1))
    source = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page_html}`").alias("html"), host.alias("host"))
    size = F.greatest(F.count("*") / group_pages, F.sum(F.length("html")) / group_chars)
    groups = materialize(source.groupBy("host").agg(F.ceil(size).cast("int").alias("groups")))
    # only hosts of more than one group are looked up: a row for each few hundred pages at most
    many = groups.where("groups > 1").withColumnRenamed("host", "large")
    dealt = source.join(many, F.col("host") == F.col("large"), "left").withColumn("dealt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("groups")), F.lit(0)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        texts = extract_group(table.column("html").to_pylist())
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    # so many tasks that one's share of groups is the same at every size
    tasks = max(wide(pages.sparkSession), -(-(groups.agg(F.sum("groups")).first()[0] or 0) // TASK_GROUPS))
    dealt = dealt.select("page_id", "url", "html", "host", "dealt").repartition(tasks, "host", "dealt")
    return dealt.groupBy("host", "dealt").applyInArrow(run, "page_id long, url string, text string, n_chars long")
