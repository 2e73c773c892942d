"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper is a sequence of block elements, each with a body that is a wrapper too, a count from lo to hi (0: optional, over
1: repeated), groups of elements that repeat together, and text slots. A page's token stream is a wrapper without
options; two wrappers are aligned, and what does not match becomes optional, what stands in a row repeated, texts that
differ a slot. Elements of one tag that stand for each other with different classes become one with the classes that
they share. Alignment is applied page by page within a task, then to the tasks' wrappers of a host in two rounds, so every
page counts, and no task gathers a host's pages. A wrapper does not grow with them: classes with digits are no part of it,
it is no deeper than DEEPEST, and an element of more than WIDE different children knows them by their tags alone.

A host has a wrapper for each kind of its pages (with <article>, with <main>, with neither), from its distinct pages. The
wrapper says where the articles are: in the deepest element that holds most of the text that varies and is not in links.
Text within <article> or <main> counts twice there, and if such an element lies around or in the one found, it is the
root. Where no element but the body holds the articles, the wrapper says which texts are the same on all pages.

What is none of the article's is told by tags and roles, and by whole names of classes and ids. A name that only has such a
word in it (`market-share`, `share-it`) says nothing alone: the wrapper decides, a text there goes if it is the same on
all of the host's pages. An element that holds the page's <article> or <main> is kept whatever it is called, and a form if
it holds most of the page.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .urls import host_of

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "strike strong sub sup time tt u var wbr".split()
)
SKIP = set(
    "head nav footer aside form script style noscript template iframe svg math button select textarea object canvas "
    "dialog menu title audio video datalist".split()
)
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Names of a class or id that mark a block as not of the article, and names that are put together of two words.
COMMENTS = set("comment comments commentlist reply replies respond disqus".split())
MARKS = COMMENTS | set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice "
    "notices alert share sharing social related recommended newsletter subscribe signup login popup modal overlay "
    "pagination pager toolbar widget".split()
)
_PAIRS = [
    ("site global top bottom primary secondary main left right footer header sidebar", "nav navbar menu navigation sidebar footer"),
    ("site global", "header banner"), ("cookie cookies consent gdpr", "banner notice bar consent popup"),
    ("related recommended", "posts articles links stories news"), ("share social sharing", "buttons bar links icons"),
    ("comment comments", "list form section area thread wrapper"), ("ad ads advert", "container slot unit banner box wrapper"),
    ("newsletter login signup search", "form signup box"), ("breadcrumb", "nav list"),
]
COMPOUNDS = {f"{a}-{b}" for first, second in _PAIRS for a in first.split() for b in second.split()}
NEVER_SKIPPED = {"html", "body", "main", "article"}
#: What markup says of a page, the surest first: its kind.
KINDS = ("article", "main")
#: A text that this many distinct pages share, and all of the host, is fixed; if less than one part in VARIES of all text
#: varies, the pages are copies and nothing is fixed.
LEAST_PAGES, VARIES = 3, 10
P_ENDS_BEFORE = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS_BEFORE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
#: Blocks that hold text, not articles.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr".split())
SALTS = 64
#: Blocks open within each other at most; those below are not opened, but separate texts and are skipped all the same.
DEEPEST = 100
#: Different children of an element in a wrapper, and a longest common sequence's cells, that are told apart.
WIDE, CELLS = 64, 4_000_000
#: Rules of hosts that may be broadcast: their summed bytes; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: Comments, declarations, tags (their quotes may hold a `>`; if they are not closed, the first `>` ends the tag), and a
#: tag that the page breaks off in.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|"
    r"<(?:/?)(?:[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    """soft: skipped for its name alone, or as a form, so that what it holds may still be the article."""

    __slots__ = ("tag", "key", "skip", "soft", "parts", "parent", "depth")

    def __init__(self, tag: str, key: str, skip: bool, soft: bool, parent: Element | None):
        self.tag, self.key, self.skip, self.soft, self.parent, self.parts = tag, key, skip, soft, parent, []
        self.depth = 0 if parent is None else parent.depth + 1


def _names(names: str) -> set[str]:
    """Whole names, without a number at the end (`ad-2`, `comment_17`)."""
    return {re.sub(r"[-_]?\d+\Z", "", n).replace("_", "-") for n in names.lower().split()}


def _classify(tag: str, attrs: str, parent: Element) -> tuple[str, bool, bool]:
    """The element's key (tag and classes without digits), whether it is none of the article's, and whether only softly."""
    if not attrs or attrs.isspace():
        found = {}
    else:
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    names = _names(f"{found.get('class', '')} {found.get('id', '')}")
    key = tag
    if found.get("class") and tag not in NEVER_SKIPPED:
        classes = sorted({c for c in re.split(r"[\s.+!#]+", found["class"]) if c and not any(map(str.isdigit, c))})
        key = ".".join([tag, *classes])
    if tag in NEVER_SKIPPED and not (tag == "article" and names & {"comment", "comments", "reply"}):
        return key, False, False
    in_article = False
    if tag == "header" or "header" in names:
        up = parent
        while up is not None and not in_article:
            in_article, up = up.tag == "article", up.parent
    hard = (
        tag in SKIP - {"form"}
        or (tag == "header" and not in_article)
        or found.get("role", "").lower() in ROLES
        or bool(names & COMMENTS)
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    marked = names & (MARKS | COMPOUNDS)
    soft = tag == "form" or bool(marked and not (in_article and marked == {"header"}))
    return key, hard or soft, soft and not hard


def _weight(element: Element) -> int:
    """Characters of text that is not in links, nor skipped below the element."""
    chars = 0
    for part in element.parts:
        if isinstance(part, tuple):
            chars += 0 if part[1] else len(part[0].strip())
        elif not part.skip:
            chars += _weight(part)
    return chars


def _soften(page: Element) -> None:
    """Keeps elements that are softly skipped and hold the page's content: if no <article> or <main> stands elsewhere, those
    around one; and a form that holds more text than all that is kept without it."""

    def around(element: Element) -> bool:
        holds = False
        for part in element.parts:
            if isinstance(part, Element) and (part.soft or not part.skip):
                if part.tag in KINDS and not part.skip or around(part):
                    part.skip, holds = False, True
        return holds

    def forms(element: Element) -> Iterator[Element]:
        for part in element.parts:
            if isinstance(part, Element):
                if part.skip and part.soft and part.tag == "form":
                    yield part
                elif not part.skip:
                    yield from forms(part)

    if not _find(page, lambda e: e.tag in KINDS):
        around(page)
        for form in list(forms(page)):
            if _weight(form) > _weight(page):
                form.skip = False


def parse(html: str) -> Element:
    """The tree of block elements; a part is an element or a pair (text, is it in a link). Inline elements are text, but
    for spans, which may be of a kind that is skipped."""
    root = top = Element("#root", "#root", False, False, None)
    at, links = 0, 0
    deep: list[Element] = []  # elements within an element that is DEEPEST, which takes their parts

    def text(end: int) -> None:
        if end > at and not any(e.skip for e in deep):
            top.parts.append((html[at:end], links > 0))

    def border() -> None:
        top.parts.append(Element("div", "div", False, False, top))

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(n)
            break
        text(m.start())
        at = m.end()
        name = m[2]
        if name is None:
            broken = re.match(r"<(/?)([a-zA-Z][^\s/>]*)(.*)>\Z", m[0], re.S)
            if broken is None:
                continue
            m = broken
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif tag == "br":
                top.parts.append((" ", links > 0))
        elif closing and any(e.tag == tag for e in deep):
            while deep.pop().tag != tag:
                pass
            if tag != "span":
                border()
        elif tag == "span" and closing:
            top = top.parent if top.tag == "span" else top
        elif closing:
            up = top
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                top, links = up.parent, 0
                deep.clear()
        elif top.depth >= DEEPEST and tag not in VOID and not m[3].endswith("/"):
            while deep and (tag in ENDS_BEFORE.get(deep[-1].tag, ()) or (deep[-1].tag == "p" and tag in P_ENDS_BEFORE)):
                deep.pop()
            if tag != "span":
                border()
                links = 0
            deep.append(Element(tag, *_classify(tag, m[3], top), top))
        else:
            if tag in P_ENDS_BEFORE:
                up = top
                while up.parent is not None and up.tag == "span":
                    up = up.parent
                if up.tag == "p":
                    top = up.parent
            while tag in ENDS_BEFORE.get(top.tag, ()):
                top = top.parent
            found = Element(tag, *_classify(tag, m[3], top), top)
            top.parts.append(found)
            if tag not in VOID and not m[3].endswith("/"):
                top, links = found, (0 if tag != "span" else links)
    _soften(root)
    return root


def _squeeze(pieces: list[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


# A wrapper is a list of nodes [key, lo, hi, body]; the body of a slot, key "#", is [pages, chars, link chars, hash or
# null if the text varies]; the key of a group that repeats together is "+" and its members' keys.


def page_wrapper(element: Element) -> list:
    nodes, texts = [], []

    def slot() -> None:
        found = _squeeze([t for t, _ in texts])
        if found:
            linked = len(_squeeze([t for t, in_link in texts if in_link]))
            nodes.append(["#", 1, 1, [1, len(found), linked, _hash(found)]])
        texts.clear()

    for part in element.parts:
        if isinstance(part, tuple):
            texts.append(part)
        elif part.tag == "span":
            texts.append(("" if part.skip else _span_text(part), False))
        else:
            slot()
            nodes.append(["!" + part.key, 1, 1, []] if part.skip else [part.key, 1, 1, page_wrapper(part)])
    slot()
    nodes = _fold(nodes)
    return nodes if len(nodes) <= WIDE else _by_tags(nodes)


def _span_text(element: Element) -> str:
    return "".join(p[0] if isinstance(p, tuple) else "" if p.skip else f" {_span_text(p)} " for p in element.parts)


def _fold(nodes: list, longest: int = 4) -> list:
    """Neighbours with the same key become one that repeats; neighbouring equal runs of up to `longest` keys a group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _join(out[-1], node, beside=True)
        else:
            out.append(node)
    for size in range(2, longest + 1):
        i = 0
        while i + 2 * size <= len(out):
            a, b = out[i : i + size], out[i + size : i + 2 * size]
            name = "+" + " ".join(x[0] for x in a)
            if [x[0] for x in a] == [x[0] for x in b]:
                both = [name, 2, 2, [_join(x, y) for x, y in zip(a, b)]]
                if i and out[i - 1][0] == name:
                    out[i - 1 : i + 2 * size] = [_join(out[i - 1], both, beside=True)]
                else:
                    out[i : i + 2 * size] = [both]
            elif i and out[i - 1][0] == name:
                out[i - 1 : i + size] = [_join(out[i - 1], [name, 1, 1, a], beside=True)]
            else:
                i += 1
    return out


def _join(a: list, b: list, beside: bool = False) -> list:
    """Two nodes of one key: one after the other, or alternatives."""
    lo, hi = (a[1] + b[1], a[2] + b[2]) if beside else (min(a[1], b[1]), max(a[2], b[2]))
    if a[0] == "#":
        x, y = a[3], b[3]
        return ["#", lo, hi, [x[0] + (not beside) * y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else None]]
    return [a[0], lo, hi, align(a[3], b[3])]


def _classes(key: str) -> set[str]:
    return set(key.split(".")[1:])


def _tag(key: str) -> str:
    return key.split(".")[0]


def _resolve(a: list, b: list) -> list:
    """What stands between two matches: elements of one tag that share a class are one, with the classes that they share;
    so are two that are left alone with each other. All else is optional."""
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            same = x[0][0] not in "+#" and _tag(x[0]) == _tag(y[0])
            if same and (_classes(x[0]) & _classes(y[0]) or len(a) == len(b) == 1):
                key = ".".join([_tag(x[0]), *sorted(_classes(x[0]) & _classes(y[0]))])
                both = _join([key, *x[1:]], [key, *y[1:]])
                return [*_resolve(a[:i], b[:j]), both, *_resolve(a[i + 1 :], b[j + 1 :])]
    return [[x[0], 0, *x[2:]] for x in [*a, *b]]


def align(a: list, b: list) -> list:
    """The wrapper of both: the longest common sequence of keys is matched, and _resolve what is left between two matches."""
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka == kb:
        return [_join(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    if n * m > CELLS:
        return _by_tags([*a, *b])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    only_a: list = []
    only_b: list = []

    def gap() -> None:
        out.extend(_resolve(only_a, only_b) if len(only_a) * len(only_b) <= CELLS // 64 else [[x[0], 0, *x[2:]] for x in only_a + only_b])
        only_a.clear()
        only_b.clear()

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[i] == kb[j]:
            gap()
            out.append(_join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            only_a.append(a[i])
            i += 1
        else:
            only_b.append(b[j])
            j += 1
    gap()
    # Two neighbours of one key that alternatives have made are one that repeats.
    folded: list = []
    for node in out:
        if folded and folded[-1][0] == node[0]:
            last = folded[-1]
            folded[-1] = [node[0], min(last[1], node[1]), last[2] + node[2], _join(last, node)[3]]
        else:
            folded.append(node)
    return folded if len(folded) <= WIDE else _by_tags(folded)


def _by_tags(nodes: list) -> list:
    """The nodes with one for each key, where optional ones have no classes; if these are still too many, nor have the
    others. Groups are known as their members."""
    for least in (1, 1 << 62):
        found: dict[str, list] = {}
        left = list(reversed(nodes))
        while left:
            key, lo, hi, body = left.pop()
            if key[0] == "+":
                left += reversed(body if lo else [[x[0], 0, *x[2:]] for x in body])
                continue
            key = key if lo >= least else _tag(key)
            old = found.get(key)
            found[key] = [key, lo, hi, body] if old is None else [key, old[1], old[2] + hi, _join(old, [key, lo, hi, body])[3]]
        if len(found) <= WIDE:
            break
    return list(found.values())


def _doubtful(key: str) -> bool:
    """Whether a class of the key has a word of MARKS in it."""
    return any(MARKS & set(re.split(r"[^a-z]+", c.lower())) for c in _classes(key))


def content_rule(wrapper: list, pages: int, kind: str = "") -> dict:
    """mark: the kind if the elements of that tag hold the articles, else null; root: keys from the page's top to the
    element that holds them, [] for the whole page; same: _place of texts that all pages share and that go, by the path
    from the page's top, or within the mark. These are all such texts if the root is no narrower than the body, and within
    a narrower one those in elements whose names leave a doubt."""
    slots: list[tuple[tuple, int, bool, int, str | None]] = []

    def walk(nodes: list, path: tuple, marked: bool) -> None:
        for key, _, _, body in nodes:
            if key == "#":
                n, chars, linked, text = body
                slots.append((path, max(chars - linked, 0), marked, n, text))
            elif key[0] == "+":
                walk(body, path, marked)
            elif key[0] != "!":
                walk(body, (*path, key), marked or key == kind)

    walk(wrapper, (), False)
    shared = [text is not None and pages >= LEAST_PAGES and n >= pages for _, _, _, n, text in slots]

    def doubts(under: tuple = (), cut: str = "") -> list[str]:
        found = set()
        for (path, _, _, _, text), all_pages in zip(slots, shared):
            below = path[path.index(cut) + 1 :] if cut in path else path[len(under) :]
            if all_pages and (cut in path if cut else path[: len(under)] == under) and any(map(_doubtful, below)):
                found.add(_place(below if cut else path, text))
        return sorted(found)

    fixed = [not marked and text is not None and pages >= LEAST_PAGES and n >= pages for _, _, marked, n, text in slots]
    varied = sum(chars for (_, chars, *_), f in zip(slots, fixed) if not f)
    if VARIES * varied < sum(chars for _, chars, *_ in slots):
        return {"mark": kind or None, "root": [], "same": []}
    holds: dict[tuple, int] = {}
    total = 0
    for (path, chars, marked, *_), f in zip(slots, fixed):
        if not f:
            chars *= 1 + marked
            total += chars
            for k in range(1, len(path) + 1):
                holds[path[:k]] = holds.get(path[:k], 0) + chars
    roots = [
        (len(p), p)
        for p, chars in holds.items()
        if total and 10 * chars >= 7 * total and p[-1].split(".")[0] not in TEXT_BLOCKS
    ]
    root = max(roots, default=(0, ()))[1]
    whole = not root or root[-1] in ("html", "body")
    if kind and (
        whole
        or kind in root
        or not any(marked for _, _, marked, *_ in slots)
        or any(marked and path[: len(root)] == root for path, _, marked, *_ in slots)
    ):
        return {"mark": kind, "root": [], "same": doubts(cut=kind)}
    same = {_place(path, text) for (path, _, _, _, text), f in zip(slots, fixed) if f} if whole else doubts(root)
    return {"mark": None, "root": list(root), "same": sorted(same)}


def _fits(key: str, own: str) -> bool:
    """Whether an element has the tag and the classes of a wrapper's key."""
    return _tag(key) == _tag(own) and _classes(key) <= _classes(own)


def _place(path: tuple, text: str) -> str:
    """A text (its hash) in its place."""
    return _hash(f"{' '.join(path)} {text}")


def kind_of(root: Element) -> str:
    """Which of KINDS the page has; "": none."""
    return next((kind for kind in KINDS if _find(root, lambda e: e.tag == kind)), "")


def _find(element: Element, wanted) -> list[Element]:
    """The topmost elements that are wanted, none within a block that is not of the article."""
    found = []
    for part in element.parts:
        if isinstance(part, Element) and not part.skip:
            found += [part] if wanted(part) else _find(part, wanted)
    return found


def extract_text(html: str | None, rules: dict | None = None) -> str:
    """The page's blocks of main text, joined by an empty line; rules: those of its host, by the kind of page. Without
    them, or if the page lacks the rule's root, markup decides."""
    if not html:
        return ""
    page = parse(html)
    kind = kind_of(page)
    rule = (rules or {}).get(kind) or {"mark": kind or None, "root": [], "same": []}
    found: list[tuple[Element, tuple]] = []
    if not rule["mark"]:
        found = [(page, ())]
        for key in rule["root"]:
            below = [(p, (*path, key)) for e, path in found for p in e.parts if isinstance(p, Element) and not p.skip]
            found = [x for x in below if x[0].key == key] or [x for x in below if _fits(key, x[0].key)]
    if not found and kind:
        found = [(e, ()) for e in _find(page, lambda e: e.tag == kind)]
    found, same = found or [(page, ())], set(rule["same"])
    blocks, texts = [], []

    def block(path: tuple) -> None:
        text = _squeeze(texts)
        if text and not (same and _place(path, _hash(text)) in same):
            blocks.append(text)
        texts.clear()

    def walk(element: Element, path: tuple) -> None:
        for part in element.parts:
            if isinstance(part, tuple):
                texts.append(part[0])
            elif part.tag == "span":
                if not part.skip:
                    walk(part, path)
            else:
                block(path)
                if not part.skip:
                    walk(part, (*path, part.key))
                    block((*path, part.key))

    for element, path in found:
        walk(element, path)
        block(path)
    return "\n\n".join(blocks)


def _page_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's kind, digest and wrapper."""
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
            html = html.as_py()
            if html:
                page = parse(html)
                digest = hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                rows.append((host.as_py(), kind_of(page), digest, json.dumps(page_wrapper(page))))
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "kind", "digest", "wrapper"]
        )


def _host_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host and kind of a task (or of some thousand of them, whichever is less)."""
    known: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        rows = list(known.items())
        known.clear()
        return pa.RecordBatch.from_pydict(
            {
                "host": pa.array([h for (h, _), _ in rows], pa.string()),
                "kind": pa.array([k for (_, k), _ in rows], pa.string()),
                "pages": pa.array([n for _, (n, _) in rows], pa.int64()),
                "wrapper": pa.array([json.dumps(w) for _, (_, w) in rows], pa.string()),
            }
        )

    for batch in batches:
        for host, kind, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "kind", "wrapper")), strict=True):
            found, old = json.loads(wrapper), known.get((host, kind))
            known[host, kind] = [old[0] + 1, align(old[1], found)] if old else [1, found]
        if len(known) > 4096:
            yield flush()
    if known:
        yield flush()


def _merged(pdf: pd.DataFrame) -> tuple[int, list]:
    wrapper = None
    for text in sorted(pdf["wrapper"]):
        wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text))
    return int(pdf["pages"].sum()), wrapper


def _merge_salted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pages, wrapper = _merged(pdf)
    return pd.DataFrame({"host": [key[0]], "kind": [key[1]], "pages": [pages], "wrapper": [json.dumps(wrapper)]})


def _merge_rules(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total, rules = 0, {}
    for kind, part in pdf.groupby("kind"):
        pages, wrapper = _merged(part)
        total, rules[kind] = total + pages, content_rule(wrapper, pages, kind)
    return pd.DataFrame({"host": [key[0]], "pages": [total], "rule": [json.dumps(rules)]})


def infer_rules(pages: DataFrame) -> DataFrame:
    """host, pages (distinct ones), rule (JSON: content_rule by kind of page) from all pages(url, html)."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    kind = "host string, kind string, pages long, wrapper string"
    parts = rows.mapInArrow(_page_wrappers, "host string, kind string, digest binary, wrapper string")
    parts = parts.dropDuplicates(["host", "kind", "digest"]).select("host", "kind", "wrapper")
    parts = parts.mapInArrow(_host_wrappers, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    parts = parts.groupBy("host", "kind", "salt").applyInPandas(_merge_salted, kind)
    return parts.groupBy("host").applyInPandas(_merge_rules, "host string, pages long, rule string")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for html, rule in zip(batch.column("html"), batch.column("rule"), strict=True):
            html, rule = html.as_py(), rule.as_py()
            if rule is not None and rule not in rules:
                if len(rules) > 4096:
                    rules.clear()
                rules[rule] = json.loads(rule)
            texts.append(extract_text(html, rules.get(rule)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    Null, empty and textless html: an empty text. Blocks below DEEPEST others give their text like any other. Null URLs share the host "". Repeated rows give repeated rows; equal
    pages of a host count once in its wrapper. Pages are processed whole, whatever their length. Other
    columns are not read. Empty table: empty result.
    """
    rules = materialise(infer_rules(pages).select(F.col("host").alias("r_host"), "rule"), "wrappers")
    if (rules.agg(F.sum(F.length("rule") + F.length("r_host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        rules = F.broadcast(rules)
    rows = pages.select("page_id", "url", "html").join(rules, host_of(F.col("url")) == F.col("r_host"), "left")
    kind = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.select("page_id", "url", "html", "rule").mapInArrow(_texts, kind)
