"""Main text of web pages by wrapper induction.

Pages of a host are aligned in batches of about ``BATCH``. Each page becomes a tree of blocks (inline tags are part of the
text; neighbouring siblings of one structure are one place), and simple tree matching against the batch's richest page puts
nodes of different pages into common slots. What a slot holds over all pages then decides:

1. Template: a text that most pages have in the same slot. Pages whose long blocks are mostly the same (copies) count once. In the
   region it is content all the same where it stands in an article or between blocks that vary (a series' headings).
2. Region: from the root down, the slot that holds most of the varying text outside links, as the mean of the pages' shares.
   Beside it, slots whose text stands bare in a container, a short piece a page, vary without being content (adverts,
   closing lines) and are left; where anything else stands beside it, the descent stops and all of the slot is content.
3. Names refine this: elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments by their tag,
   role or class hold no content; of what the descent has found, article or main elements that hold most of the varying text are
   preferred to what stands beside them. A class or id that says other things too (story-notice) doesn't count where its element
   holds most of a page's text.

The text is what the region holds outside template. Fewer than ``LEAST_PAGES`` different pages show no template and no
varying slots: then only names tell, and the descent passes only slots that hold everything. A page without any text in
the region (another layout) keeps all its text that is neither template nor named as no content.

A batch never grows with a host: the number of batches follows the host's number of pages. Trees are walked without
recursion, so nesting may be as deep as it likes; sibling lists of over ``PAIRS`` unlike pairs are aligned by equal structure
in order instead of by the best sum. Null or empty html gives an empty text. Pages without a url or host form one host.
Repeated rows are extracted alike, a row each. An empty table gives no rows. Columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import prepare

BATCH, SHARE, LEAST_PAGES = 32, 0.6, 3
#: Share of the varying text that makes a slot the main one; share of a page's text up to which a bare slot is no content.
MOST, SMALL = 0.6, 0.3
#: Characters from which a block is long; pairs of unlike siblings up to which the best alignment is sought.
LONG, PAIRS = 80, 250_000
BROADCAST_ROWS = 200_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "template", "dialog", "menu", "head", "audio", "video", "map", "datalist", "fieldset"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "section", "div"}
# What class and id words say of themselves; words that go with them without saying anything else.
_WORDS = r"ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promo(?:tion|s)?|navs?|navigation|navbar|menus?|breadcrumbs?|sidebars?|side-?bar|footers?|masthead|site-?header|page-?header|top-?bar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|signup|login|comments?|replies|respond|disqus|shar(?:e|ing)|social|related|recommended|widgets?|pagination|pager|toolbar|skip-?link|hidden|screen-?reader|sr-only"
_PLAIN = r"area|bar|block|box|buttons?|container|form|group|inner|items?|left|links?|lists?|main|outer|page|panel|primary|right|secondary|section|site|top|bottom|user|wrap(?:per)?|\d+"
_NOISE = re.compile(rf"(?:^|[-_ ])(?:{_WORDS})(?:$|[-_ ])")
_PURE = re.compile(rf"(?:(?:{_WORDS}|{_PLAIN})(?:[-_]+|$))+")
_BARE = {"html", "body", "div", "section", "center", "span", "main", "article", "header"}

#: Elements that hold text or a list of it: the descent doesn't go into them.
_PIECES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "blockquote", "pre", "figure", "figcaption", "details", "summary", "address"}


class Node:
    __slots__ = ("tag", "key", "noise", "sure", "mixed", "children", "texts", "parent", "link", "kind", "runs")

    def __init__(self, tag: str, key: str, noise: bool, parent: Node | None):
        self.tag, self.key, self.noise, self.parent = tag, key, noise, parent
        self.children: list[Node] = []
        self.link = self.kind = 0
        self.sure = self.mixed = False  # boilerplate by itself; by a name that says something else too
        self.texts: list[tuple[int, str]] = []  # (place in the page, text) of each block of text directly inside
        self.runs: list[list[Node]] = []  # neighbouring children of one kind


def _noisy(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A node's key for alignment, whether it is boilerplate by what it says of itself, and whether only a word of a name that has other
    words too says so."""
    if not attributes.strip():
        return tag, tag in _NEVER, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    name = found.get("class", "").lower()
    marks = f"{name} {found.get('id', '').lower()}"
    hidden = bool(re.search(r"(?:^|\s)hidden(?:$|[\s=])", attributes)) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    role = found.get("role", "").lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"}
    sure = tag in _NEVER or hidden or role
    named = tag not in {"body", "html", "main"} and bool(_NOISE.search(marks))
    mixed = named and not sure and not any(_NOISE.search(m) and _PURE.fullmatch(m) for m in marks.split())
    plain = re.sub(r"[^a-z]", "", name.split()[0]) if name.split() else ""
    return f"{tag}.{plain}" if plain else tag, sure or named, mixed


def _overrule(nodes: list[Node]) -> None:
    """A name that says more than boilerplate doesn't outweigh the text: an element named so that holds ``MOST`` of what stands outside
    certain boilerplate is content, but for boilerplate inside it."""
    if not any(x.mixed for x in nodes):
        return
    place = {id(x): i for i, x in enumerate(nodes)}
    certain = [x.sure for x in nodes]
    for i, x in enumerate(nodes[1:], 1):
        certain[i] |= certain[place[id(x.parent)]]
    below = [0 if c else sum(len(t) for _, t in x.texts) for x, c in zip(nodes, certain, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        below[place[id(nodes[i].parent)]] += below[i]
    for i, x in enumerate(nodes[1:], 1):
        if x.mixed and not certain[i] and below[i] >= MOST * below[0] > 0:
            x.mixed = False
            clear = [x]
            while clear:
                y = clear.pop()
                y.noise = False
                clear += [c for c in y.children if not c.mixed and not c.sure]


def parse(source: str) -> list[Node]:
    """The blocks of a page, parents before children. Never fails: what isn't markup is text, what is left open closes with its parent."""
    root = Node("html", "html", False, None)
    nodes, opened = [root], Counter()
    here, run, place, anchor, muted = root, [], 0, 0, None

    def up(to: Node) -> Node:
        """Close elements up to and including ``to``; what is open then."""
        x = here
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        opened[to.tag] -= 1
        return to.parent

    def flush():
        nonlocal place
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                here.texts.append((place, text))
                place += 1

    at, n, lower = 0, len(source), None
    last = source.rfind(">") + 1  # no tag ends beyond
    last = last if source.find("<!--", last) < 0 else n
    while at < n:
        m = _TAG.search(source, at, last) if at < last else None
        end = m.start() if m else n
        if end > at:
            piece = source[at:end]
            piece = html.unescape(piece) if "&" in piece else piece
            if not muted:
                run.append(piece)
                if anchor:
                    here.link += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if source.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                break
            continue
        closing, attributes = m[1] or m[4] or "", m[3] or m[6] or ""
        if tag in _RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                lower = source.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                at = n if stop < 0 else stop
            continue
        if tag in _INLINE:
            if tag == "a":
                anchor = 0 if closing else 1
            if muted:
                if closing and tag == muted[0]:
                    muted = (tag, muted[1] - 1) if muted[1] > 1 else None
                elif not closing and tag == muted[0]:
                    muted = (tag, muted[1] + 1)
            elif not closing and attributes.strip() and tag != "a" and _noisy(tag, attributes)[1]:
                muted = (tag, 1)  # an inline element that is hidden or an advert
            continue
        if tag in _VOID:
            if not muted:
                run.append(" ")
                if tag == "hr":
                    flush()
            continue
        muted = None
        flush()
        anchor = 0
        if closing:
            if opened[tag] > 0:
                x = here
                while x.tag != tag:
                    x = x.parent
                here = up(x)
            continue
        if tag in ("html", "body") and here is not root:
            continue
        if here.tag == "p":
            here = up(here)
        ends = _ENDS.get(tag)
        if ends and any(opened[e] > 0 for e in ends):
            x = here
            while x.parent is not None and x.tag not in ends and x.tag not in _SCOPE:
                x = x.parent
            if x.tag in ends:
                here = up(x)
        key, noise, mixed = _noisy(tag, attributes)
        node = Node(tag, key, noise or here.noise, here)
        node.sure, node.mixed = noise and not mixed, mixed
        if tag == "header" and not noise:
            node.sure = opened["article"] + opened["main"] <= 0
            node.noise = here.noise or node.sure
        here.children.append(node)
        nodes.append(node)
        opened[tag] += 1
        here = node
    flush()
    _overrule(nodes)
    return nodes


class Kinds:
    """Structures of subtrees by number, and their alignments: kinds[k] = (key, kinds of children, has text, size)."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.kinds: list[tuple[str, tuple[int, ...], bool, int]] = []
        self.pairs: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def number(self, key: str, children: tuple[int, ...], text: bool) -> int:
        found = self.numbers.get((key, children, text))
        if found is None:
            found = self.numbers[key, children, text] = len(self.kinds)
            self.kinds.append((key, children, text, 1 + text + sum(self.kinds[c][3] for c in children)))
        return found

    def of(self, nodes: list[Node]) -> int:
        """Number a page's nodes, children first; the root's kind. Neighbouring children of one kind become a run."""
        for x in reversed(nodes):
            x.runs = []
            last = -1
            for c in x.children:
                if c.kind == last:
                    x.runs[-1].append(c)
                else:
                    x.runs.append([c])
                    last = c.kind
            x.kind = self.number(x.key, tuple(r[0].kind for r in x.runs), bool(x.texts))
        return nodes[0].kind

    def weight(self, a: int, b: int) -> int | None:
        """Matched nodes of two kinds: None if they still have to be matched."""
        if a == b:
            return self.kinds[a][3]
        if self.kinds[a][0] != self.kinds[b][0]:
            return 0
        found = self.pairs.get((a, b))
        return None if found is None else found[0]

    def middle(self, a: int, b: int) -> tuple[int, int, int]:
        """Children of a and b that begin alike, and the ends of what lies before those that end alike."""
        xs, ys = self.kinds[a][1], self.kinds[b][1]
        n, p = min(len(xs), len(ys)), 0
        while p < n and xs[p] == ys[p]:
            p += 1
        q = 0
        while q < n - p and xs[-1 - q] == ys[-1 - q]:
            q += 1
        return p, len(xs) - q, len(ys) - q

    def match(self, a: int, b: int) -> list[tuple[int, int]]:
        """Simple tree matching of the children of two kinds: the pairs (place in a, place in b) that keep order and maximise
        the number of matched nodes below, when parents of matched nodes must match."""
        todo = [(a, b)]
        while todo:
            i, j = todo[-1]
            if (i, j) in self.pairs:
                todo.pop()
                continue
            p, m, n = self.middle(i, j)
            xs, ys = self.kinds[i][1][p:m], self.kinds[j][1][p:n]
            small = len(xs) * len(ys) <= PAIRS
            open_pairs = [(x, y) for x in set(xs) for y in set(ys) if self.weight(x, y) is None] if small else []
            if open_pairs:
                todo += open_pairs
                continue
            todo.pop()
            gained, found = (self.best if small else self.greedy)(xs, ys)
            tail = range(len(self.kinds[i][1]) - m)
            pairs = [(k, k) for k in range(p)] + [(p + x, p + y) for x, y in found] + [(m + k, n + k) for k in tail]
            alike = sum(self.kinds[self.kinds[i][1][k]][3] for k in (*range(p), *(m + k for k in tail)))
            self.pairs[i, j] = (1 + (self.kinds[i][2] and self.kinds[j][2]) + alike + gained, pairs)
        return self.pairs[a, b][1]

    def best(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = table[-1], [0]
            for q, y in enumerate(ys):
                w = self.weight(x, y)
                row.append(max(above[q + 1], row[q], above[q] + w if w else 0))
            table.append(row)
        pairs, p, q = [], len(xs), len(ys)
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                pairs.append((p, q))
        return table[-1][-1], pairs[::-1]

    def greedy(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        places = defaultdict(list)
        for p, x in enumerate(xs):
            places[x].append(p)
        pairs, at, gained = [], 0, 0
        for q, y in enumerate(ys):
            k = bisect_left(places[y], at) if y in places else 0
            if y in places and k < len(places[y]):
                pairs.append((places[y][k], q))
                at = places[y][k] + 1
                gained += self.kinds[y][3]
        return gained, pairs


class Slots:
    """The common slots of aligned pages: a tree that grows by what pages have beside the first one."""

    def __init__(self, kinds: Kinds, pivot: int):
        self.kinds, self.pivot = kinds, pivot
        self.numbers: dict[tuple, int] = {}
        self.parent, self.tag = [-1], ["html"]

    def _child(self, slot: int, name: int | str, tag: str) -> int:
        found = self.numbers.get((slot, name))
        if found is None:
            found = self.numbers[slot, name] = len(self.parent)
            self.parent.append(slot)
            self.tag.append(tag)
        return found

    def place(self, root: Node) -> list[tuple[int, list[Node]]]:
        """(slot, nodes) of all nodes of a page, parents first. What the pivot has no place for goes by its key."""
        out, todo = [], [(0, self.pivot, [root])]
        while todo:
            slot, like, nodes = todo.pop()
            out.append((slot, nodes))
            kind = nodes[0].kind
            if like is None:
                mine = {}
            elif like == kind:
                mine = {k: k for k in range(len(nodes[0].runs))}
            else:
                mine = {q: p for p, q in self.kinds.match(like, kind)} if self.kinds.kinds[like][0] == self.kinds.kinds[kind][0] else {}
            for q in range(len(nodes[0].runs)):
                below = [c for x in nodes for c in x.runs[q]]
                if q in mine:
                    todo.append((self._child(slot, mine[q], below[0].tag), self.kinds.kinds[like][1][mine[q]], below))
                else:
                    todo.append((self._child(slot, below[0].key, below[0].tag), None, below))
        return out


def copies(pages: list[list[Node]]) -> list[int]:
    """For each page the first one of which it is a copy: pages that share most of their long blocks."""
    blocks = [{t: len(t) for x in nodes if not x.noise for _, t in x.texts if len(t) >= LONG} for nodes in pages]
    first: list[int] = []
    for i, mine in enumerate(blocks):
        size = sum(mine.values())
        twin = i
        for j in range(i):
            if first[j] == j and 2 * sum(n for t, n in mine.items() if t in blocks[j]) > min(size, sum(blocks[j].values())):
                twin = j
                break
        first.append(twin)
    return first


def _region(slots: Slots, weight: list[float], own: list[float], bare: list[bool], aligned: bool) -> set[int]:
    """The slots whose text is content, each with all below it: where the varying text lies, and then the articles there.

    The descent knows no names. Where it ends beside or inside article or main elements that hold most of the varying text, these
    are the content.
    """
    children = defaultdict(list)
    for s, p in enumerate(slots.parent):
        if p >= 0 and weight[s] > 0:
            children[p].append(s)
    path, top = [0], 0
    while children[top]:
        main = max(children[top], key=lambda c: weight[c])
        rest = [c for c in children[top] if c != main]
        bare_only = aligned and all(bare[c] and weight[c] <= SMALL * weight[top] for c in rest)
        if weight[main] < MOST * weight[top] or own[top] > 0 or (rest and not bare_only) or slots.tag[main] in _PIECES:
            break
        top = main
        path.append(top)
    for tag in ("article", "main"):
        around = next((s for s in path if slots.tag[s] == tag), None)
        if around is not None:
            return {around}
        found, todo = [], [top]
        while todo:
            s = todo.pop()
            if slots.tag[s] == tag:
                found.append(s)
            else:
                todo += children[s]
        if sum(weight[s] for s in found) >= MOST * weight[top] and found:
            return set(found)
    return {top}


def extract_batch(pages: list[str], kinds: Kinds | None = None) -> list[str]:
    """Main texts of pages of one host, aligned with each other."""
    kinds = Kinds() if kinds is None or len(kinds.pairs) > 200_000 else kinds
    parsed = [parse(p) for p in pages]
    roots = [kinds.of(nodes) for nodes in parsed]
    slots = Slots(kinds, max(roots, key=lambda k: kinds.kinds[k][3]))
    placed = [slots.place(nodes[0]) for nodes in parsed]
    distinct = {min(i, j) for i, j in enumerate(copies(parsed))}
    aligned = len(distinct) >= LEAST_PAGES

    template: dict[int, set[str]] = {}
    if aligned:
        filled, common = Counter(), defaultdict(Counter)
        for i in distinct:
            for slot, nodes in placed[i]:
                texts = {t for x in nodes for _, t in x.texts}
                if texts:
                    filled[slot] += 1
                    common[slot].update(texts)
        template = {slot: {t for t, n in texts.items() if n >= max(LEAST_PAGES, SHARE * filled[slot])} for slot, texts in common.items()}

    n = len(slots.parent)
    own, bare, blocks = [0.0] * n, [True] * n, [0] * n
    for i in distinct:
        here = [0] * n
        for slot, nodes in placed[i]:
            fixed = template.get(slot, ())
            for x in nodes:
                if not x.noise:
                    texts = [t for _, t in x.texts if t not in fixed]
                    here[slot] += max(0, sum(map(len, texts)) - x.link)
                    blocks[slot] += len(texts)
                    bare[slot] &= not texts or x.tag in _BARE
        total = sum(here)
        if total:
            own = [a + b / total for a, b in zip(own, here, strict=True)]
    weight = list(own)
    for s in range(n - 1, 0, -1):  # parents come before children
        p = slots.parent[s]
        weight[p] += weight[s]
        blocks[p] += blocks[s]
        bare[p] &= bare[s]
    few = [b and k <= 2 * len(distinct) for b, k in zip(bare, blocks, strict=True)]
    inside = [False] * n
    region = _region(slots, weight, own, few, aligned)
    for s in range(n):
        inside[s] = s in region or (s > 0 and inside[slots.parent[s]])

    articles = {s for s in region if slots.tag[s] == "article"}
    in_article = [False] * n
    for s in range(n):
        in_article[s] = s in articles or (s > 0 and in_article[slots.parent[s]])

    out = []
    for page in placed:
        every = sorted((place, t, slot, t in template.get(slot, ())) for slot, nodes in page for x in nodes if not x.noise for place, t in x.texts)
        kept = [x for x in every if inside[x[2]] and not x[3]]
        if kept:
            # what stands between kept blocks belongs to them, as does all of an article
            lo, hi = kept[0][0], kept[-1][0]
            chosen = [x for x in every if inside[x[2]] and (in_article[x[2]] or lo <= x[0] <= hi)]
        else:
            chosen = [x for x in every if not x[3]]
        out.append("\n".join(x[1] for x in sorted(chosen)))
    return out


def _extract_group(frame: pd.DataFrame) -> pd.DataFrame:
    kinds = Kinds()
    out = []
    for _, g in frame.groupby(["host", "batch"], sort=False):
        g = g.sort_values(["page_id", "url"], kind="stable")
        texts = extract_batch([h or "" for h in g.html], kinds)
        out += zip(g.page_id, g.url, texts, map(len, texts), strict=True)
    return pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each input row."""
    prepare(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    large = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("batches")).where("batches > 1").checkpoint()
    total = pages.select(F.lit(1)).count()
    pages = pages.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "host", "left")
    pages = pages.withColumn("batch", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("batches", F.lit(1))))
    dealt = pages.select("page_id", "url", "html", "host", "batch", F.pmod(F.xxhash64("host", "batch"), F.lit(max(1, total // 128))).alias("g"))
    kind = dict(pages.dtypes)["page_id"]
    return dealt.groupBy("g").applyInPandas(_extract_group, f"page_id {kind}, url string, text string, n_chars long")
