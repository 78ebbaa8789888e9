"""Web pages: a tree by the rules of HTML's tree construction that pages rely on, and its Markdown."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

from inkgrove.functions.markdown import Page
from inkgrove.functions.text import absolute, squeezed
from inkgrove.parsers.result import Extracted
from inkgrove.schema import ParseError

# Element classes of the HTML standard and of the engine's rendering.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address article aside blockquote body button caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html li listing main marquee menu nav ol p plaintext pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template button".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SKIPPED = frozenset("script style noscript template header nav footer aside".split())
SILENT = frozenset("script style noscript template".split())
BLOCKS = frozenset((*HEADINGS, "p", "ul", "ol", "table", "blockquote", "pre", "article", "main", "section", "div"))
CONTAINERS = frozenset(("article", "main", "section", "div", "body"))


#: Steps over open elements that repairing misnested formatting may take in one page.
MOST_REPAIRS = 3_000_000
#: Characters that may pass from element to element while a page is written: times its length, and more.
MOST_PASSES, FREE_PASSES = 20, 30_000_000


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def add(self, child) -> None:
        if isinstance(child, Node):
            if child.parent is not None:
                child.parent.children.remove(child)
            child.parent = self
        self.children.append(child)

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(x.children[::-1])
        return "".join(out)


class Open:
    """The open elements from the root on. Where the last one of a tag stands is known, so looking
    for one takes the same time at any depth."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.held: set[int] = set()
        self.work = 0

    def append(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.held.add(id(node))

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.places[node.tag].pop()
        self.held.discard(id(node))
        return node

    def last(self, tags) -> int:
        """Place of the last open element of some tags, -1 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def set(self, nodes: list[Node]) -> None:
        self.work += len(nodes)
        if self.work > MOST_REPAIRS:
            raise ParseError("parse_budget_exceeded", "formatting is misnested too deeply")
        self.nodes, self.places = nodes, {}
        for k, node in enumerate(nodes):
            self.places.setdefault(node.tag, []).append(k)
        self.held = set(map(id, nodes))

    def remove(self, node: Node) -> None:
        self.set([n for n in self.nodes if n is not node])

    def __contains__(self, node: Node) -> bool:
        return id(node) in self.held

    def __len__(self) -> int:
        return len(self.nodes)

    def __getitem__(self, k: int) -> Node:
        return self.nodes[k]

    def __reversed__(self):
        return reversed(self.nodes)

    def index(self, node: Node) -> int:
        return next(k for k, n in enumerate(self.nodes) if n is node)


class Tree(HTMLParser):
    """Builds the tree while the tokens come: implied ends, formatting that outlives its paragraph
    (at most three equal ones), and misnested formatting by the adoption procedure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.body = Node("body")
        self.root.add(self.body)
        self.open = Open()
        self.open.append(self.root)
        self.open.append(self.body)
        self.deepest = 0
        self.active: list[Node | None] = []  # None is a marker
        self.after_pre = False

    # -- helpers --

    def here(self) -> Node:
        return self.open[-1]

    def in_scope(self, tags, stop=SCOPE) -> bool:
        at = self.open.last(tags)
        return at >= 0 and at >= self.open.last(stop)

    def pop_to(self, tags) -> None:
        while len(self.open) > 2:
            if self.open.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope(("p",)):
            self.pop_to(("p",))

    def insert(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.here().add(node)
        self.open.append(node)
        self.deepest = max(self.deepest, len(self.open))
        return node

    def reconstruct(self) -> None:
        """Opens again what formatting is active but was closed by its surroundings."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.insert(old.tag, dict(old.attrs))

    def activate(self, node: Node) -> None:
        same, k = 0, len(self.active)
        while k and self.active[k - 1] is not None:
            k -= 1
            if self.active[k].tag == node.tag and self.active[k].attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tokens --

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        self.after_pre = False
        if tag in ("html", "body", "head", "frameset"):
            return
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.here().tag in HEADINGS:
            self.open.pop()
        elif tag == "li":
            self.close_item(("li",))
        elif tag in ("dd", "dt"):
            self.close_item(("dd", "dt"))
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"):
            if self.open.last(("table",)) < 0:
                return
            self.table_part(tag)
        elif tag == "option" and self.here().tag == "option":
            self.open.pop()
        if tag == "a":
            old = next((n for n in reversed(self.active) if n is None or n.tag == "a"), None)
            if old is not None:
                self.adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.open:
                    self.open.remove(old)
        if tag in VOID:
            self.reconstruct()
            self.insert(tag, attrs)
            self.open.pop()
        elif tag in FORMATTING:
            self.reconstruct()
            self.activate(self.insert(tag, attrs))
        else:
            if tag not in SPECIAL:
                self.reconstruct()
            self.insert(tag, attrs)
            if tag in ("td", "th", "caption"):
                self.active.append(None)
            self.after_pre = tag == "pre"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close_item(self, tags) -> None:
        for node in reversed(self.open):
            if node.tag in tags:
                self.pop_to(tags)
                return
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str) -> None:
        stop = {"table", "template"}
        if tag in ("td", "th"):
            self.end_cell(stop)
            if not self.in_scope(("tr",), stop):
                self.section(stop)
                self.insert("tr", {})
        elif tag == "tr":
            self.end_cell(stop)
            if self.in_scope(("tr",), stop):
                self.pop_to(("tr",))
            self.section(stop)
        else:
            self.end_cell(stop)
            for kinds in (("tr",), ("tbody", "thead", "tfoot", "caption", "colgroup")):
                if self.in_scope(kinds, stop):
                    self.pop_to(kinds)

    def section(self, stop) -> None:
        if not self.in_scope(("tbody", "thead", "tfoot"), stop):
            while self.here().tag != "table":
                self.open.pop()
            self.insert("tbody", {})

    def end_cell(self, stop) -> None:
        if self.in_scope(("td", "th", "caption"), stop):
            self.pop_to(("td", "th", "caption"))
            self.to_marker()

    def handle_endtag(self, tag):
        self.after_pre = False
        if tag in ("html", "body") or tag in VOID and tag != "br":
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            if not self.in_scope(("p",)):
                self.insert("p", {})
            self.pop_to(("p",))
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
        elif tag in ("td", "th", "caption"):
            self.end_cell({"table", "template"})
        elif tag in ("tr", "tbody", "thead", "tfoot", "table"):
            if self.in_scope((tag,), {"template"} if tag == "table" else {"table", "template"}):
                if tag == "table":
                    while self.active and self.active[-1] is None and self.open.last(("td", "th", "caption")) >= 0:
                        self.to_marker()
                        break
                self.pop_to((tag,))
        elif self.in_scope((tag,), SCOPE | ({"ul", "ol"} if tag == "li" else set())):
            self.pop_to((tag,))

    def adopt(self, tag: str) -> None:
        """End of a formatting element, also where blocks opened inside of it are still open."""
        for _ in range(8):
            node = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    node = n
                    break
            if node is None:
                if self.in_scope((tag,), SPECIAL):
                    self.pop_to((tag,))
                return
            if node not in self.open:
                self.active.remove(node)
                return
            at = self.open.index(node)
            if self.open.last(SCOPE) > at:
                return
            block = next((n for n in self.open.nodes[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                self.open.set(self.open.nodes[:at])
                self.active.remove(node)
                return
            above = self.open[at - 1]
            mark = self.active.index(node)
            last, i = block, self.open.index(block)
            between, gone, copies = self.open.nodes[at + 1 : i], {id(node)}, {}
            for depth in range(1, i - at):
                inner = between[-depth]
                if inner not in self.active or depth > 3:
                    gone.add(id(inner))
                    if inner in self.active:
                        self.active.remove(inner)
                    continue
                copy = Node(inner.tag, dict(inner.attrs))
                self.active[self.active.index(inner)] = copy
                copies[id(inner)] = copy
                copy.add(last)
                last = copy
            above.add(last)
            copy = Node(node.tag, dict(node.attrs))
            for child in list(block.children):
                if isinstance(child, Node):
                    child.parent = None
                copy.children.append(child)
                if isinstance(child, Node):
                    child.parent = copy
            block.children.clear()
            block.add(copy)
            if node in self.active:
                mark = self.active.index(node)
                self.active.remove(node)
            self.active.insert(min(mark, len(self.active)), copy)
            changed = []
            for n in self.open.nodes:
                if id(n) not in gone:
                    changed.append(copies.get(id(n), n))
                if n is block:
                    changed.append(copy)
            self.open.set(changed)

    def handle_data(self, data):
        if self.after_pre and data.startswith("\n"):
            data = data[1:]
        self.after_pre = False
        if not data:
            return
        target = self.here()
        if target.tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if not data.strip():
                return
            table = self.open[self.open.last(("table",))]
            if table.parent is not None:  # text loose in a table stands in front of it
                table.parent.children.insert(table.parent.children.index(table), data)
            return
        if data.strip() and target.tag not in ("script", "style", "title", "textarea", "template"):
            self.reconstruct()
        self.here().children.append(data)


def tree(text: str) -> tuple[Node, int]:
    """The page's tree and its depth."""
    builder = Tree()
    builder.feed(text)
    builder.close()
    return builder.root, builder.deepest


class Renderer:
    """Markdown of a tree: the first article, else main, else the body. Text that stands directly in
    a container is not part of any block and is left out, nested lists likewise."""

    def __init__(self, page: Page, base: str | None, most: int):
        self.page, self.base, self.left = page, base, most

    def children(self, node: Node) -> None:
        for child in node.elements():
            self.block(child)

    def block(self, node: Node) -> None:
        tag = node.tag
        if tag in SKIPPED:
            return
        if tag in HEADINGS:
            self.page.heading(int(tag[1]), self.inline(node))
        elif tag in ("ul", "ol"):
            number = 0
            for item in node.elements():
                text = self.inline(item) if item.tag == "li" else ""
                if text:
                    number += 1
                    self.page.gap()
                    self.page.raw(f"{f'{number}.' if tag == 'ol' else '-'} {text}\n")
        elif tag == "table":
            rows = [[self.inline(c) for c in self.below(r) if c.tag in ("th", "td")] for r in self.below(node) if r.tag == "tr"]
            self.page.table([r for r in rows if r])
        elif tag == "blockquote":
            if text := self.inline(node):
                self.page.gap()
                self.page.raw(f"> {text}\n")
        elif tag == "pre":
            text = node.text().strip("\n")
            if text.strip():
                self.page.gap()
                self.page.raw(f"```\n{text}\n```\n")
        elif tag in CONTAINERS or tag != "p" and any(c.tag in BLOCKS for c in node.elements()):
            self.children(node)
        else:
            self.page.paragraph(self.inline(node))

    def below(self, node: Node) -> Iterator[Node]:
        """All elements of a node, which cost as characters do: tables in tables meet theirs at every level."""
        for x in node.walk():
            self.charge(10)
            yield x

    def charge(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise ParseError("parse_budget_exceeded", "elements are nested too deeply for their text")

    def inline(self, node: Node) -> str:
        text = "".join([self.piece(x) for x in node.children])
        self.charge(len(text) + 1)
        return squeezed(text)

    def piece(self, x) -> str:
        if isinstance(x, str):
            return x
        tag = x.tag
        if tag in SILENT or tag in ("ul", "ol", "table"):
            return ""
        if tag == "br":
            return "\n"
        if tag == "img":
            alt, src = x.attrs.get("alt", "").strip(), x.attrs.get("src", "").strip()
            if src and not src.startswith("data:"):
                return f"![{alt}]({absolute(self.base, src)})"
            return f"[image: {alt}]" if alt else ""
        if tag == "a":
            text = self.inline(x)
            if "href" not in x.attrs:
                return text
            link = absolute(self.base, x.attrs["href"])
            return f"[{text}]({link})" if text else link
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}.get(tag)
        if mark:
            text = self.inline(x)
            return f"{mark}{text}{mark}" if text else ""
        return "".join([self.piece(y) for y in x.children])


def markdown_of(text: str, base: str | None, most: int) -> str:
    root, depth = tree(text)
    # blocks and their pieces call one another, a few calls a level
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * depth + 1000))
    found = {}
    for n in root.walk():
        if n.tag in ("article", "main", "body"):
            found.setdefault(n.tag, n)
    page = Page(most)
    Renderer(page, base, MOST_PASSES * len(text) + FREE_PASSES).children(found.get("article") or found.get("main") or found["body"])
    return page.text()


def parse(text: str, source: str, most: int) -> Extracted:
    return Extracted(markdown_of(text, source, most))
