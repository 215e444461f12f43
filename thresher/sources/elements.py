"""Pages as rows of elements.

One pass over a page's HTML gives a row for each element with the structural facts that
the extraction operators need; all rules are DataFrame operations over these rows. The
parser follows the HTML rules for void elements, implied ends and left-open formatting,
as far as they decide which element holds which text.

Rows: the page's key, ord (document order), parent, last (its last descendant), tag,
attrs, text (white space collapsed; only a prefix of TEXT_KEPT characters unless it may be
a value of any length), text_len, own_text, n_desc, n_children, excluded, body_ord, scope
(nearest ancestor with itemscope), class_counts, chain (itself and up to five ancestors),
script (of JSON-LD scripts), label_text and control (of labels), chosen (of selects).

A null or blank page has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .staging import dealt

TEXT_KEPT = 2001
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: An open tag of the second set ends where one of the first starts, up to a boundary of the third.
ENDS = [
    (frozenset(("li",)), frozenset(("li",)), frozenset(("ul", "ol"))),
    (frozenset(("dt", "dd")), frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("option", "optgroup")), frozenset(("option",)), frozenset(("select",))),
    (frozenset(("tr", "tbody", "thead", "tfoot")), frozenset(("tr", "td", "th")), frozenset(("table",))),
    (frozenset(("td", "th")), frozenset(("td", "th")), frozenset(("table", "tr"))),
    (frozenset(("tbody", "thead", "tfoot")), frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
]
#: The sets (ended, bounds) by the tag that starts.
ENDS_OF = {tag: [(ended, bounds) for starts, ended, bounds in ENDS if tag in starts] for starts, *_ in ENDS for tag in starts}
P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Tags whose elements are no data, and input types that are none.
EXCLUDED_TAGS = frozenset("script style noscript template svg path canvas iframe meta link button".split())
EXCLUDED_INPUTS = frozenset(("hidden", "password", "file"))
CONTROLS = frozenset(("input", "textarea", "select", "output"))
_BLANK = re.compile(r"[\s ]+")
_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9A-Fa-f]+;|([A-Za-z][A-Za-z0-9]*;))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_LINK = "struct<tag: string, id: string, id_count: int, class: string, nth: int, same: int>"
FIELDS = (
    "ord int, parent int, last int, tag string, attrs map<string, string>, text string, text_len int, own_text boolean, "
    "n_desc int, n_children int, excluded boolean, body_ord int, scope int, class_counts map<string, int>, "
    f"chain array<{_LINK}>, script string, label_text string, control int, chosen string"
)


def _shielded(html: str) -> tuple[str, str | None]:
    """html with each ampersand that begins no whole reference (&name; or a number) as a character that html lacks, and that character."""
    if "&" not in html:
        return html, None
    mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in html)
    whole = lambda m: len(m[0]) > 1 and (m[1] is None or m[1] in html5)
    return _REFERENCE.sub(lambda m: m[0] if whole(m) else mark + m[0][1:], html), mark


def collapse(text: str) -> str:
    return _BLANK.sub(" ", text).strip()


class _Node:
    __slots__ = ("attrs", "children", "end", "last", "nth", "ord", "parent", "same", "start", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []
        self.nth = self.same = 1  # among the elements of its tag and parent

    def elements(self) -> list[_Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def all_text(self, without: frozenset[str] = frozenset()) -> str:
        found, stack = [], list(reversed(self.children))
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                found.append(one)
            elif one.tag not in without:
                stack.extend(reversed(one.children))
        return "".join(found)


class _Tree(HTMLParser):
    def __init__(self, mark: str | None = None):
        super().__init__(convert_charrefs=True)
        self.mark = mark  # stands for an ampersand that is text
        self.html = _Node("html", {}, None)
        self.head, self.body = _Node("head", {}, self.html), _Node("body", {}, self.html)
        self.html.children = [self.head, self.body]
        self.open, self.left_open, self.in_body = [self.head], [], False
        self.n_open: Counter = Counter()  # by tag, so that no search runs through open elements in vain

    def _enter_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, [self.body]
            self.n_open.clear()

    def _push(self, tag: str, attrs: dict[str, str], keep: bool = True) -> None:
        node = _Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if keep:
            self.open.append(node)
            self.n_open[tag] += 1

    def _pop_to(self, depth: int, closing: bool) -> None:
        """Ends the elements from this depth on; formatting that they leave open goes on after them."""
        lost = [n for n in self.open[depth + closing :] if n.tag in FORMATTING]
        self.left_open += [(n.tag, n.attrs) for n in lost]
        for n in self.open[depth:]:
            self.n_open[n.tag] -= 1
        del self.open[depth:]

    def _reopen(self) -> None:
        again, self.left_open = self.left_open, []
        for tag, attrs in again:
            self._push(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {}
        for name, value in attrs:
            found.setdefault(name, self._plain(value or ""))
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            node.attrs = found | node.attrs
            if tag == "body":
                self._enter_body()
            return
        if not self.in_body and not (tag in HEAD_ONLY):
            self._enter_body()
        if tag in P_ENDERS and self.n_open["p"]:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    self._pop_to(k, True)
                    break
                if self.open[k].tag in ("button", "td", "th", "table", "caption"):
                    break
        for ended, bounds in ENDS_OF.get(tag, ()):
            if any(self.n_open[t] for t in ended):
                depth = 0
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k].tag in bounds:
                        break
                    if self.open[k].tag in ended:
                        depth = k
                if depth:
                    self._pop_to(depth, True)
        if tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        if self.in_body and tag not in P_ENDERS and tag not in HEAD_ONLY and self.left_open:
            self._reopen()
        self._push(tag, found, keep=tag not in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("path", "svg"):
            self.open.pop()
            self.n_open[tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._enter_body()
            return
        for k in range(len(self.open) - 1, 0, -1) if self.n_open[tag] else ():
            if self.open[k].tag == tag:
                self._pop_to(k, True)
                return
        if tag in FORMATTING:
            for k in range(len(self.left_open) - 1, -1, -1):
                if self.left_open[k][0] == tag:
                    del self.left_open[k]
                    return

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns, which the parser counts here, are of no use."""
        return j

    def _plain(self, text: str) -> str:
        return text if self.mark is None else text.replace(self.mark, "&")

    def handle_data(self, data: str) -> None:
        data = self._plain(data)
        if not self.in_body and len(self.open) == 1:
            if not data.strip():
                return
            self._enter_body()
        if self.left_open and self.in_body and data.strip():
            self._reopen()
        self.open[-1].children.append(data)


def _chosen(node: _Node) -> str:
    """The value or text of a select's chosen, or else first, option."""
    options, queue = [], node.elements()
    while queue:
        one = queue.pop(0)
        if one.tag == "option":
            options.append(one)
        queue = one.elements() + queue
    picked = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
    return "" if picked is None else collapse(picked.attrs.get("value", "")) or collapse(picked.all_text())


def _lay_out(root: _Node) -> tuple[list[_Node], str]:
    """The elements in document order, and the page's text with white space collapsed, of which each element's text is a slice."""
    nodes: list[_Node] = []
    parts: list[str] = []
    size, blank = 0, False
    stack: list[tuple[_Node | str, bool]] = [(root, False)]
    while stack:
        one, ends = stack.pop()
        if isinstance(one, str):
            text = _BLANK.sub(" ", one)
            text = text[1:] if blank and text.startswith(" ") else text
            parts.append(text)
            size, blank = size + len(text), text.endswith(" ") if text else blank
        elif ends:
            one.last, one.end = len(nodes) - 1, size
        else:
            one.ord, one.start = len(nodes), size
            nodes.append(one)
            stack.append((one, True))
            stack.extend((c, False) for c in reversed(one.children))
    return nodes, "".join(parts)


def element_rows(html: str, whole_references: bool = False) -> list[dict]:
    """The rows of one page, without its key."""
    html, mark = _shielded(html) if whole_references else (html, None)
    tree = _Tree(mark)
    tree.feed(html)
    tree.close()
    nodes, page_text = _lay_out(tree.html)
    ids = Counter(n.attrs["id"] for n in nodes if n.attrs and n.attrs.get("id"))
    classes = Counter(c for n in nodes if n.attrs for c in set(n.attrs.get("class", "").split()))
    rows: list[dict] = []
    body_first = tree.body.ord
    chains: list[list[dict]] = []
    for node in nodes:
        attrs, parent, tag = node.attrs, node.parent, node.tag
        children = node.elements()
        if len(children) > 1:
            of_tag: dict[str, list[_Node]] = {}
            for child in children:
                of_tag.setdefault(child.tag, []).append(child)
            for equal in of_tag.values():
                for k, child in enumerate(equal, 1):
                    child.nth, child.same = k, len(equal)
        above = rows[parent.ord] if parent else None
        own_id, class_ = attrs.get("id"), attrs.get("class")
        chain = [{"tag": tag, "id": own_id, "id_count": ids[own_id] if own_id else 0, "class": class_, "nth": node.nth, "same": node.same}]
        if parent:
            chain += chains[parent.ord][:5]
        chains.append(chain)
        hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attrs.get("style", "").lower())))
        kind = attrs.get("type", "").lower()
        shut = tag in EXCLUDED_TAGS or hidden
        below_shut = above is not None and (above["below_shut"] or above["shut"])
        start = node.start + page_text.startswith(" ", node.start, node.end)
        end = node.end - page_text.endswith(" ", start, node.end)
        whole = tag == "title" or "itemprop" in attrs
        in_body = body_first < node.ord <= tree.body.last
        control = next((d.ord for d in nodes[node.ord + 1 : node.last + 1] if d.tag in CONTROLS), None) if tag == "label" else None
        rows.append({
            "ord": node.ord, "parent": parent.ord if parent else None, "last": node.last, "tag": tag, "attrs": list(attrs.items()),
            "text": page_text[start : end if whole else min(end, start + TEXT_KEPT)], "text_len": end - start, "own_text": any(isinstance(c, str) and bool(c.strip()) for c in node.children),
            "n_desc": node.last - node.ord, "n_children": len(children),
            "below_shut": below_shut, "shut": shut, "excluded": shut or below_shut or (tag == "input" and kind in EXCLUDED_INPUTS),
            "body_ord": node.ord - body_first - 1 if in_body else None,
            "scope": None if above is None else parent.ord if "itemscope" in parent.attrs else above["scope"],
            "class_counts": [(c, classes[c]) for c in dict.fromkeys(class_.split())] if class_ else [], "chain": chain,
            "script": node.all_text() if tag == "script" and kind.strip().startswith("application/ld+json") else None,
            "label_text": collapse(node.all_text(CONTROLS)) if tag == "label" else None, "control": control,
            "chosen": _chosen(node) if tag == "select" else None,
        })
    return rows


def elements(pages: DataFrame, html_col: str = "html", key: str = "page_id", whole_references: bool = False) -> DataFrame:
    """The element rows of every page, in batches of Arrow records.

    HTML also reads references that lack their semicolon (&amp at the end of a cut title);
    with whole_references they are text.
    """
    kind = pages.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, {FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for page, html in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if html and html.strip():
                    rows += [{key: page.as_py()} | r for r in element_rows(html, whole_references)]
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return dealt(pages.select(key, F.col(html_col))).mapInArrow(run, schema)
