"""HTML extraction by union-free regular-expression inference.

The token streams of all pages of a host are aligned one after another, in each task and then the tasks' wrappers. Where
they agree the wrapper keeps the token; where texts differ it gets a text slot; where tags differ, neighbours of one kind become a repeated group and
what only one side has becomes optional. The result is a regular expression without alternatives over nested tags.
It says which region of a host's pages holds the varying text, and which parts of that region are the same on every
page; every page of the host is then read by it, and a part is left out only where it equals the wrapper's constant.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import SMALL_ROWS, Tables
from .line_dedup import patience

#: Hosts whose wrappers a task holds before it passes them on.
HELD_HOSTS = 500
#: Tasks' wrappers of a host are merged in this many groups first.
MERGE_GROUPS = 32
#: Elements nested deeper than this become siblings, as in browsers; their text and signatures stay.
DEEPEST = 512

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas select textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = RAW | frozenset("head nav footer aside form button input dialog".split())
#: Elements that are never left out by a name.
WHOLE = frozenset("html body main article".split())
CLOSES_P = BLOCKS - {"br", "html", "body", "caption", "dd", "dt", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Classes, ids and roles that name what is not an article.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related comment comments disqus respond reply replies widget login search toolbar pagination pager skip contentinfo complementary alert masthead topbar".split()
)
# Words that may stand beside one of those inside a name (side-menu, ad-box-2), which names the same.
BESIDE_WORDS = frozenset("site main page left right top bottom bar box list item block area section wrap wrapper container inner outer primary secondary global form links link buttons body content header thread".split())

#: An attribute: its name may hold quotes, and a quote that nothing closes is a plain character.
_PAIR = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*+))?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[\s/]+|{_PAIR})*+)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*+)))?")
_DIGITS = re.compile(r"[0-9]+")


def _names(rest: str) -> tuple[str, bool]:
    """The classes, id and role among a tag's attributes, with numbers as 0, and whether it is hidden."""
    found: dict[str, str] = {}
    for name, x, y, z in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), entities.unescape(x or y or z))
    hidden = found.get("hidden", "until-found").strip().lower() != "until-found" or "display:none" in found.get("style", "").lower().replace(" ", "")
    names = " ".join(found[k] for k in ("class", "id", "role") if k in found).lower().split()
    return _DIGITS.sub("0", " ".join(names)), hidden


def _names_aside(names: str) -> bool:
    """Whether a name is an aside word, or is made of such words and words beside them only."""
    for name in names.split():
        parts = [x for x in re.split(r"[-_0]+", name) if x]
        if name in ASIDE_WORDS or not ASIDE_WORDS.isdisjoint(parts) and ASIDE_WORDS.union(BESIDE_WORDS).issuperset(parts):
            return True
    return False


class Node:
    """An element: its signature (tag and names) and what is in it, texts and elements."""

    __slots__ = ("tag", "names", "kids", "hidden")

    def __init__(self, tag: str, names: str = "", hidden: bool = False):
        self.tag, self.names, self.kids, self.hidden = tag, names, [], hidden

    @property
    def sign(self) -> str:
        return f"{self.tag} {self.names}" if self.names else self.tag

    @property
    def aside(self) -> bool:
        return self.tag in NOT_TEXT or self.hidden or bool(self.names) and self.tag not in WHOLE and _names_aside(self.names)


def parse(source: str) -> Node:
    """The element tree of a page, however broken; raw elements keep no content. A quoted value runs to the next quote, as in browsers."""
    _deep()
    root = Node("#root")
    stack = [root]
    at, n, closed = 0, len(source), source.rfind(">")
    while at < n:
        if at > closed:  # nothing after the last tag can be one
            stack[-1].kids.append(entities.unescape(source[at:]))
            break
        m = _TOKEN.match(source, at)
        at = m.end()
        closing, tag, rest, text = m.groups()
        if text is not None:
            stack[-1].kids.append(entities.unescape(text))
        elif tag is None:
            continue
        elif closing:
            tag = tag.lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "td", "body") and tag in ("p", "b", "i", "a", "span", "em", "strong", "li"):
                    break  # a stray end tag doesn't close its surroundings
        else:
            tag = tag.lower()
            node = Node(tag, *(_names(rest) if rest.strip() else ("", False)))
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        del stack[depth:]
                        break
                    if stack[depth].tag in BLOCKS:
                        break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag or {stack[depth].tag, tag} == {"dt", "dd"}:
                        del stack[depth:]
                        break
                    if stack[depth].tag in ("ul", "ol", "dl", "table", "select", "div"):
                        break
            if len(stack) > DEEPEST:
                stack.pop()
            stack[-1].kids.append(node)
            if tag in RAW and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
            elif tag not in VOID and not rest.rstrip().endswith("/"):
                stack.append(node)
    return root


class Piece:
    """A part of a wrapper: an element, once, optional ("?") or repeated ("+"), with its own parts; text is a constant, or None for a slot."""

    __slots__ = ("sign", "many", "kids", "text")

    def __init__(self, sign: str, many: str, kids: list, text: str | None = ""):
        self.sign, self.many, self.kids, self.text = sign, many, kids, text


def wrapper_of(node: Node) -> Piece:
    """The wrapper of one page, its repeats already folded."""
    text = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
    kids: list[Piece] = []
    for k in node.kids:
        if isinstance(k, Node) and k.tag not in RAW and k.tag != "head":
            piece = wrapper_of(k)
            if kids and kids[-1].sign == piece.sign:
                kids[-1] = generalise(kids[-1], piece)
                kids[-1].many = "+"
            else:
                kids.append(piece)
    return Piece(node.sign, "", kids, text)


def generalise(a: Piece, b: Piece) -> Piece:
    """The least wrapper of this kind that both match."""
    many = "+" if "+" in a.many + b.many else "?" if "?" in a.many + b.many else ""
    return Piece(a.sign, many, _aligned(a.kids, b.kids), a.text if a.text == b.text else None)


def _aligned(a: list[Piece], b: list[Piece]) -> list[Piece]:
    """Two lists of parts aligned by a rising common sequence of signatures, those met once in both first; what one lacks is optional."""
    n, m = len(a), len(b)
    steps = patience([p.sign for p in a], [p.sign for p in b])
    out, i, j = [], 0, 0
    for x, y in [*steps, (n, m)]:
        for p in [*a[i:x], *b[j:y]]:
            out.append(Piece(p.sign, "+" if p.many == "+" else "?", p.kids, p.text))
        if x < n and y < m:
            out.append(generalise(a[x], b[y]))
        i, j = x + 1, y + 1
    merged: list[Piece] = []
    for p in out:
        if merged and merged[-1].sign == p.sign:
            merged[-1] = generalise(merged[-1], p)
            merged[-1].many = "+"
        else:
            merged.append(p)
    return merged


def show(piece: Piece) -> str:
    """The wrapper as a regular expression over tags; #TEXT is a slot."""
    inner = ("#TEXT" if piece.text is None else piece.text) + "".join(show(k) for k in piece.kids)
    said = f"<{piece.sign}>{inner}</{piece.sign.split(' ')[0]}>"
    return f"({said}){piece.many}" if piece.many else said


@lru_cache(maxsize=10_000)
def _aside(sign: str) -> bool:
    tag, _, names = sign.partition(" ")
    return Node(tag, names).aside


def _slots(piece: Piece, known: dict[int, int]) -> int:
    """Text slots of a wrapper, those of repeated groups twice; parts that are no article have none. known keeps those of its parts."""
    if id(piece) not in known:
        own = 0 if _aside(piece.sign) else int(piece.text is None) + sum([_slots(k, known) for k in piece.kids])
        known[id(piece)] = own * (2 if piece.many == "+" else 1)
    return known[id(piece)]


def _constant(piece: Piece) -> bool:
    return piece.text is not None and piece.many != "?" and all(_constant(k) for k in piece.kids)


def _says(piece: Piece) -> bool:
    return bool(piece.text) or piece.text is None or any(_says(k) for k in piece.kids)


def _may_be_fixed(sign: str) -> bool:
    return " " in sign and sign.split(" ")[0] in ("div", "section", "ul", "ol", "table")


def rule_of(piece: Piece, pages: int) -> dict:
    """How a host's pages are read: the path of signatures to the article, and the parts of it that are the same on every page, as `show` writes them."""
    path, here, slots = [], piece, {}
    named = _named(piece)
    if named:
        path, here = named
    else:
        while True:
            kids = sorted(((k, _slots(k, slots)) for k in here.kids), key=lambda x: -x[1])
            if not kids or kids[0][1] * 10 < 6 * max(1, _slots(here, slots)) or kids[0][0].many == "+" or kids[0][0].sign.split(" ")[0] in ("p", "li", "b", "a", "span"):
                break
            here = kids[0][0]
            path.append(here.sign)
    fixed = [show(k) for k in here.kids if pages >= 3 and _may_be_fixed(k.sign) and k.many == "" and _constant(k) and _says(k)] if _slots(here, slots) else []
    return {"path": path, "fixed": fixed, "shape": show(piece)}


def _named(piece: Piece) -> tuple[list, Piece] | None:
    for tag in ("article", "main"):
        found = _find(piece, tag, [])
        if found:
            return found
    return None


def _find(piece: Piece, tag: str, path: list) -> tuple[list, Piece] | None:
    for k in piece.kids:
        here = [*path, k.sign]
        if _aside(k.sign):
            continue
        if k.sign.split(" ")[0] == tag:
            return here, k
        if found := _find(k, tag, here):
            return found
    return None


def packed(piece: Piece) -> str:
    """A wrapper as JSON: its parts in order, each with the number of its own parts."""
    out, work = [], [piece]
    while work:
        p = work.pop()
        out.append([p.sign, p.many, p.text, len(p.kids)])
        work += p.kids[::-1]
    return json.dumps(out)


def unpacked(said: str) -> Piece:
    done: list[Piece] = []
    for sign, many, text, n in reversed(json.loads(said)):
        kids = [done.pop() for _ in range(n)]
        done.append(Piece(sign, many, kids, text))
    return done[0]


class Fold:
    """The wrapper of pages so far, and hashes of three unlike ones among them at most."""

    def __init__(self):
        self.whole, self.seen = None, set()

    def add(self, piece: Piece, seen) -> None:
        self.whole = piece if self.whole is None else generalise(self.whole, piece)
        if len(self.seen) < 3:
            self.seen = set(sorted({*self.seen, *seen})[:3])


def _deep() -> None:
    """Walks take a few calls a level of DEEPEST levels, which is more than Python's default allows."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))


def _fold_pages(batches):
    _deep()
    held: dict[str, Fold] = {}

    def out():
        rows = [(h, packed(f.whole), sorted(f.seen)) for h, f in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["host", "part", "seen"])

    for batch in batches:
        for host, source, key in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(host, Fold()).add(wrapper_of(parse(source)), [key])
            if len(held) >= HELD_HOSTS:
                yield out()
    if held:
        yield out()


def _merged(pdf: pd.DataFrame) -> Fold:
    _deep()
    fold = Fold()
    for part, seen in sorted(zip(pdf.part, map(list, pdf.seen))):
        fold.add(unpacked(part), seen)
    return fold


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    fold = _merged(pdf)
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "part": [packed(fold.whole)], "seen": [sorted(fold.seen)]})


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    fold = _merged(pdf)
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "rule": [json.dumps(rule_of(fold.whole, len(fold.seen)))]})


def _at(root: Node, path: list[str]) -> list[Node]:
    """All elements at a path of signatures."""
    here = [root]
    for sign in path:
        here = [k for n in here for k in n.kids if isinstance(k, Node) and k.sign == sign]
    return here


def _any(root: Node, tag: str) -> list[Node]:
    out = []
    for k in root.kids:
        if isinstance(k, Node) and not k.aside:
            out += [k] if k.tag == tag else _any(k, tag)
    return out


def read(source: str, rule: dict | None) -> str:
    """The main text of a page by its host's rule; without one, or where the page doesn't fit it, by the page's own shape."""
    root = parse(source or "")
    rule = rule or {"path": [], "fixed": []}
    regions = _at(root, rule["path"]) if rule["path"] else []
    fixed = frozenset(rule["fixed"])
    if not regions:
        regions, fixed = _any(root, "article") or _any(root, "main") or [root], frozenset()
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        said = " ".join("".join(line).split())
        if said:
            blocks.append(said)
        line.clear()

    def walk(node: Node, depth: int, inside: bool):
        flush_after = node.tag in BLOCKS
        if flush_after:
            flush()
        for k in node.kids:
            if isinstance(k, str):
                line.append(k)
            elif k.aside or (k.tag == "header" and not inside) or (inside and k.tag == "article" and _names_aside(k.names)) or (depth == 0 and fixed and _may_be_fixed(k.sign) and show(wrapper_of(k)) in fixed):
                flush()
            elif k.tag == "br":
                flush()
            else:
                walk(k, depth + 1, inside)
        if flush_after:
            flush()

    for region in regions:
        walk(region, 0, region.tag != "#root")
        flush()
    return " ".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: bool = False):
    """One row per row of pages: id, url, text, n_chars; with wrappers, also (host, rule) as JSON.

    Null html is empty and gives an empty text. Pages whose url has no host share the host ''. References are decoded;
    white space inside a block becomes one space; blocks are joined in page order by one space. Repeated rows are read
    each. Other columns are ignored; an empty table gives an empty result.

    A host's wrapper is folded from all its pages that aren't empty: in each task, then in MERGE_GROUPS groups of tasks,
    then in one, so a hot host sends a wrapper a task. Pages themselves are shuffled only where the hosts are too many to
    broadcast.
    """
    tables = Tables(pages.sparkSession, "html")
    host = F.coalesce(F.try_parse_url(pages[url_col], F.lit("HOST")), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"), host.alias("host"))
    schema = "host string, part string, seen array<long>"
    parts = rows.where(F.trim("html") != "").select("host", "html", F.xxhash64("html")).mapInArrow(_fold_pages, schema)
    parts = tables("parts", parts.withColumn("deal", F.spark_partition_id() % MERGE_GROUPS))
    parts = parts.groupBy("host", "deal").applyInPandas(_merge, schema)
    rules = tables("rules", parts.groupBy("host").applyInPandas(_learn, "host string, rule string"))
    tables.only("rules")
    small = rules.limit(SMALL_ROWS // 20 + 1).count() <= SMALL_ROWS // 20

    def run(batches):
        _deep()
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist()):
                if rule is not None and rule not in known:
                    known[rule] = json.loads(rule)
                texts.append(read(source, known.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    brief = rules.select("host", F.to_json(F.struct(F.from_json("rule", "path array<string>, fixed array<string>").alias("r")))).toDF("host", "rule")
    brief = brief.withColumn("rule", F.get_json_object("rule", "$.r"))
    joined = rows.join(F.broadcast(brief) if small else brief, "host", "left").select("id", "url", "html", "rule")
    out = joined.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
    out = out.toDF(id_col, url_col, "text", "n_chars")
    return (out, rules) if wrappers else out
