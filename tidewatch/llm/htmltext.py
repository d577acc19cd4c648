"""Main text of web pages: a tree-structured graphical model over the DOM, solved by sum-product message passing."""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag from its name to its end, by possessive repeats: no way is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s>/<]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: As far as the first ">", for pages whose quotes don't pair.
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s>/<]*+)([^>]*+)>")
#: One attribute after the other, so that no name is found within a value or another name.
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?|["'=/]""")
#: Numbers of character references that no character has, and that are too long to be read as numbers.
ENDLESS = re.compile(r"&#[0-9]{16,}+;?")
NAMED = frozenset(("class", "id", "role"))
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
MUTE = frozenset("script style noscript template svg iframe object head title textarea select option button canvas math".split())
#: Their content is raw text up to the end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: What an opening tag ends, and within what.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SMOOTH = 0.05


class Node:
    """A block element, or (tag "#") the text between two block boundaries."""

    __slots__ = ("children", "label", "linked", "names", "parent", "size", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), label: int | None = None):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.children: list[Node] = []
        self.text, self.linked, self.size = "", 0, 0


class Open:
    """Open block elements, with the places of each tag among them, so that no search walks through the depth of a page."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """All from a place on."""
        while len(self.stack) > place:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """The deepest place of any of the tags; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str | None, labelled: bool = False) -> list[Node]:
    """The nodes of a page, parents before children, in page order; the first is the root. Forgiving: end tags without
    a start are passed over, missing ones are supplied, a tag whose quotes don't pair ends at its first ">", and
    character references are decoded. Time and memory are linear in the page, whatever its markup and depth.
    labelled: whether data-y is a label, as in the examples."""
    page = page or ""
    root = Node("root", None)
    nodes, open_, inline, inside, pieces = [root], Open(root), [], defaultdict(int), []
    linked = at = 0
    n = len(page)
    tag_at, unclosed, last = TAG, set(), page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                leaf = Node("#", open_.stack[-1])
                leaf.text, leaf.linked = text, linked
                leaf.parent.children.append(leaf)
                nodes.append(leaf)
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(ENDLESS.sub("\ufffd", raw)) if "&" in raw else raw
            pieces.append(text)
            if inside["a"]:
                linked += len(text.strip())

    def no_inline() -> None:
        inline.clear()
        inside.clear()

    def end_of(tag: str, start: int) -> int:
        """Where the end tag of an element that is not read is over; -1 if there is none."""
        if tag in unclosed:
            return -1
        for m in re.compile(f"</{re.escape(tag)}", re.IGNORECASE | re.ASCII).finditer(page, start):
            if not page[m.end() : m.end() + 1].isalnum():
                stop = page.find(">", m.end())
                if stop >= 0:
                    return stop + 1
                break
        unclosed.add(tag)
        return -1

    while at < n:
        here = page.find("<", at)
        if here < 0 or here > last and not page.startswith("<!--", here):  # no tag ends there
            say(page[at:])
            break
        say(page[at:here])
        if page.startswith(("<!", "<?"), here):
            mark = ("-->", 3) if page.startswith("<!--", here) else (">", 1)
            stop = page.find(mark[0], here + (4 if mark[1] == 3 else 2))
            at = n if stop < 0 else stop + mark[1]
            continue
        m = tag_at.match(page, here)
        if not m and tag_at is TAG and BARE_TAG.match(page, here):
            tag_at = BARE_TAG  # from here on: else each tag might be read up to the page's end in vain
            m = tag_at.match(page, here)
        if not m:
            say("<")
            at = here + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if inside[tag]:
                    while (x := inline.pop()) != tag:
                        inside[x] -= 1
                    inside[tag] -= 1
            elif place := open_.last((tag,)):
                flush()
                no_inline()
                open_.close(place)
            continue
        if tag in MUTE and tag != "head":
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            stop = end_of(tag, at)
            at = stop if stop >= 0 else n if tag in RAW else at
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag not in VOID:
                inline.append(tag)
                inside[tag] += 1
            continue
        flush()
        if tag == "p" or tag not in VOID:
            # A block ends an open paragraph, and the inline elements in it.
            no_inline()
            if open_.stack[-1].tag == "p":
                open_.close(len(open_.stack) - 1)
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            if (place := open_.last(ends)) > open_.last(within):
                open_.close(place)
        if tag in VOID:
            continue
        names, label = [], None
        for key, value in ATTR.findall(m[3]) if m[3] else ():
            key = key.lower()
            if key in NAMED:
                names += NAME.findall(value.lower())
            elif labelled and key == "data-y":
                label = int(value.strip("\"'"))
        node = Node(tag, open_.stack[-1], tuple(names), label)
        node.parent.children.append(node)
        nodes.append(node)
        open_.push(node)
    flush()
    for x in reversed(nodes):
        if x.tag == "#":
            x.size = len(x.text)
        if x.parent:
            x.parent.size += x.size
            x.parent.linked += x.linked
    return nodes


def facts(node: Node) -> list[tuple[str, object]]:
    """What the model sees of a node by itself."""
    size, share = node.size, node.linked / max(node.size, 1)
    if node.tag != "#":
        return [("tag", node.tag), ("under", 0 if share == 0 else 1 if share < 0.6 else 2), *(("name", x) for x in dict.fromkeys(node.names))]
    return [("size", min(7, size.bit_length() if size < 256 else 8 if size < 1024 else 9)), ("links", 0 if share == 0 else 1 if share < 0.4 else 2), ("stop", node.text[-1] in ".!?:;\"'”»")]


HOLDERS = frozenset("html body main article section div center td".split())


def pair(x: Node) -> int:
    """The kind of potential between a node and its parent: whether the node may hold other blocks, and whether the
    parent is the page itself."""
    return 2 * (x.tag in HOLDERS) + (x.parent.tag in ("root", "html", "body"))


class Model:
    """log potentials: unary of facts given the label, and of a child's label given its parent's."""

    def __init__(self):
        self.seen: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.step = [[[SMOOTH, SMOOTH], [SMOOTH, SMOOTH]] for _ in range(4)]

    def learn(self, nodes: list[Node], weight: float = 1.0) -> None:
        """Count a labelled page; a node without a label has its parent's."""
        nodes[0].label = nodes[0].label or 0
        for x in nodes[1:]:
            if x.label is None:
                x.label = x.parent.label
            self.step[pair(x)][x.parent.label][x.label] += weight
            for f in facts(x):
                self.seen[f][x.label] += weight
                self.total[f[0]][x.label] += weight

    def ready(self) -> Model:
        self.unary = {}
        kinds: dict[str, int] = defaultdict(int)
        for k, _ in self.seen:
            kinds[k] += 1
        for f, (zero, one) in self.seen.items():
            t, k = self.total[f[0]], SMOOTH * (kinds[f[0]] + 1)
            if f[0] == "name":  # present or not, of all elements: most have no name at all
                t, k, one, zero = self.total["tag"], 1.0, one + SMOOTH, zero + SMOOTH
            odds = math.log((one + SMOOTH) / (t[1] + k)) - math.log((zero + SMOOTH) / (t[0] + k))
            self.unary[f] = max(-12.0, min(12.0, odds))
        self.move = [tuple(max(0.001, x / sum(row)) for row in two for x in row) for two in self.step]
        self.seen = self.total = None
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content for each node: messages up from the leaves, then down from the root."""
        at = {id(x): i for i, x in enumerate(nodes)}
        odds = [math.exp(max(-30.0, min(30.0, sum(self.unary.get(f, 0.0) for f in facts(x))))) if i else 1.0 for i, x in enumerate(nodes)]
        parent = [at[id(x.parent)] if x.parent else -1 for x in nodes]
        moves = [self.move[pair(x)] if x.parent else None for x in nodes]
        b0, b1 = [1.0] * len(nodes), odds
        up0, up1 = [1.0] * len(nodes), [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            s = b0[i] + b1[i]
            b0[i] /= s
            b1[i] /= s
            p00, p01, p10, p11 = moves[i]
            m0, m1 = p00 * b0[i] + p01 * b1[i], p10 * b0[i] + p11 * b1[i]
            up0[i], up1[i] = m0, m1
            p = parent[i]
            b0[p] *= m0
            b1[p] *= m1
            s = b0[p] + b1[p]
            b0[p] /= s
            b1[p] /= s
        b1[0] *= 0.05  # the page as such isn't content
        full = [(b0[0], b1[0])]
        out = [b1[0] / (b0[0] + b1[0])]
        for i in range(1, len(nodes)):
            p00, p01, p10, p11 = moves[i]
            a0, a1 = full[parent[i]]
            a0, a1 = a0 / max(up0[i], 1e-300), a1 / max(up1[i], 1e-300)
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            c0, c1 = b0[i] * (a0 * p00 + a1 * p10), b1[i] * (a0 * p01 + a1 * p11)
            s = c0 + c1
            full.append((c0 / s, c1 / s))
            out.append(c1 / s)
        return out


#: Words in class, id or role of what surrounds an article, and of what holds it, for the labelled examples.
AROUND = "ad ads advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar header masthead footer bottom copyright legal sidebar aside widget rail related recommended recommendations popular trending more links cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login register search form contact share sharing social comment comments commentlist respond reply replies discussion disqus responses reader feedback pagination pager tags meta complementary contentinfo".split()
WITHIN = "article post entry content story body main text hentry prose page".split()
#: Names of looks, which stand on content and surroundings alike: the model learns that they say nothing.
LOOKS = "flex grid row col container wrapper inner block item box group clearfix left right center wide narrow large small md lg sm px py mx my auto theme light dark".split()


def examples(seed: int = 11) -> Iterator[str]:
    """Labelled pages: data-y is 1 for content and 0 for the rest, and holds for what is below."""
    rng = random.Random(seed)

    def say(most: int, stop: str = ".") -> str:
        """Invented text of 1 to `most` words, more often short."""
        n = max(1, round(math.exp(rng.uniform(0, math.log(most)))))
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + stop

    def article() -> str:
        parts = [f"<h1>{say(15, '')}</h1>"]
        for _ in range(rng.randint(1, 9)):
            parts.append(f"<p>{say(250)}</p>")
        more = [f"<h2>{say(8, '')}</h2>", f"<ul><li>{say(12, '')}</li><li>{say(40)}</li></ul>", f"<blockquote><p>{say(60)}</p></blockquote>", f"<table><tr><td>{say(2, '')}</td><td>{say(5, '')}</td></tr></table>", f"<pre>{say(30, '')}</pre>", f"<figure><figcaption>{say(12)}</figcaption></figure>", f"<p><a href=x>{say(4, '')}</a> {say(20)}</p>", f"<div><p>{say(90)}</p></div>", f"<section><h3>{say(6, '')}</h3><p>{say(120)}</p></section>", f"<dl><dt>{say(3, '')}</dt><dd>{say(15)}</dd></dl>", f"<header><h2>{say(9, '')}</h2></header>", f"<ol><li>{say(20)}</li></ol>", f"<h4>{say(5, '')}</h4>"]
        return "".join(parts + rng.sample(more, 5))

    def nav() -> str:
        return "<nav><ul>" + "".join(f'<li><a href="/">{say(3, "")}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul></nav>"

    def around() -> list[str]:
        return [f"<header><div>{say(4, '')}</div>{nav()}</header>", nav(), f"<aside><h3>{say(4, '')}</h3><p>{say(80)}</p></aside>", f"<footer><p>{say(20, rng.choice(['', '.']))}</p></footer>", f"<form><p>{say(12)}</p><fieldset>{say(4, '')}</fieldset></form>", f"<dialog><p>{say(40)}</p></dialog>"]

    def named(w: str) -> str:
        """A class of that word, sometimes among looks or with a part of its own."""
        more = rng.choices(LOOKS, k=rng.randint(0, 3)) if rng.random() < 0.4 else []
        return " ".join([*more, w if rng.random() < 0.7 else f"{rng.choice(['site', 'c', 'm', 'block'])}-{w}"])

    def unnamed() -> str:
        """A class that says nothing: looks, or an invented word."""
        return " ".join(rng.choices(LOOKS, k=2)) if rng.random() < 0.5 else "".join(rng.choices("bcdfghklmnprstvz", k=6))

    def links(tag: str) -> str:
        return f'<{tag} class="{unnamed()}">' + "".join(f'<a href="/">{say(4, "")}</a> ' for _ in range(rng.randint(3, 8))) + f"</{tag}>"

    def plain_around() -> str:
        """Surroundings that only their structure tells: lists of links, and lines of a few words."""
        items = "".join(f'<li><a href="/">{say(8, "")}</a></li>' for _ in range(rng.randint(2, 8)))
        return rng.choice([links("div"), links("p"), f'<div class="{unnamed()}"><ul>{items}</ul></div>', f'<ul class="{unnamed()}">{items}</ul>', f'<div class="{unnamed()}"><h3>{say(3, "")}</h3><ul>{items}</ul></div>', f'<div class="{unnamed()}">{say(3, "")}</div>'])

    shapes = [lambda w: f'<p class="{w}">{say(25)}</p>', lambda w: f'<ol class="{w}"><li><p>{say(30)}</p></li><li><div><p>{say(20)}</p></div></li></ol>', lambda w: f'<div class="{w}"><p>{say(60)}</p></div>', lambda w: f'<section id="{w}"><h{(h := rng.randint(2, 4))}>{say(4, "")}</h{h}><p>{say(60)}</p><div><p>{say(30)}</p></div></section>', lambda w: f'<ul class="{w}"><li><a href="/">{say(4, "")}</a></li><li><p>{say(8)}</p></li></ul>', lambda w: f'<div role="{w}">{say(25, rng.choice(["", "."]))}</div>']
    plain = ["<article data-y=1>{}</article>", "<main data-y=1>{}</main>", "<main><article data-y=1>{}</article></main>"]
    holders = [*plain, *(f'<div class="{w}" data-y=1>{{}}</div>' for w in WITHIN), *(f'<div><section id="{w}" data-y=1><div>{{}}</div></section></div>' for w in WITHIN)]
    for w in AROUND:
        for shape in shapes:
            outside, some = rng.choice(around()), rng.sample(around(), 3)
            w = named(w)
            yield f"<body><div>{shape(w)}</div>{outside}{rng.choice(holders).format(article())}{''.join(some)}</body>"
            # What isn't content may also stand within the article.
            inner = re.sub(r"^<(\w+)", r"<\1 data-y=0", rng.choice([shape(w), shape(w), rng.choice(around()[1:])]))
            yield f"<body>{rng.choice(around())}{rng.choice(holders).format(article() + inner + article())}{rng.choice(around())}</body>"
    for _ in range(150):
        held = f'<div class="{unnamed()}" data-y=1>{article()}</div>' if rng.random() < 0.6 else f'<div class="{unnamed()}"><div class="{unnamed()}" data-y=1>{article()}</div></div>'
        yield f'<body><div class="{unnamed()}">{plain_around()}</div>{rng.choice(around())}{held}{plain_around()}{rng.choice(around())}</body>'
    for _ in range(40):
        yield "<body>" + "".join(f"<p data-y=1>{say(200)}</p>" for _ in range(3)) + f"<footer>{say(9)}</footer></body>"


def weakly_labelled(page: str) -> list[Node] | None:
    """The nodes of a page that names its article: within it is content but for what the examples know as surroundings."""
    nodes = parse(page)
    if sum(x.tag == "article" for x in nodes) != 1:
        return None
    known = set(AROUND)
    for x in nodes:
        x.label = 1 if x.tag == "article" else 0 if x.tag in ("nav", "aside", "footer", "form") or not known.isdisjoint(x.names) else None
    return nodes


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_rows: int = 1000, max_chars: int = 20_000) -> Model:
    """Potentials from the labelled examples and from a bounded sample of pages that name their article: at most max_rows
    pages of at most max_chars characters, those with the least hash of their id."""
    m = Model()
    for x in examples():
        m.learn(parse(x, labelled=True), 3.0)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).where(F.length("html") <= max_chars)
    total = pages.count()
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = rows.where(u < int(min(1.0, 3 * max_rows / max(total, 1)) * (1 << 30)) + 1).orderBy(u, "id", "html").limit(max_rows)
    for r in some.select("html").collect():
        if nodes := weakly_labelled(r["html"]):
            m.learn(nodes, 0.1)
    return m.ready()


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page)
    return "\n".join(x.text for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.tag == "#" and p >= 0.5)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, url, text (blocks joined by line feeds; empty if none) and n_chars.

    Defined cases: null and empty pages have empty text; text without any tag is a block like any other, judged by
    itself; broken markup is read forgivingly; repeated rows and null ids or urls give a row each; an empty table gives
    no rows. Pages are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x, model) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
